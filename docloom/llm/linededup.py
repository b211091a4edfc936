"""Cross-site line dedup by distinct-site spread, with DataFrame functions only.

A line is boilerplate where it stands on at least min_sites distinct sites. Each line hash gathers a HyperLogLog
sketch of its sites; sketches merge by aggregation, before the shuffle too, so a line that is everywhere is a few
rows. Lines whose estimate is near the threshold get an exact distinct count. Of a boilerplate line the first
occurrence in the corpus (least doc_id, then text, then place) stays, all others go: no text is lost altogether.

Defined results: lines end at line feeds and are compared without spaces and control blanks at their ends; blank
lines are never boilerplate; a null text stays null; a null source is a site; a null doc_id sorts last; rows of one
id and text are one document, so both keep its first occurrences; an empty table gives an empty result; all columns
of the input are passed through, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cols, stored

#: Spaces and the like at a line's ends.
_SPACE = " \t\n\x0b\x0c\r"
#: Estimates from so much below the threshold to so much above it are counted exactly.
NEAR = 0.25
LG_K = 12
#: Line hashes of 16 bytes, with places of about 40, that may be broadcast; more of them are joined by a shuffle.
SENT_ROWS = 100_000


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: h1, h2 (its hash), site, at (order of occurrence), pos."""
    # What is said of a whole text is taken before it is split, once for each text.
    out = docs.select("doc_id", F.xxhash64("source").alias("site"), F.xxhash64("text").alias("tie"), F.split("text", "\n").alias("all")).select("doc_id", "site", "tie", F.posexplode("all"))
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "pos")
    out = out.withColumn("line", F.btrim("col", F.lit(_SPACE))).where("line != ''")
    return out.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"), "site", at.alias("at"))


def boilerplate(docs: DataFrame, min_sites: int) -> DataFrame:
    """h1, h2, first: the lines on at least min_sites sites, and where each occurs first."""
    lines = _lines(docs)
    spread = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.where(F.col("n") >= min_sites).withColumn("sites", F.hll_sketch_estimate("sketch"))
    spread = stored(spread.where(F.col("sites") >= (1 - NEAR) * min_sites).select("h1", "h2", "first", (F.col("sites") > (1 + NEAR) * min_sites).alias("sure")), "line-spread")
    near = spread.where("not sure").select("h1", "h2")
    exact = lines.join(_sent(near), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    return spread.join(exact, ["h1", "h2"], "left").where(F.col("sure") | (F.col("exact") >= min_sites)).select("h1", "h2", "first")


def _sent(keys: DataFrame) -> DataFrame:
    """Few keys are sent out, so that lines stay where they are and a line that is everywhere meets its key everywhere."""
    return F.broadcast(keys) if keys.limit(SENT_ROWS + 1).count() <= SENT_ROWS else keys


def dedup_lines(docs: DataFrame, min_sites: int = 5, counts_as: str = "lines") -> DataFrame:
    """The columns of docs with text cut down (and n_chars to match), and n_lines, n_removed in a last struct column, counts_as, which docs may not have."""
    own = cols(docs, "doc_id", "source", "text")
    bad = stored(boilerplate(own, min_sites), "boilerplate")
    again = _lines(own).join(_sent(bad), ["h1", "h2"]).where(F.col("at") != F.col("first"))
    drops = again.groupBy(F.col("at.doc_id").alias("of"), F.col("at.tie").alias("of_tie")).agg(F.sort_array(F.collect_set("at.pos")).alias("drop"))
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("d")).withColumn("tie", F.xxhash64("d.text"))
    d = d.join(drops, F.col("d.doc_id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")), "left")
    lines = F.split("d.text", "\n")

    def kept(_: Column, i: Column) -> Column:
        return ~F.array_contains("drop", i)

    text = F.when(F.col("drop").isNull(), F.col("d.text")).otherwise(F.array_join(F.filter(lines, kept), "\n"))
    d = d.withColumn("new", text)
    new = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    counts = F.struct(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"))
    counts = F.when(F.col("d.text").isNull(), F.struct(F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).when(F.col("drop").isNull(), F.struct(F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))).otherwise(counts)
    return d.select(*[new.get(n, F.col(f"d.`{n}`")).alias(n) for n in names], counts.alias(counts_as))


def summary(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars, text_sha256 of every document after dedup."""
    d = dedup_lines(cols(docs, "doc_id", "source", "text"), min_sites)
    return d.select("doc_id", "lines.n_lines", "lines.n_removed", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


ORACLE = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from documents),
cut as (select *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as line from lines),
bad as (select line, min((doc_id, pos)) as first from cut where line <> '' group by line having count(distinct source) >= 5),
told as (select c.*, b.line is not null and (c.doc_id, c.pos) <> b.first as gone from cut c left join bad b on c.line = b.line and c.line <> '')
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
  length(coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '')) as n_chars,
  sha256(coalesce(string_agg(raw, chr(10) order by pos) filter (where not gone), '')) as text_sha256
from told group by doc_id
"""
