"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document in a fixed pseudorandom order, are one stream that is packed into
blocks of a fixed length. Each source gets a whole number of slots, enough blocks for its target; the last one is cut
to meet it. All slots are spread over the output shards by one pseudorandom permutation, so the counts of the sources
in a shard are a multinomial draw under the condition that each source ends at its target. A source's j-th slot takes
the block that its own permutation (one for each pass over the source) has at j, and blocks are joined by that index.

A permutation of [0, n) is a swap-or-not shuffle: each round pairs x with k - x mod n and swaps the two or not by a
hash of the greater. It needs no table, and any slot can be computed on any executor.

A hot source is split: documents are put in order within a few thousand parts of it, and the parts' totals, few and
small, give where each part starts.

Defined results: a null text has size 0, and a text of size 0 takes 0 words; a null source is a source, the last one;
a null doc_id is a value like others; repeated rows are documents of their own; an empty table gives an empty result;
other columns than those named are ignored. The result does not depend on how the input is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cols, stored

#: A word, as a Java expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts of a source that are put in order on their own, at least, and documents of the table for each of them.
PARTS, PART_ROWS = 1024, 20_000
ROUNDS = 24
#: Slots that one task row unfolds.
UNFOLD = 1024


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of [0, n) takes x; with back, from where."""
    n = F.greatest(n, F.lit(1))

    def one(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), n) - at, n)
        return F.when(F.xxhash64(F.greatest(at, other), r, *key).bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(ROUNDS if back else 1), F.lit(1 if back else ROUNDS)), x.cast("long"), one)


def sized(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """doc_id, source, size, tie of every document; the texts are read here and nowhere else in the plan."""
    return cols(docs, "doc_id", "source", "text").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).alias("part")
    )


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> also source_no (by code point, null last) and target.

    A target is the lesser of most times the source and its weight's share of what the sources at that limit leave:
    with the sources in order of limit to weight, those at the limit come first, so running sums find them.
    The windows hold one row for each source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int"))
    by_limit = Window.orderBy("ratio", "source_no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    out = sources.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", w)
    out = out.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    out = out.withColumn("level", left / F.sum("weight").over(rest)).withColumn("level", F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level")))
    out = out.withColumn("level", F.min("level").over(every)["level"])
    return out.select("source", "source_size", F.col("source_no").cast("int").alias("source_no"), F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 256, shard_blocks: int = 64, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """What the mix takes, as (documents, pieces).

    documents: doc_id, tie, size, source_size, target and the row's key (source_no, part, row), for every document.
    pieces: key, doc_id, tie, size and, for what is taken of a document by one slot, epoch (the pass over its source),
    shard, place (in the shard), first (word) and n (words); n is 0 for a block that no slot took."""
    rows = stored(sized(docs, max(PARTS, docs.count() // PART_ROWS)), "mix-sizes")
    totals = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = totals.withColumn("part_start", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size"))
    sources = targets(totals.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)

    geo = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    geo = geo.withColumn("passes", F.expr("if(source_size = 0, 0, words div source_size)")).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    # Where the last, shorter block stands in the last pass decides how many slots that needs.
    geo = geo.withColumn("short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("passes"), back=True)).withColumn("lacks", F.col("blocks") * block - F.col("source_size"))
    geo = geo.withColumn("last", F.expr(f"case when rest = 0 then 0 when (short_at + 1) * {block} - lacks >= rest then ceil(rest / {block}) else ceil((rest + lacks) / {block}) end").cast("long"))
    geo = geo.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("last"))
    geo = geo.withColumn("offset", F.sum("slots").over(Window.orderBy("source_no")) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    geo = stored(geo, "mix-sources")

    # Unfolded in two steps, so that no task makes all slots of a hot source.
    slots = geo.where("slots > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {UNFOLD}")))).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_no", "run")
    slots = slots.withColumn("slot", F.explode(F.sequence(F.col("run") * UNFOLD, F.least((F.col("run") + 1) * UNFOLD, F.col("slots")) - 1)))
    slots = slots.withColumn("epoch", F.expr("slot div blocks")).withColumn("at", F.expr("slot % blocks"))
    slots = slots.withColumn("index", permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("epoch")))
    slots = slots.withColumn("out", permuted(F.col("offset") + F.col("slot"), F.col("all_slots"), F.lit(seed + 1)))
    held = F.expr(f"{block} - if(index = blocks - 1, lacks, 0)")
    cut = F.expr(f"greatest(0, rest - (at * {block} - if(short_at < at, lacks, 0)))")
    slots = slots.select("source_no", "index", "epoch", F.expr(f"out div {shard_blocks}").alias("shard"), F.expr(f"out % {shard_blocks}").alias("place"), F.when(F.col("epoch") < F.col("passes"), held).otherwise(F.least(held, cut)).cast("long").alias("held"))

    order = Window.partitionBy("source", "part").orderBy("doc_id", "tie", "size")
    placed = rows.withColumn("row", F.row_number().over(order)).withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    few = parts.join(geo.select("source", "source_size", "source_no", "target"), parts["source"].eqNullSafe(geo["source"])).select(parts["source"].alias("of"), parts["part"].alias("of_part"), "part_start", "source_no", "source_size", "target")
    placed = placed.join(few, placed["source"].eqNullSafe(few["of"]) & (placed["part"] == few["of_part"])).withColumn("start", F.col("start") + F.col("part_start"))
    documents = placed.select("source_no", "part", "row", "doc_id", "tie", "size", "source_size", "target", "start")

    packed = documents.withColumn("index", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))))
    packed = packed.withColumn("from", F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("index") * block)).withColumn("to", F.least(F.lit(block).cast("long"), F.col("start") + F.col("size") - F.col("index") * block))
    # The planner takes slots for as small as the few rows they unfold from, and would broadcast them.
    pieces = packed.join(slots.hint("merge"), ["source_no", "index"], "left").withColumn("n", F.when(F.col("held").isNull(), 0).otherwise(F.greatest(F.lit(0).cast("long"), F.least("to", "held") - F.col("from"))))  # least() skips nulls
    pieces = pieces.withColumn("first", F.col("index") * block + F.col("from") - F.col("start"))
    return documents, pieces.select("source_no", "part", "row", "doc_id", "tie", "size", "source_size", "target", "epoch", "shard", "place", "first", "n")


def taken(pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    key = ["source_no", "part", "row", "doc_id", "size", "source_size", "target"]
    return pieces.groupBy(*key).agg(F.sum("n").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def texts(docs: DataFrame, pieces: DataFrame) -> DataFrame:
    """The mix as documents: the columns of docs, a row for each pass that takes words of a document, with the words
    it takes in their order (the text as it is where it takes all of it), n_chars to match. Repeated rows count as one here,
    with what is taken of any of them."""
    word = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    spans = pieces.where("n > 0").groupBy("doc_id", "tie", "size", "part", "row", "source_no", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"), F.sum("n").alias("taken"))
    spans = spans.select(F.col("doc_id").alias("of"), "tie", "size", "spans", "taken")
    names = docs.columns
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("d")).select("d", F.col("d.doc_id").alias("own"), F.xxhash64("d.text").alias("own_tie")).dropDuplicates(["own", "own_tie"])
    joined = own.join(spans, F.col("own").eqNullSafe(F.col("of")) & (F.col("own_tie") == F.col("tie")))
    part = F.col("taken") < F.col("size")
    joined = joined.withColumn("words", F.when(part, F.regexp_extract_all("d.text", F.lit(f"({word})"))))
    some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(F.col("words"), (s["first"] + 1).cast("int"), s["n"].cast("int")))), "")
    joined = joined.withColumn("new", F.when(part, some).otherwise(F.col("d.text")))
    new = {"text": F.col("new"), "n_chars": F.char_length("new").cast("long")}
    return joined.select(*[new.get(n, F.col(f"d.`{n}`")).alias(n) for n in names])
