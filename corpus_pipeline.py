"""A corpus pipeline: quality, line dedup, near-duplicate documents, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame that is
written as Parquet and read back as the next stage's docs. All but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, linededup, mixing, neardup, quality
from docloom.llm.common import drop_written, stored, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A null or empty text is scored as a text without words; rows that repeat a text have its score, whatever their ids,
    null ones too; other columns pass through, whatever their names; an empty table stays empty."""
    scored = quality.score(docs, table(spark, sf_dir, "labels"), keep=True)
    return scored.where("predicted = 1").select("d.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, and documents that had nothing else; blank and null texts stay as they are.

    Nulls, ties and repeated rows are as linededup says; other columns pass through, whatever their names."""
    counts = "lines"
    while counts.lower() in (n.lower() for n in docs.columns):
        counts += "_"
    d = linededup.dedup_lines(docs, counts_as=counts)
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"[\x09-\x0D]", " ")) == "", F.lit(True))
    return d.where(~(blank & (F.col(f"{counts}.n_removed") > 0))).drop(counts)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8) the document with the least id stays.

    Rows that are equal in id and text are one document, of which one row stays. Rows that share an id but not the text
    are documents of their own, and so are rows without an id; where one of these is in a group with others, documents whose id
    is theirs alone come first, then those of the least hash of id and text. Documents without words all stay."""
    again = stored(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("again")), "repeated-ids")
    if again.isEmpty():
        gone = neardup.near_duplicates(docs, n=5, percent=80).where("not kept").select("doc_id").distinct()
        return docs.join(gone, "doc_id", "left_anti")
    # Their numbers lie above all ids of documents that are alone, so that these come first.
    most = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0] or 0
    room = (1 << 63) - 1 - max(0, most)
    d = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("d"))
    d = d.join(again.withColumn("many", F.lit(True)), F.col("d.doc_id").eqNullSafe(F.col("again")), "left")
    number = F.lit(max(0, most) + 1) + F.pmod(F.xxhash64("d.doc_id", "d.text"), F.lit(room))
    d = d.select("d", F.when(F.col("many"), number).otherwise(F.col("d.doc_id").cast("long")).alias("key"), "many")
    found = neardup.near_duplicates(d.select(F.col("key").alias("doc_id"), F.col("d.text").alias("text")), n=5, percent=80)
    kept = d.join(found.where("not kept").select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti")
    alone = kept.where("many is null").select("d.*")
    return alone.unionByName(kept.where("many").dropDuplicates(["key"]).select("d.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each pass over a source that takes words of a document, with these words as its text.

    Texts without words take no part, nulls among them; null sources are one source, the last; rows that are equal in id and
    text give the words that any of them takes, once for each pass; other columns pass through, whatever their names."""
    _, pieces = mixing.mix(docs)
    return mixing.texts(docs, pieces)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the check that they decode to it; null texts have none, repeated rows repeat, other columns go."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_duplicates", neardup_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: Neither a trained network nor a MinHash forest can be put in SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read back by the next, and its own tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        first = written()
        out = stage(spark, docs, sf_dir)
        last = written()
        docs = stored(out, f"stage-{name}")
        drop_written(spark, first, last)
    return STAGES[-1][1](spark, docs, sf_dir)
