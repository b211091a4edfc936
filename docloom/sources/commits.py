"""The commit log: an append-only table of deltas that form a graph.

cid, docID, collection, fieldName (null for a collection's own commits, "_C" for a document's), height, delta (JSON
text), status, schemaVersionId, heads (cids of parents), links (name, cid of field commits), signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import cut

SCHEMA = "cid string, docID string, collection string, fieldName string, height long, delta string, status string, schemaVersionId string, heads array<string>, links array<struct<name: string, cid: string>>, signature struct<type: string, identity: string, value: string>"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def latest(commits: DataFrame) -> DataFrame:
    """Heads: commits that are no other's parent."""
    parents = commits.select(F.explode("heads").alias("cid")).distinct()
    return commits.join(parents, "cid", "left_anti")


def query(commits: DataFrame, doc_id: str | None = None, field_name: str | None = None, cid: str | None = None, depth: int | None = None) -> DataFrame:
    """Commits of a document and field. With cid those from that one back, else from all heads back; depth counts from there."""
    if doc_id is not None:
        commits = commits.where(F.col("docID") == doc_id)
    if field_name is not None:
        commits = commits.where(F.col("fieldName") == field_name)
    if cid is None and depth is None:
        return commits
    start = commits.where(F.col("cid") == cid) if cid is not None else latest(commits)
    if cid is not None:
        depth = depth or 1
    return _back(commits, start, depth)


def ancestors(commits: DataFrame, cid: str) -> DataFrame:
    """The commit and all before it. A document's commits lead to none of another, so only its own are walked."""
    start = commits.where(F.col("cid") == cid)
    of = start.select("docID").first()
    if of is not None and of[0] is not None:
        commits = cut(commits.where(F.col("docID") == of[0]))
        start = commits.where(F.col("cid") == cid)
    return _back(commits, start, None, follow_links=True)


def deltas(changed: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """docID, fieldName, delta: a row for each document and field of values, the value as JSON text."""
    texts = [F.struct(F.lit(n).alias("fieldName"), F.regexp_extract(F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1).alias("delta")) for n, v in values.items()]
    return changed.select(F.col(key).alias("docID"), F.explode(F.array(*texts)).alias("x")).select("docID", "x.*")


def made(log: DataFrame | None, changes: DataFrame, docs: DataFrame, collection: str, status: str, version: str) -> DataFrame:
    """Commits of one mutation: one for each change (docID, fieldName, delta), and for each of docs (docID) one of the document that links to these.

    Parents are the heads of the same document and field; the height is one more than theirs. A cid is a hash of all that a commit says."""
    no_heads = F.array().cast("array<string>")
    no_links = F.array().cast("array<struct<name:string,cid:string>>")

    def after(rows: DataFrame) -> DataFrame:
        if log is None:
            return rows.withColumn("heads", no_heads).withColumn("height", F.lit(1).cast("long"))
        # Only the history of documents that change is looked at.
        mine = log.where(F.col("collection") == collection).join(docs, "docID", "left_semi").select("docID", "fieldName", "cid", "height", "heads")
        heads = latest(mine).groupBy("docID", "fieldName").agg(F.sort_array(F.collect_set("cid")).alias("heads"), F.max("height").alias("height"))
        rows = rows.join(heads, ["docID", "fieldName"], "left")
        return rows.withColumn("heads", F.coalesce("heads", no_heads)).withColumn("height", F.coalesce("height", F.lit(0)) + 1)

    def named(rows: DataFrame) -> DataFrame:
        said = F.to_json(F.struct(F.lit(collection).alias("c"), "docID", "fieldName", "height", "delta", "status", F.lit(version).alias("v"), "heads", "links"), {"ignoreNullFields": "false"})
        signature = F.lit(None).cast("struct<type:string,identity:string,value:string>")
        return rows.select(F.concat(F.lit("c"), F.sha2(said, 256)).alias("cid"), "docID", F.lit(collection).alias("collection"), "fieldName", "height", "delta", "status", F.lit(version).alias("schemaVersionId"), "heads", "links", signature.alias("signature"))

    fields = named(after(changes).withColumn("status", F.lit("active")).withColumn("links", no_links))
    links = fields.groupBy("docID").agg(F.sort_array(F.collect_list(F.struct(F.col("fieldName").alias("name"), "cid"))).alias("links"))
    whole = docs.join(links, "docID", "left").select("docID", F.lit("_C").alias("fieldName"), F.lit(None).cast("string").alias("delta"), F.lit(status).alias("status"), F.coalesce("links", no_links).alias("links"))
    return fields.unionByName(named(after(whole)))


def _back(commits: DataFrame, start: DataFrame, depth: int | None, follow_links: bool = False) -> DataFrame:
    """Commits reached from start over parents (and links). With a depth, so many steps; without, jumps are doubled until
    they lead nowhere new, so a history of n commits takes log2(n) joins."""
    links = F.transform("links", lambda x: x["cid"]) if follow_links else F.array().cast("array<string>")
    parents = F.concat(F.coalesce("heads", F.array().cast("array<string>")), F.coalesce(links, F.array().cast("array<string>")))
    jump = commits.select("cid", F.explode(parents).alias("to")).distinct()
    reached = start.select("cid").distinct()
    for _ in range(depth - 1 if depth is not None else 0):
        reached = reached.union(reached.join(jump, "cid").select(F.col("to").alias("cid"))).distinct()
    while depth is None:
        reached = cut(reached.union(reached.join(jump, "cid").select(F.col("to").alias("cid"))).distinct())
        far = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.cid")).select("a.cid", "b.to").distinct()
        jump = cut(far)
        if jump.isEmpty():
            break
    return commits.join(reached, "cid", "left_semi")
