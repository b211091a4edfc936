"""JSON backup: one object with a list of documents for each collection, or a folder for each.

Documents are written with their id and, as "<id>New", the one that they get where they are restored: ids follow from
content, which may have changed since a document was made."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Collection
from ..operators.mutate import PREFIX, content_id
from .storage import cut, shared_dir


def with_new_ids(tables: dict[str, DataFrame], collections: dict[str, Collection]) -> dict[str, DataFrame]:
    """The tables with a column "<key>New", and fields that hold another document's id rewritten to its new one, in the same collection too.

    A document that still has the content that its id was made of keeps the id, and so has one whose id was not made of content."""
    ids, out = {}, {}
    for name, df in tables.items():
        c = collections[name]
        now, key = content_id(name, [x for x in df.columns if x != c.key]), F.col(c.key)
        made = key.cast("string").startswith(PREFIX) & (now != key.cast("string"))
        ids[name] = cut(df.select(key.alias("__old"), F.when(made, now).otherwise(key.cast("string")).cast(df.schema[c.key].dataType).alias("__new")))
        # Documents whose contents have become equal keep apart.
        twice = ids[name].groupBy("__new").count().where("count > 1").select("__new", F.lit(True).alias("__twice"))
        ids[name] = ids[name].join(twice, "__new", "left").select("__old", F.when(F.col("__twice"), F.col("__old")).otherwise(F.col("__new")).alias("__new"))
    for name, df in tables.items():
        c = collections[name]
        columns = df.columns
        df = df.join(ids[name].withColumnsRenamed({"__old": c.key, "__new": f"{c.key}New"}), c.key)
        for r in c.relations.values():
            if r.own != c.key and r.own in columns and r.target in ids:
                other = ids[r.target].withColumnsRenamed({"__old": r.own, "__new": "__to"})
                df = df.join(other, r.own, "left").withColumn(r.own, F.coalesce(F.col("__to").cast(df.schema[r.own].dataType), F.col(r.own))).drop("__to")
        out[name] = df.select(c.key, f"{c.key}New", *[x for x in columns if x != c.key])
    return out


def read_backup(spark: SparkSession, path: str, schemas: dict[str, T.StructType], keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Documents of each collection from files such as {"User": [{...}, ...], ...}, under their new ids where keys names the fields that hold ids."""
    keys = keys or {}
    whole = T.StructType([T.StructField(name, T.ArrayType(_wider(s, keys.get(name)))) for name, s in schemas.items()])
    raw = spark.read.schema(whole).json(path, multiLine=True)
    return {name: _renewed(raw.select(F.explode(name).alias("d")).select("d.*"), keys.get(name)) for name in schemas}


def _wider(schema: T.StructType, key: str | None) -> T.StructType:
    return schema if key is None else T.StructType([*schema.fields, T.StructField(f"{key}New", schema[key].dataType)])


def _renewed(df: DataFrame, key: str | None) -> DataFrame:
    return df if key is None else df.withColumn(key, F.coalesce(F.col(f"{key}New"), F.col(key))).drop(f"{key}New")


def write_backup(tables: dict[str, DataFrame], path: str) -> None:
    """One file {"User": [{...}, ...], ...}: documents are put in order and made text by many tasks, and a single one writes the lines of all."""
    spark = next(iter(tables.values())).sparkSession
    parts = None
    for k, (name, df) in enumerate(tables.items()):
        doc = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
        head = spark.range(1).select(F.lit(k).alias("k"), F.lit(0).alias("part"), F.lit(None).cast("string").alias("at"), F.lit(("{" if k == 0 else ", ") + f'"{name}": [').alias("value"))
        rows = df.select(F.lit(k).alias("k"), F.lit(1).alias("part"), F.col(f"`{df.columns[0]}`").cast("string").alias("at"), doc.alias("value"))
        foot = spark.range(1).select(F.lit(k).alias("k"), F.lit(2).alias("part"), F.lit(None).cast("string").alias("at"), F.lit("]" + ("}" if k == len(tables) - 1 else "")).alias("value"))
        some = head.union(rows).union(foot)
        parts = some if parts is None else parts.union(some)
    at = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    # A comma goes before each document but the first of its list.
    first = parts.where("part = 1").groupBy("k").agg(F.min(F.struct("at", "value")).alias("first"))
    lines = parts.join(first, "k", "left").withColumn("value", F.when((F.col("part") == 1) & (F.struct("at", "value") != F.col("first")), F.concat(F.lit(","), F.col("value"))).otherwise(F.col("value")))
    lines.orderBy("k", "part", "at", "value").select("value").coalesce(1).write.text(at)
    _one_file(spark, at, path)


def _one_file(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the only part of a folder to path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    at, to = source.getFileSystem(conf), target.getFileSystem(conf)
    part = next(f.getPath() for f in at.listStatus(source) if f.getPath().getName().startswith("part-"))
    jvm.org.apache.hadoop.fs.FileUtil.copy(at, part, to, target, False, True, conf)
    at.delete(source, True)


def write_folder(tables: dict[str, DataFrame], path: str) -> None:
    """A folder for each collection with a document on each line, which any number of tasks write at once."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def read_folder(spark: SparkSession, path: str, schemas: dict[str, T.StructType], keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    keys = keys or {}
    return {name: _renewed(spark.read.schema(_wider(s, keys.get(name))).json(f"{path}/{name}"), keys.get(name)) for name, s in schemas.items()}


def backup_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """collection, doc: every document as JSON text."""
    parts = [df.select(F.lit(name).alias("collection"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("doc")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
