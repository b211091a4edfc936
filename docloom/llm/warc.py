"""WARC archives: writing pages as records and reading records back, with DataFrame functions only.

Reading is splittable. The archive is cut at every occurrence of the magic line, in headers and in payloads alike,
and each piece gives a candidate: a record that would start there, and, by the length that its header states, where
its successor would start. Candidates are places in their file; a file's offsets are running sums of piece lengths,
first within a split and then over the few splits. The true records are those that can be reached from the start of
the file. Pointer jumping finds them: a first round within each split, then doubled jumps, so that the number of
rounds is the logarithm of the longest chain. A magic line inside a payload is never reached.
Only records whose payload holds the magic are put together from several pieces.

Defined results: see archive() and digests(). Broken archives: a chain ends at the first record without a readable
header or whose stated length runs over the end of the file; what cannot be reached is not returned."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cols, shared_dir, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of about 200 bytes that may be broadcast; more of them are joined by a shuffle.
SENT_ROWS = 100_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: its 40 digits are four groups of 40 bits, each of them 8 letters."""
    groups = [F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(g, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for g in groups for i in range(8)])


def _line(text: Column) -> Column:
    """A header value may not hold line ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "%0D"), "\n", "%0A")


def archive(pages: DataFrame, path: str, least: int = 0, date: str | None = None) -> None:
    """Writes a record for each row of pages (page_id, url, html) below path, as uncompressed WARC files.

    Of records with equal payloads of at least `least` bytes, that with the smallest page_id (then url) is a response
    and the others are revisits of it without a payload; rows equal in all that are all responses. A null html is an
    empty payload; a null page_id sorts last and is written as an empty id. date is the time of capture, by default now,
    as in 2020-01-02T03:04:05Z. A record's id is of its page_id, url and payload, so only rows equal in all three share one."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    p = cols(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    key = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    small = p.select(key.alias("key"), "page_id", "url", "bytes", "digest").where(F.col("bytes") >= least)
    first = small.groupBy("digest", "bytes").agg(F.min("key").alias("first"), F.max("key").alias("last")).where(F.col("first") != F.col("last")).select("digest", "bytes", "first")
    # Only payloads that occur twice are looked up; where these are few they are sent out, so that pages stay where they are.
    first = stored(first, "warc-first")
    p = p.join(F.broadcast(first) if first.count() <= SENT_ROWS else first, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & (key != F.col("first")) & (F.col("bytes") >= least)
    crlf = "\r\n"
    uid = lambda c, url: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(":"), F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.col("digest"))), F.lit(">"))
    head = F.concat(F.lit(MAGIC), F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit(f"{crlf}WARC-Record-ID: "), uid(F.col("page_id"), F.col("url")), F.lit(f"{crlf}WARC-Date: {date}{crlf}WARC-Target-URI: "), _line(F.col("url")), F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), base32(F.col("digest")))
    head = F.concat(head, F.when(again, F.concat(F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: "), uid(F.col("first.page_id"), F.col("first.url")), F.lit(f"{crlf}WARC-Payload-Length: "), F.col("bytes").cast("string"))).otherwise(""))
    body = F.when(again, "").otherwise(F.col("html"))
    record = F.concat(head, F.lit(f"{crlf}Content-Type: text/html{crlf}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)
    p.select(record.alias("value")).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at the magic: file, split, seq (order within the split), value (what follows a magic)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), "value")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def records(spark: SparkSession, path: str, of_payload: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Every record that the chains reach: file, offset, type, record_id, uri, refers_to, digest, stated_bytes, and payload (binary)
    or, if of_payload is given, those columns instead. They should be small: they are made where the archive is read, and no payload is shuffled
    but of records that hold the magic."""
    cut = _pieces(spark, path).withColumn("bytes", F.octet_length("value").cast("long"))
    at = F.instr("value", END)
    cut = cut.withColumn("head", F.when(at > 0, F.substring("value", F.lit(1), at - 1))).withColumn("head_bytes", F.octet_length("head") + len(END))
    cut = cut.withColumn("content", _field("Content-Length").try_cast("long"))
    fields = {"type": _field("WARC-Type"), "record_id": _field("WARC-Record-ID"), "uri": _field("WARC-Target-URI"), "refers_to": _field("WARC-Refers-To"), "digest": _field("WARC-Payload-Digest"), "stated_bytes": _field("WARC-Payload-Length").try_cast("long")}
    made = of_payload or {"payload": lambda x: x}

    def told(value: str, *more: str) -> list[Column]:
        body = F.expr(f"substring({value}, head_bytes + 1, int(content))")
        return [*map(F.col, more), *[v.alias(k) for k, v in fields.items()], *[f(body).alias(k) for k, f in made.items()]]

    magic = len(MAGIC)
    # How many bytes from its magic a candidate's successor would start; null if there is no readable header.
    span = magic + F.col("head_bytes") + F.col("content") + len(END)
    # A piece that holds its whole payload is read to the end here; the columns of others are not used.
    data = cut.select(*told("cast(value as binary)", "file", "split", "seq", "bytes"), span.alias("span"))
    places = stored(data if of_payload else data.select("file", "split", "seq", "bytes", "span"), "warc-places")
    data = places if of_payload else data

    # Offsets: a piece follows the pieces before it in its split, and the splits before that.
    within = Window.partitionBy("file", "split").orderBy("seq")
    sizes = places.groupBy("file", "split").agg(F.sum(F.col("bytes") + magic).alias("all"))
    sizes = sizes.withColumn("base", F.sum("all").over(Window.partitionBy("file").orderBy("split")) - F.col("all")).select("file", "split", "base", F.sum("all").over(Window.partitionBy("file")).alias("total"))
    offset = F.sum(F.col("bytes") + magic).over(within) - F.col("bytes") - 2 * magic  # of the magic before the piece
    placed = places.withColumn("rel", offset).join(sizes, ["file", "split"])
    placed = placed.select("file", "split", "seq", "bytes", (F.col("rel") + F.col("base")).alias("offset"), "span", (F.col("total") - magic).alias("total"))
    links = stored(placed.where("offset >= 0").select("file", "split", "seq", "offset", "bytes", F.when(F.col("span").isNotNull() & (F.col("offset") + F.col("span") <= F.col("total")), F.col("offset") + F.col("span")).alias("next"), "total"), "warc-links")

    # Where candidates follow one another in a split they stand or fall together, as one run, and the jumps of the
    # first round are made at once. Runs are cut wherever another jump lands.
    run = Window.partitionBy("file", "split").orderBy("offset")
    lands = links.withColumn("then", F.lead("offset").over(run)).where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("then"))).select("file", F.col("next").alias("offset"), F.lit(True).alias("lands")).distinct()
    runs = links.join(lands, ["file", "offset"], "left").withColumn("starts", F.coalesce("lands", F.lit(False)) | ~F.lag("next").over(run).eqNullSafe(F.col("offset")))
    runs = runs.withColumn("run", F.last(F.when(F.col("starts"), F.col("offset")), True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    runs = stored(runs.drop("starts", "lands"), "warc-runs")
    jump = stored(runs.groupBy("file", "run").agg(F.max_by("next", "offset").alias("next")), "warc-jumps")

    reached = jump.where("run = 0").select("file", "run")
    jump = jump.where("next is not null")
    while True:
        more = reached.join(jump, ["file", "run"]).select("file", F.col("next").alias("run"))
        grown = stored(reached.union(more).distinct(), "warc-reached")
        far = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.next") == F.col("b.run"))).select("a.file", "a.run", "b.next")
        far = stored(far, "warc-jumps")
        reached = grown
        if far.isEmpty():
            break
        jump = far
    true = runs.join(reached, ["file", "run"], "left_semi").where("next is not null").select("file", "split", "seq", "offset", "next", "bytes")
    true = stored(true, "warc-true")

    keep = ["file", "offset", *fields, *made]
    whole = true.where(F.col("next") <= F.col("offset") + F.col("bytes") + magic).select("file", "split", "seq", "offset")
    one = data.join(whole, ["file", "split", "seq"]).select(*keep)

    # The rest hold the magic: their later pieces are those that start before the next record.
    long = stored(true.where(F.col("next") > F.col("offset") + F.col("bytes") + magic).select("file", "offset", "next"), "warc-long")
    if long.isEmpty():
        return one
    parts = links.select("file", "split", "seq", F.col("offset").alias("part")).join(long, "file").where("part >= offset and part < next")
    parts = cut.join(parts, ["file", "split", "seq"]).groupBy("file", "offset").agg(F.sort_array(F.collect_list(F.struct("part", F.col("value").cast("binary").alias("value")))).alias("parts"), F.max(F.when(F.col("part") == F.col("offset"), F.struct("head", "head_bytes", "content"))).alias("h"))
    several = parts.select("file", "offset", "h.head", "h.head_bytes", "h.content", F.expr(f"unhex(array_join(transform(parts, x -> hex(x.value)), hex('{MAGIC}')))").alias("value")).select(*told("value", "file", "offset"))
    return one.unionByName(several.select(*keep))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; lengths and digests of the full payload.

    A response's are taken of the payload that was read; a revisit's are those of the record that it refers to."""
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(.*):[0-9a-f]{40}>$", 1), F.lit("")).try_cast("long")
    r = records(spark, path, {"read_bytes": F.octet_length, "sha1": F.sha1})
    response = F.col("type") == "response"
    r = r.select(page("record_id").alias("page_id"), "type", page("refers_to").alias("refers_to"), F.when(response, F.col("read_bytes")).otherwise(F.col("stated_bytes")).cast("long").alias("payload_bytes"), F.when(response, base32(F.col("sha1"))).otherwise(F.regexp_extract("digest", "^sha1:(.*)$", 1)).alias("payload_digest"))
    return r.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to an archive in the shared folder and reads that back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    archive(pages, path, least)
    return digests(spark, path)
