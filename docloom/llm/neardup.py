"""Near-duplicate documents by an LSH forest over MinHash signatures.

Every document's shingle set gives a signature of TREES x DEPTH minima. Documents with equal sets are one class from
there on. Each tree is an order of the classes by its DEPTH minima; classes that share a prefix of SHORT of them are
candidates of each other. A region is a prefix as long as it must be, SHORT at least, for its classes to fit into one
task, by number and by the shingles that they hold; what is too much at full depth is dealt into blocks by a hash.

Links are confirmed on full sets, in steps that never write all pairs of a group:
(1) each class with the neighbour in its regions that agrees in most bits, one bit of each minimum; components of these;
(2) in regions with several components, every pair across them;
(3) where regions had to be cut deeper than SHORT, what the cuts parted: the classes of such a crowded prefix are dealt
into blocks, each component that is large there into blocks of its own, and every pair of blocks is compared but two of
one component. So what is found doesn't depend on how many documents share a prefix, nor on partitions.
Pairs within a component can't change it, and a region gives at most one link for each component it joins.
Step 3 takes time in proportion to the square of the classes that share a prefix and are not linked with each other.

Defined results: a null or blank text has an empty set and links with nothing; a document with a null id links with
nothing, has a null component and is kept; documents of one id and one set are one; repeated rows each get a row;
columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, cols, slices, stored
from .components import components
from .text import shingles, word_hashes

TREES, DEPTH, SHORT = 16, 8, 4
#: What a region holds at most: so many classes, or fewer where they have many shingles; a larger class is alone.
REGION, ROOM = 1024, 1 << 20
_RNG = np.random.default_rng(7)
_A = _RNG.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
_STEP = 1 << 17


def document_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one after the other, and where they begin."""
    sh, at = shingles(*word_hashes(buf, offs), n)
    sets = [np.unique(sh[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return np.concatenate(sets) if sets else sh, np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)]).astype(np.int64)


def _sets_of(texts: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """document_sets of any number of texts, a few at a time."""
    got = [document_sets(buf, offs[lo : hi + 1], n) for c in texts.chunks for buf, offs in [bytes_of(c)] for lo, hi in slices(offs, 1 << 20)]
    return np.concatenate([x for x, _ in got]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in got]))]).astype(np.int64)


def minima(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signatures of the texts, (texts, TREES * DEPTH) uint32; of an empty set all ones."""
    out = np.full((len(at) - 1, len(_A)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at) > 0)
    x32 = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    lo = 0
    while lo < len(some):  # so many texts at a time that the work stays in the cache
        hi = max(lo + 1, int(np.searchsorted(at[some], at[some[lo]] + _STEP)))
        part = x32[at[some[lo]] : at[some[min(hi, len(some)) - 1] + 1]]
        starts = at[some[lo:hi]] - at[some[lo]]
        for j in range(len(_A)):
            out[some[lo:hi], j] = np.minimum.reduceat((part ^ _B[j]) * _A[j], starts)
        lo = hi
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), sig (16 bits of each minimum), s0 and s1 (one bit of each)."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytes_of(batch.column("text"))
            for lo, hi in slices(offs, 1 << 20):
                sets, at = document_sets(buf, offs[lo : hi + 1], n)
                low = minima(sets, at)
                bits = np.packbits((low >> 16 & 1).astype(np.uint8), axis=1, bitorder="little").view("<i8")
                sig = low.astype(">u2")  # the low half: the minima's high bits are all small
                size = np.diff(at)
                digest = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), "n_shingles": pa.array(size), "digest": pa.array(digest, pa.binary()), "sig": pa.array([x.tobytes() for x in sig], pa.binary()), "s0": pa.array(bits[:, 0]), "s1": pa.array(bits[:, 1])})

    return cols(docs, "doc_id", "text").mapInArrow(work, "doc_id bigint, n_shingles bigint, digest binary, sig binary, s0 bigint, s1 bigint")


def _floor(similarity: float, slack: float, chance: float) -> int:
    """The least number of equal positions that a pair at this similarity shows but for `slack` standard deviations."""
    k, p = TREES * DEPTH, similarity + (1 - similarity) * chance
    return math.floor(k * p - slack * math.sqrt(k * p * (1 - p)))


def _agree(s0: np.ndarray, s1: np.ndarray, i, j) -> np.ndarray:
    return TREES * DEPTH - np.bitwise_count(s0[i] ^ s0[j]).astype(np.int16) - np.bitwise_count(s1[i] ^ s1[j])


def find_regions(least: int) -> Callable:
    """Rows sorted by region, then doc -> region, doc, s0, s1, best (its most similar neighbour there), agree."""
    few = 4

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def close(region, doc, s0, s1) -> Iterator[pa.RecordBatch]:
            n = len(doc)
            begin = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            size = np.diff(np.append(begin, n))
            of = np.repeat(np.arange(len(begin)), size)
            small = (size <= few)[of]
            found: list[tuple[np.ndarray, ...]] = []  # i, j, agree
            for lag in range(1, few):
                i = np.flatnonzero(small[:-lag] & (of[:-lag] == of[lag:])) if n > lag else np.zeros(0, np.int64)
                a = _agree(s0, s1, i, i + lag)
                ok = (a >= least) & (doc[i] != doc[i + lag])
                found.append((i[ok], i[ok] + lag, a[ok]))
            for k in np.flatnonzero(size > few).tolist():
                lo, hi = int(begin[k]), int(begin[k] + size[k])
                a = TREES * DEPTH - np.bitwise_count(s0[lo:hi, None] ^ s0[None, lo:hi]).astype(np.int16) - np.bitwise_count(s1[lo:hi, None] ^ s1[None, lo:hi])
                a[doc[lo:hi, None] == doc[None, lo:hi]] = -1
                # The best of each is enough here: of equal ones the least doc, as they are sorted.
                other = a.argmax(axis=1)
                score = a[np.arange(hi - lo), other]
                own = np.flatnonzero(score >= least)
                found.append((lo + own, lo + other[own], score[own]))
            i, j, a = (np.concatenate(x) for x in zip(*found))
            if len(i):
                i, j, a = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(a, 2)
                order = np.lexsort((doc[j], -a, i))
                k = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
                yield pa.RecordBatch.from_pydict({"region": pa.array(region[i[k]]), "doc": pa.array(doc[i[k]]), "s0": pa.array(s0[i[k]].view(np.int64)), "s1": pa.array(s1[i[k]].view(np.int64)), "best": pa.array(doc[j[k]]), "agree": pa.array(a[k].astype(np.int32))})

        for batch in batches:
            if not batch.num_rows:
                continue
            region, doc, s0, s1 = (batch.column(x).to_numpy() for x in ("region", "doc", "s0", "s1"))
            held.append((region, doc, s0.view(np.uint64), s1.view(np.uint64)))
            region, doc, s0, s1 = (np.concatenate(x) for x in zip(*held))
            new = np.flatnonzero(region[1:] != region[:-1]) + 1
            end = int(new[-1]) if len(new) else 0
            if end:
                yield from close(region[:end], doc[:end], s0[:end], s1[:end])
            held = [(region[end:], doc[end:], s0[end:], s1[end:])]
        if held:
            yield from close(*held[0])

    return work


def trees(own: DataFrame) -> DataFrame:
    """rep, sig, s0, s1, size of the classes -> a row for each class and tree: tree, doc, s0, s1, load, order (its minima), prefix."""
    each = F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 1 + 2 * DEPTH * t, 2 * DEPTH).alias("order")) for t in range(TREES)])
    rows = own.select(F.col("rep").alias("doc"), "s0", "s1", (F.col("size") + ROOM // REGION).alias("load"), F.explode(each).alias("x")).select("doc", "s0", "s1", "load", "x.*")
    return rows.withColumn("prefix", _prefix(F.col("tree"), F.col("order"), SHORT))


def _prefix(tree: Column, order: Column, depth: int) -> Column:
    return F.xxhash64(tree, F.substring(order, 1, 2 * depth))


def crowded(rows: DataFrame) -> DataFrame:
    """prefix: those of SHORT minima that hold more than fits into a region."""
    return stored(rows.groupBy("prefix").agg(F.sum("load").alias("load")).where(F.col("load") > ROOM).select("prefix"), "crowded")


def regions(rows: DataFrame, over: DataFrame) -> DataFrame:
    """region, doc, s0, s1: each class in one region of each tree. over: the crowded prefixes."""
    marked = rows.join(over.withColumn("over", F.lit(True)), "prefix", "left")
    plain = marked.where("over is null").select(F.col("prefix").alias("region"), "doc", "s0", "s1")
    keys = F.array(*[_prefix(F.col("tree"), F.col("order"), d) for d in range(SHORT + 1, DEPTH + 1)])
    steps = marked.where("over").select("prefix", "doc", "s0", "s1", "load", F.posexplode(keys).alias("step", "key"))
    full = stored(steps.groupBy("key").agg(F.sum("load").alias("load")).where(F.col("load") > ROOM).select("key", F.ceil(F.col("load") / ROOM).alias("blocks")), "crowded-deeper")
    steps = steps.join(full, "key", "left")
    fits = F.min(F.when(F.col("blocks").isNull(), F.struct("step", "key")))["key"]
    last = F.max(F.when(F.col("step") == DEPTH - SHORT - 1, F.xxhash64("key", F.pmod(F.xxhash64("doc", "s0", "s1"), F.col("blocks")))))
    deep = steps.groupBy("prefix", "doc", "s0", "s1").agg(F.coalesce(fits, last).alias("region")).select("region", "doc", "s0", "s1")
    return plain.unionByName(deep)


def block_pairs(rows: DataFrame, own: DataFrame, over: DataFrame, label: DataFrame) -> DataFrame:
    """region, side, tree, doc, label, s0, s1, prefixes: the classes of crowded prefixes, once for each pair of blocks to compare.

    A component that fills more than half a region has blocks of its own, which are not compared with each other."""
    half = ROOM // 2
    prefixes = F.concat(*[F.unhex(F.lpad(F.hex(F.hash(F.lit(t), F.substring("sig", 1 + 2 * DEPTH * t, 2 * SHORT)).bitwiseAND(F.lit(0x7FFFFFFF))), 8, "0")) for t in range(TREES)])
    hot = rows.join(over, "prefix", "left_semi").join(own.select(F.col("rep").alias("doc"), "s0", "s1", prefixes.alias("prefixes")), ["doc", "s0", "s1"])
    hot = hot.join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("root", "doc")).drop("root", "order")
    hot = stored(hot, "crowded-classes")
    sums = hot.groupBy("prefix", "label").agg(F.sum("load").alias("load"))
    large = stored(sums.where(F.col("load") > half).select("prefix", "label", F.ceil(F.col("load") / half).alias("many")), "large-components")
    small = sums.where(F.col("load") <= half).groupBy("prefix").agg(F.ceil(F.sum("load") / half).alias("many")).withColumn("label", F.lit(None).cast("long"))
    every = small.select("prefix", "label", "many").union(large)
    every = every.groupBy("prefix").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0).cast("long"), F.col("many") - 1), lambda k: F.struct(F.col("label").alias("of"), F.xxhash64("prefix", "label", k).alias("name"))))).alias("blocks"), F.max(F.when(F.col("label").isNull(), F.col("many"))).alias("rest"))
    placed = hot.join(large, ["prefix", "label"], "left").join(stored(every, "blocks"), "prefix")
    placed = placed.withColumn("of", F.when(F.col("many").isNotNull(), F.col("label")))
    placed = placed.withColumn("block", F.xxhash64("prefix", "of", F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("doc", "s0", "s1"), F.col("many"))).otherwise(F.pmod(F.xxhash64("label"), F.col("rest")))))
    placed = placed.withColumn("with", F.explode(F.filter("blocks", lambda b: b["of"].isNull() | F.col("of").isNull() | (b["of"] != F.col("of")))["name"]))
    return placed.select(F.xxhash64(F.least("block", "with"), F.greatest("block", "with")).alias("region"), (F.col("block") > F.col("with")).alias("side"), "tree", "doc", "label", "s0", "s1", "prefixes")


def find_crossing(least: int) -> Callable:
    """Rows of block_pairs by region -> region, doc: classes that may have a link into another component, and not by an earlier tree."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, t in _by_region(batches):
            doc, label, side = (t.column(c).to_numpy() for c in ("doc", "label", "side"))
            s0, s1 = t.column("s0").to_numpy().view(np.uint64), t.column("s1").to_numpy().view(np.uint64)
            known = np.array([np.frombuffer(x.as_buffer(), np.uint32) for x in t.column("prefixes")])
            whole, tree = not side.any() or bool(side.all()), t.column("tree")[0].as_py()
            found = np.zeros(len(doc), bool)
            for lo in range(0, len(doc), 512):
                own = slice(lo, lo + 512)
                near = _agree(s0, s1, (own, None), (None, slice(None))) >= least
                near &= label[own, None] != label[None, :]
                if not whole:
                    near &= side[own, None] != side[None, :]
                i, j = np.nonzero(near)
                new = ~(known[lo + i, :tree] == known[j, :tree]).any(axis=1)
                found[lo + i[new]] = found[j[new]] = True
            if found.any():
                yield pa.RecordBatch.from_pydict({"region": pa.array(np.full(int(found.sum()), region)), "doc": pa.array(doc[found])})

    return work


def _by_region(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Regions of rows that come sorted by region."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        r = t.column("region").to_numpy()
        edges = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                if held and held[0].column("region")[0].as_py() != r[lo]:
                    yield held[0].column("region")[0].as_py(), pa.concat_tables(held)
                    held = []
                held.append(t.slice(lo, hi - lo))
    if held:
        yield held[0].column("region")[0].as_py(), pa.concat_tables(held)


def join_labels(n: int, percent: int) -> Callable:
    """Rows region, doc, label, text by region -> a, b: links that join its labels, at most one less than it has labels.

    Sets are compared in full. The shingles of a region are numbered; intersections are a matrix product over the common
    ones and, for a document with all others, one pass over the rest; what only one document has is in none. Documents
    of the region's commonest label are only compared with others."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _by_region(batches):
            doc, label = t.column("doc").to_numpy(), t.column("label").to_numpy().copy()
            sets, at = _sets_of(t.column("text"), n)
            size, (number, times) = np.diff(at), np.unique(sets, return_inverse=True, return_counts=True)[1:]
            if not len(number):
                continue
            row = np.repeat(np.arange(len(doc)), size)
            common = np.flatnonzero(times > max(32, len(doc) // 8))
            shared = np.zeros((len(doc), len(doc)), np.float32)
            for lo in range(0, len(common), 2048):
                place = np.full(len(times), -1)
                place[common[lo : lo + 2048]] = np.arange(len(common[lo : lo + 2048]))
                k = np.flatnonzero(place[number] >= 0)
                m = np.zeros((len(doc), len(common[lo : lo + 2048])), np.float32)
                m[row[k], place[number[k]]] = 1
                shared += m @ m.T
            # The rest by lists of the documents that have a shingle.
            times[common] = 0
            k = np.flatnonzero(times[number] > 1)
            number, at = number[k], np.concatenate([[0], np.cumsum(np.bincount(row[k], minlength=len(doc)))])
            of = row[k][np.argsort(number, kind="stable")]
            times[times == 1] = 0
            first = np.cumsum(times) - times
            names, count = np.unique(label, return_counts=True)
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(label != names[np.argmax(count)]).tolist():
                if not size[i]:
                    continue
                own = number[at[i] : at[i + 1]]
                many = times[own]
                lists = np.repeat(first[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
                same = shared[i].astype(np.int64) + np.bincount(of[lists], minlength=len(doc))
                near = np.flatnonzero((size > 0) & (100 * same >= percent * (size + size[i] - same)) & (label != label[i]))
                for k, j in zip(*np.unique(label[near], return_index=True)):
                    out.append((int(doc[i]), int(doc[near[j]])))
                    label[label == k] = label[i]
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out]), "b": pa.array([y for _, y in out])})

    return work


def confirm(n: int, percent: int) -> Callable:
    """By region, texts first (doc, text), then pairs (a, b): the pairs that full sets confirm."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, list[np.ndarray]] = {}
        region = None
        for batch in batches:
            which, a, b = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("region", "a", "b"))
            is_pair = batch.column("pair").to_numpy(zero_copy_only=False)
            buf, offs = bytes_of(batch.column("text"))
            out: list[tuple[int, int]] = []
            for k in range(len(which)):
                if which[k] != region:
                    sets, region = {}, which[k]
                if not is_pair[k]:
                    sets.setdefault(int(a[k]), []).append(document_sets(buf, offs[k : k + 2], n)[0])
                    continue
                for x in sets.get(int(a[k]), ()):
                    for y in sets.get(int(b[k]), ()):
                        if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                            same = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                            if same and 100 * same >= percent * (len(x) + len(y) - same):
                                out.append((int(a[k]), int(b[k])))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return work


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; links where 100 * intersection >= percent * union."""
    docs = cols(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sigs = stored(signatures(docs, n), "signatures")
    linked = sigs.where("doc_id is not null and digest is not null")
    classes = stored(linked.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    own = linked.join(classes, "digest").where("doc_id = rep").select("rep", "digest", "sig", "s0", "s1", F.col("n_shingles").alias("size"))
    own = stored(own.dropDuplicates(["rep", "digest"]), "class-signatures")

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = _floor(percent / 100, 4.0, 0.5)
    rows = trees(own)
    over = crowded(rows)
    deeper = not over.isEmpty()
    sort = regions(rows, over) if deeper else rows.select(F.col("prefix").alias("region"), "doc", "s0", "s1")
    sort = sort.repartition(parts, "region").sortWithinPartitions("region", "doc", "s0", "s1")
    members = stored(sort.mapInArrow(find_regions(least), "region bigint, doc bigint, s0 bigint, s1 bigint, best bigint, agree int"), "regions")

    needed = members.select(F.col("doc").alias("doc_id"))
    if deeper:
        needed = needed.union(rows.join(over, "prefix", "left_semi").select("doc"))
    texts = docs.where("doc_id is not null").join(needed.distinct(), "doc_id", "left_semi")
    texts = stored(texts.groupBy("doc_id", F.xxhash64("text").alias("tie")).agg(F.first("text").alias("text")).drop("tie"), "region-texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        needs = pairs.select("region", F.col("a").alias("doc")).union(pairs.select("region", "b")).distinct()
        rows = needs.join(texts, needs["doc"] == texts["doc_id"]).select("region", F.lit(False).alias("pair"), F.col("doc").alias("a"), F.col("doc").alias("b"), "text")
        rows = rows.union(pairs.select("region", F.lit(True), "a", "b", F.lit(None).cast("string")))
        rows = rows.repartition(parts, "region").sortWithinPartitions("region", "pair")
        return rows.mapInArrow(confirm(n, percent), "a bigint, b bigint")

    def across(labelled: DataFrame, label: DataFrame) -> DataFrame:
        """label, with the components joined that links across the regions of labelled (region, doc, label) join."""
        several = labelled.groupBy("region").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("region")
        labelled = labelled.join(several, "region", "left_semi").distinct()
        labelled = labelled.join(texts, labelled["doc"] == texts["doc_id"]).select("region", "doc", "label", "text")
        more = labelled.repartition(parts, "region").sortWithinPartitions("region", "doc").mapInArrow(join_labels(n, percent), "a bigint, b bigint")
        return components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    best = members.groupBy("doc").agg(F.max(F.struct("agree", (-F.col("best")).alias("best"), "region")).alias("x")).select("x.region", F.least("doc", -F.col("x.best")).alias("a"), F.greatest("doc", -F.col("x.best")).alias("b"))
    first = stored(best.groupBy("a", "b").agg(F.min("region").alias("region")), "pairs")
    label = components(confirmed(first))
    label = across(members.join(label, members["doc"] == label["node"], "left").select("region", "doc", F.coalesce("root", "doc").alias("label")), label)
    if deeper:
        pairs = block_pairs(rows, own, over, label).repartition(parts, "region").sortWithinPartitions("region", "side", "doc", "s0", "s1")
        found = stored(pairs.mapInArrow(find_crossing(least), "region bigint, doc bigint"), "crossing")
        label = across(found.join(label, found["doc"] == label["node"], "left").select("region", "doc", F.coalesce("root", "doc").alias("label")), label)

    root = classes.join(label, classes["rep"] == label["node"], "left").select("digest", F.coalesce("root", "rep").alias("root"))
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(root, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("root", "doc_id") == F.col("doc_id"))).alias("kept"))
