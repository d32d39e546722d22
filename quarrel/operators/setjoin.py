"""Pairs of texts whose sets of runs of words are alike: a complete search, its steps on packed arrays.

Texts of equal words are one class, named by a digest; its node is the digest's first 64 bits, and runs are their 64-bit hashes.

1. Runs with a hash in the lower LOWER of all are dealt to buckets by hash, packed. A set of n runs that is alike to another shares all but
   n - ceil(n * percent / 100) of its runs, so one with more runs that no other class has is settled: it has no partner. Exact, for any data.
2. The runs of the sets that are left are ordered: those of few sets by hash, then those of many (`frequent`, at most MOST_LISTED) by how many.
   Two alike sets meet among their first n - ceil(n * percent / 100) + 1 runs, whatever the order is, and no order loses a pair.
3. Sets that meet in a run of FEW sets at most are pairs, counted: beyond the first of both ends no more runs can be shared than the rest
   has, so pairs that met too seldom go. Holders of a run of more sets are chained by size, unless sizes rule all pairs across a link out.
4. Components of what is left are clusters. All pairs of a cluster are compared on full sets, in pairs of blocks of bounded size.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrel.operators import graph
from quarrel.plans import written

LOWER = 0.5
FEW = 32  # holders of a run that are paired; more are chained
MOST_LISTED = 1_000_000
BLOCK_SETS, BLOCK_RUNS = 128, 1 << 19
CHAINED = 1 << 30
_SPACES = bytes.maketrans(b"\t\r\n", b"   ")
_LOW32 = np.uint64(0xFFFFFFFF)


def words(text: str) -> list[bytes]:
    """Words parted by spaces, tabs and line ends, as UTF-8."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ") if w]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_set(ws: list[bytes], k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words."""
    n = len(ws) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    g = mixed(h[:n] + np.uint64(k))
    for j in range(1, k):
        g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(g)


def digest(ws: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(ws)).digest()


def needed(n, percent: int):  # noqa: ANN001, ANN201 - of numbers, arrays and columns
    """Of a set of n runs, how many an alike one shares at least: ceil(n * percent / 100)."""
    return (percent * n + 99) // 100


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Shuffles that nothing refers to any more give their files back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete the files of written() tables that nothing reads any more."""
    for t in tables:
        for f in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Runs of equal values in the first columns of a stream sorted by these; only the open run is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = np.nonzero((k[:, 1:] != k[:, :-1]).any(0))[0] + 1
        if held and (last != k[:, 0]).any():
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in cuts.tolist():
            yield pa.Table.from_batches([*held, b.slice(at, c - at)])
            held, at = [], c
        held.append(b.slice(at))
        last = k[:, -1]
    if held:
        yield pa.Table.from_batches(held)


def _joined(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in t.column(name).chunks for x in c])


def packed(sets: list[np.ndarray], nodes: np.ndarray, sizes: np.ndarray, buckets: int, below: float) -> pa.RecordBatch:
    """bucket, nodes, sizes, counts, grams: runs (hashes below that share of all) of each bucket, ordered by owner."""
    count = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets) if sets else np.empty(0, np.uint64), np.repeat(np.arange(len(sets), dtype=np.int32), count)
    bucket = np.minimum(flat.astype(np.float64) * (buckets / (below * 2.0**64)), buckets - 1).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    flat, owner, bucket = flat[order], owner[order], bucket[order]
    new = np.ones(len(flat), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    at = np.nonzero(new)[0]
    per = np.diff(np.append(at, len(flat))).astype(np.uint32)
    head, held = owner[at], bucket[at]
    there = np.unique(bucket)
    lo, hi = np.searchsorted(bucket, there), np.searchsorted(bucket, there, "right")
    hlo, hhi = np.searchsorted(held, there), np.searchsorted(held, there, "right")
    cut = lambda x, a, b: pa.array([x[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary())
    columns = [pa.array(there, pa.int32()), cut(nodes[head], hlo, hhi), cut(sizes[head].astype(np.uint32), hlo, hhi), cut(per, hlo, hhi), cut(flat, lo, hi)]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "nodes", "sizes", "counts", "grams"])


PACKED = "bucket int, nodes binary, sizes binary, counts binary, grams binary"


def dealt(packed: DataFrame) -> DataFrame:
    return packed.repartition(width(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


def _described(items: DataFrame, k: int) -> DataFrame:
    """A row (id, digest, node, n, low) for each of items(id, text), and rows (bucket, nodes, counts, grams) with the low 32 bits of its runs
    below LOWER; out of one pass over the texts."""
    buckets, cut = width(items.sparkSession), np.uint64(int(LOWER * 2.0**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sets, n = [], [], []
            keep = []
            for i, text in enumerate(b.column(1).to_pylist()):
                if ws := words(text):
                    keep.append(i)
                    digests.append(digest(ws))
                    s = run_set(ws, k)
                    n.append(len(s))
                    sets.append(s[: np.searchsorted(s, cut)])
            nodes = np.frombuffer(b"".join(d[:8] for d in digests), np.int64)
            rows = len(keep)
            none = lambda kind, m: pa.nulls(m, kind)
            docs = [b.column(0).take(pa.array(keep, pa.int32())), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(n, pa.int32()), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*docs, none(pa.int32(), rows), *[none(pa.binary(), rows)] * 3], names=names)
            p = packed(sets, nodes, np.array(n, np.int64), buckets, LOWER)
            grams = pa.array([(np.frombuffer(x.as_buffer(), np.uint64) & _LOW32).astype(np.uint32).tobytes() for x in p.column("grams")], pa.binary())
            m = p.num_rows
            yield pa.RecordBatch.from_arrays([none(pa.int64(), m), none(pa.binary(), m), none(pa.int64(), m), none(pa.int32(), m), none(pa.int32(), m), p.column("bucket"), p.column("nodes"), p.column("counts"), grams], names=names)

    names = ["id", "digest", "node", "n", "low", "bucket", "nodes", "counts", "grams"]
    known = items.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), F.lower("text").alias("t"))
    return known.mapInArrow(run, "id long, digest binary, node long, n int, low int, bucket int, nodes binary, counts binary, grams binary")


def _shared(packed: DataFrame) -> DataFrame:
    """node, shared: how many of its runs in a bucket of packed(bucket, nodes, counts, grams of 32 bits) another node has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            nodes, place, times = np.unique(_joined(t, "nodes", np.int64), return_inverse=True, return_counts=True)
            key = np.repeat(place.astype(np.uint64), _joined(t, "counts", np.uint32)) | (_joined(t, "grams", np.uint32).astype(np.uint64) << np.uint64(32))
            key.sort()
            gram, owner = key >> np.uint64(32), (key & _LOW32).astype(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = gram[1:] != gram[:-1]
            number = np.cumsum(new) - 1
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]  # a class of several texts, and equal low bits of one text, count once
            often = (np.bincount(number[fresh]) > 1)[number] if len(key) else np.empty(0, bool)
            found = np.bincount(owner[often], minlength=len(nodes)) // times
            some = found > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some], pa.int64()), pa.array(found[some], pa.int64())], names=["node", "shared"])

    return dealt(packed).mapInArrow(run, "node long, shared long")


def classes(items: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of items(id, text) with words, and (id, digest, node): least ids of classes that may be alike to another (step 1)."""
    spark = items.sparkSession
    table = written(_described(items, k), "runs")
    docs = table.where("bucket is null")
    known = written(docs.select("id", "digest"), "digests")
    shared = _shared(table.where("bucket is not null").select("bucket", "nodes", "counts", "grams")).groupBy("node").agg(F.sum("shared").alias("shared"))
    each = docs.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.first("node").alias("node"), F.first("n").cast("long").alias("n"), F.first("low").alias("low"))
    n = F.col("n")
    may = (F.col("low") - F.coalesce("shared", F.lit(0))) <= n - F.floor((percent * n + 99) / 100)
    left = written(each.join(shared, "node", "left").where(may).select("id", "digest", "node"), "open")
    discard(table)
    del table, docs, shared, each
    release(spark)
    return known, left


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.sha256(s.tobytes()).digest()


def sets_of(items: DataFrame, which: DataFrame, k: int, by_set: bool = False) -> DataFrame:
    """node, id, n, s (the set's hashes) for which(id, digest, node), out of the texts of these ids; digests are of texts, or of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, found = [], [], []
            for i, (text, d) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                ws = words(text)
                s = run_set(ws, k) if by_set or digest(ws) == d else None
                if s is not None and (not by_set or set_digest(s) == d):  # another row may share the id
                    keep.append(i)
                    n.append(len(s))
                    found.append(s.tobytes())
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(n, pa.int64()), pa.array(found, pa.binary())], names=["node", "id", "n", "s"])

    text = items.where("id is not null and text is not null").select(F.col("id").cast("long").alias("at"), "text")
    met = which.hint("merge").join(text, F.col("id") == F.col("at")).select("node", "id", F.lower("text").alias("t"), "digest")
    return met.mapInArrow(run, "node long, id long, n long, s binary")


def frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs of more than FEW of sets(node, n, s), sorted, and their places in the order of step 2: the MOST_LISTED most frequent ones."""
    buckets = width(sets.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(0)]
            zero = np.zeros(len(s), np.int64)
            yield packed(s, zero, zero, buckets, 1).select(["bucket", "grams"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            g, n = np.unique(_joined(t, "grams", np.uint64), return_counts=True)
            some = n > FEW
            yield pa.RecordBatch.from_arrays([pa.array(g[some].view(np.int64), pa.int64()), pa.array(n[some], pa.int64())], names=["g", "n"])

    counted = dealt(sets.select("s").mapInArrow(pack, "bucket int, grams binary")).mapInArrow(count, "g long, n long")
    rows = counted.orderBy(F.desc("n"), "g").limit(MOST_LISTED).toArrow()
    g, n = rows.column("g").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    by_hash = np.argsort(g)
    place = np.empty(len(g), np.int64)
    place[np.lexsort((g, n))] = np.arange(len(g))
    return g[by_hash], place[by_hash]


def first_runs(s: np.ndarray, many: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The first n - needed + 1 runs of a set in the order of step 2, sorted by hash."""
    p = len(s) - needed(len(s), percent) + 1
    if not len(many):
        return s[:p]
    at = np.minimum(np.searchsorted(many, s), len(many) - 1)
    common = many[at] == s
    few = s[~common]
    if len(few) >= p:
        return few[:p]
    rest = s[common][np.argsort(place[at[common]])][: p - len(few)]
    return np.sort(np.concatenate([few, rest]))


def meetings(t: pa.Table, percent: int) -> pa.RecordBatch:
    """a, b, na, nb, met: nodes of a bucket's packed runs that meet, how often, and links of chains (met is CHAINED)."""
    nodes, first, place = np.unique(_joined(t, "nodes", np.int64), return_index=True, return_inverse=True)
    size = _joined(t, "sizes", np.uint32).astype(np.int64)[first]
    owner, gram = np.repeat(place, _joined(t, "counts", np.uint32)), _joined(t, "grams", np.uint64)
    order = np.lexsort((owner, size[owner], gram))
    owner, gram = owner[order], gram[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    owner, gram = owner[fresh], gram[fresh]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    at = np.nonzero(new)[0]
    held = np.diff(np.append(at, len(gram)))
    pairs, chained = [], [np.empty((0, 2), np.int64)]
    for m in np.unique(held[held > 1]).tolist():
        members = owner[at[held == m][:, None] + np.arange(m)]  # a row a run, in order of size
        i, j = np.triu_indices(m, 1) if m <= FEW else (np.arange(m - 1), np.arange(1, m))
        (pairs if m <= FEW else chained).append(np.stack([members[:, i].ravel(), members[:, j].ravel()], 1))
    near = lambda x: x[100 * size[x[:, 0]] >= percent * size[x[:, 1]]]
    x = near(np.concatenate(pairs)) if pairs else np.empty((0, 2), np.int64)
    code, met = np.unique(x.min(1) * len(nodes) + x.max(1), return_counts=True)
    y = near(np.concatenate(chained))
    code = np.concatenate([code, np.unique(y.min(1) * len(nodes) + y.max(1))])
    met = np.concatenate([met, np.full(len(code) - len(met), CHAINED)])
    a, b = code // max(len(nodes), 1), code % max(len(nodes), 1)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (nodes[a], nodes[b], size[a], size[b], met)], names=["a", "b", "na", "nb", "met"])


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold every pair of alike sets(node, n, s)."""
    spark, buckets = sets.sparkSession, width(sets.sparkSession)
    order = spark.sparkContext.broadcast(frequent(sets))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, place = order.value
        for b in batches:
            firsts = [first_runs(np.frombuffer(x.as_buffer(), np.uint64), many, place, percent) for x in b.column(2)]
            yield packed(firsts, b.column(0).to_numpy(), b.column(1).to_numpy(), buckets, 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches):
            yield meetings(t, percent)

    met = dealt(sets.select("node", "n", "s").mapInArrow(pack, PACKED)).mapInArrow(meet, "a long, b long, na long, nb long, met long")
    each = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("met").alias("met"))
    # Behind the end that comes first no more are shared than that set has left, and its first runs before it all count.
    least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent) - 1e-6) - (F.floor((percent * F.greatest("na", "nb") + 99) / 100) - 1)
    return each.where(F.col("met") >= least).select("a", "b")


def overlaps(t: pa.Table, percent: int) -> tuple[np.ndarray, ...]:
    """Places i, j of alike sets of a unit and what they share: across its sides, or within if it has side 0 alone."""
    side = t.column("side").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("s").chunks for x in c]
    sizes, n = np.array([len(s) for s in sets], np.int64), len(sets)
    if n == 2:
        shared = np.zeros((2, 2), np.int64)
        shared[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        col = np.cumsum(new) - 1
        often = np.bincount(col) > 1
        keep = often[col]
        owner, col = owner[keep], (np.cumsum(often) - 1)[col[keep]]
        product = np.zeros((n, n), np.float64)
        for lo in range(0, int(often.sum()), 4096):
            x, y = np.searchsorted(col, (lo, lo + 4096))
            m = np.zeros((n, 4096), np.float32)
            m[owner[x:y], col[x:y] - lo] = 1
            product += m @ m.T
        shared = product.astype(np.int64)
    alike = np.triu(100 * shared >= percent * (sizes[:, None] + sizes[None] - shared), 1)
    if side.any():
        alike &= side[:, None] != side[None]
    i, j = np.nonzero(alike)
    return i, j, shared[i, j], sizes


def verified(sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """a, b (ids, a < b), shared, na, nb of all alike sets(node, id, n, s) in one component of edges(a, b), each pair once."""
    labels = written(graph.components(edges), "clusters").select(F.col("id").alias("member"), F.col("component").alias("cluster"))
    inside = written(sets.join(labels, F.col("node") == F.col("member")).select("cluster", "node", "id", "n", "s"), "members")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_RUNS)).cast("int")
    placed = inside.join(inside.groupBy("cluster").agg(parts.alias("parts")), "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("other")
    units = placed.select("cluster", "block", other, "node", "id", "s")
    units = units.select("cluster", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "id", "s")
    keys = ("cluster", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            _, once = np.unique(t.column("node").to_numpy(), return_index=True)  # rows may be repeated
            if len(once) < 2:
                continue
            t = t.take(pa.array(once)) if len(once) < t.num_rows else t
            i, j, shared, sizes = overlaps(t, percent)
            ids = t.column("id").to_numpy()
            columns = (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), shared, np.where(ids[i] < ids[j], sizes[i], sizes[j]), np.where(ids[i] < ids[j], sizes[j], sizes[i]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=["a", "b", "shared", "na", "nb"])

    placed = units.repartition(width(sets.sparkSession), *keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(compare, "a long, b long, shared long, na long, nb long").where("a < b")


def alike(items: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, digest) of items(id, text) with words, and (a, b, shared, na, nb): all pairs of least ids of classes whose sets of runs of k words
    have a Jaccard similarity of percent or more."""
    spark = items.sparkSession
    known, left = classes(items, k, percent)
    sets = written(sets_of(items, left, k), "sets")
    release(spark)
    edges = written(candidates(sets, percent), "edges")
    release(spark)
    return known, verified(sets, edges, percent)
