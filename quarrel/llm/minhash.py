"""MinHash near-duplicates by tensored banding, every link confirmed on full shingle sets.

1. Each whole text becomes its set of five-word shingles (hashes), and the set two collections of ROWS-wise min-hashes: LEFT and RIGHT
   bands, computed once. Equal sets are one class, a node with a number of its own.
2. Table keys are all pairs (left band i, right band j): LEFT x RIGHT tables for LEFT + RIGHT bands of min-hashes, so about the square
   root of the hashes of plain banding. A pair of similarity 0.85 shares a key with probability 0.99985, one of 0.9 with 0.999996. A lower
   percentage has more bands (side()), so that a pair just at it is missed no more often: 14 x 14 tables at 0.8, probability 0.99991.
   A key can only be shared where both its bands are, so pairs are formed of bands that another node has as well, and of no others.
3. Members of a key are joined to its least member; the components of those star edges are candidate clusters.
4. Clusters are compared on full sets with dense products, all pairs inside a block of bounded size. A cluster beyond a block is dealt into
   blocks by hash, each with the cluster's HUBS, nodes that share the most keys: a group of copies of one text is linked by these alone. Only
   nodes that are then outside their cluster's largest part are compared with all its others, in pairs of blocks of neighbouring bands of
   set size. A unit passes on a spanning forest of its links, so no table grows with the square of a group.
5. Components of the confirmed links give the result.

Null and empty texts and texts without words have empty sets and link with nothing; texts of fewer than five words have one shingle. Rows
without doc_id are not compared: component null, kept true. Rows that share a doc_id and have words are one node: what links with any of
their texts is of their component. Repeated rows are of one class. Extra columns are ignored by groups() and kept by deduplicated(). An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.llm.common import Union, components, discard, gram_hashes, lower_words, release, runs, shuffle_width, tie, word_hashes, written

SHINGLE = 5
PERCENT = 85
ROWS, LEFT, RIGHT = 3, 10, 10
FIRST_DOCS, BLOCK_DOCS = 64, 128  # documents of a block, of the first comparison and of the second
BLOCK_SHINGLES = 1 << 19
HUBS = 4


def side(percent: int) -> int:
    """Bands of a side, so that a pair of just this similarity is missed no more often than one of PERCENT by LEFT bands."""
    miss = lambda p: math.log1p(-((p / 100) ** ROWS))
    return max(LEFT, math.ceil(LEFT * miss(PERCENT) / miss(percent) - 1e-9))


@cache
def _draws(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of the min-hashes of n bands."""
    rng = np.random.default_rng(9)
    mul = rng.integers(0, 1 << 63, n * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mul, rng.integers(0, 1 << 63, n * ROWS, dtype=np.uint64)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashed shingles."""
    h = word_hashes(lower_words(text))
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def bands(s: np.ndarray, n: int = LEFT + RIGHT) -> np.ndarray:
    """n band hashes of a set that is not empty."""
    mul, add = _draws(n)
    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[None, at : at + 2048] * mul[:, None] + add[:, None]).min(1))
    low = low.reshape(-1, ROWS)
    out = low[:, 0].copy()
    for k in range(1, ROWS):
        out = out * np.uint64(0x9E3779B97F4A7C15) + low[:, k]
        out ^= out >> np.uint64(29)
    return out


def _set_id(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _digests(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's identity) and both collections of bands, a row for each row."""
    half = side(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, s1, s2, left, right = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                ids = _set_id(s)
                s1.append(ids[0])
                s2.append(ids[1])
                v = bands(s, 2 * half).view(np.int64) if len(s) else np.empty(0, np.int64)
                left.append(v[:half])
                right.append(v[half:])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(left, longs), pa.array(right, longs)], names=["doc_id", "n", "s1", "s2", "l", "r"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, l array<long>, r array<long>")


def _candidates(classes: DataFrame, half: int) -> DataFrame:
    """a, b, held: for each table key of two nodes or more its members a, its least member b and their number."""
    spread = classes.select("node", F.posexplode(F.concat("l", "r")).alias("i", "x")).select("node", "i", F.xxhash64("i", "x").alias("band"))
    shared = written(spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band"), "shared-bands")
    per = spread.join(shared, "band").groupBy("node").agg(F.collect_list(F.struct("i", "band")).alias("bands"))  # LEFT + RIGHT at most
    of = lambda left: F.transform(F.filter("bands", lambda x: (x["i"] < half) == F.lit(left)), lambda x: x["band"])
    keys = per.select("node", of(True).alias("ls"), of(False).alias("rs")).select("node", "rs", F.explode("ls").alias("x")).select("node", "x", F.explode("rs").alias("y"))
    keys = written(keys.select("node", F.xxhash64("x", "y").alias("key")), "keys")
    least = keys.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("held")).where("held > 1")
    least = written(least.withColumnRenamed("key", "k"), "least")
    out = written(keys.join(least, F.col("key") == F.col("k")).groupBy(F.col("node").alias("a"), "b").agg(F.sum("held").alias("held")), "candidates")
    discard(shared, keys, least)
    return out


def _compare(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A forest of the links inside a unit: between its sides 0 and 1, or within a unit that has side 0 alone."""
    ids, side = group.column("id").to_numpy(), group.column("side").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("s")]
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        inter = np.zeros((2, 2), np.int64)
        inter[0, 1] = inter[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate(([True], flat[1:] != flat[:-1]))
        col = np.cumsum(new) - 1
        often = np.bincount(col) > 1
        keep = often[col]
        owner, col = owner[keep], (np.cumsum(often) - 1)[col[keep]]
        inter = np.zeros((n, n), np.float64)
        for at in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(col, (at, at + 4096))
            m = np.zeros((n, 4096), np.float32)
            m[owner[lo:hi], col[lo:hi] - at] = 1
            inter += m @ m.T
        inter = inter.astype(np.int64)
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None] - inter)
    if side.any():
        linked &= side[:, None] != side[None]
    forest, out = Union(n), []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        if forest.join(int(i), int(j)):
            out.append((int(ids[i]), int(ids[j])))
    return out


def _verified(units: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning set of the links inside each of units(unit, side, node, s)."""
    dealt = units.select("unit", "side", F.col("node").alias("id"), "s").repartition(shuffle_width(units.sparkSession), "unit").sortWithinPartitions("unit")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in runs(batches):
            if group.num_rows > 1:
                out += _compare(group, percent)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return dealt.mapInArrow(verify, "a long, b long")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, cluster, n, s (the set's hashes) for members(node, cluster, id, n, s1), taken from a text of doc_id id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, found = [], []
            for i, (text, s1) in enumerate(zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)):
                s = shingles(text)
                if _set_id(s)[0] == s1:  # another row may share the doc_id
                    keep.append(i)
                    found.append(s.tobytes())
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), pa.array(found, pa.binary())], names=["node", "cluster", "n", "s"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A merge join at every size: by shuffles that can be split, and without a jump where one side no longer fits a broadcast.
    met = members.hint("merge").join(text, F.col("id") == F.col("doc_id")).select("node", "cluster", "n", "s1", "text")
    return met.mapInArrow(run, "node long, cluster long, n long, s binary").dropDuplicates(["node"])


def _within_blocks(sets: DataFrame, weights: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) found inside blocks, and (cluster) of more than one block."""
    size = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
    parts = F.greatest(F.ceil(F.col("docs") / FIRST_DOCS), F.ceil(F.col("grams") / BLOCK_SHINGLES)).cast("int")
    size = written(size.select("cluster", parts.alias("parts")), "cluster-parts")
    large = size.where("parts > 1")
    # The most central node of each of HUBS classes by hash: partial aggregates, so no task sees a cluster's nodes.
    share = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(HUBS)).alias("class")
    central = F.max(F.struct("held", (-F.col("node")).alias("minus")))["minus"]
    hubs = sets.select("node", "cluster").join(large, "cluster").join(weights, "node").groupBy("cluster", share).agg((-central).alias("hub"))
    hubs = written(hubs.select("hub"), "hubs")
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    placed = sets.join(size, "cluster").join(hubs, F.col("node") == F.col("hub"), "left").withColumn("block", block)
    every = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("block"))
    units = placed.select("node", "s", "cluster", F.explode(every).alias("at")).select(F.xxhash64("cluster", "at").alias("unit"), F.lit(0).alias("side"), "node", "s")
    return written(_verified(units, percent), "block-links"), large.select("cluster")


def _between_blocks(sets: DataFrame, large: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between the nodes of large clusters that found(a, b) leaves outside their cluster's largest part and all its others."""
    inside = written(sets.select("node", "cluster", "n").join(large, "cluster").join(components(found).withColumnsRenamed({"id": "i", "component": "part"}), F.col("node") == F.col("i"), "left").select("node", "cluster", "n", F.coalesce("part", "node").alias("part")), "parts")
    most = inside.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "part"))["part"].alias("largest"), F.count(F.lit(1)).alias("of"))
    # A band's sizes differ by less than 100 / percent, so linked sets are of one band or of neighbours.
    band = F.floor(F.log("n") / float(-np.log(percent / 100))).cast("int")
    marked = inside.join(written(most.where("of > 1"), "largest"), "cluster").select("node", "cluster", "n", band.alias("band"), (F.col("part") != F.col("largest")).alias("open"))
    marked = written(marked, "marked")
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    pieces = written(marked.groupBy("cluster", "band", "open").agg(count.alias("parts")), "pieces")  # two a band of a cluster at most
    other = pieces.select(F.col("cluster").alias("c2"), F.col("band").alias("band2"), F.col("open").alias("open2"), F.col("parts").alias("parts2"))
    near = (F.col("cluster") == F.col("c2")) & (F.abs(F.col("band") - F.col("band2")) <= 1) & (F.col("open") | F.col("open2"))
    partners = pieces.join(other, near).groupBy("cluster", "band", "open").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("band2", "open2", "parts2")).alias("others"))
    salt = F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")
    placed = marked.join(written(partners, "partners"), ["cluster", "band", "open"]).withColumn("salt", salt)
    placed = placed.select("node", "cluster", F.struct("band", "open").alias("own"), "salt", F.explode("others").alias("o"))
    placed = placed.select("node", "cluster", "own", "salt", F.struct(F.col("o.band2").alias("band"), F.col("o.open2").alias("open")).alias("piece"), F.explode(F.sequence(F.lit(0), F.col("o.parts2") - 1)).alias("at"))
    mine, theirs = F.struct("own", "salt"), F.struct(F.col("piece").alias("own"), F.col("at").alias("salt"))
    units = placed.select("node", F.xxhash64("cluster", F.least(mine, theirs), F.greatest(mine, theirs)).alias("unit"), (mine > theirs).cast("int").alias("side"))
    return _verified(units.join(sets.select("node", "s"), "node"), percent)


def _links(docs: DataFrame, members: DataFrame, weights: DataFrame, percent: int) -> DataFrame:
    """A spanning set of the confirmed links (a, b) of members(node, cluster, id, n, s1); weights: node, held."""
    sets = written(_sets(docs, members), "sets")
    found, large = _within_blocks(sets, weights, percent)
    if not large.take(1):
        discard(sets)
        return found
    links = written(found.unionByName(_between_blocks(sets, large, found.join(sets.join(large, "cluster").select(F.col("node").alias("a")), "a"), percent)), "links")
    discard(sets, found)
    return links


def _same_id(digests: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): the nodes of doc_ids that have several sets, each with the least of them."""
    rows = digests.where("n > 0 and doc_id is not null")
    several = rows.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("doc_id")
    named = rows.select("doc_id", "s1", "s2").join(several, "doc_id").distinct().join(classes.select("s1", "s2", "node"), ["s1", "s2"])
    named = written(named.select("doc_id", "node"), "same-id")
    least = named.groupBy("doc_id").agg(F.min("node").alias("b"))
    return named.join(least, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text); links are of percent (below 100) or more."""
    spark = docs.sparkSession
    digests = written(_digests(docs, percent), "minhash")
    sets = digests.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("r").alias("r"))
    classes = written(sets.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbered once, as the table is read from here on
    release(spark)
    edges = _candidates(classes, side(percent))
    release(spark)
    clusters = components(edges.where("a <> b").select("a", "b")).select(F.col("id").alias("m"), F.col("component").alias("cluster"))
    members = written(classes.select("node", "id", "n", "s1").join(clusters, F.col("node") == F.col("m")).drop("m"), "clusters")
    weights = edges.groupBy(F.col("a").alias("node")).agg(F.sum("held").alias("held"))
    links = _links(docs, members, weights, percent)
    release(spark)
    labels = written(components(links.unionByName(_same_id(digests, classes))), "labels")
    known = labels.join(classes.select("node", F.col("id").alias("doc")), F.col("id") == F.col("node"))
    least = known.groupBy("component").agg(F.min("doc").alias("least"))
    known = written(known.join(least, "component").select("node", "least"), "least-ids")
    named = classes.select(F.col("s1").alias("t1"), F.col("s2").alias("t2"), "id", "node").join(known, "node", "left")
    named = written(named.select("t1", "t2", F.coalesce("least", "id").alias("component")), "named")
    discard(classes, edges, members, links, labels, known)
    release(spark)
    some = F.col("n") > 0  # rows without words match nothing, and are spread over the tasks by doc_id
    keyed = digests.select("doc_id", "n", F.when(some, F.col("s1")).otherwise(F.xxhash64("doc_id")).alias("s1"), F.when(some, F.col("s2")).otherwise(F.lit(0)).alias("s2"))
    joined = keyed.join(named, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group the row whose doc_id is its component, and of repeated rows one."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    kept = groups(docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    once = plain.join(kept, at["doc_id"] == F.col("doc_id"), "left_semi").withColumn("same", tie(at["text"]))
    rows = once.dropDuplicates([f"c{names.index('doc_id')}", "same"]).drop("same").unionByName(plain.where(at["doc_id"].isNull()))
    return rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
