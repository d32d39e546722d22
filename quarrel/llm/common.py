"""What the operators of this subpackage share: scratch tables, words and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CLASS = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Where that is unset, as in tests, a folder of our own on a local
    master; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quarrel-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of written() tables whose readers have all been written themselves."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let the driver's collector find shuffles that are no longer reachable, so that their files go before the next step."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: str | None) -> list[bytes]:
    """Words of whole text: maximal runs without U+0020 and U+0009 to U+000D, as UTF-8. bytes.split() has exactly that set."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes; order counts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = mix(h[:n] + np.uint64(k))
    for j in range(1, k):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return g


def tie(text: Column) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(text)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch of edges, a spanning forest of them: at most one edge a node, each to its root."""
    for b in batches:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while (up := parent[x]) != root:
                parent[x], x = root, up
            return root

        for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(a), find(c)
            if x != y:
                parent[max(x, y)] = min(x, y)
        rows = [(x, find(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])


FEW_EDGES = 10_000  # counted first; so many, and no more, are joined in one task


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, to) for every end of at most FEW_EDGES edges(a, b): the least node it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["node", "to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, to long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a long, b long): one row (id, component) per id in edges, component its smallest reachable id.

    Randomised contraction: each round every node joins its neighbour (or itself) of least pseudo-random rank and edges are relabelled,
    which shrinks the graph by a constant factor in expectation, for chains as for stars, until FEW_EDGES are left. Every round is a written
    table; nothing is collected but its edge count. Hubs are reduced by partial aggregates. Loops, repeated edges and an empty table are fine; edges with a
    null end are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    e = written(map_batches(e, _forest, "a long, b long").distinct(), "edges")
    labels, turn = None, 0
    while left := e.count():  # every round joins at least two nodes, so it ends
        turn += 1
        if left <= FEW_EDGES:
            step = written(_in_one_task(e), "step")
        else:
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("r"), F.col("b").alias("n"))).alias("m"))
            own = F.struct(F.xxhash64("a", F.lit(turn)).alias("r"), F.col("a").alias("n"))
            step = written(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["n"].alias("to")), "step")
        if labels is None:
            after = step.select(F.col("node").alias("id"), F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), "to")
            after = labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        after = written(after, "labels")
        if left <= FEW_EDGES:
            discard(step, labels)
            labels = after
            break
        n = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        n = n.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b")
        n = written(map_batches(n, _forest, "a long, b long").distinct(), "edges")
        discard(e, step, labels)
        e, labels = n, after
    if labels is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")


def runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Groups of equal key of a stream that is sorted by that column; only the open group is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy(zero_copy_only=False)
        cuts = np.nonzero(k[1:] != k[:-1])[0] + 1
        if held and held[-1].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for c in cuts.tolist():
            yield pa.Table.from_batches([*held, b.slice(at, c - at)])
            held, at = [], c
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """A small union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b
