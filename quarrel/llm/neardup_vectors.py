"""Embedding near-duplicates with randomised-rotation binary codes.

Vectors of one label and dimension are compared. A unit vector is rotated by a seeded random orthogonal matrix and coded by the signs of
its components; stored beside the code is the correction factor f, the inner product of vector and code. <code, q> / f is an unbiased
estimate of <o, q> over rotations, and what it misses is bounded: the code's part across o has length sqrt(1 - f^2), so the error is at
most sqrt(1 - f^2) / f * sqrt(1 - <o, q>^2). A pair whose estimate lies below the threshold by more than that for a pair at the threshold
cannot be linked; the others are recomputed exactly in double precision. The bound holds with certainty, so no link is lost.

1. Equal vectors of a label are one class, a node with a number of its own. Code, factor and the rotated vector in bytes (with the length of
   what the bytes miss, which the bound adds) are computed once for each class and stored.
2. Classes of a label are dealt into blocks of bounded size, and pairs of blocks are units of work (compared in blocks, never joined row by
   row). A unit gets codes and bytes alone, about an eighth of the vectors, and passes on its open pairs; a unit where most are open, as
   in a group of copies, passes on its number instead.
3. Open pairs fetch their two vectors by joins. Numbered units get the vectors of their rows and pass on, for each class, the number of
   vectors linked and a spanning forest of its links, so nothing grows with the square of a group but the comparisons.

Vectors without vec_id or label, and those that are null, empty, zero or hold null or non-finite components, link with nothing: n_links 0,
component their own vec_id. Repeated rows are linked copies; rows that share a vec_id are vectors of their own, which only their own links
join. Extra columns are ignored. A cosine at the threshold links. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrel.llm.common import Union, components, discard, runs, shuffle_width, written
from quarrel.llm.vectors import blocked, matrix, usable

THRESHOLD = 0.93
BLOCK = 1024
ROUNDING = 1e-3  # of the estimates, in single precision
DENSE = 2  # open pairs a row from which a unit is compared by its vectors


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, correction factors, bytes of the rotated unit vectors, their scales, lengths of what they miss) of the rows of x."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = unit.astype(np.float32) @ rotation(x.shape[1])
    scale = np.abs(y).max(1) / 127
    q = np.round(y / scale[:, None]).astype(np.int8)
    return np.packbits(y >= 0, axis=1), np.abs(y).sum(1) / np.sqrt(x.shape[1]), q, scale, np.linalg.norm(y - q * scale[:, None], axis=1)


def _digests(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim and, for usable vectors, d1 and d2 (the vector's identity) and v (its doubles, scaled to a greatest component of 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d1, d2, raw = [], [], []
            for good, x in zip(b.column(3).to_pylist(), b.column(2), strict=True):
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) if good else np.zeros(1)
                if not v.any():
                    d1.append(None), d2.append(None), raw.append(None)
                    continue
                d = xxhash.xxh3_128_intdigest(v.tobytes())
                d1.append((d >> 64) - (1 << 63)), d2.append((d & ((1 << 64) - 1)) - (1 << 63)), raw.append((v / np.abs(v).max()).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(r) // 8 if r else 0 for r in raw], pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "d1", "d2", "v"])

    return rows.mapInArrow(run, "vec_id long, label long, dim int, d1 long, d2 long, v binary")


def _coded(classes: DataFrame) -> DataFrame:
    """classes(label, dim, vec_id, copies, v, ...) with code, f, q, qs and qe of codes()."""
    names = classes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[None] * b.num_rows for _ in range(5)]
            dims = b.column(names.index("dim")).to_numpy()
            for d in np.unique(dims):
                rows = np.nonzero(dims == d)[0]
                bits, f, q, qs, qe = codes(matrix(b.column(names.index("v")).take(pa.array(rows))))
                for k, i in enumerate(rows.tolist()):
                    out[0][i], out[1][i], out[2][i], out[3][i], out[4][i] = bits[k].tobytes(), float(f[k]), q[k].tobytes(), float(qs[k]), float(qe[k])
            kinds = (pa.binary(), pa.float64(), pa.binary(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=[*names, "code", "f", "q", "qs", "qe"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, *T.StructType.fromDDL("code binary, f double, q binary, qs double, qe double").fields]))


def _sides(side: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    two = bool(side.any())
    return two, *((np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]) if two else (np.arange(len(side)), np.arange(len(side))))


def _open(group: pa.Table, threshold: float) -> list[tuple[int, int]] | None:
    """Pairs of nodes of a unit that the codes leave open, or None if there are more than DENSE a row."""
    ids, (two, left, right) = group.column("node").to_numpy(), _sides(group.column("side").to_numpy())
    q, factor, qs = matrix(group.column("q"), "i1"), group.column("f").to_numpy(), group.column("qs").to_numpy()
    dim = q.shape[1]
    y = q.astype(np.float32) * qs.astype(np.float32)[:, None]
    sign = np.unpackbits(matrix(group.column("code"), "u1"), axis=1, count=dim).astype(np.float32) * 2 - 1
    scale = (1 / (np.sqrt(dim) * factor)).astype(np.float32)
    slack = np.sqrt(np.maximum(0, 1 - factor**2)) / factor * np.sqrt(1 - threshold**2) + group.column("qe").to_numpy().max() / factor
    floor = (threshold - slack - ROUNDING).astype(np.float32)
    out: list[tuple[int, int]] = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        i, j = np.nonzero((sign[rows] * scale[rows, None]) @ y[right].T >= floor[rows, None])
        i, j = rows[i], right[j]
        if not two:
            i, j = i[i < j], j[i < j]
        if len(out) + len(i) > DENSE * len(ids):
            return None
        out += zip(ids[i].tolist(), ids[j].tolist(), strict=True)
    return out


def _compare(group: pa.Table, threshold: float) -> tuple[list[int], list[int], list[tuple[int, int]]]:
    """(nodes, vectors linked to each, forest of links) of a unit, by its vectors."""
    ids, (two, left, right) = group.column("node").to_numpy(), _sides(group.column("side").to_numpy())
    copies, x = group.column("copies").to_numpy(), matrix(group.column("v"))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    counts, forest, edges = np.zeros(len(ids), np.int64), Union(len(ids)), []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        product = x[rows] @ x[right].T
        i, j = np.nonzero(product >= threshold - 1e-9)
        sure = product[i, j] >= threshold + 1e-9
        i, j = rows[i], right[j]
        if not two:
            i, j, sure = i[i < j], j[i < j], sure[i < j]
        near = np.nonzero(~sure)[0]
        sure[near] = _cosine(x[i[near]], x[j[near]]) >= threshold
        i, j = i[sure], j[sure]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        for p, r in zip(i.tolist(), j.tolist(), strict=True):
            if forest.join(p, r):
                edges.append((int(ids[p]), int(ids[r])))
    return ids.tolist(), counts.tolist(), edges


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of unit vectors."""
    return np.einsum("ij,ij->i", a, b)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _exact_pairs(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, n: the linked ones of pairs(a, b) as (a, b, null), and the copies they add to either as (a, null, n)."""
    of = lambda c, v, n: classes.select(F.col("node").alias(c), F.col("v").alias(v), F.col("copies").alias(n))
    met = pairs.join(of("a", "x", "ca"), "a").join(of("b", "y", "cb"), "b").select("a", "b", "ca", "cb", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.array([len(x.as_buffer()) for x in batch.column(4)])
            for n in np.unique(size):
                b = batch.take(pa.array(np.nonzero(size == n)[0]))
                x, y = matrix(b.column(4)), matrix(b.column(5))
                linked = _cosine(x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)) >= threshold
                p, q, cp, cq = (b.column(k).to_numpy()[linked] for k in range(4))
                none = pa.nulls(len(p), pa.int64())
                for cols in ((p, q, none), (p, none, cq), (q, none, cp)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_FOUND)

    return met.mapInArrow(run, "a long, b long, n long")


def links(embeddings: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings(vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    rows = written(_digests(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), good.alias("good"))), "vectors")
    classes = rows.where("v is not null").groupBy("label", "dim", "d1", "d2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = written(_coded(classes).withColumn("node", F.monotonically_increasing_id()), "vector-classes")  # numbered once
    unit = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda s: F.struct(F.xxhash64("label", "dim", F.least(F.col("salt"), s), F.greatest(F.col("salt"), s)).alias("unit"), (s < F.col("salt")).cast("int").alias("side")))
    placed = written(blocked(classes.select("node", "vec_id", "label", "dim"), ["label", "dim"], block, "blocks").select("node", F.explode(unit).alias("u")).select("u.unit", "u.side", "node"), "units")

    def dealt(units: DataFrame, *cols: str) -> DataFrame:
        return units.join(classes.select("node", *cols), "node").select("unit", "side", "node", *cols).repartition(shuffle_width(spark), "unit").sortWithinPartitions("unit")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            pairs = _open(group, threshold)
            a, b, u = ([p[0] for p in pairs], [p[1] for p in pairs], [None] * len(pairs)) if pairs is not None else ([None], [None], [group.column("unit")[0].as_py()])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, u)], names=["a", "b", "dense"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            ids, counts, edges = _compare(group, threshold)
            some = [(i, c) for i, c in zip(ids, counts, strict=True) if c]
            a, b, n = [i for i, _ in some] + [e[0] for e in edges], [None] * len(some) + [e[1] for e in edges], [c for _, c in some] + [None] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], schema=_FOUND)

    opened = written(dealt(placed, "code", "f", "q", "qs", "qe").mapInArrow(estimate, "a long, b long, dense long"), "open")
    pairs = _exact_pairs(opened.where("dense is null").select("a", "b"), classes, threshold)
    dense = placed.join(opened.where("dense is not null").select(F.col("dense").alias("unit")), "unit")
    found = written(pairs.unionByName(dealt(dense, "copies", "v").mapInArrow(run, "a long, b long, n long")), "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).where("n is not null")
    labels = written(components(found.where("b is not null").select("a", "b")), "labels")
    known = labels.join(classes.select("node", "vec_id"), F.col("id") == F.col("node"))
    least = known.groupBy("component").agg(F.min("vec_id").alias("least"))
    named = classes.join(counts, F.col("node") == F.col("a"), "left").join(known.join(least, "component").select("id", "least"), F.col("node") == F.col("id"), "left")
    named = named.select(F.col("label").alias("l"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("least", "vec_id").alias("component"))
    named = written(named, "named")
    discard(classes, placed, opened, found, labels)
    joined = rows.select("vec_id", "label", "d1", "d2").join(named, (F.col("label") == F.col("l")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
