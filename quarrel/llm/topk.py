"""Exact top-k by inner product: dual-tree search over cover trees.

Queries and candidates are integer vectors, floor(scale * x). Both are dealt into blocks of bounded size; a unit of work is a query block
against a data block, and each holds a cover tree of either side: a node stands for points within its covering radius of a center that
is one of them, and its children are the rows nearest to centers taken farthest first, until all lie within half the radius of one or there
are FAN. For a query node (center u, radius s) and a data node (center c, radius r) every inner product
is at most <u, c> + |c| s + |u| r + r s; the pair of nodes is pruned if that is below the worst kth score in the query group. Query leaves
search best node first. The k best of every unit meet in a window by query: k rows a data block.

Vectors that are null, empty or hold null or non-finite components, and rows without vec_id, take no part; vectors of different
dimension are not compared. A query does not meet rows of its own vec_id. Ties go to the smaller vec_id, repeated rows of one vec_id are
as many candidates, and repeated query rows are as many queries, each with its k rows. With fewer than k candidates all are returned, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrel.llm.common import runs, shuffle_width, written
from quarrel.llm.vectors import blocked, usable

K = 10
SCALE = 1024
QUERY_BLOCK, DATA_BLOCK = 4096, 4096
LEAF, FAN = 256, 24  # wide leaves: in many dimensions few nodes are pruned, and a leaf is one product
_NONE = np.iinfo(np.int64).min


class CoverTree:
    """Nodes over the rows of x: center row, covering radius, children, and at leaves the rows."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        todo = [(np.arange(len(x)), 0, -1)]
        while todo:
            rows, center, parent = todo.pop()
            far = np.linalg.norm(x[rows] - x[center], axis=1)
            radius = float(far.max())
            node = len(self.center)
            self.center.append(center)
            self.radius.append(radius)
            self.children.append([])
            self.rows.append(rows)
            if parent >= 0:
                self.children[parent].append(node)
            if len(rows) > LEAF and radius > 0:
                parts = self._divide(rows, center, far, radius / 2)
                if max(len(p) for p, _ in parts) < len(rows):
                    todo += [(p, c, node) for p, c in parts]
        self.c = x[self.center].astype(np.float64)
        self.r = np.array(self.radius)
        self.norm = np.linalg.norm(self.c, axis=1)

    def _divide(self, rows: np.ndarray, center: int, far: np.ndarray, half: float) -> list[tuple[np.ndarray, int]]:
        """Centers more than half apart until all rows lie within half of one, or FAN of them; each row goes to its nearest."""
        near, owner, centers = far.copy(), np.zeros(len(rows), np.int64), [center]
        while len(centers) < FAN and (far_at := int(near.argmax())) >= 0 and near[far_at] > half:
            c = int(rows[far_at])
            d = np.linalg.norm(self.x[rows] - self.x[c], axis=1)
            closer = d < near
            owner[closer], near[closer] = len(centers), d[closer]
            centers.append(c)
        return [(rows[owner == i], c) for i, c in enumerate(centers) if (owner == i).any()]


class DualSearch:
    """The k best candidates of every query of one unit."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.query_ids, self.ids, self.k = query_ids, ids, k
        top = float(max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)))
        exact = top * top * q.shape[1] < 2**53  # then products of doubles are exact
        self.q, self.x = (q.astype(np.float64), x.astype(np.float64)) if exact else (q, x)
        self.best = np.full((len(q), k), _NONE)
        self.best_id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.queries, self.data = CoverTree(q.astype(np.float64)), CoverTree(x.astype(np.float64))

    def bound(self, node: int, data: np.ndarray) -> np.ndarray:
        t, d = self.queries, self.data
        u, s = t.c[node], t.r[node]
        top = d.c[data] @ u + d.norm[data] * s + t.norm[node] * d.r[data] + d.r[data] * s
        return top + 1 + 1e-9 * np.abs(top)  # more than rounding can take away

    def worst(self, node: int) -> float:
        return float(self.best[self.queries.rows[node], -1].min())

    def run(self) -> None:
        todo = [(0, np.array([0]))]
        while todo:
            node, data = todo.pop()
            data = data[self.bound(node, data) >= self.worst(node)]
            children = self.queries.children[node]
            if children:
                wider = [c for d in data for c in (self.data.children[d] or [d])]
                todo += [(c, np.array(wider, np.int64)) for c in children]
            else:
                self._leaf(node, data)

    def _leaf(self, node: int, data: np.ndarray) -> None:
        heap = [(-b, int(d)) for b, d in zip(self.bound(node, data), data, strict=True)]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= self.worst(node):
            d = heapq.heappop(heap)[1]
            if self.data.children[d]:
                kids = np.array(self.data.children[d])
                for b, c in zip(self.bound(node, kids), kids, strict=True):
                    heapq.heappush(heap, (-b, int(c)))
            else:
                self._score(self.queries.rows[node], self.data.rows[d])

    def _score(self, qs: np.ndarray, rows: np.ndarray) -> None:
        scores = (self.q[qs] @ self.x[rows].T).astype(np.int64)
        ids = np.broadcast_to(self.ids[rows], scores.shape)
        own = ids == self.query_ids[qs, None]
        scores[own] = _NONE
        ids = np.where(own, np.iinfo(np.int64).max, ids)
        scores, ids = np.concatenate((self.best[qs], scores), 1), np.concatenate((self.best_id[qs], ids), 1)
        order = np.lexsort((ids, ~scores), axis=-1)[:, : self.k]
        self.best[qs], self.best_id[qs] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def top(embeddings: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of embeddings(vec_id, embedding) for every row that is_query, an SQL condition, selects."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(F.col("vec_id").isNotNull() & usable(F.col("e")))
    ints = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), F.size("e").alias("dim"), F.transform("e", lambda x: F.floor(x * scale)).alias("v"))
    ints = written(ints, "integers")
    data = blocked(ints, ["dim"], DATA_BLOCK, "blocks")
    queries = blocked(ints.where(is_query), ["dim"], QUERY_BLOCK, "query_blocks")
    count = lambda df, name: df.groupBy("dim").agg(F.first(name).alias(name))
    of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias("other")
    left = queries.join(count(data, "blocks"), "dim").select("vec_id", "row", "v", "dim", F.col("salt").alias("qb"), of("blocks")).select(F.xxhash64("dim", "qb", "other").alias("unit"), F.lit(True).alias("query"), "vec_id", "row", "v")
    right = data.join(count(queries, "query_blocks"), "dim").select("vec_id", "row", "v", "dim", F.col("salt").alias("db"), of("query_blocks")).select(F.xxhash64("dim", "other", "db").alias("unit"), F.lit(False).alias("query"), "vec_id", "row", "v")
    dealt = left.unionByName(right).repartition(shuffle_width(spark), "unit").sortWithinPartitions("unit", "query", "vec_id")
    schema = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            query, ids, own = (group.column(c).to_numpy() for c in ("query", "vec_id", "row"))
            flat = group.column("v").combine_chunks()
            x = flat.flatten().to_numpy().reshape(len(ids), -1)
            if not query.any() or query.all():
                continue
            found = DualSearch(ids[query], x[query], ids[~query], x[~query], k)
            found.run()
            i, j = np.nonzero(found.best_id != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(found.query_ids[i]), pa.array(own[query][i]), pa.array(found.best_id[i, j]), pa.array(found.best[i, j])], schema=schema)

    best = dealt.mapInArrow(run, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
