"""Mixing sources to target weights: repetition rates from token counts, then whole copies plus one seeded Bernoulli copy.

Sources in code point order, null last, weigh 5, 2, 1, repeating. They share all words of the input by weight; a target stops at LIMIT
times its source's size and what is over is shared anew by weight among the others. The rate of a source is target / size; a document is
taken floor(rate) times and once more if a hash of a seed, its doc_id and its text, read as a number below 1, is below the fraction: a
Bernoulli draw of its own, whatever other documents there are. Such draws stray in a source of few or very unequal documents, so each
source has one of some numbered seeds: the first whose copies come within NEAR of the target, else the nearest. One aggregate tries them
all, the more of them the fewer documents a source has (TRIES, at least and at most SEEDS). A large source nearly always has the first. Per-source sums are partial aggregates; the only pass over texts counts words.

Null and empty texts have size 0 and are taken like any document of their source (a source without words has target 0 and rate 0). Rows
that are repeated (equal doc_id and text) draw alike, whatever their other columns hold. A null doc_id is hashed as such. There are no ties:
a draw compares a document with nothing but its fraction. Extra columns, one named size among them, are kept by emit(). An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrel.llm.common import WORD_CLASS, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = 20
SEEDS = (16, 1024)
TRIES = 1 << 16
NEAR = 0.005


def size_of(text: Column) -> Column:
    """The number of runs outside U+0020 and U+0009 to U+000D, in one scan."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def _running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows, written, with sums (column -> new name) over all rows before each in order: by range partitions and their totals, so that no
    task needs all rows. The window over partitions sees as many rows as a shuffle has tasks."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "placed")
    totals = placed.groupBy("part").agg(*[F.sum(c).alias(f"all_{n}") for c, n in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", *[F.sum(f"all_{n}").over(earlier).alias(f"pre_{n}") for n in sums.values()])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({f"own_{n}": F.sum(c).over(own) for c, n in sums.items()}).join(before, "part")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return summed.select(*rows.columns, *[(zero(f"pre_{n}") + zero(f"own_{n}")).alias(n) for n in sums.values()])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size, docs, target for sizes(source, size).

    Sources that stop at the limit are those of least size by weight: in that order the first whose share stays below its limit sets the
    share of all after it.
    """
    by_name = F.col("source").asc_nulls_last()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")).withColumn("one", F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = _running(per, [by_name], {"one": "rank"}).select("source", "source_size", "docs", weight.alias("weight"))
    ranked = ranked.withColumn("ratio", F.col("source_size") * float(limit) / F.col("weight"))
    ordered = written(_running(ranked, [F.col("ratio"), by_name], {"source_size": "before", "weight": "used"}), "weights")
    whole = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, free = float(whole["size"] or 0), float(whole["weight"] or 0)
    share = (F.lit(total) - float(limit) * F.col("before")) / (F.lit(free) - F.col("used"))
    stays = ordered.withColumn("share", share).where(F.col("weight") * F.col("share") <= F.col("source_size") * float(limit))
    first = stays.agg(F.min(F.struct("ratio", "used", "share"))["share"].alias("share")).first()["share"] or 0.0
    capped = F.col("weight") * F.lit(first) > F.col("source_size") * float(limit)
    target = F.when(capped, F.col("source_size") * float(limit)).otherwise(F.col("weight") * F.lit(first))
    return ordered.select("source", "source_size", "docs", target.alias("target"))


def _hit(draw: Column, k: Column, fraction: Column) -> Column:
    """Does the kth seed take the document once more?"""
    return F.pmod(F.xxhash64(draw, k), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52)) < fraction


def rates(sizes: DataFrame) -> DataFrame:
    """of (a source), source_size, target, whole (copies of each document), fraction, k (the source's seed) for sizes(source, size, draw)."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(LIMIT)))).otherwise(F.lit(0.0))
    per = targets(sizes).withColumnRenamed("source", "of").withColumn("rate", rate)
    per = written(per.select("of", "source_size", "docs", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction")), "rates")
    met = sizes.where("size > 0").join(per, F.col("source").eqNullSafe(F.col("of"))).where("fraction > 0")
    tries = F.greatest(F.lit(SEEDS[0]), F.least(F.lit(SEEDS[1]), F.floor(TRIES / F.col("docs")))).cast("int")
    tried = met.withColumn("k", F.explode(F.sequence(F.lit(0), tries - 1)))
    wanted = F.first("target") - F.first("whole") * F.first("source_size")
    off = F.abs(F.sum(F.when(_hit(F.col("draw"), F.col("k"), F.col("fraction")), F.col("size")).otherwise(0)) - wanted)
    sums = tried.groupBy("of", "k").agg(off.alias("off"), F.first("target").alias("target"))
    far = F.col("off") > NEAR * F.col("target")
    best = sums.groupBy(F.col("of").alias("s")).agg(F.min(F.struct(F.when(far, F.col("off")).otherwise(0.0).alias("off"), "k"))["k"].alias("k"))
    return written(per.join(best, F.col("of").eqNullSafe(F.col("s")), "left").select("of", "source_size", "target", "whole", "fraction", F.coalesce("k", F.lit(0)).alias("k")), "seeds")


def _draw(doc_id: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), doc_id.cast("long"), text)


def _copies() -> Column:
    return (F.col("whole") + _hit(F.col("draw"), F.col("k"), F.col("fraction")).cast("int")).cast("long")


def takes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs(doc_id, text, source)."""
    text = F.col("text")
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(text).alias("size"), _draw(F.col("doc_id"), text, seed).alias("draw")), "sizes")
    drawn = sizes.join(rates(sizes), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", _copies())
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def emit(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken, with the columns of docs. Texts are not shuffled."""
    names, text = docs.columns, F.col("text")
    per = rates(written(docs.select("source", size_of(text).alias("size"), _draw(F.col("doc_id"), text, seed).alias("draw")), "sizes"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    drawn = plain.withColumn("draw", _draw(at["doc_id"], at["text"], seed)).join(per, at["source"].eqNullSafe(F.col("of"))).withColumn("copies", _copies())
    repeated = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


#: The part of takes() that no draw decides, in SQL: doc_id, size, source_size, target.
TARGETS_SQL = r"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM s GROUP BY source),
w AS (SELECT source, source_size, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 3::DOUBLE / weight, source NULLS LAST) AS pos FROM w),
b AS (SELECT *, sum(source_size) OVER (ORDER BY pos) - source_size AS before, sum(weight) OVER (ORDER BY pos) - weight AS used, sum(source_size) OVER () AS total, sum(weight) OVER () AS free FROM o),
c AS (SELECT *, (total::DOUBLE - 3::DOUBLE * before::DOUBLE) / (free - used) AS share FROM b),
x AS (SELECT arg_min(share, pos) AS share FROM c WHERE weight * share <= source_size * 3::DOUBLE)
SELECT doc_id, size, source_size, CASE WHEN weight * x.share > source_size * 3::DOUBLE THEN source_size * 3::DOUBLE ELSE weight * x.share END AS target
FROM s JOIN w ON s.source IS NOT DISTINCT FROM w.source CROSS JOIN x
"""
