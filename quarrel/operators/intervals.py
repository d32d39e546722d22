"""Intervals and order: innermost spans, as-of matches, islands and maximal intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _around(spans: DataFrame, points: DataFrame) -> DataFrame:
    """points(key, point_id, at) with the spans(key, span_id, s, e) around them, all times as microseconds.

    A span lies in one or two buckets as wide as the power of two above its length, and a point in one bucket of each width there is (64 at
    most), so a key with many spans is spread over its buckets and no point meets the spans of another time.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    sized = spans.select("key", "span_id", micros("s"), micros("e")).where("s <= e").withColumn("width", F.ceil(F.log2(F.col("e") - F.col("s") + 2)).cast("int"))
    widths = sorted(r[0] for r in sized.select("width").distinct().collect())
    bucket = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("width"))).cast("long")
    left = sized.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket("s"), bucket("e")))))
    right = points.select("key", "point_id", micros("at")).withColumn("width", F.explode(F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>"))).withColumn("bucket", bucket("at"))
    return right.join(left, ["key", "width", "bucket"]).where((F.col("s") <= F.col("at")) & (F.col("at") <= F.col("e")))


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """(point_id, span_id) of the shortest span(key, span_id, s, e) around each point(key, point_id, at); ties to the later start, then id.

    A point keeps its best span by a partial aggregate, not a sort of all matches.
    """
    best = F.min(F.struct((F.col("e") - F.col("s")).alias("w"), (-F.col("s")).alias("s"), F.col("span_id")))
    return _around(spans, points).groupBy("point_id").agg(best["span_id"].alias("span_id"))


def latest_before(events: DataFrame, key: str, order: list[str], is_def, is_use) -> DataFrame:
    """Each use with the id of the latest def before it under its key: one window, no join. events carry id."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("def_id", F.last(F.when(is_def, F.col("id")), ignorenulls=True).over(before)).where(is_use)


def islands(rows: DataFrame, key: str) -> DataFrame:
    """Neighbouring rows(key, s, e, reason, level) of one reason that touch or overlap, merged; a change of reason starts anew."""
    order = Window.partitionBy(key).orderBy("s", "e", "reason", "level")
    fresh = (F.col("reason") != F.lag("reason").over(order)) | F.lag("reason").over(order).isNull()
    run = rows.withColumn("run", F.sum(F.when(fresh, 1).otherwise(0)).over(order))
    inside = Window.partitionBy(key, "run").orderBy("s", "e", "level")
    reach = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    cut = run.withColumn("cut", F.sum(F.when(reach.isNull() | (F.col("s") > reach + 1), 1).otherwise(0)).over(inside))
    return cut.groupBy(key, "run", "cut").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("reason").alias("reason"), F.max("level").alias("level"), F.count(F.lit(1)).alias("merged")).drop("run", "cut")


def maximal(spans: DataFrame) -> DataFrame:
    """spans(key, span_id, s, e) that no other of the key contains; of equal ones the least id stays. One window in order of start."""
    order = Window.partitionBy("key").orderBy("s", F.col("e").desc(), "span_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("e").over(order)
    return spans.withColumn("reach", reach).where(F.col("reach").isNull() | (F.col("e") > F.col("reach"))).drop("reach")


def enclosing(spans: DataFrame, points: DataFrame) -> DataFrame:
    """point_id, depth and scopes (ids of the other spans around the point, widest first, joined by slashes). Scopes of a point are as many as it is deep."""
    met = _around(spans, points).where("span_id <> point_id")
    found = met.select("point_id", F.struct((F.col("s") - F.col("e")).alias("w"), "span_id").alias("m")).groupBy("point_id").agg(F.sort_array(F.collect_list("m")).alias("l"))
    return found.select("point_id", F.size("l").cast("long").alias("depth"), F.array_join(F.transform("l", lambda x: x["span_id"].cast("string")), "/").alias("scopes"))


def unshadowed(uses: DataFrame, hiding: DataFrame) -> DataFrame:
    """uses(key, at, ...) that no span of hiding(key, s, e) covers. One window over both: a use is covered if the furthest end of the spans
    that began before it reaches it, so no use meets every span of its key."""
    names = [c for c in uses.columns if c not in ("key", "at")]
    marks = hiding.select("key", F.col("s").alias("at"), F.col("e").alias("end"), F.lit(0).alias("kind"), *[F.lit(None).cast(uses.schema[c].dataType).alias(c) for c in names])
    both = marks.unionByName(uses.select("key", "at", F.lit(None).cast(hiding.schema["e"].dataType).alias("end"), F.lit(1).alias("kind"), *names))
    reach = F.max("end").over(Window.partitionBy("key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("reach", reach).where((F.col("kind") == 1) & (F.col("reach").isNull() | (F.col("reach") < F.col("at")))).select("key", "at", *names)
