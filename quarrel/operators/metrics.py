"""Complexity summaries, roll-ups, coupling between classes and cohesion of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrel.operators.graph import components, written

# Upper bounds of low and medium risk.
COMPLEXITY_RISK = (9, 19)
CBO_RISK = (3, 7)
LCOM_RISK = (2, 5)


def risk(value: Column, bounds: tuple[int, int]) -> Column:
    return F.when(value <= bounds[0], "low").when(value <= bounds[1], "medium").otherwise("high")


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def in_range(value: Column, least: float, most: float = 0) -> Column:
    """At least `least`, and at most `most` unless that is 0."""
    return (value >= least) & (value <= most) if most > 0 else value >= least


def enabled(value: Column, kinds: list) -> Column:
    """Membership; no list enables all."""
    return value.isin(kinds) if kinds else F.lit(True)


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n of rows with their rank; order is total. A distributed top-k; the window sees n rows."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with dense numbers from 0 in a total order: places inside range partitions and the sizes of those before, so no task sorts all."""
    part = F.spark_partition_id()
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", part), "placed")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(before, "_part").select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias(name))


def _stats(cc: Column) -> list[Column]:
    return [F.count(cc).alias("functions"), F.coalesce(F.round(F.avg(cc), 6), F.lit(0.0)).alias("avg_cc"), F.coalesce(F.max(cc), F.lit(0)).cast("long").alias("max_cc"), _count_if(cc > COMPLEXITY_RISK[1]).alias("high_risk")]


def summary(functions: DataFrame) -> DataFrame:
    """One row over functions(complexity): count, average, bounds and functions per risk level."""
    cc = F.col("complexity")
    return functions.agg(
        F.count(cc).alias("functions"), F.round(F.avg(cc), 6).alias("avg_cc"), F.min(cc).cast("long").alias("min_cc"), F.max(cc).cast("long").alias("max_cc"),
        _count_if(cc <= COMPLEXITY_RISK[0]).alias("low_risk"), _count_if((cc > COMPLEXITY_RISK[0]) & (cc <= COMPLEXITY_RISK[1])).alias("medium_risk"), _count_if(cc > COMPLEXITY_RISK[1]).alias("high_risk"),
    )


def distribution(functions: DataFrame) -> DataFrame:
    return functions.groupBy(F.col("complexity").cast("long").alias("complexity")).agg(F.count(F.lit(1)).alias("n"))


def median(functions: DataFrame) -> DataFrame:
    """The exact midpoint median, from the distribution: the state is one row a distinct value."""
    return distribution(functions).agg(F.expr("percentile(complexity, 0.5, n)").alias("median_cc"))


def histogram(functions: DataFrame, edges: tuple[int, ...] = (1, 5, 9, 19)) -> DataFrame:
    """Counts of the bins up to each edge and beyond the last; empty bins are kept."""
    cc, spark = F.col("complexity"), functions.sparkSession
    bin_of = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bin_of = F.when(cc <= edges[i], F.lit(i)).otherwise(bin_of)
    bins = spark.range(len(edges) + 1).select(F.col("id").alias("bin"))
    counts = functions.groupBy(bin_of.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # one row a bin


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Partial summaries(functions, avg_cc, max_cc, high_risk) merged: averages weigh by their functions."""
    whole = F.sum("functions")
    avg = F.when(whole > 0, F.round(F.sum(F.col("avg_cc") * F.col("functions")) / whole, 6)).otherwise(0.0)
    return parts.groupBy(*keys).agg(whole.alias("functions"), avg.alias("avg_cc"), F.max("max_cc").alias("max_cc"), F.sum("high_risk").alias("high_risk"))


def rollup_by(functions: DataFrame, *keys: str) -> DataFrame:
    return functions.groupBy(*keys).agg(*_stats(F.col("complexity")))


def rollup_sets(functions: DataFrame, *keys: str) -> DataFrame:
    """The same at every level of a hierarchy, coarser keys null."""
    return functions.rollup(*keys).agg(*_stats(F.col("complexity")))


def hotspots(rollup: DataFrame, key: str, n: int = 8) -> DataFrame:
    """The n worst rows with their rank: most high-risk functions, then greatest, then average complexity, then size, then key."""
    order = [F.col("high_risk").desc(), F.col("max_cc").desc(), F.col("avg_cc").desc(), F.col("functions").desc(), F.col(key)]
    top = rollup.orderBy(*order).limit(n)  # a distributed top-k; the window sees n rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def quality(complexity: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """Complexity and finding roll-ups side by side: a module counts if either side knows it."""
    both = complexity.join(findings, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return both.select(key, zero("functions"), zero("max_cc"), zero("high_risk"), zero("findings"), zero("critical"))


def cbo(deps: DataFrame) -> DataFrame:
    """Coupling of deps(class, dep, kind): distinct other classes, list, dependencies by kind and risk. Classes without any are dropped."""
    other = deps.where("dep is not null and cast(class as string) <> dep").select("class", "dep", "kind").distinct()
    kinds = other.groupBy("class", "kind").agg(F.count("dep").alias("k")).groupBy("class").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", F.col("k").cast("string")))), ",").alias("by_kind"))
    names = other.select("class", "dep").distinct().groupBy("class").agg(F.count("dep").alias("cbo"), F.array_join(F.sort_array(F.collect_list("dep")), ",").alias("deps"))
    return names.join(kinds, "class").select("class", "cbo", "deps", "by_kind", risk(F.col("cbo"), CBO_RISK).alias("risk"))


def cbo_buckets(metrics: DataFrame) -> DataFrame:
    c = F.col("cbo")
    label = F.when(c == 0, "0").when(c <= 3, "1-3").when(c <= 7, "4-7").when(c <= 10, "8-10").otherwise("10+")
    return metrics.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("classes"))


def cbo_summary(metrics: DataFrame) -> DataFrame:
    c = F.col("cbo")
    return metrics.agg(F.count(c).alias("classes"), F.round(F.avg(c), 6).alias("avg_cbo"), F.min(c).alias("min_cbo"), F.max(c).alias("max_cbo"), _count_if(c <= CBO_RISK[0]).alias("low_risk"), _count_if((c > CBO_RISK[0]) & (c <= CBO_RISK[1])).alias("medium_risk"), _count_if(c > CBO_RISK[1]).alias("high_risk"))


def after_terminator(statements: DataFrame, keys: list[str], ends: Column, reason: Column) -> DataFrame:
    """keys, reason, dead: how many of statements(keys, at, ...) come after the first that ends its block. Blocks are met by an
    aggregate and a join, so a long one is not sorted in one task."""
    first = statements.where(ends).groupBy(*keys).agg(F.min(F.struct("at", reason.alias("reason"))).alias("m"))
    met = statements.select(*keys, "at").join(first, keys).where(F.col("at") > F.col("m.at"))
    return met.groupBy(*keys, F.col("m.reason").alias("reason")).agg(F.count(F.lit(1)).alias("dead"))


def lcom4(accesses: DataFrame) -> DataFrame:
    """Cohesion of accesses(class, method, target): components of the methods of a class that share a target, and risk."""
    node = lambda kind, c: F.xxhash64("class", F.lit(kind), c)
    methods = accesses.select("class", "method").distinct().withColumn("node", node("m", "method"))
    edges = accesses.where("target is not null").select(node("m", "method").alias("a"), node("t", "target").alias("b"))
    found = methods.join(components(edges), F.col("node") == F.col("id"), "left")
    return found.groupBy("class").agg(F.count("method").alias("methods"), F.countDistinct(F.coalesce("component", "node")).alias("lcom4")).select("class", "methods", "lcom4", risk(F.col("lcom4"), LCOM_RISK).alias("risk"))


def histogram_median(hist: DataFrame) -> DataFrame:
    """median, functions and values_seen of hist(v, n), one row a value. The window is over the distinct values alone."""
    upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    low = F.min(F.when(F.col("upto") >= F.floor((F.col("total") + 1) / 2), F.col("v")))
    high = F.min(F.when(F.col("upto") >= F.floor(F.col("total") / 2) + 1, F.col("v")))
    return upto.agg(((low + high) / 2.0).cast("double").alias("median"), F.sum("n").alias("functions"), F.count(F.lit(1)).alias("values_seen"))


def common_root(files: DataFrame) -> DataFrame:
    """root: the leading folders that all of files(path) share. What the least and the greatest folder share, all between them share."""
    parts = F.split("path", "/")
    folder = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ends = files.where("path is not null").agg(F.min(folder).alias("l"), F.max(folder).alias("h"))
    same = F.transform(F.arrays_zip("l", "h"), lambda p: (p["l"] == p["h"]) & p["l"].isNotNull() & p["h"].isNotNull())
    n = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
    shared = F.when(n == 0, F.size("l")).otherwise(n - 1).cast("int")
    return ends.select(F.array_join(F.slice("l", F.lit(1), shared), "/").alias("root"))


def patch_delta(functions: DataFrame, key: str) -> DataFrame:
    """Per key of functions(key, before, after), where 0 means absent: worst increase, most complex new one, how many went, any worse."""
    before, after = F.col("before"), F.col("after")
    grown, zero = (before > 0) & (after > before), F.lit(0)
    worst = F.max(F.when((before > 0) & (after > 0), after - before))
    return functions.groupBy(key).agg(
        F.coalesce(worst, zero).cast("long").alias("worst_increase"),
        F.coalesce(F.max(F.when(before == 0, after)), zero).cast("long").alias("new_max"),
        F.count(F.when(after == 0, 1)).alias("removed"),
        F.coalesce(F.bool_or(grown), F.lit(False)).alias("worse"),
    )


def checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, failures and rows checked for each rule that says what is wrong; a rule of unknown outcome does not fail."""
    counts = rows.agg(F.count(F.lit(1)).alias("checked"), *[F.count(F.when(bad, 1)).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failures")) for i, name in enumerate(rules)])
    return counts.select("checked", F.explode(listed).alias("r")).select("r.rule", "r.failures", "checked")


def merged_summaries(parts: DataFrame) -> DataFrame:
    """One summary out of partial ones(functions, avg_cc, min_cc, max_cc): means weigh by functions, parts without functions bound nothing."""
    some, n = F.col("functions") > 0, F.sum("functions")
    return parts.agg(n.alias("functions"), F.when(n > 0, F.round(F.sum(F.col("avg_cc") * F.col("functions")) / n, 6)).otherwise(0.0).alias("avg_cc"), F.coalesce(F.min(F.when(some, F.col("min_cc"))), F.lit(0)).alias("min_cc"), F.coalesce(F.max(F.when(some, F.col("max_cc"))), F.lit(0)).alias("max_cc"))


def renumbered(parts: list[DataFrame], key: str, order: list[Column], name: str) -> DataFrame:
    """The rows of all parts in one total order with new dense ids; part says where a row came from."""
    both = None
    for i, p in enumerate(parts):
        one = p.withColumn("part", F.lit(i)).withColumnRenamed(key, f"old_{key}")
        both = one if both is None else both.unionByName(one)
    return numbered(both, order, name)


def regressed(worst: Column, high_risk: Column, critical: Column, warning: Column) -> Column:
    """Did a change make any measured figure worse?"""
    return (worst > 0) | (high_risk > 0) | (critical > 0) | (warning > 0)


def unused(exports: DataFrame, imports: DataFrame, skipped: Column) -> DataFrame:
    """exports(file, name, ...) that no import(file, name) takes; files that are imported whole (name *) have none, nor have rows that skipped says."""
    whole = imports.where("name = '*'").select("file").distinct()
    return exports.where(~skipped).join(whole, "file", "left_anti").join(imports.select("file", "name").distinct(), ["file", "name"], "left_anti")


def resolved(refs: DataFrame, known: list[DataFrame]) -> DataFrame:
    """refs(ref, key_0, key_1, ...) with target and strategy: the first of known[i](key, target) that knows key_i. A key that stands for several
    targets does not tell; each strategy sees what those before it left."""
    left, out = refs, None
    for i, k in enumerate(known):
        one = k.groupBy("key").agg(F.min("target").alias("target"), F.countDistinct("target").alias("of")).where("of = 1").select(F.col("key").alias(f"key_{i}"), "target")
        met = left.join(one, f"key_{i}").select("ref", "target", F.lit(i).alias("strategy"))
        out = met if out is None else out.union(met)
        left = left.join(one.select(f"key_{i}"), f"key_{i}", "left_anti")
    return out.union(left.select("ref", F.lit(None).cast(out.schema["target"].dataType), F.lit(None).cast("int")))
