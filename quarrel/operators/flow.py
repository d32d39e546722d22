"""Control flow and data flow of many functions at once, over tables.

blocks(fn, block, entry), edges(fn, src, dst, kind), stmts(fn, block, pos, kind): kinds of edges are normal, cond_true, cond_false, loop,
exception, return, break and continue; kinds of statements that end a block are return, throw, break and continue, and noop says nothing.
refs(fn, block, pos, name, role, kind) are definitions (role def) and uses (role use) of names. Every function is independent of the others, so keys
spread them; loops over blocks are rounds of joins on (fn, block), each written, as many as the longest way through one function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrel.operators.similarity import cosine, count_likeness
from quarrel.plans import scratch, written

ENDS = ("return", "throw", "break", "continue")
_CONDS = ("cond_true", "cond_false")


def ending_blocks(stmts: DataFrame) -> DataFrame:
    """(fn, block) that hold a terminator anywhere."""
    return stmts.where(F.col("kind").isin(*ENDS)).select("fn", "block").distinct()


def live_blocks(blocks: DataFrame, edges: DataFrame, stmts: DataFrame) -> DataFrame:
    """(fn, block) reached from the entry; normal edges out of a block with a terminator are not followed, all others are."""
    spark, path = blocks.sparkSession, scratch(blocks.sparkSession, "live")
    ends = ending_blocks(stmts).withColumnRenamed("block", "src").withColumn("ends", F.lit(True))
    open_edges = written(edges.join(ends, ["fn", "src"], "left").where("ends is null or kind <> 'normal'").select("fn", "src", "dst").distinct(), "open-edges")
    front = written(blocks.where("entry").select("fn", "block").distinct(), "front")
    while True:
        front.write.mode("append").parquet(path)
        seen = spark.read.schema(front.schema).parquet(path)
        if not front.take(1):
            return seen
        step = front.withColumnRenamed("block", "src").join(open_edges, ["fn", "src"]).select("fn", F.col("dst").alias("block")).distinct()
        front = written(step.join(seen, ["fn", "block"], "left_anti"), "front")


def dead_code(blocks: DataFrame, edges: DataFrame, stmts: DataFrame, empty: bool = True) -> DataFrame:
    """fn, block, reason, severity: blocks out of reach (critical), unless they hold nothing but no-ops, or nothing at all and empty is off; and in reachable blocks the first
    terminator that something follows (warning after return and throw, info after break and continue)."""
    live = written(live_blocks(blocks, edges, stmts), "live").withColumn("live", F.lit(True))
    per = stmts.groupBy("fn", "block").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "noop", 1)).alias("noops"), F.max("pos").alias("last"), F.min(F.when(F.col("kind").isin(*ENDS), F.struct("pos", "kind"))).alias("end"))
    met = blocks.select("fn", "block").distinct().join(live, ["fn", "block"], "left").join(per, ["fn", "block"], "left")
    idle = F.coalesce((F.col("n") > 0) & (F.col("n") == F.col("noops")), F.lit(not empty))
    follows = F.col("end.pos") < F.col("last")
    reason = F.when(F.col("live").isNull() & ~idle, "unreachable").when(F.col("live") & follows, F.concat(F.lit("after_"), F.col("end.kind")))
    severity = F.when(F.col("reason") == "unreachable", "critical").when(F.col("reason").isin("after_return", "after_throw"), "warning").otherwise("info")
    return met.select("fn", "block", reason.alias("reason")).where("reason is not null").withColumn("severity", severity)


def dead_code_by_function(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """fn, blocks, dead, ratio, critical, warning, info for every function; found: dead_code()."""
    size = blocks.groupBy("fn").agg(F.countDistinct("block").alias("blocks"))
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    per = found.groupBy("fn").agg(F.count(F.lit(1)).alias("dead"), count("critical"), count("warning"), count("info"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    met = size.join(per, "fn", "left").select("fn", "blocks", *map(zero, ("dead", "critical", "warning", "info")))
    return met.withColumn("ratio", F.round(F.col("dead") / F.col("blocks"), 6))


def complexity(blocks: DataFrame, edges: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """fn, decisions, extras, complexity: a block's distinct conditional targets less one, one more for a block with an exception edge, what
    extras(fn, n) add (logical operators and the like), and one."""
    per = edges.groupBy("fn", "src").agg(F.countDistinct(F.when(F.col("kind").isin(*_CONDS), F.col("dst"))).alias("targets"), F.max((F.col("kind") == "exception").cast("int")).alias("raises"))
    decisions = per.groupBy("fn").agg(F.sum(F.greatest(F.col("targets") - 1, F.lit(0)) + F.col("raises")).alias("decisions"))
    met = blocks.select("fn").distinct().join(decisions, "fn", "left")
    met = met.join(extras.groupBy("fn").agg(F.sum("n").alias("extras")), "fn", "left") if extras is not None else met.withColumn("extras", F.lit(0).cast("long"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return met.select("fn", zero("decisions").alias("decisions"), zero("extras").alias("extras"), (zero("decisions") + zero("extras") + 1).alias("complexity"))


EDGE_KINDS = ("normal", "cond_true", "cond_false", "loop", "exception", "return", "break", "continue")


def shape(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """fn, blocks, edges, cyclomatic (edges - blocks + 2), branching (mean successors of blocks with two or more; 0 if none), turns (loop and
    conditional edges), and a count of edges of each kind."""
    size = blocks.groupBy("fn").agg(F.countDistinct("block").alias("blocks"))
    out = edges.groupBy("fn", "src").agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in EDGE_KINDS])
    per = out.groupBy("fn").agg(F.sum("n").alias("edges"), F.avg(F.when(F.col("n") > 1, F.col("n"))).alias("branching"), *[F.sum(k).alias(k) for k in EDGE_KINDS])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    met = size.join(per, "fn", "left").select("fn", "blocks", zero("edges"), F.coalesce(F.round("branching", 6), F.lit(0.0)).alias("branching"), *map(zero, EDGE_KINDS))
    return met.withColumn("cyclomatic", F.col("edges") - F.col("blocks") + 2).withColumn("turns", F.col("loop") + F.col("cond_true") + F.col("cond_false"))


def shape_likeness(x: Column, y: Column) -> Column:
    """Of two structs of shape()."""
    weights = {"blocks": 0.2, "edges": 0.15, "cyclomatic": 0.25, "branching": 0.1, "turns": 0.05}  # fixed values
    return sum((w * count_likeness(x[c], y[c]) for c, w in weights.items()), 0.25 * cosine([x[k] for k in EDGE_KINDS], [y[k] for k in EDGE_KINDS]))


def def_use(blocks: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """fn, name, use_block, use_pos, def_block, def_pos: the definition that reaches each use, if any.

    The latest before it in its own block (one of kind pattern may share its place); else the latest of the nearest block on the ways that lead
    there, by number of edges, of equally near ones the least block. Uses that are met leave the rounds.
    """
    key = ["fn", "name", "block"]
    defs = refs.where("role = 'def'").select(*key, "pos", "kind")
    uses = refs.where("role = 'use'").select(*key, F.col("pos").alias("use_pos")).distinct()
    here = uses.join(defs, key).where("pos < use_pos or (kind = 'pattern' and pos = use_pos)").groupBy(*key, "use_pos").agg(F.max("pos").alias("def_pos"))
    here = written(here.select("fn", "name", F.col("block").alias("use_block"), "use_pos", F.col("block").alias("def_block"), "def_pos"), "pairs")
    left = uses.select("fn", "name", F.col("block").alias("use_block"), "use_pos").join(here, ["fn", "name", "use_block", "use_pos"], "left_anti")
    last = written(defs.groupBy(*key).agg(F.max("pos").alias("def_pos")), "last-defs")
    back = written(edges.where("src <> dst").select("fn", F.col("dst").alias("block"), F.col("src").alias("to")).distinct(), "back")
    # Uses of one name in one block look the same way, so the rounds are over (fn, name, block).
    front = written(left.select("fn", "name", "use_block", F.col("use_block").alias("block")).distinct(), "front")
    known = front.select("fn", "name", "use_block", "block")
    done, one = None, ["fn", "name", "use_block"]
    while front.take(1):
        step = front.join(back, ["fn", "block"]).select(*one, F.col("to").alias("block")).distinct()
        step = written(step.join(known, [*one, "block"], "left_anti"), "step")
        met = step.join(last, key).groupBy(*one).agg(F.min(F.struct("block", "def_pos")).alias("m"))
        met = written(met.select(*one, F.col("m.block").alias("def_block"), F.col("m.def_pos").alias("def_pos")), "met")
        done = met if done is None else done.union(met)
        front = written(step.join(met, one, "left_anti"), "front")
        known = written(known.union(front), "known")
    far = left.join(done, one).select(here.columns) if done is not None else here.limit(0)
    return here.union(far)


def flow_facts(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """fn, defs, uses, names, pairs, chain (mean references of a name), crossing (share of pairs between blocks), and a count of every kind of
    definition and use as one sorted text."""
    is_def = F.col("role") == "def"
    per = refs.groupBy("fn").agg(F.count(F.when(is_def, 1)).alias("defs"), F.count(F.when(~is_def, 1)).alias("uses"), F.countDistinct("name").alias("names"))
    kinds = refs.groupBy("fn", "role", "kind").agg(F.count(F.lit(1)).alias("n")).groupBy("fn").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "role", "kind", F.col("n").cast("string")))), ",").alias("kinds"))
    linked = pairs.groupBy("fn").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("def_block") != F.col("use_block"), 1)).alias("far"))
    met = per.join(kinds, "fn").join(linked, "fn", "left")
    n = F.coalesce("pairs", F.lit(0))
    return met.select("fn", "defs", "uses", "names", n.alias("pairs"), F.round((F.col("defs") + F.col("uses")) / F.col("names"), 6).alias("chain"), F.when(n > 0, F.round(F.col("far") / n, 6)).otherwise(0.0).alias("crossing"), "kinds")


def facts_likeness(x: Column, y: Column, def_kinds: list[str], use_kinds: list[str]) -> Column:
    """Of two structs with pairs, chain, crossing and a count d_<kind> or u_<kind> for every kind."""
    over = lambda p, kinds: cosine([x[p + k] for k in kinds], [y[p + k] for k in kinds])
    return 0.25 * count_likeness(x["pairs"], y["pairs"]) + 0.2 * count_likeness(x["chain"], y["chain"]) + 0.2 * count_likeness(x["crossing"], y["crossing"]) + 0.2 * over("d_", def_kinds) + 0.15 * over("u_", use_kinds)  # fixed weights


def meaning_likeness(shape_like: Column, facts_like: Column) -> Column:
    return 0.6 * shape_like + 0.4 * facts_like


def with_evidence(base: Column, literals: tuple[Column, Column], signals: tuple[Column, Column], returns: tuple[Column, Column]) -> Column:
    """base, halved if both have two literals or more and share none; else less a quarter if signals or kinds of return exclude each other."""
    meet = lambda a, b: (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)
    apart = (F.size(literals[0]) >= 2) & (F.size(literals[1]) >= 2) & ~F.arrays_overlap(*literals)
    return F.when(base == 0, 0.0).when(apart, base * 0.5).when(~meet(*signals) | ~meet(*returns), base * 0.75).otherwise(base)


def sequence_refs(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with pos, their place under key."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
