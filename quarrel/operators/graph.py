"""Graph operators over edge tables. Loops write each round to the shared folder; the driver sees counts alone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrel.plans import scratch, written

SMALL = 200_000  # distinct edges, counted first, that one task may hold


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for edges(a, b): random-rank contraction, about a constant factor a round on chains and stars alike."""
    e = written(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    names = edges.select(F.col("a").alias("id")).union(edges.select("b")).where("id is not null").distinct()
    labels = written(names.select("id", F.col("id").alias("label")), "labels")
    turn = 0
    while e.take(1):
        turn += 1
        rank = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("r"), F.col(c).alias("n"))
        both = e.union(e.select("b", "a"))
        moves = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("old"), F.least("m", rank("a"))["n"].alias("new"))
        moves = written(moves, "moves")
        labels = written(labels.join(moves, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
        on = lambda side: moves.select(F.col("old").alias(side), F.col("new").alias(f"{side}2"))  # noqa: E731, B023
        e = written(e.join(on("a"), "a").join(on("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct(), "edges")
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")


def coupling(edges: DataFrame, abstractness: DataFrame) -> DataFrame:
    """Afferent and efferent coupling, instability, abstractness and distance of every node of edges(src, dst); abstractness(node, a)."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    sides = e.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("inc")).union(e.select("dst", F.lit(0), F.lit(1)))
    per = sides.groupBy("node").agg(F.sum("inc").alias("ca"), F.sum("out").alias("ce"))
    full = abstractness.join(per, "node", "left").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"), "a")
    inst = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(0.0)
    return full.select("node", "ca", "ce", F.round(inst, 6).alias("instability"), F.round("a", 6).alias("abstractness"), F.round(F.abs(F.col("a") + inst - 1), 6).alias("distance"))


def zones(metrics: DataFrame) -> DataFrame:
    """pain (stable, concrete, far off the main sequence, with two dependents at least), uselessness (unstable, abstract, far off), main_sequence or none."""
    i, a, far = F.col("instability"), F.col("abstractness"), F.col("distance") >= 0.5
    zone = F.when(far & (F.col("ca") >= 2) & (i <= 0.3) & (a <= 0.3), "pain").when(far & (i >= 0.7) & (a >= 0.7), "uselessness")
    return metrics.select("node", zone.when(F.col("distance") <= 0.2, "main_sequence").otherwise("none").alias("zone"))


def node_flags(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """is_entry (nothing leads in) and is_leaf (nothing leads out) for nodes(node)."""
    e = edges.where("src <> dst")
    into, out = e.select(F.col("dst").alias("node")).distinct().withColumn("i", F.lit(1)), e.select(F.col("src").alias("node")).distinct().withColumn("o", F.lit(1))
    return nodes.join(into, "node", "left").join(out, "node", "left").select("node", F.col("i").isNull().alias("is_entry"), F.col("o").isNull().alias("is_leaf"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """node for all that starts(node) lead to, themselves included: frontier joins with an anti-join on what is known. A round adds its front
    to the table of known nodes and rewrites nothing."""
    spark, path = edges.sparkSession, scratch(edges.sparkSession, "seen")
    front = written(starts.select("node").distinct(), "front")
    while True:
        front.write.mode("append").parquet(path)
        seen = spark.read.schema(front.schema).parquet(path)
        if not front.take(1):
            return seen
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = written(step.join(seen, "node", "left_anti"), "front")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more: path doubling, so rounds grow with the logarithm of the longest path."""
    pairs = written(edges.select("src", "dst").distinct(), "pairs")
    n = -1
    while (m := pairs.count()) != n:
        n = m
        longer = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst"))
        pairs = written(pairs.union(longer).distinct(), "pairs")
    return pairs


def neighbours(edges: DataFrame) -> DataFrame:
    """node, successors and predecessors of edges(src, dst), sorted and comma-joined."""
    e = edges.select("src", "dst").distinct()
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), ",")
    out, into = e.groupBy(F.col("src").alias("node")).agg(joined("dst").alias("successors")), e.groupBy(F.col("dst").alias("node")).agg(joined("src").alias("predecessors"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("successors", F.lit("")).alias("successors"), F.coalesce("predecessors", F.lit("")).alias("predecessors"))


def _scc_in_a_task(edges: DataFrame) -> DataFrame:
    """(node, scc) of all nodes of at most SMALL edges, in one task: two depth-first searches, the second against the edges."""
    kind = edges.schema["src"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict = {}
        into: dict = {}
        for part in parts:
            for a, b in zip(part["src"], part["dst"], strict=True):
                out.setdefault(a, []).append(b)
                out.setdefault(b, [])
                into.setdefault(b, []).append(a)
        order, met = [], set()
        for root in sorted(out):
            todo = [] if root in met else [(root, iter(out[root]))]
            met.add(root)
            while todo:
                node, rest = todo[-1]
                for n in rest:
                    if n not in met:
                        met.add(n)
                        todo.append((n, iter(out[n])))
                        break
                else:
                    order.append(todo.pop()[0])
        rows, done = [], set()
        for root in reversed(order):
            if root in done:
                continue
            group, todo = [], [root]
            done.add(root)
            while todo:
                node = todo.pop()
                group.append(node)
                fresh = [n for n in into.get(node, ()) if n not in done]
                done.update(fresh)
                todo += fresh
            rows += [(n, min(group)) for n in group]
        yield pd.DataFrame(rows, columns=["node", "scc"])

    return edges.coalesce(1).mapInPandas(run, f"node {kind}, scc {kind}")


def _scc_by_rounds(e: DataFrame) -> DataFrame:
    """The same in rounds over tables of nodes and edges: nodes without edges in or out are trimmed, each node takes the least node that leads to
    it, and the nodes that lead back to that one inside its class are its component."""
    found = None
    while True:
        n = -1
        while (m := e.count()) != n:
            n = m
            keep = written(e.select(F.col("src").alias("node")).intersect(e.select("dst")), "kept")
            e = written(e.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
        if not n:
            return found
        label = written(e.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("scc")), "least")
        moved = True
        while moved:
            step = label.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.min("scc").alias("got"))
            after = written(label.join(step, F.col("node") == F.col("to"), "left").select("node", F.least("scc", "got").alias("scc"), (F.col("got") < F.col("scc")).alias("moved")), "least")
            moved = bool(after.where("moved").take(1))
            label = after.select("node", "scc")
        of = lambda side: label.select(F.col("node").alias(side), F.col("scc").alias(f"s_{side}"))  # noqa: E731, B023
        inside = written(e.join(of("src"), "src").join(of("dst"), "dst").where("s_src = s_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
        group = written(reachable(inside, label.where("node = scc").select("node")).join(label, "node"), "groups")
        found = group if found is None else found.union(group)
        e = written(e.join(group.select(F.col("node").alias("src")), "src", "left_anti").join(group.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "edges")


def strong(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, scc) of the nodes on a cycle of two nodes or more; scc is its least node. Up to `small` distinct edges, counted first, are
    searched in one task; beyond that by rounds, each of which writes tables no larger than the edges."""
    e = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    found = _scc_in_a_task(e) if e.count() <= small else _scc_by_rounds(e)
    if found is None:
        return e.select(F.col("src").alias("node"), F.col("dst").alias("scc"))
    several = found.groupBy("scc").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("scc")
    return found.join(several, "scc").select("node", "scc")


def _labelled(edges: DataFrame) -> DataFrame:
    """edges with scc_src and scc_dst, which are the nodes themselves off cycles."""
    found = written(strong(edges), "strong")
    on = lambda side: found.select(F.col("node").alias(side), F.col("scc").alias(f"s_{side}"))
    e = edges.join(on("src"), "src", "left").join(on("dst"), "dst", "left")
    return e.withColumn("scc_src", F.coalesce("s_src", "src")).withColumn("scc_dst", F.coalesce("s_dst", "dst"))


def condensation(edges: DataFrame) -> DataFrame:
    """scc_src, scc_dst, links and the least link (src, dst) between every two strongly connected components."""
    least = F.min(F.struct("src", "dst"))
    per = _labelled(edges.select("src", "dst").distinct()).where("scc_src <> scc_dst").groupBy("scc_src", "scc_dst").agg(F.count(F.lit(1)).alias("links"), least.alias("m"))
    return per.select("scc_src", "scc_dst", "links", "m.src", "m.dst")


def break_edges(edges: DataFrame) -> DataFrame:
    """scc, src, dst, weight: the lightest of edges(src, dst, weight) inside each cycle, the first of equals."""
    inside = _labelled(edges.where("src <> dst")).where("scc_src = scc_dst")
    return inside.groupBy(F.col("scc_src").alias("scc")).agg(F.min(F.struct("weight", "src", "dst")).alias("m")).select("scc", "m.src", "m.dst", "m.weight")


def module_risk(metrics: DataFrame) -> DataFrame:
    """Risk of each node by its links and its distance from the main sequence."""
    links, far = F.col("ca") + F.col("ce"), F.col("distance")
    return metrics.select("node", F.when((links >= 10) | (far > 0.5), "high").when((links >= 5) | (far > 0.3), "medium").otherwise("low").alias("risk"))


def flow_features(steps: DataFrame, key: str, order: list[str], block: str) -> DataFrame:
    """Per key: blocks, distinct edges between successive ones by kind (loops, conds out of branching blocks, plain), cyclomatic, branching."""
    s = steps.select(key, F.col(block).alias("at"), F.lead(block).over(Window.partitionBy(key).orderBy(*order)).alias("to"))
    out = s.where("to is not null").distinct().groupBy(key, "at").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at") == F.col("to"), 1)).alias("l"))
    fork, zero = F.col("n") > 1, F.lit(0)
    kinds = out.groupBy(key).agg(F.sum("n").alias("edges"), F.sum("l").alias("loops"), F.sum(F.when(fork, F.col("n") - F.col("l")).otherwise(0)).alias("conds"), F.sum(F.when(fork, 0).otherwise(F.col("n") - F.col("l"))).alias("plain"), F.avg(F.when(fork, F.col("n"))).alias("branching"))
    f = s.groupBy(key).agg(F.countDistinct("at").alias("blocks")).join(kinds, key, "left")
    f = f.select(key, "blocks", *[F.coalesce(c, zero).alias(c) for c in ("edges", "loops", "conds", "plain")], F.coalesce("branching", F.lit(0.0)).alias("branching"))
    return f.withColumn("cyclomatic", F.col("edges") - F.col("blocks") + 2).withColumn("turns", F.col("loops") + F.col("conds"))


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of two nodes or more: id (least node), size, members, severity by size."""
    groups = strong(edges).groupBy("scc").agg(F.count("node").alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list("node")), lambda x: x.cast("string")), ",").alias("members")).where("size > 1")
    return groups.withColumn("severity", F.when(F.col("size") <= 2, "low").when(F.col("size") <= 4, "medium").when(F.col("size") <= 6, "high").otherwise("critical"))


def kcore(edges: DataFrame, k: int = 2) -> DataFrame:
    """Nodes of the undirected k-core: peel until every node keeps k neighbours."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).distinct()
    e, n = written(both, "core"), -1
    while (m := e.count()) != n:
        n = m
        keep = e.groupBy("a").agg(F.count("b").alias("d")).where(F.col("d") >= k).select("a")
        e = written(e.join(keep, "a", "left_semi").join(keep.select(F.col("a").alias("b")), "b", "left_semi").select("a", "b"), "core")
    return e.select(F.col("a").alias("node")).distinct()


def chains(edges: DataFrame) -> DataFrame:
    """scc, size, weight, before for every strongly connected component of edges(src, dst), single nodes included: its nodes, the nodes of
    the heaviest chain of components that ends with it, and the component before it there (the least of equals, null at the start)."""
    marked = written(_labelled(edges.select("src", "dst").distinct()), "labelled")
    nodes = marked.select(F.col("src").alias("node"), F.col("scc_src").alias("scc")).union(marked.select("dst", "scc_dst")).distinct()
    size = written(nodes.groupBy("scc").agg(F.count(F.lit(1)).alias("size")), "sizes")
    links = written(marked.where("scc_src <> scc_dst").select("scc_src", "scc_dst").distinct(), "links")
    at = written(size.select("scc", "size", F.col("size").alias("weight")), "chains")
    while True:  # components have no cycles, so this ends after as many rounds as the longest chain has links
        step = at.select(F.col("scc").alias("scc_src"), "weight").join(links, "scc_src").groupBy(F.col("scc_dst").alias("to")).agg(F.max("weight").alias("got"))
        new = F.greatest(F.col("weight"), F.col("size") + F.coalesce("got", F.lit(0)))
        after = written(at.join(step, F.col("scc") == F.col("to"), "left").select("scc", "size", new.alias("weight"), (new > F.col("weight")).alias("moved")), "chains")
        at = after.select("scc", "size", "weight")
        if not after.where("moved").take(1):
            break
    ends = at.select(F.col("scc").alias("scc_dst"), (F.col("weight") - F.col("size")).alias("rest"))
    met = links.join(at.select(F.col("scc").alias("scc_src"), "weight"), "scc_src").join(ends, "scc_dst").where("weight = rest")
    before = met.groupBy(F.col("scc_dst").alias("to")).agg(F.min("scc_src").alias("before"))
    return at.join(before, F.col("scc") == F.col("to"), "left").select("scc", "size", "weight", "before")


def longest_chain(edges: DataFrame) -> DataFrame:
    """place, scc, size of the heaviest chain of components, from its start; of equal ends the least."""
    c = written(chains(edges), "chains")
    top = c.orderBy(F.col("weight").desc(), "scc").limit(1).select(F.col("scc").alias("node"))
    on = reachable(c.where("before is not null").select(F.col("scc").alias("src"), F.col("before").alias("dst")), top)
    met = c.join(on.withColumnRenamed("node", "scc"), "scc")
    return met.select(F.row_number().over(Window.orderBy("weight")).cast("long").alias("place"), "scc", "size")  # as many rows as the chain has


def entry_chains(edges: DataFrame, n: int = 5) -> DataFrame:
    """node, weight: the n entries (nothing leads in) from which the heaviest chains of components start."""
    flipped = written(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "flipped")
    starts = edges.select(F.col("src").alias("node")).distinct().join(edges.where("src <> dst").select(F.col("dst").alias("node")), "node", "left_anti")
    return starts.join(chains(flipped), F.col("node") == F.col("scc")).orderBy(F.col("weight").desc(), "node").limit(n).select("node", "weight")


def top_chains(edges: DataFrame, n: int = 3) -> DataFrame:
    """rank, scc, weight: the ends of the n heaviest chains of components that no other chain goes on from."""
    c = written(chains(edges), "chains")
    last = c.join(c.where("before is not null").select(F.col("before").alias("scc")), "scc", "left_anti")
    order = [F.col("weight").desc(), F.col("scc")]
    return last.orderBy(*order).limit(n).select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "scc", "weight")


def route(edges: DataFrame, start, end) -> DataFrame:
    """place, node of a shortest way from start to end, the least nodes first; empty if there is none. Rounds of frontier joins, then one walk back
    over nodes that each have one parent."""
    kind = edges.schema["src"].dataType
    front = written(edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(None).cast(kind).alias("parent"), F.lit(0).cast("long").alias("place")), "front")
    seen, place = front, 0
    while front.take(1) and not front.where(F.col("node") == F.lit(end)).take(1):
        place += 1
        step = front.select(F.col("node").alias("src")).join(edges, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.lit(place).cast("long").alias("place"))
        front = written(step.join(seen.select("node"), "node", "left_anti").select("node", "parent", "place"), "front")
        seen = seen.union(front)
    seen = written(seen, "seen")
    back = seen.where("parent is not null").select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    on = reachable(back, seen.where(F.col("node") == F.lit(end)).select("node"))
    return seen.join(on, "node").select("place", "node")


def suggestions(found: DataFrame, lightest: DataFrame) -> DataFrame:
    """scc, suggestion: which link to turn for each of cycles(), and for those of three nodes or more that interfaces may be taken out."""
    link = lightest.select("scc", F.format_string("Remove or invert the dependency of '%s' on '%s' to break the cycle", F.col("src").cast("string"), F.col("dst").cast("string")).alias("suggestion"))
    split = found.where("size >= 3").select("scc", F.concat(F.lit("Extract interfaces for modules: "), F.replace("members", F.lit(","), F.lit(", "))).alias("suggestion"))
    return link.union(split)


def module_graph(imports: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(node, external) and edges(src, dst, kind, weight) of imports(src, target, kind, names) and known(node). Targets that are no known
    module are external nodes; of several imports between two modules the strongest kind names the edge, and an import weighs its names, one at least."""
    rank = F.when(F.col("kind") == "dynamic", 0).when(F.col("kind") == "type_only", 1).otherwise(2)
    per = imports.groupBy("src", F.col("target").alias("dst")).agg(F.min(F.struct(rank.alias("r"), "kind"))["kind"].alias("kind"), F.sum(F.greatest("names", F.lit(1))).cast("long").alias("weight"))
    missing = per.select(F.col("dst").alias("node")).distinct().join(known, "node", "left_anti")
    return known.select("node", F.lit(False).alias("external")).union(missing.select("node", F.lit(True))), per


def load_time(edges: DataFrame) -> DataFrame:
    """Edges that count for cycles and depth: those that are not loaded later."""
    return edges.where("kind <> 'dynamic'")
