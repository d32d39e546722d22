"""Text features, exact copies, containment, edit distance of strings and of ordered trees, paired tests."""

from __future__ import annotations

import math
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrel.operators import setjoin


def _runs(text: Column, k: int) -> Column:
    """Structs of each run of k words of a text (words are parted by white space). Shifted copies are zipped: a lambda that held the words
    would evaluate them for every run."""
    ws = F.filter(F.split(F.lower(text), r"[ \t\r\n]+"), lambda w: w != "")
    n = F.greatest(F.size(ws) - k + 1, F.lit(0))
    return F.arrays_zip(*[F.slice(ws, F.lit(j + 1), n).alias(f"w{j}") for j in range(k)])


def grams(text: Column, k: int) -> Column:
    """The distinct runs of k words, in order of first place."""
    return F.array_distinct(F.transform(_runs(text, k), lambda z: F.concat_ws(" ", *[z[f"w{j}"] for j in range(k)])))


def gram_hashes(text: Column, k: int) -> Column:
    """The distinct 64-bit hashes of the runs of k words."""
    return F.array_distinct(F.transform(_runs(text, k), lambda z: F.xxhash64(*[z[f"w{j}"] for j in range(k)])))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def ladder(same: Column, sim: Column, steps: tuple[float, ...] = (0.85, 0.75, 0.7, 0.65)) -> tuple[Column, Column]:
    """(kind of copy, similarity): kind 1 needs equal text; others stay just below its threshold, and take the strongest kind they reach."""
    first = same & (sim >= steps[0])
    capped = F.when(first, sim).otherwise(F.least(sim, F.lit(steps[0] - 1e-12)))
    kind = F.when(first, 1)
    for i, least in enumerate(steps[1:], 2):
        kind = kind.when(capped >= least, i)
    return kind.otherwise(0), capped


def near_size(nodes_a: Column, nodes_b: Column, lines_a: Column, lines_b: Column) -> Column:
    """False where sizes alone rule a copy out: nodes differ by over half of their mean, or lines by over half of both."""
    mean, lines = (nodes_a + nodes_b) / 2, F.abs(lines_a - lines_b)
    return ~((mean > 0) & (F.abs(nodes_a - nodes_b) > 0.5 * mean)) & ~((lines > lines_a * 0.5) & (lines > lines_b * 0.5))


def overlap(x: Column, y: Column) -> Column:
    """Two structs of file, s and e have a line in common."""
    return (x["file"] == y["file"]) & ~((x["e"] < y["s"]) | (y["e"] < x["s"]))


def confidence(sim: Column, nodes_a: Column, nodes_b: Column, complexity_a: Column, complexity_b: Column) -> Column:
    """Similarity, up to 0.2 more for large fragments and up to 0.1 for equal complexity; 1 at most."""
    ratio = F.when((complexity_a > 0) & (complexity_b > 0), F.least(complexity_a, complexity_b) / F.greatest(complexity_a, complexity_b)).otherwise(0.0)
    return F.least(F.lit(1.0), sim + F.least((nodes_a + nodes_b) / 200, F.lit(0.2)) + 0.1 * ratio)


def count_likeness(a: Column, b: Column) -> Column:
    """1 for equal counts, less the share of the greater by which they differ."""
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top == 0, 1.0).otherwise(1 - F.try_divide(F.abs(a - b).cast("double"), top.cast("double")))


def cosine(a: list[Column], b: list[Column]) -> Column:
    """Of two histograms over one list of bins: 1 if both are empty, 0 if one is."""
    dot = lambda x, y: sum((p * q for p, q in zip(x, y, strict=True)), F.lit(0)).cast("double")
    return F.when((dot(a, a) == 0) & (dot(b, b) == 0), 1.0).otherwise(F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


def flow_likeness(x: Column, y: Column) -> Column:
    """Weighted likeness of two structs of graph.flow_features."""
    weights = {"blocks": 0.2, "edges": 0.15, "cyclomatic": 0.25, "branching": 0.1, "turns": 0.05}  # fixed values
    kinds = ("loops", "conds", "plain")
    return sum((w * count_likeness(x[c], y[c]) for c, w in weights.items()), 0.25 * cosine([x[k] for k in kinds], [y[k] for k in kinds]))


def duplication(items: DataFrame, key: str) -> DataFrame:
    """Per key: fragments, those whose normalised text occurs again anywhere, and their percentage. Counted by digest before any join."""
    per = items.where("text is not null").select(key, F.sha2(normalised(F.col("text")), 256).alias("digest")).groupBy("digest", key).agg(F.count(F.lit(1)).alias("n"))
    again = per.groupBy("digest").agg(F.sum("n").alias("of"))
    counts = per.join(again, "digest").groupBy(key).agg(F.sum("n").alias("fragments"), F.sum(F.when(F.col("of") > 1, F.col("n")).otherwise(0)).alias("clones"))
    return counts.select(key, "fragments", "clones", F.round(100.0 * F.col("clones") / F.col("fragments"), 6).alias("duplication"))


def membership(items: DataFrame, key: str) -> DataFrame:
    """Per key: fragments, members of groups of equal normalised text, and groups. Digests are counted per key before the groups are known."""
    per = items.where("text is not null").select(key, F.sha2(normalised(F.col("text")), 256).alias("digest")).groupBy("digest", key).agg(F.count(F.lit(1)).alias("n"))
    again = per.groupBy("digest").agg(F.sum("n").alias("of"))
    inside = F.col("of") > 1
    return per.join(again, "digest").groupBy(key).agg(F.sum("n").alias("fragments"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("members"), F.count(F.when(inside, 1)).alias("groups"))


def exact_groups(items: DataFrame) -> DataFrame:
    """Groups of two or more of items(id, text) with equal normalised text: digest, size, least id. Texts do not leave their task."""
    return items.where("text is not null").select("id", F.sha2(normalised(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.count("id").alias("size"), F.min("id").alias("first_id")).where("size > 1")


def containment(items: DataFrame, probes: DataFrame, k: int = 8) -> DataFrame:
    """Shared k-grams of items(id, text) and probes(pid, text), and their share of the probe: an equi-join on gram hashes."""
    left = items.select("id", F.explode(gram_hashes(F.col("text"), k)).alias("g"))
    right = probes.select("pid", F.explode(gram_hashes(F.col("text"), k)).alias("g"))
    size = right.groupBy("pid").agg(F.count("g").alias("of"))
    shared = left.join(right, "g").groupBy("id", "pid").agg(F.count("g").alias("shared"))
    return shared.join(size, "pid").select("id", "pid", "shared", F.round(F.col("shared") / F.col("of"), 6).alias("containment"))


def copies(items: DataFrame, k: int = 4, percent: int = 65) -> DataFrame:
    """Kind and similarity of all copies among items(id, text), whatever their ids.

    Items of equal normalised text are one class: its least id is paired with each other member (kind 1). Least ids of classes whose runs of k
    words have a Jaccard similarity of at least percent are paired (kind 2 and up). The search of setjoin is complete. Runs are compared by
    64-bit hashes. Empty texts have no copies, and texts under k words only equal ones.
    """
    known, pairs = setjoin.alike(items, k, percent)
    least = known.groupBy("digest").agg(F.min("id").alias("a"))
    equal = known.distinct().join(least, "digest").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1).cast("long").alias("kind"), F.lit(1.0).alias("similarity"))
    kind, capped = ladder(F.lit(False), F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return equal.union(pairs.select("a", "b", kind.cast("long").alias("kind"), F.round(capped, 6).alias("similarity")))


def levenshtein_pairs(items: DataFrame, block: str) -> DataFrame:
    """Byte edit distance and similarity of all pairs of items(id, text, block) in a block; blocks are small by contract."""
    raw = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    a = items.select(F.col("id").alias("a"), block, raw.alias("x"))
    b = items.select(F.col("id").alias("b"), block, raw.alias("y"))
    d = F.levenshtein("x", "y").cast("long")
    longest = F.greatest(F.length("x"), F.length("y"))
    return a.join(b, block).where("a < b").select("a", "b", d.alias("distance"), F.round(F.when(longest > 0, 1 - d / longest).otherwise(1.0), 6).alias("similarity"))


class _Tags(HTMLParser):
    """Labels and parents of a page's elements in document order; unclosed elements end with their parents."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.labels, self.parents, self.open = ["#root"], [-1], [0]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.labels.append(tag)
        self.parents.append(self.open[-1])
        if tag not in self.VOID:
            self.open.append(len(self.labels) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.labels[self.open[i]] == tag:
                del self.open[i:]
                break


def tree(html: str | None) -> tuple[list[str], list[int]]:
    p = _Tags()
    p.feed(html or "")
    return p.labels, p.parents


def nesting(pages: DataFrame) -> DataFrame:
    """page_id, elements and greatest depth of pages(page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, html in zip(b["page_id"], b["html"], strict=True):
                labels, parents = tree(html)
                depth = [0] * len(labels)
                for j in range(1, len(labels)):
                    depth[j] = depth[parents[j]] + 1
                out.append((i, len(labels) - 1, max(depth)))
            yield pd.DataFrame(out, columns=["page_id", "elements", "depth"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, elements long, depth long")


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
    """Edit distance of two ordered trees with unit costs, by the keyroot dynamic programme over post-order, at any size.

    The forests of all keyroots of b lie side by side in one row, nested ones first, so a row is a few array operations. A running minimum
    stays within a forest as each lies lower than the one before. Rows are kept while a subtree to their right is open.
    """

    def order(t: tuple[list[str], list[int]]) -> tuple[list[str], list[int], list[int], dict[int, int]]:
        """Labels, parents and leftmost leaves in post-order, and the keyroot of each leftmost leaf."""
        labels, parents = t
        kids: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                kids[p].append(i)
        post, todo = [], [(0, False)]
        while todo:
            n, done = todo.pop()
            if done:
                post.append(n)
            else:
                todo.append((n, True))
                todo += [(c, False) for c in reversed(kids[n])]
        place = {n: i for i, n in enumerate(post)}
        left = [0] * len(post)
        for i, n in enumerate(post):
            left[i] = left[place[kids[n][0]]] if kids[n] else i
        roots = {}
        for i, v in enumerate(left):
            roots[v] = i
        return [labels[n] for n in post], [place.get(parents[n], -1) for n in post], left, roots

    if a == b:
        return 0
    la, _, lefta, rootsa = order(a)
    lb, up, leftb, rootsb = order(b)
    level = dict.fromkeys(sorted(rootsb.values()), 0)
    for r in level:
        if up[r] >= 0:
            above = rootsb[leftb[up[r]]]
            level[above] = max(level[above], level[r] + 1)
    parts: list[list[int]] = [[] for _ in range(max(level.values()) + 1)]
    for r, k in level.items():
        parts[k].append(r)

    zero, shift, blocks, at, far = [], [], [], 0, 4 * (len(la) + len(lb) + 1)
    for roots in parts:
        begin, path, side = at, [], []
        for r in roots:
            lo = leftb[r]
            zero.append(np.arange(r - lo + 2))
            shift.append(zero[-1] + len(shift) * far)
            for y in range(lo, r + 1):
                (path if leftb[y] == lo else side).append((at + y - lo + 1, y, at + leftb[y] - lo))
            at += r - lo + 2
        blocks.append((slice(begin, at), *(np.array(x, np.int64).reshape(-1, 3).T for x in (path, side))))
    zero, shift = np.concatenate(zero), np.concatenate(shift)
    col, node, before = np.concatenate([x for b3 in blocks for x in b3[1:]], axis=1)
    code = {w: k for k, w in enumerate(dict.fromkeys(la + lb))}
    names = np.array([code[w] for w in lb])

    d = np.zeros((len(la), len(lb)), np.int32)
    for i in sorted(rootsa.values()):
        row, kept = zero, {}
        for x in range(lefta[i], i + 1):
            new = row + 1
            if lefta[x] == lefta[i]:
                for part, (pc, pn, _), (sc, sn, sb) in blocks:
                    new[pc] = np.minimum(new[pc], row[pc - 1] + (names[pn] != code[la[x]]))
                    new[sc] = np.minimum(new[sc], zero[sb] + d[x, sn])
                    new[part] = np.minimum.accumulate(new[part] - shift[part]) + shift[part]
                    d[x, pn] = new[pc]
            else:
                if lefta[x] == x:
                    kept[x] = row
                new[col] = np.minimum(new[col], kept[lefta[x]][before] + d[x, node])
                new = np.minimum.accumulate(new - shift) + shift
                if rootsa[lefta[x]] == x:
                    del kept[lefta[x]]
            row = new
    return int(d[-1, -1])


def neighbours_tree_distance(pages: DataFrame) -> DataFrame:
    """Distance and similarity of each page's element tree to that of the next page_id, exact at every size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for a, c, x, y in zip(b["a"], b["b"], b["x"], b["y"], strict=True):
                s, t = tree(x), tree(y)
                big = max(len(s[0]), len(t[0]))
                d = tree_distance(s, t)
                out.append((a, c, d, round(1 - min(d, big) / big, 6)))
            yield pd.DataFrame(out, columns=["a", "b", "distance", "similarity"])

    one = pages.select(F.col("page_id").alias("a"), F.col("html").alias("x"))
    two = pages.select((F.col("page_id") - 1).alias("a"), F.col("page_id").alias("b"), F.col("html").alias("y"))
    return one.join(two, "a").select("a", "b", "x", "y").mapInPandas(run, "a long, b long, distance long, similarity double")


def mcnemar(pairs: DataFrame, key: str) -> DataFrame:
    """Discordant counts of pairs(key, before, after) per key and the exact two-sided binomial p."""

    @F.pandas_udf("double")
    def exact_p(b: pd.Series, c: pd.Series) -> pd.Series:
        def p(x: int, y: int) -> float:
            n, k = x + y, min(x, y)
            if not n:
                return 1.0
            log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
            return min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(k + 1)))

        return pd.Series([round(p(int(x), int(y)), 6) for x, y in zip(b, c, strict=True)])

    worse, better = F.count(F.when(F.col("before") & ~F.col("after"), 1)), F.count(F.when(~F.col("before") & F.col("after"), 1))
    counts = pairs.groupBy(key).agg(worse.alias("worse"), better.alias("better"))
    return counts.select(key, "worse", "better", exact_p("worse", "better").alias("p"))
