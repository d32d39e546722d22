"""Labelled ordered trees: features, weighted edit distance with bounds, verification of pairs of fragments, leader clusters.

A tree is (labels, parents) in document order, parents before children, the root's parent -1. A label may hold detail in brackets behind its base
type, as in identifier(count).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrel.operators.similarity import jaccard, near_size

Tree = tuple[list[str], list[int]]
# What a node weighs by its category, and how alike two labels are.
WEIGHTS = {"structural": 1.5, "control": 1.3, "expression": 0.8, "other": 1.0}
SAME_BASE, RELATED, SAME_CATEGORY = 0.8, 0.5, 0.3
LITERALS = ("string", "number", "literal", "true", "false", "null", "char", "int", "float")


def base_type(label: str) -> str:
    return label.split("(", 1)[0]


@dataclass(frozen=True)
class Costs:
    """Costs of edits by categories of base types and pairs of related ones; the defaults make every edit cost one."""

    categories: dict[str, str] = field(default_factory=dict)
    related: frozenset[frozenset[str]] = frozenset()
    weighted: bool = False
    ignore_literals: bool = False
    ignore_identifiers: bool = False

    def node(self, label: str) -> float:
        """Of inserting or deleting a node."""
        return WEIGHTS[self.categories.get(base_type(label), "other")] if self.weighted else 1.0

    def rename(self, a: str, b: str) -> float:
        if a == b:
            return 0.0
        x, y = base_type(a), base_type(b)
        if (self.ignore_literals and x in LITERALS and y in LITERALS) or (self.ignore_identifiers and x == y and "identifier" in x):
            return 0.0
        if not self.weighted:
            return 1.0
        if x == y:
            return 1 - SAME_BASE
        if frozenset((x, y)) in self.related:
            return 1 - RELATED
        c = self.categories.get(x, "other")
        return 1 - SAME_CATEGORY if c != "other" and c == self.categories.get(y, "other") else 1.0


def children(t: Tree) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in t[0]]
    for i, p in enumerate(t[1]):
        if p >= 0:
            out[p].append(i)
    return out


def height(t: Tree) -> int:
    depth = [1] * len(t[0])
    for i, p in enumerate(t[1]):
        if p >= 0:
            depth[i] = depth[p] + 1
    return max(depth, default=0)


def _post(t: Tree) -> tuple[list[str], list[int], list[int]]:
    """Labels and leftmost leaves in post-order, and the keyroots in order."""
    kids, order, todo = children(t), [], [(i, False) for i, p in enumerate(t[1]) if p < 0][::-1]
    while todo:
        n, done = todo.pop()
        if done:
            order.append(n)
        else:
            todo += [(n, True), *((c, False) for c in reversed(kids[n]))]
    place = {n: i for i, n in enumerate(order)}
    left: list[int] = []
    for i, n in enumerate(order):
        left.append(left[place[kids[n][0]]] if kids[n] else i)
    return [t[0][n] for n in order], left, sorted({v: i for i, v in enumerate(left)}.values())


def distance(a: Tree, b: Tree, costs: Costs | None = None) -> float:
    """Weighted edit distance, exact, by the keyroot programme over post-order."""
    costs = costs or Costs()
    (la, lefta, rootsa), (lb, leftb, rootsb) = _post(a), _post(b)
    gone, new = [costs.node(x) for x in la], [costs.node(x) for x in lb]
    renames: dict[tuple[str, str], float] = {}
    d = [[0.0] * len(lb) for _ in la]
    if not la or not lb:
        return sum(gone) + sum(new)
    for i in rootsa:
        for j in rootsb:
            x0, y0 = lefta[i], leftb[j]
            row = [0.0]
            for y in range(y0, j + 1):
                row.append(row[-1] + new[y])
            rows = [row]
            for x in range(x0, i + 1):
                above, here = rows[-1], [rows[-1][0] + gone[x]]
                whole = lefta[x] == x0
                for y in range(y0, j + 1):
                    best = min(above[y - y0 + 1] + gone[x], here[-1] + new[y])
                    if whole and leftb[y] == y0:
                        key = (la[x], lb[y])
                        if key not in renames:
                            renames[key] = costs.rename(*key)
                        best = min(best, above[y - y0] + renames[key])
                        d[x][y] = best
                    else:
                        best = min(best, rows[lefta[x] - x0][leftb[y] - y0] + d[x][y])
                    here.append(best)
                rows.append(here)
    return d[-1][-1]


def label_bound(a: Iterable[str], b: Iterable[str], costs: Costs | None = None) -> float:
    """No tree of labels a is nearer to one of labels b: labels that are not shared are deleted or renamed to the nearest label of the other side."""
    costs = costs or Costs()
    x, y = Counter(a), Counter(b)

    def side(own: Counter, other: Counter) -> float:
        return sum(n * min([costs.node(w), *(costs.rename(w, v) for v in other if v != w)]) for w, n in sorted((own - other).items()))

    return max(side(x, y), side(y, x))


def size_bound(n: int, m: int, costs: Costs | None = None) -> float:
    return abs(n - m) * (min(WEIGHTS.values()) if costs and costs.weighted else 1.0)


def shape_histograms(t: Tree) -> tuple[Counter, Counter]:
    """How many nodes stand on each level and have each number of children."""
    depth = [0] * len(t[0])
    for i, p in enumerate(t[1]):
        depth[i] = depth[p] + 1 if p >= 0 else 0
    return Counter(depth), Counter(map(len, children(t)))


def shape_profile(a: Tree, b: Tree) -> float:
    """Half of what the histograms of shape differ by, the greater of both: a profile, not a bound."""
    differ = lambda x, y: sum(abs(x[k] - y[k]) for k in set(x) | set(y)) / 2
    return max(differ(x, y) for x, y in zip(shape_histograms(a), shape_histograms(b), strict=True))


def same_shape(a: Tree, b: Tree) -> bool:
    return a[1] == b[1]


def bounded_distance(a: Tree, b: Tree, limit: float, costs: Costs | None = None) -> float:
    """The distance up to limit, or limit + 1 beyond it; sizes and labels rule most pairs out before the programme runs."""
    if max(size_bound(len(a[0]), len(b[0]), costs), label_bound(a[0], b[0], costs)) > limit:
        return limit + 1
    d = distance(a, b, costs)
    return d if d <= limit else limit + 1


def similarity(d: float, n: int, m: int, by: str = "max") -> float:
    """1 for two empty trees, 0 if one is; else one less the distance, cut at the greater size (or the sum), over it."""
    if not n or not m:
        return float(n == m)
    most = n + m if by == "sum" else max(n, m)
    return 1 - min(d, most) / most


def leaders(trees: list[Tree | None], threshold: float, costs: Costs | None = None) -> list[list[int]]:
    """Each tree that has no leader leads all later ones without one that are alike by the threshold; missing trees are left out."""
    out, taken = [], set()
    for i, t in enumerate(trees):
        if t is None or i in taken:
            continue
        group = [i]
        for j in range(i + 1, len(trees)):
            u = trees[j]
            if u is not None and j not in taken:
                most = max(len(t[0]), len(u[0]))
                if most and 1 - bounded_distance(t, u, (1 - threshold) * most + 1e-9, costs) / most >= threshold - 1e-12:
                    group.append(j)
                    taken.add(j)
        out.append(group)
    return out


# ---- features ----


def _digest(text: str) -> str:
    return blake2b(text.encode(), digest_size=8).hexdigest()


def features(t: Tree, k: int = 4, tall: int = 3, literals: bool = True, patterns: tuple[str, ...] = ()) -> list[str]:
    """Sorted distinct features: sub (subtrees up to a height), kgram (runs of k labels in document order), type (base types), typedist (how often, in
    bins) and pattern (those of patterns that occur as base types). literals=False drops detail in brackets and literals' labels."""
    labels, parents = t
    plain = [w if literals else "literal" if base_type(w) in LITERALS else base_type(w) for w in labels]
    kids = children(t)
    tallness, hashed, out = [1] * len(labels), [""] * len(labels), set()
    for i in range(len(labels) - 1, -1, -1):
        tallness[i] = 1 + max((tallness[c] for c in kids[i]), default=0)
        hashed[i] = _digest(plain[i] + "(" + ",".join(hashed[c] for c in kids[i]) + ")")
        if tallness[i] <= tall:
            out.add(f"sub:{hashed[i]}")
    out |= {"kgram:" + " ".join(plain[i : i + k]) for i in range(len(plain) - k + 1)}
    counts = Counter(map(base_type, plain))
    bins = lambda n: "1" if n <= 1 else "2-3" if n <= 3 else "4-7" if n <= 7 else "8-15" if n <= 15 else "16+"
    out |= {f"type:{w}" for w in counts} | {f"typedist:{w}:{bins(n)}" for w, n in counts.items()} | {f"pattern:{p}" for p in patterns if p in counts}
    return sorted(out)


def admitted(n_nodes: int, n_lines: int, least_nodes: int = 20, least_lines: int = 10) -> bool:
    return n_nodes >= least_nodes and n_lines >= least_lines


# ---- pairs of fragments ----

FRAGMENT = "id long, file string, s long, e long, lines long, digest string, labels array<string>, parents array<int>"


def with_features(fragments: DataFrame, literals: bool = True) -> DataFrame:
    """fragments(id, labels, parents, ...) with their features, built once for each."""
    names = fragments.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.copy()
            out["features"] = [features((list(x), list(y)), literals=literals) for x, y in zip(b["labels"], b["parents"], strict=True)]
            yield out[[*names, "features"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fragments.schema)
    return fragments.mapInPandas(run, f"{kinds}, features array<string>")


def verified(pairs: DataFrame, fragments: DataFrame, thresholds: tuple[float, ...] = (0.85, 0.8, 0.8), limit: float = 50, least: float = 0.8, costs: Costs | None = None) -> DataFrame:
    """a, b, distance, similarity, kind of the copies among pairs(a, b) of FRAGMENT rows with features: pairs that overlap, that sizes or a tenth of
    common features rule out, whose trees are further apart than limit, or that reach no kind or not `least`, are gone.

    Kind 1 needs equal digests; others stay just below its threshold. Kind 2 takes the lesser of that and of the likeness of features without literals.
    """
    blind = with_features(fragments.select("id", "labels", "parents"), literals=False).select("id", F.col("features").alias("blind"))
    full = fragments.join(blind, "id")
    side = lambda p: full.select(F.col("id").alias(p), F.struct(*[c for c in full.columns if c != "id"]).alias(f"f{p}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    x, y = F.col("fa"), F.col("fb")
    apart = (x["file"] != y["file"]) | (x["e"] < y["s"]) | (y["e"] < x["s"])
    rough = (F.size(x["features"]) == 0) | (F.size(y["features"]) == 0) | (jaccard(x["features"], y["features"]) >= 0.1)
    kept = met.where(apart & near_size(F.size(x["labels"]), F.size(y["labels"]), x["lines"], y["lines"]) & rough)
    kept = kept.select("a", "b", x["labels"].alias("la"), x["parents"].alias("pa"), y["labels"].alias("lb"), y["parents"].alias("pb"), (F.coalesce(x["digest"] == y["digest"], F.lit(False)) & (x["digest"] != "")).alias("same"), jaccard(x["blind"], y["blind"]).alias("blind"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                t, u = (list(r.la), list(r.pa)), (list(r.lb), list(r.pb))
                d = bounded_distance(t, u, limit, costs)
                if d > limit:
                    continue
                sim = similarity(d, len(t[0]), len(u[0]))
                kind, sim = classify(sim, bool(r.same), float(r.blind), thresholds)
                if kind and sim >= least:
                    rows.append((r.a, r.b, d, sim, kind))
            yield pd.DataFrame(rows, columns=["a", "b", "distance", "similarity", "kind"])

    return kept.mapInPandas(run, "a long, b long, distance double, similarity double, kind long")


def classify(sim: float, same: bool, blind: float, thresholds: tuple[float, ...]) -> tuple[int, float]:
    """(kind, similarity): 1 for equal text; 2 where both the capped similarity and the likeness without literals reach it, the lesser of both; then
    the first later threshold that the capped similarity reaches; 0 if none."""
    if same and sim >= thresholds[0]:
        return 1, sim
    capped = min(sim, max(math.nextafter(thresholds[0], 0), thresholds[1] if thresholds[1] >= thresholds[0] else 0))
    if capped >= thresholds[1] and blind >= thresholds[1]:
        return 2, min(capped, blind)
    for kind, least in enumerate(thresholds[2:], 3):
        if capped >= least:
            return kind, capped
    return 0, capped
