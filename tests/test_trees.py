"""Weighted tree distance against the plain recursion, its bounds, features, clusters and the verification of pairs."""

import random
from functools import cache

from quarrel.operators import similarity, trees

COSTS = trees.Costs({"func": "structural", "if": "control", "for": "control", "call": "expression", "add": "expression"}, frozenset({frozenset(("for", "while"))}), weighted=True)
LABELS = ["func", "if", "for", "while", "call", "add", "identifier(a)", "identifier(b)", "number(1)", "number(2)"]


def plain(x, y, costs):
    def nested(t, i=0):
        return (t[0][i], tuple(nested(t, j) for j, p in enumerate(t[1]) if p == i))

    def weight(f):
        return sum(costs.node(w) + weight(k) for w, k in f)

    @cache
    def dist(f, g):
        if not f or not g:
            return weight(f) + weight(g)
        (a, fa), (b, gb) = f[-1], g[-1]
        return min(dist(f[:-1] + fa, g) + costs.node(a), dist(f, g[:-1] + gb) + costs.node(b), dist(f[:-1], g[:-1]) + dist(fa, gb) + costs.rename(a, b))

    return dist((nested(x),), (nested(y),))


def made(rng, n):
    return [rng.choice(LABELS) for _ in range(n)], [-1, *(rng.randint(max(0, i - 3), i) for i in range(n - 1))]


def test_distance_and_bounds():
    rng = random.Random(1)
    for _ in range(150):
        x, y = made(rng, rng.randint(1, 8)), made(rng, rng.randint(1, 8))
        x, y = (sorted_tree(t) for t in (x, y))
        for costs in (trees.Costs(), COSTS, trees.Costs(ignore_literals=True, ignore_identifiers=True)):
            want = plain(x, y, costs)
            assert abs(trees.distance(x, y, costs) - want) < 1e-9
            assert trees.label_bound(x[0], y[0], costs) <= want + 1e-9 and trees.size_bound(len(x[0]), len(y[0]), costs) <= want + 1e-9
            assert abs(trees.bounded_distance(x, y, 3, costs) - (want if want <= 3 else 4)) < 1e-9
        assert trees.distance(x, y) == similarity.tree_distance(x, y)
    assert trees.distance(([], []), (["if"], [-1]), COSTS) == 1.3


def sorted_tree(t):
    """The same tree in document order."""
    kids, labels, parents = trees.children(t), [], []

    def walk(i, up):
        labels.append(t[0][i])
        parents.append(up)
        here = len(labels) - 1
        for c in kids[i]:
            walk(c, here)

    walk(0, -1)
    return labels, parents


def test_costs_similarity_and_shapes():
    assert [COSTS.node(w) for w in ("func(x)", "if", "call", "while")] == [1.5, 1.3, 0.8, 1.0]
    renames = [("identifier(a)", "identifier(b)", 0.2), ("for", "while", 0.5), ("if", "for", 0.7), ("if", "call", 1.0), ("if", "if", 0.0)]
    assert all(abs(COSTS.rename(a, b) - c) < 1e-12 for a, b, c in renames)
    assert [trees.similarity(d, n, m) for d, n, m in ((0, 0, 0), (1, 0, 1), (5, 4, 10), (20, 4, 10))] == [1.0, 0.0, 0.5, 0.0] and trees.similarity(7, 4, 10, "sum") == 0.5
    chain, star = (["a"] * 4, [-1, 0, 1, 2]), (["a"] * 4, [-1, 0, 0, 0])
    assert (trees.height(chain), trees.height(star), trees.height(([], []))) == (4, 2, 0)
    assert trees.shape_profile(chain, star) == 3.0 and trees.shape_profile(chain, chain) == 0 and trees.same_shape(star, (["b"] * 4, [-1, 0, 0, 0]))
    assert trees.leaders([chain, star, None, chain, (["z"], [-1]), star], 0.9) == [[0, 3], [1, 5], [4]]


def test_features_and_kinds():
    t = (["func", "identifier(a)", "number(1)", "call", "identifier(b)"], [-1, 0, 0, 0, 3])
    u = (["func", "identifier(z)", "string(q)", "call", "identifier(b)"], [-1, 0, 0, 0, 3])
    a, b = trees.features(t, patterns=("call", "for")), trees.features(u)
    assert a == sorted(set(a)) and "pattern:call" in a and "pattern:for" not in a and "kgram:func identifier(a) number(1) call" in a and "typedist:identifier:2-3" in a
    assert len([f for f in a if f.startswith("sub:")]) == 5 and set(a) != set(b)
    assert trees.features(t, literals=False) == trees.features(u, literals=False)
    steps = (0.85, 0.75, 0.7, 0.65)
    assert trees.classify(0.9, True, 0, steps) == (1, 0.9) and trees.classify(0.8, True, 1.0, steps) == (2, 0.8)
    kind, sim = trees.classify(1.0, False, 1.0, steps)
    assert kind == 2 and 0.8499 < sim < 0.85
    assert trees.classify(0.8, False, 0.76, steps) == (2, 0.76) and trees.classify(0.8, False, 0.1, steps) == (3, 0.8) and trees.classify(0.66, False, 1, steps) == (4, 0.66) and trees.classify(0.1, True, 1, steps)[0] == 0
    assert trees.admitted(20, 10) and not trees.admitted(19, 10) and not trees.admitted(20, 9)


def test_pairs_are_verified(spark):
    rng = random.Random(5)
    one = sorted_tree(made(rng, 40))
    two = ([*one[0][:-1], "while"], one[1])
    other = sorted_tree(([rng.choice(["x", "y"]) for _ in range(40)], [-1, *range(39)]))
    rows = [(1, "f", 1, 20, 20, "d", *one), (2, "g", 1, 20, 20, "d", *one), (3, "h", 1, 20, 20, "e", *two), (4, "f", 10, 30, 20, "d", *one), (5, "k", 1, 20, 20, "x", *other), (6, "m", 1, 90, 90, "y", one[0][:12], one[1][:12])]
    fragments = trees.with_features(spark.createDataFrame(rows, trees.FRAGMENT))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)], "a long, b long")
    got = {r.b: (r.distance, r.kind) for r in trees.verified(pairs, fragments).collect()}
    assert got[2] == (0.0, 1) and got[3][0] == 1.0 and got[3][1] in (2, 3) and set(got) == {2, 3}
