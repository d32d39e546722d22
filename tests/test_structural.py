"""Bindings against their SQL, and operators on small fixtures."""

import random
from functools import cache

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarrel import sources
from quarrel.operators import graph, intervals, metrics, scoring, similarity
from quarrel.plans import bindings
from quarrel.streaming import merge_into

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(bindings.ORACLE))
def test_matches_sql(spark, sf, con, name):
    got, want = bindings.QUERIES[name](spark, sf).toPandas(), con.sql(bindings.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    key = lambda d: sorted(tuple("null" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) or type(v).__module__ == "numpy" else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.ORACLE)))
def test_runs(spark, sf, name):
    assert bindings.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8


def test_chain_cycle_and_core(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)], "src long, dst long")
    found = {r.id: r.component for r in graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()}
    assert {found[i] for i in range(41)} == {0} and found[101] == 100
    assert [(r.scc, r["size"], r.severity) for r in graph.cycles(e).collect()] == [(100, 3, "medium")]
    core = graph.kcore(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), 2)
    assert sorted(r.node for r in core.collect()) == [100, 101, 102]


def test_cycles_in_a_task_and_by_rounds(spark):
    rng = random.Random(4)
    for n, m in ((30, 42),):
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {a: {a} for a in range(n)}
        for _ in range(n):
            for a, b in pairs:
                for x in reach:
                    if a in reach[x]:
                        reach[x].add(b)
        groups = {a: sorted(b for b in range(n) if b in reach[a] and a in reach[b]) for a in range(n)}
        want = sorted((a, g[0]) for a, g in groups.items() if len(g) > 1)
        e = spark.createDataFrame(sorted(pairs), "src long, dst long")
        for small in (0, 1000):
            assert sorted(tuple(r) for r in graph.strong(e, small).select("node", "scc").collect()) == want


def test_chains_end_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (1, 4), (5, 4), (4, 6)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.chains(e).collect()) == [(1, 1, 1, None), (2, 2, 3, 1), (4, 1, 4, 2), (5, 1, 1, None), (6, 1, 5, 4)]
    assert [tuple(r) for r in graph.longest_chain(e).orderBy("place").collect()] == [(1, 1, 1), (2, 2, 2), (3, 4, 1), (4, 6, 1)]


def test_islands_restart_on_a_new_reason(spark):
    r = spark.createDataFrame([(1, 1, 100, "x", 1), (1, 2, 3, "y", 1), (1, 50, 60, "y", 2), (1, 61, 70, "y", 1)], "k int, s long, e long, reason string, level int")
    assert sorted((x.s, x.e, x.reason, x.level) for x in intervals.islands(r, "k").collect()) == [(1, 100, "x", 1), (2, 3, "y", 1), (50, 70, "y", 2)]


def test_tree_distance():
    t = lambda s: similarity.tree(s)
    assert similarity.tree_distance(t("<a><b></b></a>"), t("<a><b></b></a>")) == 0
    assert similarity.tree_distance(t("<a><b></b><c></c></a>"), t("<a><c></c></a>")) == 1
    assert similarity.tree_distance(t("<a><b></b></a>"), t("<d><b></b></d>")) == 1


def test_mcnemar_and_scores(spark):
    p = spark.createDataFrame([("a", True, False)] * 5 + [("a", True, True)], "k string, before boolean, after boolean")
    assert similarity.mcnemar(p, "k").first().p == 0.0625
    one = spark.range(1).select(scoring.health([F.lit(10), F.lit(None).cast("int")], [20, 16]).alias("h"))
    assert one.first().h == 50
    assert spark.range(1).select(scoring.grade(F.lit(76))).first()[0] == "B"


def test_files_and_streaming_merge(spark, tmp_path):
    for name in ("a/x.py", "a/vendor/y.py", "a/.git/z.py", "a/test_w.py", "a/n.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("print(1)\n")
    got = sources.read_files(spark, [str(tmp_path / "a")], {".py": "python"}, exclude=["test_*"])
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["x.py"]
    f = spark.createDataFrame([("m", 3), ("m", 25)], "module string, complexity long")
    state = merge_into(None, f, "module")
    both = merge_into(state, f, "module").first()
    assert (both.functions, both.avg_cc, both.high_risk) == (4, 14.0, 2)
    assert metrics.histogram(f).count() == 5


def test_penalties_at_their_bounds(spark):
    lit, nan = F.lit, F.lit(float("nan"))
    cols = [scoring.duplication_penalty(nan), scoring.duplication_penalty(lit(75.0)), scoring.parse_error_penalty(lit(1), lit(1000)), scoring.parse_error_penalty(lit(9), lit(3)), scoring.parse_error_penalty(lit(1), lit(0)), scoring.coupling_penalty(lit(1), lit(0), lit(0)), scoring.dependency_penalty(lit(0), lit(0), lit(9), lit(0.0)), scoring.dependency_penalty(lit(4), lit(4), lit(99), lit(2.0))]
    assert list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()) == [0, 20, 11, 56, 0, 0, 0, 16]


def test_copies_ladder(spark):
    rows = spark.createDataFrame([(True, 1.0), (True, 0.8), (False, 1.0), (False, 0.72), (False, 0.66), (False, 0.1)], "same boolean, sim double")
    kind, sim = similarity.ladder(F.col("same"), F.col("sim"))
    assert [(r.k, round(r.s, 6)) for r in rows.select(kind.alias("k"), sim.alias("s")).collect()] == [(1, 1.0), (2, 0.8), (2, 0.85), (3, 0.72), (4, 0.66), (0, 0.1)]


def test_path_suffixes_of_nothing(spark):
    from quarrel import functions as fn

    got = spark.createDataFrame([("/a/b.js",), ("",), ("/",)], "p string").select(fn.suffixes(F.col("p")).alias("s"), fn.stem(F.col("p")).alias("stem")).collect()
    assert [(r.s, r.stem) for r in got] == [(["b.js", "a/b.js"], "b"), ([], ""), ([], "")]


def test_tree_distance_is_exact_at_every_size(spark):
    """Against the plain recursion over forests on small trees, and on pages of equal size over 500 elements."""

    def plain(x, y):
        @cache
        def dist(f, g):
            if not f or not g:
                return size(f) + size(g)
            (a, fa), (b, gb) = f[-1], g[-1]
            return min(dist(f[:-1] + fa, g) + 1, dist(f, g[:-1] + gb) + 1, dist(f[:-1], g[:-1]) + dist(fa, gb) + (a != b))

        size = lambda f: sum(1 + size(k) for _, k in f)

        def nested(t, i=0):
            return (t[0][i], tuple(nested(t, j) for j, p in enumerate(t[1]) if p == i))

        return dist((nested(x),), (nested(y),))

    rng = random.Random(6)
    page = lambda n: (["#root", *(rng.choice("abc") for _ in range(n))], [-1, *(rng.randint(max(0, i - 3), i) for i in range(n))])
    for _ in range(60):
        x, y = page(rng.randint(0, 9)), page(rng.randint(0, 9))
        assert similarity.tree_distance(x, y) == plain(x, y)
    row = lambda tag: f"<{tag}><i></i></{tag}>"
    pages = spark.createDataFrame([(1, row("p") * 400), (2, row("b") * 400), (3, row("b") * 400), (4, row("b") * 399 + "<b></b><i></i>")], "page_id long, html string")
    assert [r.distance for r in similarity.neighbours_tree_distance(pages).orderBy("a").collect()] == [400, 0, 2]


def test_copies_are_found_at_any_distance_of_ids(spark):
    rng = random.Random(9)
    texts = {}
    for base in range(0, 400, 40):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(30)) for _ in range(rng.randint(4, 60))]
        for k in range(6):
            texts[base + 7 * k] = " ".join(w if rng.random() > 0.02 * k else "new" for w in words)
    texts |= {900: "Two words", 950: "two  words", 960: "", 970: " ", 980: "other words", 990: None}
    plain = {i: " ".join(t.lower().split()) for i, t in texts.items() if t and t.strip()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in plain.items()}
    first = {}
    for i in sorted(plain):
        first.setdefault(plain[i], i)
    want = {(first[t], i): (1, 1.0) for i, t in plain.items() if first[t] != i}
    for a in first.values():
        for b in first.values():
            union = len(sets[a] | sets[b])
            if a < b and union and len(sets[a] & sets[b]) / union >= 0.65:
                sim = min(len(sets[a] & sets[b]) / union, 0.85 - 1e-12)
                want[a, b] = (2 if sim >= 0.75 else 3 if sim >= 0.7 else 4, round(sim, 6))
    assert len({k for k, _ in want.values()}) == 4
    got = similarity.copies(spark.createDataFrame(list(texts.items()), "id long, text string")).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.kind, r.similarity) for r in got} == want
