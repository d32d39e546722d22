"""Scopes, snippets, roots, deltas, medians and checks at their edges."""

import random

from pyspark.sql import functions as F

from quarrel import functions as fn
from quarrel.operators import intervals, metrics, similarity


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_uses_are_hidden_by_any_span_that_covers_them(spark):
    hiding = spark.createDataFrame([("k", 1, 9), ("k", 2, 3)], "key string, s long, e long")
    uses = spark.createDataFrame([("k", 0, 1), ("k", 1, 2), ("k", 5, 3), ("k", 9, 4), ("k", 10, 5), ("m", 5, 6), ("k", None, 7)], "key string, at long, use_id long")
    assert [r[2] for r in rows(intervals.unshadowed(uses, hiding).where("at is not null"), "use_id")] == [1, 5, 6]
    assert intervals.unshadowed(uses, hiding.limit(0)).count() == len([1, 2, 3, 4, 5, 6, 7])


def test_enclosing_scopes_are_listed_widest_first(spark):
    spans = spark.createDataFrame([("k", 1, 0, 100), ("k", 2, 10, 50), ("k", 3, 20, 30), ("m", 4, 0, 99)], "key string, span_id long, s long, e long")
    spans = spans.select("key", "span_id", F.timestamp_seconds("s").alias("s"), F.timestamp_seconds("e").alias("e"))
    points = spans.select("key", F.col("span_id").alias("point_id"), F.col("s").alias("at"))
    assert rows(intervals.enclosing(spans, points), "point_id") == [(2, 1, "1"), (3, 2, "1/2")]


def test_innermost_against_brute_force(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), i, a := rng.randrange(2000), a + rng.choice((0, 1, 5, 60, 900))) for i in range(80)]
    points = [(rng.choice("abc"), i, rng.randrange(2200)) for i in range(200)]
    want = {}
    for key, p, at in points:
        around = [(e - s, -s, i) for k, i, s, e in spans if k == key and s <= at <= e]
        if around:
            want[p] = min(around)[2]
    at = lambda *cs: [F.timestamp_seconds(c).alias(c) for c in cs]
    left = spark.createDataFrame(spans, "key string, span_id long, s long, e long").select("key", "span_id", *at("s", "e"))
    right = spark.createDataFrame(points, "key string, point_id long, at long").select("key", "point_id", *at("at"))
    assert {r.point_id: r.span_id for r in intervals.innermost(left, right).collect()} == want
    assert intervals.innermost(left.limit(0), right).count() == 0


def test_repeated_boundary_lines_go(spark):
    c = spark.createDataFrame([(1, 1, "a\nb"), (1, 2, "b\nc"), (1, 3, "c"), (1, 4, "d"), (2, 1, "")], "k long, t long, text string")
    assert [(r.again, r.kept) for r in fn.joined_snippets(c, "k", ["t", "text"]).orderBy("k", "t").collect()] == [(False, "a\nb"), (True, "c"), (True, ""), (False, "d"), (False, "")]


def test_common_root(spark):
    root = lambda *paths: metrics.common_root(spark.createDataFrame([(p,) for p in paths], "path string")).first()[0]
    assert root("/a/b/x.py", "/a/bc/y.py", None) == "/a"
    assert root("/a/b/x.py", "/a/b/c/y.py") == "/a/b"
    assert root("a/x", "b/y") == ""


def test_median_of_a_histogram(spark):
    of = lambda *r: metrics.histogram_median(spark.createDataFrame(list(r), "v long, n long")).first()[0]
    assert of((1, 2), (4, 2)) == 2.5
    assert of((1, 2), (4, 3)) == 4.0
    assert metrics.histogram_median(spark.createDataFrame([], "v long, n long")).first()[0] is None


def test_patch_delta_and_checks(spark):
    f = spark.createDataFrame([("a", 2, 5), ("a", 3, 0), ("a", 0, 7), ("b", 4, 1)], "file string, before long, after long")
    assert rows(metrics.patch_delta(f, "file"), "file") == [("a", 3, 7, 1, True), ("b", -3, 0, 0, False)]
    assert rows(metrics.checks(f, {"grew": F.col("after") > F.col("before"), "none": F.col("file").isNull()}), "rule") == [("grew", 2, 4), ("none", 0, 4)]


def test_membership_counts_copies_within_and_across_keys(spark):
    d = spark.createDataFrame([("x", "A b"), ("x", "a  B"), ("x", "c"), ("y", "c"), ("y", "d"), ("y", None)], "source string, text string")
    assert rows(similarity.membership(d, "source"), "source") == [("x", 3, 3, 2), ("y", 2, 1, 1)]


def test_columns(spark):
    df = spark.createDataFrame([(1, [], ["a"]), (7, ["a", "b"], ["c", "d"]), (40, ["a"], ["b"]), (100, ["a", "b"], ["b", "c"])], "top long, x array<string>, y array<string>")
    got = df.select(fn.axis_ceiling(F.col("top")), fn.compatible(F.col("x"), F.col("y")), fn.disjoint(F.col("x"), F.col("y"))).collect()
    assert [tuple(r) for r in got] == [(3, True, False), (10, False, True), (50, False, False), (100, True, False)]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in (0, 2, 3, 4, 10, 11, 60, 61, 1000, 1001)], "n long").select(fn.axis_ceiling(F.col("n"))).collect()] == [3, 3, 3, 5, 10, 20, 60, 100, 1000, 2000]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in ("a/test.js", "a/x.spec", "a/x.test.ts", "a/testing.js", "a/__tests__/b.js")], "p string").select(fn.is_test(F.col("p"))).collect()] == [True, True, True, False, True]
    assert spark.range(1).select(fn.strip_comments(F.lit("a<!--\n-->b<!--c"), "<!--", "-->")).first()[0] == "ab<!--c"


def test_names_paths_and_literals(spark):
    def of(values, *cols):
        return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()]

    x = F.col("x")
    assert of(["'a'", '"b"', "`c`", "`${d}`", "'e", "f", "''"], fn.unquoted(x)) == [("a",), ("b",), ("c",), (None,), (None,), (None,), ("",)]
    assert of(["/r/a/b", "/rx/a", "/r", "\\r\\a"], fn.relative_to(x, "/r/")) == [("a/b",), ("/rx/a",), ("/r",), ("a",)]
    assert of(["./a/b", "../../p/q", "@s/p/q", "@s", "lodash/x", "lodash"], fn.package_of(x)) == [("a",), ("p",), ("@s/p",), ("@s",), ("lodash",), ("lodash",)]
    assert of(["import type a\nimport b\n  import type c", ""], fn.type_only_lines(x)) == [([1, 3],), ([],)]
    assert of(["identifier(a(b))", "if"], fn.label_base(x)) == [("identifier",), ("if",)]
    assert of(["Box", "box", "Éa", "_x", "", "1"], fn.is_exported(x)) == [(True,), (False,), (True,), (False,), (False,), (False,)]
    assert of(["AsyncFunctionDeclaration", "ClassDeclaration", "VariableDeclaration"], fn.declares_callable(x)) == [(True,), (True,), (False,)]
    assert of(["/s/app/x/page.tsx", "/s/app/x/route.ts", "/s/page.tsx"], fn.is_reserved(x, F.lit("metadata")), fn.is_reserved(x, F.lit("GET"))) == [(True, False), (True, True), (False, False)]
    assert of(["info", "warning", "critical", "odd"], fn.at_least_severity(x, "warning")) == [(False,), (True,), (True,), (False,)]
    assert of(["unreachable", "other"], fn.reason_text(x)) == [("Code that no path reaches",), ("Code that never runs",)]
    assert of(["package", "relative"], fn.is_external(x), fn.counted(F.length(x), "letter", "letters")) == [(True, "7 letters"), (False, "8 letters")]
    assert of(["a::b::c", "d"], fn.last_part(x, "::")) == [("c",), ("d",)]
    assert spark.range(1).select(fn.abstractness(F.lit(25)), fn.abstractness(F.lit(3))).first()[:] == (1.0, 0.3)
