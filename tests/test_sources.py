"""Files, patterns, reports, records, patches and settings."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from quarrel import config, sources
from quarrel.sources import patches


def test_patterns_and_gitignore(spark):
    paths = ["a.js", "src/Widget.TS", "src/generated/x/y.ts", "node_modules/p/i.js", "lib/a.test.js", "deep/src/generated/z.js", "keep/build/o.js", "build/o.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = lambda cond: [r.path for r in df.where(cond).collect()]
    assert got(sources.matches_paths(F.col("path"), ["**/*.ts"])) == ["src/Widget.TS", "src/generated/x/y.ts"]
    assert got(sources.matches_paths(F.col("path"), ["src/generated"])) == ["src/generated/x/y.ts", "deep/src/generated/z.js"]
    assert got(sources.matches_paths(F.col("path"), ["node_modules", "*.test.js", "[", ""])) == ["node_modules/p/i.js", "lib/a.test.js"]
    assert got(sources.matches_paths(F.col("path"), ["src/**/y.ts"])) == ["src/generated/x/y.ts"]
    assert got(sources.ignored(F.col("path"), "# c\n\n/build/\n*.ts\n!y.ts\nnode_modules\nlib/**\n")) == ["node_modules/p/i.js", "lib/a.test.js", "build/o.js"]
    assert "build/o.js" in got(sources.ignored(F.col("path"), "/build/")) and "keep/build/o.js" not in got(sources.ignored(F.col("path"), "/build/"))
    assert got(sources.ignored(F.col("path"), "build/")) == ["keep/build/o.js", "build/o.js"]
    assert got(sources.ignored(F.col("path"), "*.js\n!a.js")) == ["node_modules/p/i.js", "lib/a.test.js", "deep/src/generated/z.js", "keep/build/o.js", "build/o.js"]


def test_scripts_are_read_once_with_their_errors(spark, tmp_path):
    for name, raw in {"a.js": b"f()", "b/C.TSX": b"x", "b/bad.ts": b"\xff\xfe", "out/d.js": b"1", "n.txt": b"", ".gitignore": b"out/\n", "skip/e.mjs": b"2"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(raw)
    snap = sources.read_scripts(spark, str(tmp_path), exclude=["skip"])
    assert sorted((r.path, r.lang, r.content, r.error) for r in snap.collect()) == [("a.js", "JavaScript", "f()", None), ("b/C.TSX", "TypeScript", "x", None), ("b/bad.ts", "TypeScript", None, "not UTF-8")]
    assert [r.path for r in sources.read_scripts(spark, str(tmp_path), include=["*.js"], exclude=["skip"]).collect()] == ["a.js"]
    row = sources.accounting(snap, spark.createDataFrame([("a.js",)], "path string")).first()
    assert (row.total, row.analyzed, row.partial, row.skipped, row.messages) == (3, 2, 1, 1, "a.js: syntax error\nb/bad.ts: not UTF-8")
    assert sources.same_paths(snap, snap) and not sources.same_paths(snap.limit(1), snap)


def test_reports():
    summary, sections = {"files": 1234, "mean": 2.5, "name": 'a "b"', "none": None}, {"top": [{"fn": "x<y", "cc": 3}, {"fn": "z", "cc": 1}], "empty": []}
    assert json.loads(sources.report_text(summary, sections, "json"))["top"][1] == {"fn": "z", "cc": 1}
    assert sources.report_text(summary, sections, "yaml") == 'summary:\n  files: 1234\n  mean: 2.5\n  name: "a \\"b\\""\n  none: null\ntop:\n  -\n    fn: "x<y"\n    cc: 3\n  -\n    fn: "z"\n    cc: 1\nempty: []\n'
    assert "# top\nfn,cc\nx<y,3\nz,1\n" in sources.report_text(summary, sections, "csv")
    assert "<td>x&lt;y</td>" in sources.report_text(summary, sections, "html") and "1,234" in sources.report_text(summary, sections, "html")
    assert sources.report_text(summary, sections, "cli").startswith("files: 1,234\nmean: 2.50") and "TOP" in sources.report_text(summary, sections, "text")
    with pytest.raises(ValueError):
        sources.report_text({}, {}, "pdf")


def test_records_pool_and_refuse_to_mix(spark, tmp_path):
    a, b, c, d = (str(tmp_path / x) for x in "abcd")
    sources.write_records(spark.createDataFrame([(1, "x", 0.5), (2, "y", 1.0)], "i long, s string, v double"), {"analyzer": "1", "n_instances": 2, "repo": "r"}, a)
    (tmp_path / "b").mkdir()
    with gzip.open(tmp_path / "b" / "set.jsonl.gz", "wt") as f:
        f.write('{"record_type": "meta", "analyzer": "1", "n_instances": 3, "repo": "q"}\n\n{"i": 3, "ok": true}\n')
    records, meta = sources.read_records(spark, [a, b])
    assert sorted((r.i, r.s, r.v, r.ok) for r in records.collect()) == [(1, "x", 0.5, None), (2, "y", 1.0, None), (3, None, None, True)]
    assert meta == {"analyzer": "1", "n_instances": 5, "repo": "q, r"}
    sources.write_records(spark.createDataFrame([(1,)], "i long"), {"analyzer": "2"}, c)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "m.jsonl").write_text('{"record_type": "meta"}\n')
    for bad in ([a, c], [d]):
        with pytest.raises(ValueError):
            sources.read_records(spark, bad)


def test_patches(spark):
    text = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n a\n--- b\n+++ c\n+d\n e\n@@ -9 +10 @@\n-f\n+g\n\\ No newline at end of file\n--- /dev/null\n+++ b/new.py\t2024\n@@ -0,0 +1 @@\n+h\n--- a/old.txt\n+++ /dev/null\n@@ -1 +0,0 @@\n-i\n--- a/p.py\n+++ b/q.py\n"
    assert patches.entries(text) == [("x.py", "x.py", 5), (None, "new.py", 1), ("old.txt", None, 1), ("p.py", "q.py", 0)]
    assert patches.entries("fatal: not a repository") == patches.entries(None) == []
    found = patches.parsed(spark.createDataFrame([("i", text), ("j", "no diff")], "id string, patch string"))
    assert sorted((r.path, r.what) for r in patches.classified(found, (".py",)).collect()) == [("new.py", "created"), ("p.py", "deleted"), ("q.py", "created"), ("x.py", "modified")]
    assert [tuple(r) for r in patches.changed_lines(found, spark.createDataFrame([("i", "x.py"), ("i", "gone.py")], "id string, path string")).collect()] == [("i", 5)]
    rows = spark.createDataFrame([(0, 1, True, 0), (1, 0, True, 0), (1, 1, False, 0), (1, 1, True, 2), (1, 1, True, 0)], "e int, f int, a boolean, b int")
    assert [r[0] for r in rows.select(patches.outcome(F.col("e"), F.col("f"), F.col("a"), F.col("b"))).collect()] == ["not_a_diff", "no_measurable_files", "apply_failed", "broke_syntax", "ok"]
    before = spark.createDataFrame([("i", "x", 5, 1, 0), ("i", "y", 9, 0, 2)], "id string, path string, max_cc long, high_risk long, dead long")
    after = spark.createDataFrame([("i", "x", 12, 1, 0), ("i", "y", 2, 1, 0)], "id string, path string, max_cc long, high_risk long, dead long")
    assert [tuple(r) for r in patches.measured(before, after).collect()] == [("i", 3, 1, -2)]


def test_settings(tmp_path):
    assert config.load(target=str(tmp_path))[0] == config.Settings() or config.discover(str(tmp_path))
    (tmp_path / "quarrel.toml").write_text("low = 5\nmedium = 8\nodd = 1\n")
    (tmp_path / "sub").mkdir()
    settings, unknown = config.load(target=str(tmp_path / "sub"))
    assert (settings.low, settings.medium, unknown) == (5, 8, ["odd"]) and [settings.risk(n) for n in (5, 8, 9)] == ["low", "medium", "high"]
    (tmp_path / "bad.json").write_text('{"low": 0, "format": "pdf", "clone_thresholds": [0.8, 0.9, 0.7, 0.6]}')
    with pytest.raises(ValueError, match="low must"):
        config.load(str(tmp_path / "bad.json"))
    assert len(config.Settings(low=20, sort_by="x", include=[], max_pairs=-1).problems()) == 4
    assert config.selected(["cbo"])["cbo"] and not config.selected(["cbo"])["deps"]
    for bad in ([], ["nothing"]):
        with pytest.raises(ValueError):
            config.selected(bad)
