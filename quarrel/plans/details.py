"""Orders, merges, scores, names and modules on the driver's tables, with their SQL.

Roles as in bindings.py; a page is a module, and the links in it are its imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrel import functions as fn
from quarrel.operators import graph, metrics, scoring, sketch
from quarrel.plans.bindings import CBO, CHAINS, CLOSURE, EDGES, FUNCTIONS, PATHS, PLACED, deps, edges, functions, placed, query, table, weighted_edges
from quarrel.sources import js

# ---- orders: every one is total ----


@query(f"WITH {FUNCTIONS} SELECT row_number() OVER (ORDER BY complexity DESC, module, fn)::INTEGER AS rank, fn FROM functions QUALIFY rank <= 50")
def functions_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top(functions(spark, sf_dir), [F.col("complexity").desc(), F.col("module"), F.col("fn")], 50).select("rank", "fn")


ORDERS = {"name": "name", "risk": "level DESC, value DESC, name", "value": "value DESC, name"}


def sorted_by(rows: DataFrame, n: int = 20) -> DataFrame:
    """mode, rank, name: the first n of rows(name, level, value) in each of the orders that a report offers."""
    name, level, value = F.col("name"), F.col("level").desc(), F.col("value").desc()
    parts = [metrics.top(rows, order, n).select(F.lit(mode).alias("mode"), "rank", "name") for mode, order in (("name", [name]), ("risk", [level, value, name]), ("value", [value, name]))]
    return parts[0].union(parts[1]).union(parts[2])


def _sorted_sql(cte: str, of: str) -> str:
    return f"WITH {cte}, s AS ({of}) " + " UNION ALL ".join(f"(SELECT '{m}' AS mode, row_number() OVER (ORDER BY {o})::INTEGER AS rank, name FROM s QUALIFY rank <= 20)" for m, o in ORDERS.items())


@query(_sorted_sql(FUNCTIONS, "SELECT fn AS name, complexity AS value, CASE WHEN complexity <= 9 THEN 1 WHEN complexity <= 19 THEN 2 ELSE 3 END AS level FROM functions"))
def functions_by_mode(spark, sf_dir):
    """Functions by name, risk and complexity."""
    cc = F.col("complexity")
    return sorted_by(functions(spark, sf_dir).select(F.col("fn").alias("name"), cc.alias("value"), F.when(cc <= 9, 1).when(cc <= 19, 2).otherwise(3).alias("level")))


@query(_sorted_sql(CBO, "SELECT class AS name, cbo AS value, CASE WHEN cbo <= 3 THEN 1 WHEN cbo <= 7 THEN 2 ELSE 3 END AS level FROM n"))
def classes_by_mode(spark, sf_dir):
    """Classes by name, risk and coupling."""
    c = F.col("cbo")
    return sorted_by(metrics.cbo(deps(spark, sf_dir)).select(F.col("class").alias("name"), c.alias("value"), F.when(c <= 3, 1).when(c <= 7, 2).otherwise(3).alias("level")))


@query("""WITH f AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'error' THEN 2 ELSE 1 END AS level, ts::DATE::VARCHAR AS file FROM events)
(SELECT 'severity' AS mode, row_number() OVER (ORDER BY level DESC, file, event_id)::INTEGER AS rank, event_id FROM f QUALIFY rank <= 20) UNION ALL (SELECT 'line', row_number() OVER (ORDER BY event_id)::INTEGER AS rank, event_id FROM f QUALIFY rank <= 20)
UNION ALL (SELECT 'file', row_number() OVER (ORDER BY file, event_id)::INTEGER AS rank, event_id FROM f QUALIFY rank <= 20) UNION ALL (SELECT 'function', row_number() OVER (ORDER BY user_id, event_id)::INTEGER AS rank, event_id FROM f QUALIFY rank <= 20)""")
def findings_by_mode(spark, sf_dir):
    """Findings by severity, line, file and function."""
    t, line = F.col("event_type"), F.col("event_id")
    f = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(t == "purchase", 3).when(t == "error", 2).otherwise(1).alias("level"), F.date_format("ts", "yyyy-MM-dd").alias("file"))
    orders = {"severity": [F.col("level").desc(), F.col("file"), line], "line": [line], "file": [F.col("file"), line], "function": [F.col("user_id"), line]}
    out = [metrics.top(f, order, 20).select(F.lit(mode).alias("mode"), "rank", "event_id") for mode, order in orders.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT (row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1)::BIGINT AS place, o_orderkey FROM orders")
def spans_in_order(spark, sf_dir):
    """All spans numbered by file, start and id."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return metrics.numbered(o, [F.col("o_custkey"), F.col("o_orderdate"), F.col("o_orderkey")], "place").select("place", "o_orderkey")


# ---- merges ----


@query(f"""WITH {FUNCTIONS}, h AS (SELECT fn % 3 AS part, count(*) AS functions, avg(complexity) AS avg_cc, min(complexity) AS min_cc, max(complexity) AS max_cc FROM functions GROUP BY 1)
SELECT sum(functions)::BIGINT AS functions, round(sum(functions * avg_cc) / sum(functions), 6) AS avg_cc, min(min_cc)::BIGINT AS min_cc, max(max_cc)::BIGINT AS max_cc FROM h""")
def merged_complexity(spark, sf_dir):
    """Summaries of three parts, and an empty one, merged."""
    f = functions(spark, sf_dir)
    cc = F.col("complexity")
    parts = f.groupBy((F.col("fn") % 3).alias("part")).agg(F.count(cc).alias("functions"), F.avg(cc).alias("avg_cc"), F.min(cc).cast("long").alias("min_cc"), F.max(cc).cast("long").alias("max_cc")).drop("part")
    none = spark.range(1).select(F.lit(0).cast("long").alias("functions"), F.lit(0.0).alias("avg_cc"), F.lit(0).cast("long").alias("min_cc"), F.lit(0).cast("long").alias("max_cc"))
    return metrics.merged_summaries(parts.unionByName(none))


@query(f"""WITH {PLACED}, h AS (SELECT nation, fn % 2 AS part, count(*) AS functions, avg(complexity) AS avg_cc, max(complexity) AS max_cc, count(*) FILTER (WHERE complexity > 19) AS high_risk FROM placed GROUP BY 1, 2),
m AS (SELECT nation, sum(functions)::BIGINT AS functions, round(sum(functions * avg_cc) / sum(functions), 6) AS avg_cc, max(max_cc)::BIGINT AS max_cc, sum(high_risk)::BIGINT AS high_risk FROM h GROUP BY nation)
SELECT row_number() OVER (ORDER BY avg_cc DESC, nation)::INTEGER AS rank, * FROM m""")
def merged_directories(spark, sf_dir):
    """Directories of two parts merged, in the order of their mean."""
    cc = F.col("complexity")
    parts = placed(spark, sf_dir).groupBy("nation", (F.col("fn") % 2).alias("part")).agg(F.count(cc).alias("functions"), F.avg(cc).alias("avg_cc"), F.max(cc).cast("long").alias("max_cc"), F.count(F.when(cc > 19, 1)).alias("high_risk"))
    m = metrics.merged(parts, "nation")
    return metrics.top(m, [F.col("avg_cc").desc(), F.col("nation")], 1000)  # nations are 25


@query(f"WITH {CBO} SELECT count(*) AS classes, round(avg(cbo), 6) AS avg_cbo, min(cbo) AS min_cbo, max(cbo) AS max_cbo, count(*) FILTER (WHERE cbo <= 3) AS low_risk, count(*) FILTER (WHERE cbo > 3 AND cbo <= 7) AS medium_risk, count(*) FILTER (WHERE cbo > 7) AS high_risk FROM n")
def merged_coupling(spark, sf_dir):
    """Dependencies of two parts together, summed up anew."""
    d = deps(spark, sf_dir)
    return metrics.cbo_summary(metrics.cbo(d.where("kind = 'R'").unionByName(d.where("kind <> 'R'"))))


@query(f"""WITH {EDGES}, d AS (SELECT src, dst FROM edges UNION SELECT n_nationkey::BIGINT, (n_nationkey + 1) % 25 FROM nation WHERE n_nationkey % 5 = 0), ns AS (SELECT n_nationkey::BIGINT AS node FROM nation),
m AS (SELECT node, (SELECT count(*) FROM d WHERE dst = node AND src <> dst) AS ca, (SELECT count(*) FROM d WHERE src = node AND src <> dst) AS ce FROM ns)
SELECT node, ca, ce, CASE WHEN ca + ce > 0 THEN round(ce::DOUBLE / (ca + ce), 6) ELSE 0 END::DOUBLE AS instability FROM m""")
def merged_graph(spark, sf_dir):
    """Two graphs as one, its coupling measured anew."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    second = nodes.where("node % 5 = 0").select(F.col("node").alias("src"), ((F.col("node") + 1) % 25).alias("dst"))
    return graph.coupling(edges(spark, sf_dir).union(second), nodes.withColumn("a", F.lit(0.0))).select("node", "ca", "ce", "instability")


@query(f"""WITH {FUNCTIONS}, u AS (SELECT fn AS old_fn, 0 AS part, complexity FROM functions WHERE complexity > 6 AND fn % 2 = 0 UNION ALL SELECT fn, 1, complexity FROM functions WHERE complexity > 6 AND fn % 2 = 1)
SELECT old_fn, part, (row_number() OVER (ORDER BY complexity DESC, part, old_fn) - 1)::BIGINT AS new_id FROM u""")
def renumbered_rows(spark, sf_dir):
    """Rows of two reports with new ids in one order."""
    f = functions(spark, sf_dir).where("complexity > 6").select("fn", "complexity")
    out = metrics.renumbered([f.where("fn % 2 = 0"), f.where("fn % 2 = 1")], "fn", [F.col("complexity").desc(), F.col("part"), F.col("old_fn")], "new_id")
    return out.select("old_fn", "part", "new_id")


@query(f"WITH {FUNCTIONS} SELECT 'complexity' AS dimension, count(*) AS n FROM functions UNION ALL SELECT 'coupling', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'dead_code', count(*) FROM events WHERE event_type IN ('purchase', 'error')")
def report_sections(spark, sf_dir):
    """Results of all dimensions side by side, a row each."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("dimension"), "n")
    classes = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct()
    found = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return one("complexity", functions(spark, sf_dir)).union(one("coupling", classes)).union(one("dead_code", found))


# ---- roll-ups ----


@query(f"""WITH {FUNCTIONS}, r AS (SELECT module, count(*) AS functions, max(complexity)::BIGINT AS max_cc FROM functions GROUP BY module)
SELECT c_custkey AS module, coalesce(functions, 0) AS functions, coalesce(max_cc, 0) AS max_cc, length(c_name)::BIGINT AS loc FROM customer LEFT JOIN r ON module = c_custkey""")
def modules_without_functions(spark, sf_dir):
    """Every file has a row, those without functions too."""
    r = metrics.rollup_by(functions(spark, sf_dir), "module").select("module", "functions", "max_cc")
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("module"), F.length("c_name").cast("long").alias("loc"))
    return files.join(r, "module", "left").select("module", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("max_cc", F.lit(0)).alias("max_cc"), "loc")


@query("""WITH m AS (SELECT s_nationkey AS folder, l_suppkey AS receiver, count(*) AS methods, count(DISTINCT l_linenumber) AS places FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_tax > 0 GROUP BY 1, 2)
SELECT folder, count(*) AS classes, round(avg(methods), 6) AS avg_methods, max(methods) AS max_methods, count(*) FILTER (WHERE places > 5) AS high_risk FROM m GROUP BY folder""")
def cohesion_by_folder(spark, sf_dir):
    """Methods by folder and receiver; those without a receiver (no tax) do not count."""
    li = table(spark, sf_dir, "lineitem").where("l_tax > 0").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("methods"), F.countDistinct("l_linenumber").alias("places"))
    met = li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy(F.col("s_nationkey").alias("folder")).agg(F.count(F.lit(1)).alias("classes"), F.round(F.avg("methods"), 6).alias("avg_methods"), F.max("methods").alias("max_methods"), F.count(F.when(F.col("places") > 5, 1)).alias("high_risk"))


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS class, l_linenumber AS method FROM lineitem),
e AS (SELECT DISTINCT a.l_orderkey AS class, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey),
r AS (SELECT class, method AS x, method AS y FROM m UNION SELECT r.class, r.x, e.y FROM r JOIN e ON r.class = e.class AND r.y = e.x), c AS (SELECT class, x, min(y) AS c FROM r GROUP BY class, x), l AS (SELECT class, count(DISTINCT c) AS lcom4 FROM c GROUP BY class)
SELECT count(*) AS classes, round(avg(lcom4), 6) AS avg_lcom, min(lcom4) AS min_lcom, max(lcom4) AS max_lcom, count(*) FILTER (WHERE lcom4 <= 2) AS low_risk, count(*) FILTER (WHERE lcom4 > 2 AND lcom4 <= 5) AS medium_risk, count(*) FILTER (WHERE lcom4 > 5) AS high_risk FROM l""")
def lcom_summary(spark, sf_dir):
    v = F.col("lcom4")
    found = metrics.lcom4(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("class"), F.col("l_linenumber").alias("method"), F.col("l_suppkey").alias("target")))
    few, some = metrics.LCOM_RISK
    return found.agg(F.count(v).alias("classes"), F.round(F.avg(v), 6).alias("avg_lcom"), F.min(v).alias("min_lcom"), F.max(v).alias("max_lcom"), F.count(F.when(v <= few, 1)).alias("low_risk"), F.count(F.when((v > few) & (v <= some), 1)).alias("medium_risk"), F.count(F.when(v > some, 1)).alias("high_risk"))


@query("SELECT count(*) AS classes FROM (SELECT DISTINCT l_suppkey % 3 AS lang, l_suppkey AS name FROM lineitem UNION SELECT s_suppkey % 3, s_suppkey FROM supplier)")
def class_count(spark, sf_dir):
    """Distinct classes of two reports."""
    of = lambda df, c: df.select((F.col(c) % 3).alias("lang"), F.col(c).alias("name"))
    both = of(table(spark, sf_dir, "lineitem"), "l_suppkey").union(of(table(spark, sf_dir, "supplier"), "s_suppkey")).distinct()
    return both.agg(F.count(F.lit(1)).alias("classes"))


@query("SELECT user_id, arg_min(event_type, event_id) AS first_name, min(event_id) FILTER (WHERE event_id % 10 > 0) AS first_line FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id")
def first_findings(spark, sf_dir):
    """The first function with a finding and the first line that is known, of each file."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return e.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_name"), F.min(F.when(F.col("event_id") % 10 > 0, F.col("event_id"))).alias("first_line"))


@query("""WITH c AS (SELECT s_suppkey AS class, count(DISTINCT p_brand) AS cbo FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 48 LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT class, cbo FROM c WHERE cbo <= 5""")
def coupling_filter(spark, sf_dir):
    """Classes in a range of coupling, those of none too."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 48").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = li.groupBy(F.col("l_suppkey").alias("class")).agg(F.countDistinct("p_brand").alias("n"))
    every = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("class")).join(per, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("cbo"))
    return every.where(metrics.in_range(F.col("cbo"), 0, 5))


# ---- scores ----

SCORES = f"""{PLACED}, f AS (SELECT nation, count(*) AS total, count(*) FILTER (WHERE complexity > 7) AS high, count(*) FILTER (WHERE complexity > 6 AND complexity <= 7) AS medium, avg(complexity) AS mean FROM placed GROUP BY nation),
d AS (SELECT n_name AS nation, count(*) FILTER (WHERE c_acctbal < -900) AS critical, count(*) FILTER (WHERE c_acctbal >= -900 AND c_acctbal < 0) AS warning, count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 500) AS info, count(*) AS files FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
p AS (SELECT nation, CASE WHEN high + 0.5 * medium > 0 THEN greatest(1, round(least((high + 0.5 * medium) / total / 0.3, 1) * 20)) ELSE 0 END::BIGINT AS complexity, round(least((critical + 0.5 * warning + 0.2 * info)::DOUBLE / greatest(files, 1) / 3, 1) * 20)::BIGINT AS dead_code,
  round(least((warning + 0.3 * info)::DOUBLE / files / 0.4, 1) * 20)::BIGINT AS cohesion, CASE WHEN critical = 0 THEN 0 ELSE greatest(round(56.0 * critical / files), 11) END::BIGINT AS parse_errors, mean, critical, high FROM f JOIN d USING (nation)),
s AS (SELECT *, greatest(0, 100 - round(100.0 * (complexity + dead_code + cohesion) / 60)::BIGINT - parse_errors) AS score FROM p)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    cc, bal = F.col("complexity"), F.col("c_acctbal")
    f = placed(spark, sf_dir).groupBy("nation").agg(F.count(cc).alias("total"), F.count(F.when(cc > 7, 1)).alias("high"), F.count(F.when((cc > 6) & (cc <= 7), 1)).alias("medium"), F.avg(cc).alias("mean"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    d = c.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.when(bal < -900, 1)).alias("critical"), F.count(F.when((bal >= -900) & (bal < 0), 1)).alias("warning"), F.count(F.when((bal >= 0) & (bal < 500), 1)).alias("info"), F.count(F.lit(1)).alias("files"))
    critical, warning, info, files = map(F.col, ("critical", "warning", "info", "files"))
    p = f.join(d, "nation").select("nation", "mean", "critical", "high", scoring.complexity_penalty(F.col("high"), F.col("medium"), F.col("total")).alias("complexity"), scoring.dead_code_penalty(critical, warning, info, files).alias("dead_code"), scoring.cohesion_penalty(warning, info, files).alias("cohesion"), scoring.parse_error_penalty(critical, files).alias("parse_errors"))
    names = ("complexity", "dead_code", "cohesion")
    return p.withColumn("score", scoring.total_score({n: F.col(n) for n in names}, dict.fromkeys(names, 20), F.col("parse_errors")))


@query(f"WITH {SCORES} SELECT nation, complexity, dead_code, cohesion, parse_errors, score::BIGINT AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade, score >= 70 AS healthy, high > 0 OR critical > 0 AS has_issues FROM s")
def total_scores(spark, sf_dir):
    """Score of each nation by the budgets of its dimensions, less what unread files cost."""
    s = scored(spark, sf_dir)
    return s.select("nation", "complexity", "dead_code", "cohesion", "parse_errors", "score", scoring.grade(F.col("score")).alias("grade"), scoring.is_healthy(F.col("score")).alias("healthy"), ((F.col("high") > 0) | (F.col("critical") > 0)).alias("has_issues"))


@query(f"WITH {SCORES} SELECT nation, (100 - CASE WHEN mean > 10 THEN 10 ELSE 0 END - CASE WHEN critical > 0 THEN 5 ELSE 0 END - CASE WHEN high > 0 THEN 5 ELSE 0 END)::BIGINT AS score FROM s")
def fallback_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("nation", scoring.fallback_score(F.col("mean"), F.col("critical"), F.col("high")).alias("score"))


@query(f"""WITH {SCORES}, v AS (SELECT nation, 0 AS i, 'complexity' AS dimension, 100 - complexity * 5 AS score FROM s UNION ALL SELECT nation, 1, 'dead_code', 100 - dead_code * 5 FROM s UNION ALL SELECT nation, 2, 'cohesion', 100 - cohesion * 5 FROM s),
t AS (SELECT *, CASE WHEN score >= 90 THEN 'clean' WHEN score < 75 THEN 'weak' ELSE 'fair' END AS state FROM v)
SELECT nation, dimension, score::BIGINT AS score, state, CASE WHEN state = 'weak' THEN row_number() OVER (PARTITION BY nation, state ORDER BY score, i) END::INTEGER AS place FROM t""")
def score_dimensions(spark, sf_dir):
    """Dimensions as rows, the weak ones in order."""
    s = scored(spark, sf_dir)
    return scoring.dimensions(s, "nation", {n: scoring.penalty_score(F.col(n), 20) for n in ("complexity", "dead_code", "cohesion")} | {"architecture": F.lit(None)})


@query("""WITH h AS (SELECT l_suppkey AS file, sum(CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN -1 ELSE 1 END) FILTER (WHERE l_quantity > 45) AS d_high, sum(CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN -1 ELSE 1 END) FILTER (WHERE l_returnflag = 'R') AS d_critical,
  sum(CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN -1 ELSE 1 END) FILTER (WHERE l_returnflag = 'A') AS d_warning, max(l_discount) AS max_cc, sum(l_quantity)::BIGINT AS changed FROM lineitem GROUP BY 1)
SELECT file, coalesce(d_high, 0) > 0 OR coalesce(d_critical, 0) > 0 OR coalesce(d_warning, 0) > 0 AS worse, max_cc, changed FROM h""")
def regressions(spark, sf_dir):
    """Whether a later half-life of a file is worse than the earlier, with its greatest figure and lines changed."""
    sign = F.when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp"), -1).otherwise(1)
    delta = lambda cond: F.coalesce(F.sum(F.when(cond, sign)), F.lit(0))
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file")).agg(delta(F.col("l_quantity") > 45).alias("h"), delta(F.col("l_returnflag") == "R").alias("c"), delta(F.col("l_returnflag") == "A").alias("w"), F.max("l_discount").alias("max_cc"), F.sum("l_quantity").cast("long").alias("changed"))
    return per.select("file", metrics.regressed(F.lit(0), F.col("h"), F.col("c"), F.col("w")).alias("worse"), "max_cc", "changed")


# ---- names and paths ----


@query(r"SELECT p_partkey, regexp_matches(p_type, '^[^/]*BRASS$') OR regexp_matches(p_type, '^SMALL [^/]*$') OR regexp_matches(p_type, '^[^/]ROMO[^/]*$') OR lower(p_type) = 'economy anodized steel' AS excluded FROM part")
def excluded_names(spark, sf_dir):
    """Class names that patterns leave out: globs, or equal in any case."""
    return table(spark, sf_dir, "part").select("p_partkey", fn.matches_names(F.col("p_type"), ["*BRASS", "SMALL *", "?ROMO*", "Economy Anodized Steel"]).alias("excluded"))


@query(rf"""WITH {PATHS}, q AS (SELECT page_id, '/app' || path AS path, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths), s AS (SELECT *, regexp_extract(base, '^(.*?)(?:\.[^.]*)?$', 1) AS stem FROM q)
SELECT page_id, len(list_filter(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), lambda x: x IN ('en', 'test'))) > 0 AS in_tests,
  contains(path, '/app/') AND stem IN ('page', 'layout', 'template', 'loading', 'error', 'not-found', 'default', 'route') AS convention, contains(path, '/app/') AND stem = 'route' AS route FROM s""")
def framework_files(spark, sf_dir):
    """Pages in folders of tests, and those that a framework calls by their names."""
    path = F.concat(F.lit("/app"), fn.url_path(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", fn.in_folders(path, ["en", "test"]).alias("in_tests"), fn.is_convention(path).alias("convention"), fn.is_route(path).alias("route"))


@query(rf"""WITH {PATHS} SELECT page_id, regexp_replace(regexp_replace(regexp_replace(ltrim(path, '/'), '^(\./)+', ''), '^(\.\./)+', ''), '^([^/]+)/.*$', '\1', 's') AS package,
  CASE WHEN starts_with(path, '/en/') THEN substr(path, 5) ELSE path END AS relative, list_extract(string_split(path, '/'), -1) AS last FROM paths""")
def module_names(spark, sf_dir):
    """The package a path names, its path below a root and its last part."""
    path = fn.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fn.package_of(F.ltrim(path, F.lit("/"))).alias("package"), fn.relative_to(path, "/en").alias("relative"), fn.last_part(path, "/").alias("last"))


@query("""SELECT p_brand AS module, least(count(*) / 10.0, 1)::DOUBLE AS abstractness, round(count(*) FILTER (WHERE p_type LIKE '%BRASS')::DOUBLE / count(*), 6) AS interfaces, count(*) FILTER (WHERE upper(p_name[1]) = p_name[1] AND lower(p_name[1]) <> p_name[1]) AS exported FROM part GROUP BY p_brand""")
def module_abstractness(spark, sf_dir):
    """How abstract modules are: by their exports, by the share of interfaces, and how many names are exported."""
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("module")).agg(fn.abstractness(n).alias("abstractness"), F.round(F.count(F.when(F.col("p_type").endswith("BRASS"), 1)) / n, 6).alias("interfaces"), F.count(F.when(fn.is_exported(F.col("p_name")), 1)).alias("exported"))


# ---- imports ----

LINKS = rf"""hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages), {PATHS}"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", fn.url_path(F.col("url")).alias("src"), F.explode(found).alias("target"))


@query(rf"""WITH {LINKS}, i AS (SELECT p.path AS src, h.target AS dst, CASE WHEN h.target LIKE '%,' THEN 'dynamic' WHEN h.target LIKE '%.' THEN 'type_only' ELSE 'import' END AS kind FROM hrefs h JOIN paths p USING (page_id))
SELECT src, dst, arg_min(kind, CASE kind WHEN 'dynamic' THEN 0 WHEN 'type_only' THEN 1 ELSE 2 END) AS kind, count(*) AS weight FROM i GROUP BY src, dst""")
def module_edges(spark, sf_dir):
    """Links between modules with their kind and weight."""
    t = F.col("target")
    kind = F.when(t.endswith(","), "dynamic").when(t.endswith("."), "type_only").otherwise("import")
    known = table(spark, sf_dir, "pages").select(fn.url_path(F.col("url")).alias("node")).distinct()
    return graph.module_graph(links(spark, sf_dir).select("src", "target", kind.alias("kind"), F.lit(1).alias("names")), known)[1]


@query(rf"WITH {LINKS}, k AS (SELECT DISTINCT path AS node FROM paths) SELECT node, false AS external FROM k UNION ALL SELECT DISTINCT target, true FROM hrefs WHERE target NOT IN (SELECT node FROM k)")
def module_nodes(spark, sf_dir):
    """Modules, and what is linked but not known as external ones."""
    known = table(spark, sf_dir, "pages").select(fn.url_path(F.col("url")).alias("node")).distinct()
    return graph.module_graph(links(spark, sf_dir).select("src", "target", F.lit("import").alias("kind"), F.lit(1).alias("names")), known)[0]


@query(r"""WITH e AS (SELECT DISTINCT p_brand AS file, p_type AS name, p_size FROM part), i AS (SELECT p_brand AS file, CASE WHEN l_linenumber = 7 AND l_discount > 0.09 THEN '*' ELSE p_type END AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_quantity > 49)
SELECT file, name, count(*) AS exports FROM e WHERE p_size > 5 AND file NOT IN (SELECT file FROM i WHERE name = '*') AND (file, name) NOT IN (SELECT file, name FROM i) GROUP BY file, name""")
def unused_names(spark, sf_dir):
    """Exported names that nobody imports; small ones are tests, and a file that is imported whole has none."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("name"), "p_size").distinct()
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    star = (F.col("l_linenumber") == 7) & (F.col("l_discount") > 0.09)
    imports = li.select(F.col("p_brand").alias("file"), F.when(star, "*").otherwise(F.col("p_type")).alias("name"))
    return metrics.unused(e, imports, F.col("p_size") <= 5).groupBy("file", "name").agg(F.count(F.lit(1)).alias("exports"))


@query(r"""WITH e AS (SELECT event_id AS ref, 'c' || user_id AS k0, event_type || '/' || (user_id % 20) AS k1, event_type AS k2 FROM events WHERE event_id % 4 = 0),
a AS (SELECT 'c' || c_custkey AS key, c_custkey AS target FROM customer WHERE c_nationkey = 3), b AS (SELECT DISTINCT event_type || '/' || (user_id % 20) AS key, user_id AS target FROM events WHERE user_id <= 25), c AS (SELECT DISTINCT event_type AS key, 7::BIGINT AS target FROM events WHERE event_type < 'f'),
u AS (SELECT key, min(target) AS target FROM b GROUP BY key HAVING count(DISTINCT target) = 1)
SELECT ref, coalesce(a.target, u.target, c.target) AS target, CASE WHEN a.key IS NOT NULL THEN 0 WHEN u.key IS NOT NULL THEN 1 WHEN c.key IS NOT NULL THEN 2 END AS strategy FROM e LEFT JOIN a ON a.key = k0 LEFT JOIN u ON u.key = k1 LEFT JOIN c ON c.key = k2""")
def resolved_references(spark, sf_dir):
    """References by the first strategy that knows them: qualified name, name in a folder, bare name. What is ambiguous does not tell."""
    ev, t = table(spark, sf_dir, "events"), F.col("event_type")
    local = F.concat(t, F.lit("/"), (F.col("user_id") % 20).cast("string"))
    refs = ev.where("event_id % 4 = 0").select(F.col("event_id").alias("ref"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("key_0"), local.alias("key_1"), t.alias("key_2"))
    c = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("target"))
    near = ev.where("user_id <= 25").select(local.alias("key"), F.col("user_id").alias("target"))
    return metrics.resolved(refs, [c, near, ev.where("event_type < 'f'").select(t.alias("key"), F.lit(7).cast("long").alias("target"))])


@query(rf"""WITH {PATHS}, f AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM paths), x AS (SELECT page_id, l[-1] AS want FROM f WHERE len(l) > 0),
k AS (SELECT f.page_id AS of, array_to_string(list_slice(l, len(l) - i + 1, len(l)), '/') AS suffix FROM f, range(1, 6) r(i) WHERE i <= len(l)) SELECT x.page_id, count(*) AS matches, min(of) AS first FROM x JOIN k ON suffix = want GROUP BY x.page_id""")
def suffix_match(spark, sf_dir):
    """All files whose path ends as an alias does."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(fn.suffixes(fn.url_path(F.col("url")), 5)).alias("suffix"))
    want = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.get(fn.suffixes(fn.url_path(F.col("url")), 1), F.lit(0)).alias("suffix"))
    return want.join(pages, "suffix").groupBy(F.col("id").alias("page_id")).agg(F.count(F.lit(1)).alias("matches"), F.min("page_id").alias("first"))


# ---- ways through the dependency graph ----


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT 0::BIGINT AS node, 0 AS place UNION SELECT e.dst, place + 1 FROM r JOIN edges e ON e.src = node WHERE place < 25) SELECT min(place)::BIGINT AS hops FROM r WHERE node = 7 HAVING min(place) IS NOT NULL")
def route_length(spark, sf_dir):
    """Links on a shortest way between two modules."""
    way = graph.route(graph.written(edges(spark, sf_dir), "edges"), 0, 7)
    return way.agg(F.max("place").alias("hops")).where("hops is not null")


@query(f"""WITH RECURSIVE {CLOSURE}, l AS (SELECT a.src AS node, min(a.dst) AS scc FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), g AS (SELECT scc, string_agg(node::VARCHAR, ', ' ORDER BY node) AS members, count(*) AS size FROM l GROUP BY scc HAVING count(*) > 1),
e AS (SELECT x.scc, edges.src, edges.dst FROM edges JOIN w ON w.src = edges.src AND w.dst = edges.dst JOIN l x ON x.node = edges.src JOIN l y ON y.node = edges.dst WHERE x.scc = y.scc QUALIFY row_number() OVER (PARTITION BY x.scc ORDER BY weight, edges.src, edges.dst) = 1)
SELECT scc, 'Remove or invert the dependency of ''' || src || ''' on ''' || dst || ''' to break the cycle' AS suggestion FROM e UNION ALL SELECT scc, 'Extract interfaces for modules: ' || members FROM g WHERE size >= 3""")
def cycle_suggestions(spark, sf_dir):
    w = graph.written(weighted_edges(spark, sf_dir), "weighted")
    return graph.suggestions(graph.cycles(w.select("src", "dst")), graph.break_edges(w))


_BEST = f"{EDGES.replace('edges AS (SELECT src, dst FROM', 'forward AS (SELECT src, dst FROM')}, edges AS (SELECT dst AS src, src AS dst FROM forward)"
_BACK = CHAINS.replace(EDGES, _BEST)


@query(f"WITH RECURSIVE {_BACK} SELECT scc AS node, weight FROM m WHERE scc IN (SELECT src FROM forward) AND scc NOT IN (SELECT dst FROM forward) ORDER BY weight DESC, scc LIMIT 5")
def entry_chains(spark, sf_dir):
    """The entries from which the heaviest chains start."""
    return graph.entry_chains(graph.written(edges(spark, sf_dir), "edges"))


@query(f"""WITH RECURSIVE {CHAINS}, c AS (SELECT scc, weight, (SELECT min(s) FROM k JOIN m b ON b.scc = s WHERE d = m.scc AND b.weight = m.weight - m.size) AS before FROM m)
SELECT row_number() OVER (ORDER BY weight DESC, scc)::INTEGER AS rank, scc, weight FROM c WHERE scc NOT IN (SELECT before FROM c WHERE before IS NOT NULL) QUALIFY rank <= 3""")
def top_chains(spark, sf_dir):
    """The ends of the heaviest chains."""
    return graph.top_chains(edges(spark, sf_dir))


# ---- scripts in pages, and sketches ----


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1, 's')) AS code FROM pages), c AS (SELECT page_id, string_agg(code, chr(10)) AS code FROM s GROUP BY page_id)
SELECT page_id, length(code) - length(replace(code, ';', '')) AS statements, len(regexp_extract_all(code, '[A-Za-z_]+\(')) AS calls, 1::BIGINT AS functions, 0::BIGINT AS errors FROM c""")
def page_scripts(spark, sf_dir):
    """Statements, calls, functions (the script itself is one) and errors of the scripts in each page, by the parser of scripts."""
    found = F.regexp_extract_all("html", F.lit("(?s)<script>(.*?)</script>"), F.lit(1))
    files = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.array_join(found, "\n").alias("content")).where("content <> ''")
    facts = js.facts(files)
    n = lambda c: F.count(F.when(c, 1))
    calls = n((F.col("kind") == "ident") & (F.col("name") == "track"))
    return facts.groupBy(F.col("path").cast("long").alias("page_id")).agg(n(F.col("kind") == "stmt").alias("statements"), calls.alias("calls"), n(F.col("kind") == "function").alias("functions"), n(F.col("kind") == "error").alias("errors"))


@query(r"""WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\r\n]+'), lambda x: x <> '')) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS k FROM w GROUP BY item_id),
f AS (SELECT item_id, n, min(item_id) OVER (PARTITION BY k) AS first FROM n), s AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.item_id < y.item_id GROUP BY 1, 2)
SELECT a, b, round(shared::DOUBLE / (x.n + y.n - shared), 6) AS similarity FROM s JOIN f x ON x.item_id = a AND x.first = a JOIN f y ON y.item_id = b AND y.first = b WHERE shared::DOUBLE / (x.n + y.n - shared) >= 0.03 UNION ALL SELECT first, item_id, 1 FROM f WHERE first <> item_id""")
def jaccard_pairs(spark, sf_dir):
    """Benchmark texts with a thirtieth of their words in common: all that share a word are compared, at any size."""
    ws = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda x: x != ""))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), ws.alias("features"))
    return sketch.similar_pairs(items, 0.03, prefilter=0).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def lsh_pairs(spark, sf_dir):
    """Documents whose runs of four words are alike by 0.65 or more, by bands of their signatures; a search that can miss, tests measure how much."""
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sketch.similar_texts(items, 4, 65).select("a", "b", F.round("similarity", 6).alias("similarity"))
