"""The operators on the driver's tables, and the same results in plain SQL.

Roles: an order is a function and its line items are its decisions; a customer is a module, a nation a directory, a region a project; a
supplier is a class and brands are what it depends on; events are references and control-flow steps of a user; a page is a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrel import functions as fn
from quarrel.operators import graph, intervals, metrics, scoring, similarity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- complexity ----

FUNCTIONS = """functions AS (
  SELECT o_orderkey AS fn, o_custkey AS module, count(l_orderkey) + 1 AS complexity
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey)"""
STATS = """count(*) AS functions, round(avg(complexity), 6) AS avg_cc, max(complexity)::BIGINT AS max_cc,
  count(*) FILTER (WHERE complexity > 19) AS high_risk"""


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn, module, complexity: decisions are counted before the join, so orders meet one row each."""
    decisions = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fn")).agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fn"), F.col("o_custkey").alias("module"))
    return orders.join(decisions, "fn", "left").select("fn", "module", (F.coalesce("n", F.lit(0)) + 1).alias("complexity"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """functions with nation and region."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    homes = customer.join(where, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("module"), "nation", "region")
    return functions(spark, sf_dir).join(homes, "module")


PLACED = FUNCTIONS + """, placed AS (
  SELECT f.*, n_name AS nation, r_name AS region FROM functions f JOIN customer ON module = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {FUNCTIONS} SELECT count(*) AS functions, round(avg(complexity), 6) AS avg_cc, min(complexity)::BIGINT AS min_cc,
  max(complexity)::BIGINT AS max_cc, count(*) FILTER (WHERE complexity <= 9) AS low_risk,
  count(*) FILTER (WHERE complexity > 9 AND complexity <= 19) AS medium_risk, count(*) FILTER (WHERE complexity > 19) AS high_risk FROM functions""")
def complexity_summary(spark, sf_dir):
    return metrics.summary(functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS} SELECT complexity::BIGINT AS complexity, count(*) AS n FROM functions GROUP BY 1")
def complexity_distribution(spark, sf_dir):
    return metrics.distribution(functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS} SELECT median(complexity)::DOUBLE AS median_cc FROM functions")
def complexity_median(spark, sf_dir):
    return metrics.median(functions(spark, sf_dir))


@query(f"""WITH {FUNCTIONS}, b AS (SELECT CASE WHEN complexity <= 1 THEN 0 WHEN complexity <= 5 THEN 1 WHEN complexity <= 9 THEN 2 WHEN complexity <= 19 THEN 3 ELSE 4 END AS bin FROM functions)
SELECT r.range::BIGINT AS bin, count(b.bin) AS n FROM range(5) r LEFT JOIN b ON b.bin = r.range GROUP BY 1""")
def complexity_histogram(spark, sf_dir):
    return metrics.histogram(functions(spark, sf_dir))


@query(f"WITH {FUNCTIONS} SELECT module, {STATS} FROM functions GROUP BY module")
def module_rollup(spark, sf_dir):
    return metrics.rollup_by(functions(spark, sf_dir), "module")


@query(f"WITH {PLACED} SELECT nation, {STATS} FROM placed GROUP BY nation")
def directory_rollup(spark, sf_dir):
    return metrics.rollup_by(placed(spark, sf_dir), "nation")


@query(f"WITH {PLACED} SELECT region, nation, {STATS} FROM placed GROUP BY ROLLUP (region, nation)")
def rollup_levels(spark, sf_dir):
    return metrics.rollup_sets(placed(spark, sf_dir), "region", "nation")


@query(f"WITH {PLACED} SELECT region, {STATS} FROM placed GROUP BY region")
def merged_rollup(spark, sf_dir):
    """Per-module parts merged by region; averages weigh by functions. Parts keep sums, so nothing is rounded twice."""
    f = placed(spark, sf_dir)
    parts = f.groupBy("region", "module").agg(F.count(F.lit(1)).alias("functions"), F.avg("complexity").alias("avg_cc"), F.max("complexity").cast("long").alias("max_cc"), F.count(F.when(F.col("complexity") > 19, 1)).alias("high_risk"))
    return metrics.merged(parts, "region")


@query(f"""WITH {FUNCTIONS}, r AS (SELECT module, {STATS} FROM functions GROUP BY module)
SELECT module, functions, avg_cc, max_cc, high_risk, row_number() OVER (ORDER BY high_risk DESC, max_cc DESC, avg_cc DESC, functions DESC, module)::INTEGER AS rank FROM r QUALIFY rank <= 8""")
def hotspots_topk(spark, sf_dir):
    return metrics.hotspots(metrics.rollup_by(functions(spark, sf_dir), "module"), "module")


@query(f"""WITH {FUNCTIONS}, a AS (SELECT module, {STATS} FROM functions GROUP BY module),
b AS (SELECT user_id AS module, count(*) AS findings, count(*) FILTER (WHERE event_type = 'purchase') AS critical FROM events GROUP BY user_id)
SELECT coalesce(a.module, b.module) AS module, coalesce(functions, 0) AS functions, coalesce(max_cc, 0) AS max_cc, coalesce(high_risk, 0) AS high_risk,
  coalesce(findings, 0) AS findings, coalesce(critical, 0) AS critical FROM a FULL OUTER JOIN b ON a.module = b.module""")
def module_quality_full_outer(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("module")).agg(F.count(F.lit(1)).alias("findings"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("critical"))
    return metrics.quality(metrics.rollup_by(functions(spark, sf_dir), "module"), found, "module")


@query(f"""WITH {FUNCTIONS} SELECT CASE WHEN complexity <= 9 THEN 'low' WHEN complexity <= 19 THEN 'medium' ELSE 'high' END AS risk, count(*) AS n FROM functions GROUP BY 1""")
def risk_levels(spark, sf_dir):
    return functions(spark, sf_dir).groupBy(metrics.risk(F.col("complexity"), metrics.COMPLEXITY_RISK).alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FUNCTIONS} SELECT fn, module, complexity::BIGINT AS complexity FROM functions WHERE complexity >= 5 AND complexity <= 8")
def complexity_filter(spark, sf_dir):
    return functions(spark, sf_dir).where(F.col("complexity").between(5, 8))


@query("""WITH h AS (SELECT o_custkey AS module, CASE WHEN month(o_orderdate) <= 6 THEN 0 ELSE 1 END AS half, o_totalprice AS v FROM orders),
s AS (SELECT module, max(v) FILTER (WHERE half = 0) AS before, max(v) FILTER (WHERE half = 1) AS after FROM h GROUP BY module)
SELECT module, round(after - before, 2) AS delta, before IS NULL AS created, after IS NULL AS removed FROM s WHERE before IS NULL OR after IS NULL OR after > before""")
def function_delta(spark, sf_dir):
    """Modules that got worse from the first half-years to the second, are new, or went."""
    first = F.month("o_orderdate") <= 6
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("module")).agg(F.max(F.when(first, F.col("o_totalprice"))).alias("b"), F.max(F.when(~first, F.col("o_totalprice"))).alias("a"))
    return s.where("a is null or b is null or a > b").select("module", F.round(F.col("a") - F.col("b"), 2).alias("delta"), F.col("b").isNull().alias("created"), F.col("a").isNull().alias("removed"))


# ---- coupling and cohesion ----

DEPS = """deps AS (SELECT l_suppkey AS class, p_brand AS dep, l_returnflag AS kind FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL)"""
CBO = f"""{DEPS}, d AS (SELECT DISTINCT class, dep, kind FROM deps),
n AS (SELECT class, count(*) AS cbo, string_agg(dep, ',' ORDER BY dep) AS deps FROM (SELECT DISTINCT class, dep FROM d) x GROUP BY class),
k AS (SELECT class, string_agg(kind || '=' || c, ',' ORDER BY kind) AS by_kind FROM (SELECT class, kind, count(*) AS c FROM d GROUP BY class, kind) x GROUP BY class)"""


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("class"), F.col("p_brand").alias("dep"), F.col("l_returnflag").alias("kind"))


@query(f"WITH {CBO} SELECT n.class, cbo, deps, by_kind, CASE WHEN cbo <= 3 THEN 'low' WHEN cbo <= 7 THEN 'medium' ELSE 'high' END AS risk FROM n JOIN k ON n.class = k.class")
def cbo_by_supplier(spark, sf_dir):
    return metrics.cbo(deps(spark, sf_dir))


@query(f"""WITH {CBO} SELECT CASE WHEN cbo = 0 THEN '0' WHEN cbo <= 3 THEN '1-3' WHEN cbo <= 7 THEN '4-7' WHEN cbo <= 10 THEN '8-10' ELSE '10+' END AS bucket, count(*) AS classes FROM n GROUP BY 1""")
def cbo_buckets(spark, sf_dir):
    return metrics.cbo_buckets(metrics.cbo(deps(spark, sf_dir)))


@query("""WITH RECURSIVE m AS (SELECT DISTINCT l_orderkey AS class, l_linenumber AS method FROM lineitem),
e AS (SELECT DISTINCT a.l_orderkey AS class, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey),
r AS (SELECT class, method AS x, method AS y FROM m UNION SELECT r.class, r.x, e.y FROM r JOIN e ON r.class = e.class AND r.y = e.x),
c AS (SELECT class, x, min(y) AS c FROM r GROUP BY class, x)
SELECT class, count(*) AS methods, count(DISTINCT c) AS lcom4, CASE WHEN count(DISTINCT c) <= 2 THEN 'low' WHEN count(DISTINCT c) <= 5 THEN 'medium' ELSE 'high' END AS risk FROM c GROUP BY class""")
def lcom4(spark, sf_dir):
    return metrics.lcom4(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("class"), F.col("l_linenumber").alias("method"), F.col("l_suppkey").alias("target")))


# ---- dependency graph: nations, with the links that carry more than their source's mean ----

EDGES = """w AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
edges AS (SELECT src, dst FROM (SELECT *, avg(weight) OVER (PARTITION BY src) AS mean FROM w) x WHERE weight > 1.5 * mean AND src <> dst)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_edges(spark, sf_dir).select("src", "dst")


def weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, s = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    met = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    w = met.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    mean = F.avg("weight").over(Window.partitionBy("src"))
    return w.withColumn("mean", mean).where("weight > 1.5 * mean and src <> dst").select("src", "dst", "weight")


COUPLING = f"""{EDGES}, n AS (SELECT n_nationkey::BIGINT AS node, count(c_custkey) FILTER (WHERE c_acctbal < 0)::DOUBLE / greatest(count(c_custkey), 1) AS a
  FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1),
m AS (SELECT node, a, (SELECT count(*) FROM edges WHERE dst = node) AS ca, (SELECT count(*) FROM edges WHERE src = node) AS ce FROM n),
i AS (SELECT *, CASE WHEN ca + ce > 0 THEN ce::DOUBLE / (ca + ce) ELSE 0 END AS i FROM m),
metrics AS (SELECT node, ca::BIGINT AS ca, ce::BIGINT AS ce, round(i, 6)::DOUBLE AS instability, round(a, 6) AS abstractness, round(abs(a + i - 1), 6)::DOUBLE AS distance FROM i)"""


def coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    per = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy(F.col("n_nationkey").cast("long").alias("node"))
    a = per.agg((F.count(F.when(F.col("c_acctbal") < 0, F.col("c_custkey"))) / F.greatest(F.count("c_custkey"), F.lit(1))).alias("a"))
    return graph.coupling(edges(spark, sf_dir), a)


@query(f"WITH {COUPLING} SELECT * FROM metrics")
def coupling_metrics(spark, sf_dir):
    return coupled(spark, sf_dir)


@query(f"""WITH {COUPLING} SELECT node, CASE WHEN distance >= 0.5 AND ca >= 2 AND instability <= 0.3 AND abstractness <= 0.3 THEN 'pain'
  WHEN distance >= 0.5 AND instability >= 0.7 AND abstractness >= 0.7 THEN 'uselessness' WHEN distance <= 0.2 THEN 'main_sequence' ELSE 'none' END AS zone FROM metrics""")
def stability_zones(spark, sf_dir):
    return graph.zones(coupled(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))


@query(f"""WITH {EDGES} SELECT n_nationkey::BIGINT AS node, n_nationkey NOT IN (SELECT dst FROM edges) AS is_entry, n_nationkey NOT IN (SELECT src FROM edges) AS is_leaf FROM nation""")
def node_flags(spark, sf_dir):
    return graph.node_flags(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM edges) UNION SELECT e.dst FROM r JOIN edges e ON r.node = e.src)
SELECT node FROM r""")
def reachable(spark, sf_dir):
    e = graph.written(edges(spark, sf_dir), "edges")
    return graph.reachable(e, graph.node_flags(nodes(spark, sf_dir), e).where("is_entry").select("node"))


@query(f"""WITH RECURSIVE {EDGES}, r AS (SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM edges) UNION SELECT e.dst FROM r JOIN edges e ON r.node = e.src)
SELECT n_nationkey::BIGINT AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM r)""")
def orphans(spark, sf_dir):
    return nodes(spark, sf_dir).join(reachable(spark, sf_dir), "node", "left_anti")


CLOSURE = f"{EDGES}, p AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM p JOIN edges e ON p.dst = e.src)"


@query(f"WITH RECURSIVE {CLOSURE} SELECT src, dst FROM p")
def transitive_closure(spark, sf_dir):
    return graph.closure(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {CLOSURE}, l AS (SELECT a.src AS node, min(a.dst) AS scc FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
g AS (SELECT scc, count(*) AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM l GROUP BY scc HAVING count(*) > 1)
SELECT scc, size, members, CASE WHEN size <= 2 THEN 'low' WHEN size <= 4 THEN 'medium' WHEN size <= 6 THEN 'high' ELSE 'critical' END AS severity FROM g""")
def dependency_cycles(spark, sf_dir):
    return graph.cycles(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, u AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
r AS (SELECT a AS id, a AS x FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.x = u.a)
SELECT id, min(x) AS component FROM r GROUP BY id""")
def graph_components(spark, sf_dir):
    return graph.components(edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query()
def group_kcore(spark, sf_dir):
    return graph.kcore(edges(spark, sf_dir).select(F.col("src").alias("a"), F.col("dst").alias("b")), 2)


CHAINS = f"""{CLOSURE}, l AS (SELECT a.src AS node, min(a.dst) AS scc FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src),
n AS (SELECT DISTINCT node, coalesce(l.scc, x.node) AS scc FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) x LEFT JOIN l USING (node)), z AS (SELECT scc, count(*) AS size FROM n GROUP BY scc),
k AS (SELECT DISTINCT a.scc AS s, b.scc AS d FROM edges JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.scc <> b.scc),
r AS (SELECT scc, size::BIGINT AS w FROM z UNION SELECT d, w + size FROM r JOIN k ON r.scc = s JOIN z ON z.scc = d),
m AS (SELECT scc, any_value(size) AS size, max(w) AS weight FROM r JOIN z USING (scc) GROUP BY scc)"""


@query(f"WITH RECURSIVE {CHAINS} SELECT scc, size, weight, (SELECT min(s) FROM k JOIN m b ON b.scc = s WHERE d = m.scc AND b.weight = m.weight - m.size) AS before FROM m")
def chain_weights(spark, sf_dir):
    """The heaviest chain of components that ends with each, and what stands before it."""
    return graph.chains(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {CHAINS}, c AS (SELECT scc, size, weight, (SELECT min(s) FROM k JOIN m b ON b.scc = s WHERE d = m.scc AND b.weight = m.weight - m.size) AS before FROM m),
t AS (SELECT * FROM (SELECT * FROM c ORDER BY weight DESC, scc LIMIT 1) y UNION SELECT c.* FROM t JOIN c ON c.scc = t.before)
SELECT row_number() OVER (ORDER BY weight) AS place, scc, size FROM t""")
def longest_chain(spark, sf_dir):
    """The heaviest chain of components, whatever cycles there are."""
    return graph.longest_chain(edges(spark, sf_dir))


# ---- unused elements and paths ----


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def unused_exports(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(used, "p_partkey", "left_anti")


PATHS = r"paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS path FROM pages)"


@query(rf"WITH {PATHS} SELECT page_id, path, regexp_extract(path, '^(?:\.{{0,2}}/)*([^/]*)', 1) AS module FROM paths")
def normalize_module(spark, sf_dir):
    path = fn.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), fn.module_of(path).alias("module"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^\.{1,2}(/|$)') THEN 'relative' WHEN url LIKE '/%' THEN 'absolute' WHEN regexp_matches(url, '^[@~]/') THEN 'alias'
  WHEN regexp_matches(url, '^[a-z]+://') THEN 'url' ELSE 'package' END AS kind FROM pages""")
def classify_source(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.source_kind(F.col("url")).alias("kind"))


@query(rf"WITH {PATHS}, s AS (SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS suffix FROM paths) SELECT suffix, count(*) AS files, min(page_id) AS first_page FROM s GROUP BY suffix")
def suffix_index(spark, sf_dir):
    s = F.regexp_extract(fn.url_path(F.col("url")), "([^/]*)$", 1)
    return table(spark, sf_dir, "pages").groupBy(s.alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.min("page_id").alias("first_page"))


# ---- control flow and data flow over events and conversations ----


@query("""WITH d AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'click' THEN struct_pack(ts := ts, id := event_id) END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM events)
SELECT event_id AS use_id, user_id, d.id AS def_id FROM d WHERE event_type = 'purchase'""")
def asof_def_use(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", "ts")
    found = intervals.latest_before(e, "user_id", ["ts", "id"], F.col("event_type") == "click", F.col("event_type") == "purchase")
    return found.select(F.col("id").alias("use_id"), "user_id", "def_id")


@query("""SELECT user_id, count(*) AS refs, count(*) FILTER (WHERE event_type = 'click') AS defs, count(*) FILTER (WHERE event_type = 'purchase') AS uses,
  count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""")
def dfa_features(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("refs"), F.count(F.when(t == "click", 1)).alias("defs"), F.count(F.when(t == "purchase", 1)).alias("uses"), F.countDistinct(t).alias("kinds"))


@query("""WITH s AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
t AS (SELECT user_id, src, count(DISTINCT dst) AS n FROM s WHERE dst IS NOT NULL GROUP BY user_id, src)
SELECT user_id, (sum(n - 1) + 1)::BIGINT AS complexity FROM t GROUP BY user_id""")
def mccabe(spark, sf_dir):
    """A block's distinct targets less one, summed, and one."""
    dst = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    t = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("src"), dst.alias("dst")).where("dst is not null").groupBy("user_id", "src").agg(F.countDistinct("dst").alias("n"))
    return t.groupBy("user_id").agg((F.sum(F.col("n") - 1) + 1).cast("long").alias("complexity"))


@query("""WITH s AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations),
b AS (SELECT conv_id, count(DISTINCT role) AS blocks, count(nxt) AS steps FROM s GROUP BY conv_id),
e AS (SELECT conv_id, count(*) AS edges FROM (SELECT DISTINCT conv_id, role, nxt FROM s WHERE nxt IS NOT NULL) x GROUP BY conv_id)
SELECT b.conv_id, blocks, steps, coalesce(edges, 0) AS edges, coalesce(edges, 0) - blocks + 2 AS cyclomatic FROM b LEFT JOIN e ON b.conv_id = e.conv_id""")
def cfg_features(spark, sf_dir):
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    s = table(spark, sf_dir, "conversations").select("conv_id", "role", nxt.alias("nxt"))
    f = s.groupBy("conv_id").agg(F.countDistinct("role").alias("blocks"), F.count("nxt").alias("steps"), F.countDistinct(F.when(F.col("nxt").isNotNull(), F.struct("role", "nxt"))).alias("edges"))
    return f.withColumn("cyclomatic", F.col("edges") - F.col("blocks") + 2)


@query("SELECT CASE event_type WHEN 'purchase' THEN 'critical' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity, count(*) AS findings, count(DISTINCT user_id) AS files FROM events GROUP BY 1")
def severity_rollup(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy(F.when(t == "purchase", "critical").when(t == "click", "warning").otherwise("info").alias("severity")).agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("user_id").alias("files"))


# ---- intervals ----


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
p AS (SELECT o_custkey AS k, l_orderkey * 8 + l_linenumber AS pid, l_shipdate AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT pid, id, row_number() OVER (PARTITION BY pid ORDER BY epoch(e) - epoch(s), epoch(s) DESC, id) AS r FROM p JOIN s ON p.k = s.k AND p.at BETWEEN s.s AND s.e)
SELECT pid AS point_id, id AS span_id FROM m WHERE r = 1""")
def innermost_span(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    both = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    spans = both.groupBy(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("span_id"), F.col("o_orderdate").alias("s")).agg(F.max("l_shipdate").alias("e"))
    points = both.select(F.col("o_custkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), F.col("l_shipdate").alias("at"))
    return intervals.innermost(spans, points)


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
SELECT k AS key, id AS span_id FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.k = a.k AND b.id <> a.id AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e OR b.id < a.id))""")
def group_dedupe_subset(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e"))
    spans = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("span_id"), F.col("o_orderdate").alias("s"), "e")
    return intervals.maximal(spans).select("key", "span_id")


@query("""WITH r AS (SELECT user_id, floor(epoch(ts) / 3600)::BIGINT AS s, event_type AS reason, event_id FROM events),
f AS (SELECT *, CASE WHEN reason IS DISTINCT FROM lag(reason) OVER w OR s > lag(s) OVER w + 1 THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY user_id ORDER BY s, reason, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, reason, event_id) AS run FROM f)
SELECT user_id, min(s) AS s, max(s) AS e, reason, count(*) AS merged FROM g GROUP BY user_id, run, reason""")
def merge_contiguous(spark, sf_dir):
    """Hours of a user's events as ranges: neighbours of one kind that touch are one finding."""
    hour = F.floor(F.unix_timestamp("ts") / 3600).cast("long")
    rows = table(spark, sf_dir, "events").select("user_id", hour.alias("s"), hour.alias("e"), F.col("event_type").alias("reason"), F.lit(1).alias("level"))
    return intervals.islands(rows, "user_id").drop("level")


# ---- text, copies, trees, scores ----


@query(r"SELECT doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS loc FROM documents")
def loc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.loc(F.col("text")).alias("loc"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(translate(x, chr(9) || chr(13), '  ')) <> ''))::BIGINT AS code_lines FROM documents")
def code_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.code_lines(F.col("text")).alias("code_lines"))


@query(r"""WITH d AS (SELECT doc_id AS id, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL)
SELECT digest, count(*) AS size, min(id) AS first_id FROM d GROUP BY digest HAVING count(*) > 1""")
def exact_clones(spark, sf_dir):
    return similarity.exact_groups(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _grams(name: str, key: str, of: str, k: int) -> str:
    """CTE name(key, g): the distinct runs of k words of table `of`."""
    run = " || ' ' || ".join(["w", *(f"lead(w, {j}) OVER o" for j in range(1, k))])
    return rf"""{name} AS (SELECT DISTINCT {key}, g FROM (SELECT {key}, {run} AS g FROM (SELECT {key}, w, i FROM (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS i
  FROM (SELECT {key}, regexp_split_to_array(lower(text), '[ \t\r\n]+') AS l FROM {of}) t) u WHERE w <> '') v WINDOW o AS (PARTITION BY {key} ORDER BY i)) x WHERE g IS NOT NULL)"""


@query(f"WITH {_grams('g', 'doc_id', 'documents', 4)} SELECT d.doc_id, count(g) AS grams FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id")
def kgram_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(similarity.gram_hashes(F.col("text"), 4)).cast("long").alias("grams"))


@query(f"""WITH {_grams('x', 'doc_id', 'documents', 8)}, {_grams('y', 'item_id', 'benchmark', 8)}, n AS (SELECT item_id, count(*) AS of FROM y GROUP BY item_id)
SELECT doc_id, y.item_id, count(*) AS shared, round(count(*)::DOUBLE / any_value(of), 6) AS containment FROM x JOIN y ON x.g = y.g JOIN n ON n.item_id = y.item_id GROUP BY doc_id, y.item_id""")
def containment_benchmark(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pid"), "text")
    return similarity.containment(docs, items).withColumnsRenamed({"id": "doc_id", "pid": "item_id"})


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::BIGINT AS distance,
  round(1 - levenshtein(a.n_name, b.n_name)::DOUBLE / greatest(length(a.n_name), length(b.n_name)), 6) AS similarity
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def levenshtein_pairs(spark, sf_dir):
    return similarity.levenshtein_pairs(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("text"), "n_regionkey"), "n_regionkey")


@query()
def dom_nesting(spark, sf_dir):
    return similarity.nesting(table(spark, sf_dir, "pages"))


@query()
def dom_tree_distance(spark, sf_dir):
    return similarity.neighbours_tree_distance(table(spark, sf_dir, "pages"))


@query("""WITH c AS (SELECT lang, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS worse, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS better
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id GROUP BY lang)
SELECT lang, worse, better, CASE WHEN worse + better = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(worse + better + 1) - lgamma(i.range + 1) - lgamma(worse + better - i.range + 1) - (worse + better) * ln(2)))
  FROM range(100000) i WHERE i.range <= least(worse, better))), 6) END AS p FROM c""")
def paired_mcnemar(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("before"), (F.col("toxic") == 1).alias("after"))
    return similarity.mcnemar(pairs, "lang")


@query("""WITH c AS (SELECT source, count(*) AS files FROM documents GROUP BY source)
SELECT source, files, CASE WHEN files < 10 THEN 'micro' WHEN files < 50 THEN 'small' WHEN files < 200 THEN 'medium' WHEN files < 1000 THEN 'large' ELSE 'enterprise' END AS scale FROM c""")
def project_scale(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    return c.select("source", "files", scoring.scale(F.col("files")).alias("scale"))


@query(f"""WITH {PLACED}, s AS (SELECT nation, count(*) AS total, count(*) FILTER (WHERE complexity > 6) + 0.5 * count(*) FILTER (WHERE complexity > 4 AND complexity <= 6) AS weighted FROM placed GROUP BY nation),
p AS (SELECT nation, greatest(CASE WHEN weighted > 0 THEN 1 ELSE 0 END, round(least(weighted / total / 0.9, 1.0) * 20))::BIGINT AS penalty FROM s),
h AS (SELECT nation, penalty, greatest(0, least(100, 100 - round(100.0 * penalty / 20)))::BIGINT AS score FROM p)
SELECT nation, penalty, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM h""")
def health_score(spark, sf_dir):
    cc = F.col("complexity")
    weighted = F.count(F.when(cc > 6, 1)) + 0.5 * F.count(F.when((cc > 4) & (cc <= 6), 1))
    s = placed(spark, sf_dir).groupBy("nation").agg(F.count(F.lit(1)).alias("total"), weighted.alias("weighted"))
    p = s.select("nation", scoring.ratio_penalty(F.col("weighted"), F.col("total"), 0.9, floor=True).alias("penalty"))
    return p.withColumn("score", scoring.health([F.col("penalty")], [scoring.BUDGET])).withColumn("grade", scoring.grade(F.col("score")))
