"""More operators on the driver's tables, with their SQL: penalties, cycles to break, paths, findings, profiles and similarity of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrel import functions as fn
from quarrel.operators import graph, metrics, scoring, similarity
from quarrel.plans.bindings import CBO, CLOSURE, COUPLING, EDGES, PATHS, PLACED, _grams, coupled, deps, edges, placed, query, table, weighted_edges

# ---- scores ----


@query("""WITH c AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS high, count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal < 1000) AS medium FROM customer GROUP BY 1),
p AS (SELECT nation, round(least((high + 0.3 * medium) / n / 0.4, 1) * 20)::BIGINT AS coupling, round(least(100.0 * high / n / 60, 1) * 20)::BIGINT AS duplication,
  CASE WHEN high = 0 THEN 0 ELSE greatest(round(56.0 * high / n), 11) END::BIGINT AS parse_errors, round(12.0 * high / n)::BIGINT AS architecture,
  (CASE WHEN high = 0 THEN 0 ELSE round(least(10, greatest(log2(high + 1), 10.0 * high / n))) END
   + least(3, greatest(0, medium - greatest(3, ceil(log2(n + 1)) + 1))) + round(3.0 * high / n))::BIGINT AS dependency FROM c)
SELECT nation, coupling, duplication, parse_errors, architecture, dependency, greatest(0, least(20, round(architecture * 20.0 / 12)))::BIGINT AS architecture_base,
  greatest(0, least(100, 100 - round(dependency * 100.0 / 16)))::BIGINT AS dependency_score FROM p""")
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are the bad cases of a nation, those with little money the medium ones."""
    bal = F.col("c_acctbal")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bal < 0, 1)).alias("high"), F.count(F.when((bal >= 0) & (bal < 1000), 1)).alias("medium"))
    n, high, medium = F.col("n"), F.col("high"), F.col("medium")
    p = c.select("nation", scoring.coupling_penalty(high, medium, n).alias("coupling"), scoring.duplication_penalty(100.0 * high / n).alias("duplication"), scoring.parse_error_penalty(high, n).alias("parse_errors"), scoring.architecture_penalty(1 - high / n).alias("architecture"), scoring.dependency_penalty(n, high, medium, high / n).alias("dependency"))
    return p.withColumn("architecture_base", scoring.to_base(F.col("architecture"), 12)).withColumn("dependency_score", scoring.penalty_score(F.col("dependency"), 16))


# ---- dependency graph ----


@query(f"""WITH {EDGES}, s AS (SELECT src AS node, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS successors FROM edges GROUP BY src), p AS (SELECT dst AS node, string_agg(src::VARCHAR, ',' ORDER BY src) AS predecessors FROM edges GROUP BY dst)
SELECT coalesce(s.node, p.node) AS node, coalesce(successors, '') AS successors, coalesce(predecessors, '') AS predecessors FROM s FULL OUTER JOIN p ON s.node = p.node""")
def neighbour_lists(spark, sf_dir):
    return graph.neighbours(edges(spark, sf_dir))


LABELS = f"{CLOSURE}, l AS (SELECT a.src AS node, min(a.dst) AS scc FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src)"


@query(f"""WITH RECURSIVE {LABELS}, e AS (SELECT coalesce(x.scc, src) AS scc_src, coalesce(y.scc, dst) AS scc_dst, src, dst FROM edges LEFT JOIN l x ON x.node = src LEFT JOIN l y ON y.node = dst)
SELECT scc_src, scc_dst, count(*) AS links, min(src * 1000 + dst) // 1000 AS src, min(src * 1000 + dst) % 1000 AS dst FROM e WHERE scc_src <> scc_dst GROUP BY scc_src, scc_dst""")
def condensation(spark, sf_dir):
    """Links between components, and the least of them."""
    return graph.condensation(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {LABELS}, e AS (SELECT x.scc, edges.src, edges.dst, weight FROM edges JOIN w ON w.src = edges.src AND w.dst = edges.dst JOIN l x ON x.node = edges.src JOIN l y ON y.node = edges.dst WHERE x.scc = y.scc)
SELECT scc, src, dst, weight FROM e QUALIFY row_number() OVER (PARTITION BY scc ORDER BY weight, src, dst) = 1""")
def cycle_break_edges(spark, sf_dir):
    """The lightest link inside each cycle."""
    return graph.break_edges(weighted_edges(spark, sf_dir))


BUCKET = "CASE WHEN ca + ce = 0 THEN 0 WHEN ca + ce <= 3 THEN 3 WHEN ca + ce <= 7 THEN 7 WHEN ca + ce <= 10 THEN 10 ELSE 11 END"


@query(f"WITH {COUPLING} SELECT ({BUCKET})::BIGINT AS bucket, count(*) AS modules, round(avg(ca + ce), 6) AS avg_coupling, round(avg(instability), 5) AS avg_instability, round(avg(distance), 5) AS avg_distance FROM metrics GROUP BY 1")
def coupling_analysis(spark, sf_dir):
    c = F.col("ca") + F.col("ce")
    bucket = F.when(c == 0, 0).when(c <= 3, 3).when(c <= 7, 7).when(c <= 10, 10).otherwise(11).cast("long")
    return coupled(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("modules"), F.round(F.avg(c), 6).alias("avg_coupling"), F.round(F.avg("instability"), 5).alias("avg_instability"), F.round(F.avg("distance"), 5).alias("avg_distance"))


@query(f"WITH {COUPLING} SELECT node, CASE WHEN ca + ce >= 10 OR distance > 0.5 THEN 'high' WHEN ca + ce >= 5 OR distance > 0.3 THEN 'medium' ELSE 'low' END AS risk FROM metrics")
def module_risk(spark, sf_dir):
    return graph.module_risk(coupled(spark, sf_dir))


# ---- classes and functions ----


@query(f"""WITH {CBO} SELECT count(*) AS classes, round(avg(cbo), 6) AS avg_cbo, min(cbo) AS min_cbo, max(cbo) AS max_cbo, count(*) FILTER (WHERE cbo <= 3) AS low_risk,
  count(*) FILTER (WHERE cbo > 3 AND cbo <= 7) AS medium_risk, count(*) FILTER (WHERE cbo > 7) AS high_risk FROM n""")
def cbo_summary(spark, sf_dir):
    return metrics.cbo_summary(metrics.cbo(deps(spark, sf_dir)))


@query(f"WITH {CBO} SELECT class, cbo FROM n ORDER BY cbo DESC, class LIMIT 10")
def most_coupled_topk(spark, sf_dir):
    return metrics.cbo(deps(spark, sf_dir)).select("class", "cbo").orderBy(F.col("cbo").desc(), "class").limit(10)


@query(f"WITH {PLACED} SELECT region, fn, complexity::BIGINT AS complexity FROM placed QUALIFY row_number() OVER (PARTITION BY region ORDER BY complexity DESC, fn) = 1")
def extreme_functions(spark, sf_dir):
    """The most complex function of each region, the first of equals: an aggregate, no sort."""
    best = F.min(F.struct((-F.col("complexity")).alias("c"), F.col("fn")))
    return placed(spark, sf_dir).groupBy("region").agg(best.alias("b")).select("region", "b.fn", (-F.col("b.c")).alias("complexity"))


# ---- paths ----


@query(rf"""WITH {PATHS}, b AS (SELECT page_id, path, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths), s AS (SELECT *, regexp_extract(base, '^(.*?)(?:\.[^.]*)?$', 1) AS stem FROM b)
SELECT page_id, stem, regexp_matches(base, '(^|\.)(test|spec)(\.|$)') OR contains(path, '__tests__') AS is_test, stem IN ('index', 'main', 'app', 'server') AS is_entry, regexp_matches(base, '(^|\.)(config|setup)(\.|$)') AS is_config FROM s""")
def path_flags(spark, sf_dir):
    path = fn.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", fn.stem(path).alias("stem"), fn.is_test(path).alias("is_test"), fn.is_entry(path).alias("is_entry"), fn.is_config(path).alias("is_config"))


@query(rf"""WITH {PATHS}, s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM paths), k AS (SELECT l, unnest(range(1, least(5, len(l)) + 1)) AS k FROM s)
SELECT array_to_string(list_slice(l, len(l) - k + 1, len(l)), '/') AS suffix, count(*) AS files FROM k GROUP BY 1""")
def path_suffixes(spark, sf_dir):
    """How many files end in each run of one to five segments."""
    suffix = F.explode(fn.suffixes(fn.url_path(F.col("url")), 5)).alias("suffix")
    return table(spark, sf_dir, "pages").select(suffix).groupBy("suffix").agg(F.count(F.lit(1)).alias("files"))


@query(r"""WITH known AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS target FROM pages),
c AS (SELECT page_id, 0 AS priority, url AS target FROM pages UNION ALL SELECT page_id, 1, regexp_replace(url, '#.*$', '') FROM pages UNION ALL SELECT page_id, 2, regexp_replace(url, '[?#].*$', '') FROM pages)
SELECT page_id, priority, c.target FROM c JOIN known ON known.target = c.target QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY priority) = 1""")
def import_priority_probe(spark, sf_dir):
    """The first of a page's candidate names that is known."""
    pages, url = table(spark, sf_dir, "pages"), F.col("url")
    bare = F.regexp_replace(url, "[?#].*$", "")
    names = (url, F.regexp_replace(url, "#.*$", ""), bare)
    tried = pages.select("page_id", F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), x.alias("target")) for i, x in enumerate(names)])).alias("c")).select("page_id", "c.priority", "c.target")
    met = tried.join(pages.select(bare.alias("target")).distinct(), "target", "left_semi")
    return met.groupBy("page_id").agg(F.min(F.struct("priority", "target")).alias("m")).select("page_id", "m.priority", "m.target")


@query(r"""SELECT CASE WHEN regexp_matches(url, '^\.{1,2}(/|$)') THEN 'relative' WHEN url LIKE '/%' THEN 'absolute' WHEN regexp_matches(url, '^[@~]/') THEN 'alias' WHEN regexp_matches(url, '^[a-z]+://') THEN 'url' ELSE 'package' END AS kind,
  count(*) AS imports, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS hosts FROM pages GROUP BY 1""")
def import_kinds(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(fn.source_kind(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("imports"), F.countDistinct(host).alias("hosts"))


# ---- findings ----


@query("""WITH e AS (SELECT user_id, ts::DATE::VARCHAR AS day, ts, event_id, event_type FROM events),
f AS (SELECT user_id, day, min(struct_pack(ts := ts, id := event_id, t := event_type)) FILTER (WHERE event_type IN ('purchase', 'error')) AS m FROM e GROUP BY user_id, day)
SELECT e.user_id, e.day, 'after_' || m.t AS reason, count(*) AS dead FROM e JOIN f ON e.user_id = f.user_id AND e.day = f.day WHERE e.ts > m.ts OR (e.ts = m.ts AND e.event_id > m.id) GROUP BY ALL""")
def dead_after_terminator(spark, sf_dir):
    """A user's day is a block: what follows its first terminator is dead."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.struct("ts", F.col("event_id").alias("id")).alias("at"), "event_type")
    return metrics.after_terminator(e, ["user_id", "day"], F.col("event_type").isin("purchase", "error"), F.concat(F.lit("after_"), F.col("event_type")))


@query("""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS level FROM events)
SELECT user_id, max(level)::BIGINT AS worst, count(*) AS findings, coalesce(min(event_id) FILTER (WHERE level >= 2), -1) AS first_line FROM s GROUP BY user_id""")
def file_severity(spark, sf_dir):
    level = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    first = F.min(F.when(F.col("level") >= 2, F.col("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", level.alias("level")).groupBy("user_id").agg(F.max("level").cast("long").alias("worst"), F.count(F.lit(1)).alias("findings"), F.coalesce(first, F.lit(-1)).alias("first_line"))


# ---- copies and profiles ----


@query(r"""WITH d AS (SELECT lang, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS digest FROM documents WHERE text IS NOT NULL), g AS (SELECT *, count(*) OVER (PARTITION BY digest) AS n FROM d)
SELECT lang, count(*) AS fragments, count(*) FILTER (WHERE n > 1) AS clones, round(100.0 * count(*) FILTER (WHERE n > 1) / count(*), 6)::DOUBLE AS duplication FROM g GROUP BY lang""")
def duplication_share(spark, sf_dir):
    return similarity.duplication(table(spark, sf_dir, "documents"), "lang")


@query(rf"""WITH {_grams("g", "doc_id", "documents", 4)}, t AS (SELECT d.doc_id, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS text, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) AS n FROM documents d WHERE text IS NOT NULL),
i AS (SELECT a.doc_id, count(*) AS shared FROM g a JOIN g b ON b.doc_id = a.doc_id + 1 AND a.g = b.g GROUP BY a.doc_id),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, x.text <> '' AND x.text = y.text AS same, CASE WHEN x.n + y.n = 0 THEN 1 ELSE coalesce(shared, 0)::DOUBLE / (x.n + y.n - coalesce(shared, 0)) END AS sim FROM t x JOIN t y ON y.doc_id = x.doc_id + 1 LEFT JOIN i ON i.doc_id = x.doc_id),
c AS (SELECT a, b, same AND sim >= 0.85 AS one, CASE WHEN same AND sim >= 0.85 THEN sim ELSE least(sim, 0.85 - 1e-12) END AS sim FROM s)
SELECT a, b, (CASE WHEN one THEN 1 WHEN sim >= 0.75 THEN 2 WHEN sim >= 0.7 THEN 3 WHEN sim >= 0.65 THEN 4 ELSE 0 END)::BIGINT AS kind, round(sim, 6) AS similarity FROM c""")
def clone_classify(spark, sf_dir):
    """Each document and the next one: kind of copy and similarity of their runs of four words."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("a"), similarity.normalised(F.col("text")).alias("x"), similarity.gram_hashes(F.col("text"), 4).alias("g"))
    pair = d.join(d.select((F.col("a") - 1).alias("a"), F.col("a").alias("b"), F.col("x").alias("y"), F.col("g").alias("h")), "a")
    kind, sim = similarity.ladder((F.col("x") != "") & (F.col("x") == F.col("y")), similarity.jaccard(F.col("g"), F.col("h")))
    return pair.select("a", "b", kind.cast("long").alias("kind"), F.round(sim, 6).alias("similarity"))


@query(rf"""WITH {_grams("g", "doc_id", "documents", 4)}, t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM t WHERE text <> ''), r AS (SELECT g.doc_id, g.g FROM g JOIN c ON c.doc_id = g.doc_id AND c.first = c.doc_id), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY doc_id),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM r x JOIN r y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
p AS (SELECT a, b, least(shared::DOUBLE / (x.n + y.n - shared), 0.85 - 1e-12) AS sim FROM s JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b)
SELECT first AS a, doc_id AS b, 1::BIGINT AS kind, 1::DOUBLE AS similarity FROM c WHERE doc_id <> first
UNION ALL SELECT a, b, (CASE WHEN sim >= 0.75 THEN 2 WHEN sim >= 0.7 THEN 3 ELSE 4 END)::BIGINT, round(sim, 6) FROM p WHERE sim >= 0.65""")
def clone_pairs(spark, sf_dir):
    """All copies among the documents: kind and similarity of their runs of four words."""
    return similarity.copies(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


TAGS = "tags AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages), hist AS (SELECT page_id, tag, count(*) AS n FROM tags GROUP BY page_id, tag)"


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("tag")).groupBy("page_id", F.lower("tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TAGS} SELECT tag, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 7 THEN '4-7' WHEN n <= 15 THEN '8-15' ELSE '16+' END AS bin, count(*) AS pages FROM hist GROUP BY 1, 2")
def typedist_bins(spark, sf_dir):
    return tag_counts(spark, sf_dir).groupBy("tag", fn.count_bin(F.col("n")).alias("bin")).agg(F.count(F.lit(1)).alias("pages"))


@query(f"""WITH {TAGS}, pair AS (SELECT a.page_id AS a FROM pages a JOIN pages b ON b.page_id = a.page_id + 1),
d AS (SELECT a, tag, sum(n) AS n FROM (SELECT page_id AS a, tag, n FROM hist UNION ALL SELECT page_id - 1, tag, -n FROM hist) x GROUP BY a, tag)
SELECT pair.a, coalesce(sum(abs(n)) / 2.0, 0)::DOUBLE AS shape_distance, coalesce(greatest(sum(greatest(n, 0)), -sum(least(n, 0))), 0)::BIGINT AS label_distance FROM pair LEFT JOIN d ON d.a = pair.a GROUP BY pair.a""")
def profile_distance(spark, sf_dir):
    """Distances of the tag counts of each page and the next: half of what differs, and the greater side of it."""
    hist, pages = tag_counts(spark, sf_dir), table(spark, sf_dir, "pages")
    signed = hist.select(F.col("page_id").alias("a"), "tag", "n").union(hist.select(F.col("page_id") - 1, "tag", -F.col("n")))
    d = signed.groupBy("a", "tag").agg(F.sum("n").alias("n")).groupBy("a").agg(F.sum(F.greatest("n", F.lit(0))).alias("more"), F.sum(-F.least("n", F.lit(0))).alias("less"))
    pair = pages.select(F.col("page_id").alias("a")).join(pages.select((F.col("page_id") - 1).alias("a")), "a", "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return pair.join(d, "a", "left").select("a", (zero(F.col("more") + F.col("less")) / 2).alias("shape_distance"), zero(F.greatest("more", "less")).alias("label_distance"))


def _sim(v: str) -> str:
    return f"(CASE WHEN x.{v} = 0 AND y.{v} = 0 THEN 1 ELSE 1 - abs(x.{v} - y.{v})::DOUBLE / greatest(abs(x.{v}), abs(y.{v})) END)"


@query(f"""WITH s AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS nxt FROM conversations), b AS (SELECT conv_id, count(DISTINCT role) AS blocks FROM s GROUP BY conv_id),
r AS (SELECT conv_id, role, count(*) AS n, count(*) FILTER (WHERE role = nxt) AS l FROM (SELECT DISTINCT conv_id, role, nxt FROM s WHERE nxt IS NOT NULL) z GROUP BY conv_id, role),
g AS (SELECT b.conv_id, blocks, coalesce(sum(n), 0) AS edges, coalesce(sum(l), 0) AS loops, coalesce(sum(CASE WHEN n > 1 THEN n - l ELSE 0 END), 0) AS conds, coalesce(sum(CASE WHEN n > 1 THEN 0 ELSE n - l END), 0) AS plain,
  coalesce(sum(n) FILTER (WHERE n > 1)::DOUBLE / nullif(count(*) FILTER (WHERE n > 1), 0), 0) AS branching FROM b LEFT JOIN r ON r.conv_id = b.conv_id GROUP BY b.conv_id, blocks),
f AS (SELECT *, edges - blocks + 2 AS cyclomatic, loops + conds AS turns FROM g)
SELECT x.conv_id AS a, round(0.2 * {_sim("blocks")} + 0.15 * {_sim("edges")} + 0.25 * {_sim("cyclomatic")} + 0.1 * {_sim("branching")} + 0.05 * {_sim("turns")} + 0.25 * (CASE WHEN x.edges = 0 AND y.edges = 0 THEN 1 WHEN x.edges = 0 OR y.edges = 0 THEN 0
  ELSE (x.loops * y.loops + x.conds * y.conds + x.plain * y.plain)::DOUBLE / (sqrt((x.loops * x.loops + x.conds * x.conds + x.plain * x.plain)::DOUBLE) * sqrt((y.loops * y.loops + y.conds * y.conds + y.plain * y.plain)::DOUBLE)) END), 6)::DOUBLE AS similarity
FROM f x JOIN f y ON y.conv_id = x.conv_id + 1""")
def cfg_similarity(spark, sf_dir):
    """Likeness of the flow of roles in each conversation and the next."""
    f = graph.flow_features(table(spark, sf_dir, "conversations"), "conv_id", ["turn", "role"], "role")
    names = [c for c in f.columns if c != "conv_id"]
    pair = f.select(F.col("conv_id").alias("a"), F.struct(*names).alias("x")).join(f.select((F.col("conv_id") - 1).alias("a"), F.struct(*names).alias("y")), "a")
    like: Column = similarity.flow_likeness(F.col("x"), F.col("y"))
    return pair.select("a", F.round(like, 6).alias("similarity"))
