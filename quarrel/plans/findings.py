"""More operators on the driver's tables, with their SQL: copies per file, scopes, deltas of patches, report figures and sets of signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrel import functions as fn
from quarrel.operators import intervals, metrics, similarity
from quarrel.plans.bindings import CBO, FUNCTIONS, PATHS, PLACED, deps, functions, placed, query, table

# ---- report figures ----


@query(f"""WITH {FUNCTIONS}, h AS (SELECT complexity AS v, count(*) AS n FROM functions GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY v) AS upto, sum(n) OVER () AS total FROM h)
SELECT ((min(v) FILTER (WHERE upto >= (total + 1) // 2) + min(v) FILTER (WHERE upto >= total // 2 + 1)) / 2.0)::DOUBLE AS median, sum(n)::BIGINT AS functions, count(*) AS values_seen FROM c""")
def histogram_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median out of a value -> count table, which stays small however many functions there are."""
    return metrics.histogram_median(functions(spark, sf_dir).groupBy(F.col("complexity").alias("v")).agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {PLACED}, m AS (SELECT nation, max(complexity)::BIGINT AS top FROM placed GROUP BY nation), p AS (SELECT *, pow(10, length(top::VARCHAR) - 1) AS mag FROM m)
SELECT nation, top, (CASE WHEN top <= 3 THEN 3 ELSE mag * CASE WHEN top <= mag THEN 1 WHEN top <= 2 * mag THEN 2 WHEN top <= 3 * mag THEN 3 WHEN top <= 5 * mag THEN 5 WHEN top <= 6 * mag THEN 6 ELSE 10 END END)::BIGINT AS ceiling FROM p""")
def axis_ceiling(spark, sf_dir):
    """The round figure at or over the greatest complexity of each nation."""
    top = placed(spark, sf_dir).groupBy("nation").agg(F.max("complexity").cast("long").alias("top"))
    return top.select("nation", "top", fn.axis_ceiling(F.col("top")).alias("ceiling"))


@query(r"SELECT c_custkey, regexp_replace(reverse(regexp_replace(reverse(floor(abs(c_acctbal))::BIGINT::VARCHAR), '([0-9]{3})', '\1,', 'g')), '^,', '') AS grouped FROM customer")
def digit_grouping(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_number(F.floor(F.abs("c_acctbal")), 0).alias("grouped"))


@query(f"""WITH {CBO} SELECT arg_min(class, (-cbo, class)) AS class, max(cbo) AS cbo FROM n""")
def most_coupled(spark, sf_dir):
    """The class of most links, the first of equals: one partial aggregate."""
    return metrics.cbo(deps(spark, sf_dir)).agg(F.min(F.struct((-F.col("cbo")).alias("c"), "class")).alias("m")).select("m.class", (-F.col("m.c")).alias("cbo"))


@query(rf"""WITH {PATHS}, d AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/') AS dir FROM paths), e AS (SELECT min(dir) AS lo, max(dir) AS hi FROM d),
k AS (SELECT string_split(lo, '/') AS l, string_split(hi, '/') AS h FROM e)
SELECT array_to_string(list_transform(list_filter(range(1, least(len(l), len(h)) + 1), lambda i: list_slice(l, 1, i) = list_slice(h, 1, i)), lambda i: l[i]), '/') AS root FROM k""")
def common_root(spark, sf_dir):
    """The deepest folder above all pages. Two extremes in order of segments share what all share, so one aggregate of two values does."""
    return metrics.common_root(table(spark, sf_dir, "pages").select(fn.url_path(F.col("url")).alias("path")))


# ---- copies per file ----


@query(r"""WITH d AS (SELECT source, doc_id, sha256(trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g'))) AS g FROM documents WHERE text IS NOT NULL), n AS (SELECT g FROM d GROUP BY g HAVING count(*) > 1),
m AS (SELECT source, count(*) AS members, count(DISTINCT g) AS groups FROM d WHERE g IN (SELECT g FROM n) GROUP BY source), a AS (SELECT source, count(*) AS fragments FROM d GROUP BY source)
SELECT a.source, fragments, coalesce(members, 0) AS members, coalesce(groups, 0) AS groups FROM a LEFT JOIN m ON m.source IS NOT DISTINCT FROM a.source""")
def clone_membership(spark, sf_dir):
    """Per source: fragments, those in a group of copies, and the groups they are in."""
    return similarity.membership(table(spark, sf_dir, "documents"), "source")


# ---- scopes ----

SPANS = "s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order lasts from its date to the last shipment."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("e"))
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("span_id"), F.col("o_orderdate").alias("s"), "e")


@query(f"""WITH {SPANS}, p AS (SELECT k, id, s AS at FROM s), m AS (SELECT p.id AS point_id, s.id, epoch(s.e) - epoch(s.s) AS w FROM p JOIN s ON s.k = p.k AND s.id <> p.id AND p.at >= s.s AND p.at <= s.e)
SELECT point_id, count(*) AS depth, string_agg(id::VARCHAR, '/' ORDER BY w DESC, id) AS scopes FROM m GROUP BY point_id""")
def enclosing_scopes(spark, sf_dir):
    """All scopes of a customer around the start of each order, outermost first."""
    s = spans(spark, sf_dir)
    return intervals.enclosing(s, s.select("key", F.col("span_id").alias("point_id"), F.col("s").alias("at")))


@query(f"""WITH {SPANS}, u AS (SELECT o_custkey AS k, l_orderkey * 8 + l_linenumber AS use_id, l_shipdate AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
b AS (SELECT s.* FROM s JOIN orders ON o_orderkey = id WHERE o_orderpriority = '1-URGENT')
SELECT use_id FROM u WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = u.k AND u.at >= b.s AND u.at <= b.e)""")
def unshadowed_uses(spark, sf_dir):
    """Returned items are uses; an urgent order of the customer that covers one hides it."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    hiding = spans(spark, sf_dir).join(o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("span_id")), "span_id", "left_semi")
    uses = li.where("l_returnflag = 'R'").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    uses = uses.select(F.col("o_custkey").alias("key"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("use_id"), F.col("l_shipdate").alias("at"))
    return intervals.unshadowed(uses, hiding).select("use_id")


# ---- deltas ----


@query("""WITH h AS (SELECT l_suppkey AS file, l_partkey AS fn, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1995-01-01') AS before, count(*) FILTER (WHERE l_shipdate >= TIMESTAMP '1995-01-01') AS after FROM lineitem GROUP BY 1, 2)
SELECT file, coalesce(max(after - before) FILTER (WHERE before > 0 AND after > 0), 0)::BIGINT AS worst_increase, coalesce(max(after) FILTER (WHERE before = 0), 0)::BIGINT AS new_max, count(*) FILTER (WHERE after = 0) AS removed,
  coalesce(bool_or(after > before AND before > 0), false) AS worse FROM h GROUP BY file""")
def patch_delta(spark, sf_dir):
    """Before and after of each function of a file in one pass: worst increase, most complex new function, functions removed."""
    late = F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp")
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("fn")).agg(F.count(F.when(~late, 1)).alias("before"), F.count(F.when(late, 1)).alias("after"))
    return metrics.patch_delta(h, "file")


# ---- signals ----


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events WHERE event_type <> 'view' GROUP BY user_id), u AS (SELECT DISTINCT user_id FROM events), f AS (SELECT u.user_id, coalesce(kinds, []) AS kinds FROM u LEFT JOIN s ON s.user_id = u.user_id)
SELECT x.user_id AS a, (len(x.kinds) = 0 OR len(y.kinds) = 0 OR list_has_any(x.kinds, y.kinds)) AS compatible, (len(x.kinds) >= 2 AND len(y.kinds) >= 2 AND NOT list_has_any(x.kinds, y.kinds)) AS disjoint_sets FROM f x JOIN f y ON y.user_id = x.user_id + 1""")
def signal_sets(spark, sf_dir):
    """Whether the signals of each user and the next meet (none meet all), and whether two sets of two or more are disjoint."""
    t = F.col("event_type")
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(t != "view", t)).alias("x"))
    pair = f.select(F.col("user_id").alias("a"), "x").join(f.select((F.col("user_id") - 1).alias("a"), F.col("x").alias("y")), "a")
    return pair.select("a", fn.compatible(F.col("x"), F.col("y")).alias("compatible"), fn.disjoint(F.col("x"), F.col("y")).alias("disjoint_sets"))


@query("""SELECT user_id, event_type AS name, min(event_id) AS first_id, count(*) AS usages, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS place FROM events GROUP BY user_id, event_type""")
def distinct_imports(spark, sf_dir):
    """Distinct names a file takes, in order of their first place."""
    per = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("usages"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("first_id")).cast("long"))


# ---- outcomes, texts and checks ----


@query("""SELECT lang, count(*) AS instances, count(*) FILTER (WHERE quality = 1) AS resolved, count(*) FILTER (WHERE quality = 1 AND nearby) AS also_before
FROM (SELECT d.lang, l.quality, EXISTS (SELECT 1 FROM labels p WHERE p.doc_id = l.doc_id - 1 AND p.quality = 1) AS nearby FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.toxic = 0) x GROUP BY lang""")
def patch_outcomes(spark, sf_dir):
    """Labelled rows are instances, toxic ones destructive and left out; resolved ones are counted, and those whose neighbour is too."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    good = labels.where("quality = 1").select((F.col("doc_id") + 1).alias("doc_id")).distinct().withColumn("nearby", F.lit(True))
    met = labels.where("toxic = 0").join(docs, "doc_id").join(good, "doc_id", "left")
    resolved = F.col("quality") == 1
    return met.groupBy("lang").agg(F.count(F.lit(1)).alias("instances"), F.count(F.when(resolved, 1)).alias("resolved"), F.count(F.when(resolved & F.col("nearby"), 1)).alias("also_before"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), l AS (SELECT *, string_split(text, chr(10)) AS lines FROM t),
b AS (SELECT *, coalesce(lines[1] = lag(lines[-1]) OVER (PARTITION BY conv_id ORDER BY turn, role, text), false) AS again FROM l)
SELECT conv_id, turn, role, again, md5(CASE WHEN again THEN array_to_string(list_slice(lines, 2, len(lines)), chr(10)) ELSE text END) AS digest FROM b""")
def joined_snippets(spark, sf_dir):
    """Turns of a conversation as pieces of one text; a first line that repeats the line before it is dropped."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    return fn.joined_snippets(c, "conv_id", ["turn", "role", "text"]).select("conv_id", "turn", "role", "again", F.md5("kept").alias("digest"))


@query(r"""WITH s AS (SELECT page_id, html, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS bare FROM pages)
SELECT page_id, length(html) - length(bare) AS comment_chars, len(list_filter(string_split(bare, chr(10)), lambda x: trim(replace(replace(x, chr(9), ' '), chr(13), ' ')) <> ''))::BIGINT AS code_lines FROM s""")
def comment_free_lines(spark, sf_dir):
    """Characters in comments of a page, and lines that are not blank without them."""
    bare = fn.strip_comments(F.col("html"), "<!--", "-->")
    return table(spark, sf_dir, "pages").select("page_id", (F.length("html") - F.length(bare)).cast("long").alias("comment_chars"), fn.code_lines(bare).alias("code_lines"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity <= 0 AS quantity, l_discount < 0 OR l_discount > 1 AS discount, l_shipdate < o_orderdate AS early, o_orderkey IS NULL AS orphan FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey)
SELECT r.name AS rule, count(*) FILTER (WHERE r.bad) AS failures, count(*) AS checked FROM o, LATERAL (VALUES ('quantity', quantity), ('discount', discount), ('early', early), ('orphan', orphan)) r(name, bad) GROUP BY 1""")
def validity_checks(spark, sf_dir):
    """Range and consistency rules and how many rows fail each, in one pass."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    met = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rules = {"quantity": F.col("l_quantity") <= 0, "discount": (F.col("l_discount") < 0) | (F.col("l_discount") > 1), "early": F.col("l_shipdate") < F.col("o_orderdate"), "orphan": F.col("o_orderkey").isNull()}
    return metrics.checks(met, rules)


@query(f"""WITH {PLACED}, n AS (SELECT nation, 100 - round(100 * least(1, (count(*) FILTER (WHERE complexity > 9) * 1.0 / count(*)) / 0.3))::BIGINT AS score FROM placed GROUP BY nation)
SELECT nation, score::BIGINT AS score, CASE WHEN score >= 75 THEN 'ok' WHEN score >= 60 THEN 'watch' ELSE 'poor' END AS band FROM n""")
def score_bands(spark, sf_dir):
    """Score of each nation by its share of complex functions, full at none and 0 at three tenths, and its band."""
    share = F.count(F.when(F.col("complexity") > 9, 1)) * 1.0 / F.count(F.lit(1))
    score = F.lit(100) - F.round(100 * F.least(F.lit(1.0), share / 0.3)).cast("long")
    return placed(spark, sf_dir).groupBy("nation").agg(score.alias("score")).withColumn("band", fn.band(F.col("score")))
