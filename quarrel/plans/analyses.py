"""Control flow, data flow, groups of copies and their figures on the driver's tables, with their SQL.

Roles here: a user is a function, a day its block and an event a statement. A purchase returns, an error throws, a view says nothing. A block leads
to the next day, conditionally so if it holds a click, which also leads to the day after that; an error leads there as an exception. Copies
are clone_pairs() of documents; a document's language is its file, and its length gives its range of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrel.operators import flow, grouping, metrics, similarity
from quarrel.operators.graph import written
from quarrel.plans import scratch
from quarrel.plans.bindings import ORACLE, query, table
from quarrel.plans.reports import clone_pairs

# ---- control flow ----

FLOW = """e AS (SELECT user_id AS fn, ts::DATE::VARCHAR AS block, event_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1 AS pos FROM events),
stmts AS (SELECT fn, block, pos, CASE event_type WHEN 'purchase' THEN 'return' WHEN 'error' THEN 'throw' WHEN 'view' THEN 'noop' ELSE 'plain' END AS kind FROM e),
b AS (SELECT fn, block, bool_or(event_type = 'click') AS clicks, bool_or(event_type = 'error') AS errors FROM e GROUP BY fn, block),
blocks AS (SELECT *, lead(block) OVER w AS n1, lead(block, 2) OVER w AS n2, row_number() OVER w = 1 AS entry FROM b WINDOW w AS (PARTITION BY fn ORDER BY block)),
edges AS (SELECT fn, block AS src, n1 AS dst, CASE WHEN clicks THEN 'cond_true' ELSE 'normal' END AS kind FROM blocks WHERE n1 IS NOT NULL
  UNION ALL SELECT fn, block, n2, 'cond_false' FROM blocks WHERE clicks AND n2 IS NOT NULL UNION ALL SELECT fn, block, n2, 'exception' FROM blocks WHERE errors AND n2 IS NOT NULL)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fn, block, pos, kind, event_id, event_type."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), F.date_format("ts", "yyyy-MM-dd").alias("block"), "ts", "event_id", "event_type")
    pos = F.row_number().over(Window.partitionBy("fn", "block").orderBy("ts", "event_id")) - 1
    t = F.col("event_type")
    return e.select("fn", "block", pos.alias("pos"), F.when(t == "purchase", "return").when(t == "error", "throw").when(t == "view", "noop").otherwise("plain").alias("kind"), "event_id", "event_type")


def blocks_and_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    some = lambda t: F.max((F.col("event_type") == t).cast("int")) == 1
    b = e.groupBy(F.col("user_id").alias("fn"), F.date_format("ts", "yyyy-MM-dd").alias("block")).agg(some("click").alias("clicks"), some("error").alias("errors"))
    days = Window.partitionBy("fn").orderBy("block")
    b = written(b.withColumns({"n1": F.lead("block").over(days), "n2": F.lead("block", 2).over(days), "entry": F.row_number().over(days) == 1}), "blocks")
    out = lambda to, kind: b.where(F.col(to).isNotNull()).select("fn", F.col("block").alias("src"), F.col(to).alias("dst"), kind.alias("kind"), "clicks", "errors")
    first = out("n1", F.when(F.col("clicks"), "cond_true").otherwise("normal"))
    edges = first.union(out("n2", F.lit("cond_false")).where("clicks")).union(out("n2", F.lit("exception")).where("errors"))
    return b.select("fn", "block", "entry"), edges.select("fn", "src", "dst", "kind")


LIVE = f"""{FLOW}, ends AS (SELECT DISTINCT fn, block FROM stmts WHERE kind IN ('return', 'throw')),
open_edges AS (SELECT DISTINCT g.fn, src, dst FROM edges g LEFT JOIN ends x ON x.fn = g.fn AND x.block = src WHERE x.fn IS NULL OR kind <> 'normal'),
live AS (SELECT fn, block FROM blocks WHERE entry UNION SELECT l.fn, g.dst FROM live l JOIN open_edges g ON g.fn = l.fn AND g.src = l.block)"""


@query(f"WITH RECURSIVE {LIVE} SELECT fn, block FROM live")
def live_blocks(spark, sf_dir):
    """Blocks in reach of the entry."""
    return flow.live_blocks(*blocks_and_edges(spark, sf_dir), statements(spark, sf_dir))


DEAD = f"""{LIVE}, per AS (SELECT fn, block, count(*) AS n, count(*) FILTER (WHERE kind = 'noop') AS noops, max(pos) AS last, min(pos) FILTER (WHERE kind IN ('return', 'throw')) AS end_pos,
  arg_min(kind, pos) FILTER (WHERE kind IN ('return', 'throw')) AS end_kind FROM stmts GROUP BY fn, block),
dead AS (SELECT fn, block, CASE WHEN ok IS NULL THEN 'unreachable' ELSE 'after_' || end_kind END AS reason, CASE WHEN ok IS NULL THEN 'critical' ELSE 'warning' END AS severity
  FROM per p LEFT JOIN (SELECT fn, block, true AS ok FROM live) l USING (fn, block) WHERE (ok IS NULL AND n <> noops) OR (ok AND end_pos < last))"""


def found_dead(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks, edges = blocks_and_edges(spark, sf_dir)
    return blocks, flow.dead_code(blocks, edges, statements(spark, sf_dir))


@query(f"WITH RECURSIVE {DEAD} SELECT fn, block, reason, severity FROM dead")
def cfg_dead_code(spark, sf_dir):
    """Blocks out of reach, and those with statements behind a terminator."""
    return found_dead(spark, sf_dir)[1]


@query(f"""WITH RECURSIVE {DEAD}, z AS (SELECT fn, count(*) AS blocks FROM blocks GROUP BY fn),
d AS (SELECT fn, count(*) AS dead, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning FROM dead GROUP BY fn)
SELECT fn, blocks, coalesce(dead, 0) AS dead, coalesce(critical, 0) AS critical, coalesce(warning, 0) AS warning, 0::BIGINT AS info, round(coalesce(dead, 0)::DOUBLE / blocks, 6) AS ratio FROM z LEFT JOIN d USING (fn)""")
def dead_code_by_function(spark, sf_dir):
    blocks, found = found_dead(spark, sf_dir)
    return flow.dead_code_by_function(blocks, found)


@query(f"WITH RECURSIVE {DEAD} SELECT reason, severity, count(*) AS findings, count(DISTINCT fn) AS functions FROM dead GROUP BY 1, 2")
def dead_reasons(spark, sf_dir):
    return found_dead(spark, sf_dir)[1].groupBy("reason", "severity").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("fn").alias("functions"))


@query(f"""WITH {FLOW}, t AS (SELECT fn, src, count(DISTINCT dst) FILTER (WHERE kind IN ('cond_true', 'cond_false')) AS targets, max(CASE WHEN kind = 'exception' THEN 1 ELSE 0 END) AS raises FROM edges GROUP BY fn, src),
d AS (SELECT fn, sum(greatest(targets - 1, 0) + raises)::BIGINT AS decisions FROM t GROUP BY fn), x AS (SELECT fn, count(*) FILTER (WHERE event_type = 'signup') AS extras FROM e GROUP BY fn)
SELECT fn, coalesce(decisions, 0) AS decisions, extras, coalesce(decisions, 0) + extras + 1 AS complexity FROM x LEFT JOIN d USING (fn)""")
def cfg_complexity(spark, sf_dir):
    """Branches, exceptions and what single statements add (a signup counts as a logical operator)."""
    blocks, edges = blocks_and_edges(spark, sf_dir)
    extras = statements(spark, sf_dir).where("event_type = 'signup'").groupBy("fn").agg(F.count(F.lit(1)).alias("n"))
    return flow.complexity(blocks, edges, extras)


_KINDS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS \"{k}\"" for k in flow.EDGE_KINDS)
_ZEROS = ", ".join(f'coalesce(p."{k}", 0) AS "{k}"' for k in flow.EDGE_KINDS)
SHAPE = f"""{FLOW}, z AS (SELECT fn, count(*) AS blocks FROM blocks GROUP BY fn), o AS (SELECT fn, src, count(*) AS n FROM edges GROUP BY fn, src), r AS (SELECT fn, avg(n) FILTER (WHERE n > 1) AS branching FROM o GROUP BY fn),
p AS (SELECT fn, count(*) AS edges, {_KINDS} FROM edges GROUP BY fn),
shape AS (SELECT z.fn, blocks, coalesce(p.edges, 0) AS edges, coalesce(round(branching, 6), 0)::DOUBLE AS branching, {_ZEROS}, coalesce(p.edges, 0) - blocks + 2 AS cyclomatic, coalesce(p."loop" + p.cond_true + p.cond_false, 0) AS turns
  FROM z LEFT JOIN p ON p.fn = z.fn LEFT JOIN r ON r.fn = z.fn)"""


@query(f"WITH {SHAPE} SELECT * FROM shape")
def cfg_shape(spark, sf_dir):
    return flow.shape(*blocks_and_edges(spark, sf_dir))


def _like(v: str) -> str:
    return f"(CASE WHEN x.{v} = 0 AND y.{v} = 0 THEN 1 ELSE 1 - abs(x.{v} - y.{v})::DOUBLE / greatest(abs(x.{v}), abs(y.{v})) END)"


def _cosine(kinds: list[str]) -> str:
    dot = lambda a, b: "(" + " + ".join(f'{a}."{k}" * {b}."{k}"' for k in kinds) + ")::DOUBLE"
    return f"(CASE WHEN {dot('x', 'x')} = 0 AND {dot('y', 'y')} = 0 THEN 1 WHEN {dot('x', 'x')} = 0 OR {dot('y', 'y')} = 0 THEN 0 ELSE {dot('x', 'y')} / (sqrt({dot('x', 'x')}) * sqrt({dot('y', 'y')})) END)"


SHAPE_LIKE = f"0.2 * {_like('blocks')} + 0.15 * {_like('edges')} + 0.25 * {_like('cyclomatic')} + 0.1 * {_like('branching')} + 0.05 * {_like('turns')} + 0.25 * {_cosine(list(flow.EDGE_KINDS))}"


def _with_next(df: DataFrame) -> DataFrame:
    """a, x and y: the structs of each function and the next."""
    names = [c for c in df.columns if c != "fn"]
    return df.select(F.col("fn").alias("a"), F.struct(*names).alias("x")).join(df.select((F.col("fn") - 1).alias("a"), F.struct(*names).alias("y")), "a")


@query(f"WITH {SHAPE} SELECT x.fn AS a, round({SHAPE_LIKE}, 6)::DOUBLE AS similarity FROM shape x JOIN shape y ON y.fn = x.fn + 1")
def cfg_shape_similarity(spark, sf_dir):
    return _with_next(flow.shape(*blocks_and_edges(spark, sf_dir))).select("a", F.round(flow.shape_likeness(F.col("x"), F.col("y")), 6).alias("similarity"))


# ---- data flow: clicks and signups define one of three names, other events use one ----

REFS = f"""{FLOW}, refs AS (SELECT fn, block, pos, 'v' || (event_id % 3) AS name, CASE WHEN event_type IN ('click', 'signup') THEN 'def' ELSE 'use' END AS role, event_type AS kind FROM e),
back AS (SELECT DISTINCT fn, dst AS block, src AS prev FROM edges), far AS (SELECT fn, block, prev AS up, 1 AS hops FROM back UNION SELECT f.fn, f.block, b.prev, hops + 1 FROM far f JOIN back b ON b.fn = f.fn AND b.block = f.up),
near AS (SELECT fn, block, up, min(hops) AS hops FROM far GROUP BY ALL), last AS (SELECT fn, name, block, max(pos) AS pos FROM refs WHERE role = 'def' GROUP BY ALL),
here AS (SELECT u.fn, u.name, u.block AS use_block, u.pos AS use_pos, u.block AS def_block, max(d.pos) AS def_pos FROM refs u JOIN refs d ON d.fn = u.fn AND d.name = u.name AND d.block = u.block AND d.role = 'def' AND d.pos < u.pos WHERE u.role = 'use' GROUP BY ALL),
there AS (SELECT u.fn, u.name, u.block AS use_block, u.pos AS use_pos, l.block AS def_block, l.pos AS def_pos FROM refs u JOIN near n ON n.fn = u.fn AND n.block = u.block JOIN last l ON l.fn = u.fn AND l.name = u.name AND l.block = n.up
  WHERE u.role = 'use' AND NOT EXISTS (SELECT 1 FROM here h WHERE h.fn = u.fn AND h.use_block = u.block AND h.use_pos = u.pos) QUALIFY row_number() OVER (PARTITION BY u.fn, u.name, u.block, u.pos ORDER BY hops, l.block) = 1),
pairs AS (SELECT * FROM here UNION ALL SELECT * FROM there)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type").isin("click", "signup"), "def").otherwise("use")
    return statements(spark, sf_dir).select("fn", "block", "pos", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("name"), role.alias("role"), F.col("event_type").alias("kind"))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    blocks, edges = blocks_and_edges(spark, sf_dir)
    refs = written(references(spark, sf_dir), "refs")
    return refs, flow.def_use(blocks, edges, refs)


@query(f"WITH RECURSIVE {REFS} SELECT fn, name, use_block, use_pos::INTEGER AS use_pos, def_block, def_pos::INTEGER AS def_pos FROM pairs")
def def_use_pairs(spark, sf_dir):
    """The definition that reaches each use, in its block or the nearest before."""
    return _pairs(spark, sf_dir)[1]


FACTS = f"""{REFS}, c AS (SELECT fn, count(*) FILTER (WHERE role = 'def') AS defs, count(*) FILTER (WHERE role = 'use') AS uses, count(DISTINCT name) AS names FROM refs GROUP BY fn),
k AS (SELECT fn, string_agg(role || ':' || kind || ':' || n, ',' ORDER BY role || ':' || kind || ':' || n) AS kinds FROM (SELECT fn, role, kind, count(*) AS n FROM refs GROUP BY ALL) y GROUP BY fn),
l AS (SELECT fn, count(*) AS pairs, count(*) FILTER (WHERE def_block <> use_block) AS far FROM pairs GROUP BY fn),
facts AS (SELECT c.fn, defs, uses, names, coalesce(pairs, 0) AS pairs, round((defs + uses)::DOUBLE / names, 6) AS chain, CASE WHEN coalesce(pairs, 0) > 0 THEN round(far::DOUBLE / pairs, 6) ELSE 0 END::DOUBLE AS crossing, kinds FROM c JOIN k USING (fn) LEFT JOIN l USING (fn))"""


@query(f"WITH RECURSIVE {FACTS} SELECT * FROM facts")
def flow_facts(spark, sf_dir):
    return flow.flow_facts(*_pairs(spark, sf_dir))


_DEFS, _USES = ["click", "signup"], ["error", "purchase", "view"]
_COUNTS = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {p}_{k}" for p, ks in (("d", _DEFS), ("u", _USES)) for k in ks)
FACT_LIKE = f"0.25 * {_like('pairs')} + 0.2 * {_like('chain')} + 0.2 * {_like('crossing')} + 0.2 * {_cosine(['d_' + k for k in _DEFS])} + 0.15 * {_cosine(['u_' + k for k in _USES])}"
@query(f"""WITH RECURSIVE {FACTS}, {SHAPE.split('FROM blocks WHERE errors AND n2 IS NOT NULL), ')[1]}, h AS (SELECT fn, {_COUNTS} FROM refs GROUP BY fn),
i AS (SELECT fn, list(DISTINCT event_id % 40) FILTER (WHERE event_type = 'signup' AND event_id % 7 = 0) AS sig, list(DISTINCT event_id % 60) FILTER (WHERE event_type = 'view' AND event_id % 5 = 0) AS lit, list(DISTINCT event_id % 30) FILTER (WHERE event_type = 'purchase' AND event_id % 4 = 0) AS ret FROM e GROUP BY fn),
q AS (SELECT facts.fn, facts.pairs, chain, crossing, blocks, shape.edges, cyclomatic, branching, turns, {', '.join(f'shape."{k}"' for k in flow.EDGE_KINDS)}, {', '.join('d_' + k for k in _DEFS)}, {', '.join('u_' + k for k in _USES)}, coalesce(sig, []) AS sig, coalesce(lit, []) AS lit, coalesce(ret, []) AS ret
  FROM facts JOIN shape ON shape.fn = facts.fn JOIN h ON h.fn = facts.fn JOIN i ON i.fn = facts.fn),
s AS (SELECT x.fn AS a, {SHAPE_LIKE} AS shapes, {FACT_LIKE} AS flows, x.lit AS xl, y.lit AS yl, x.sig AS xs, y.sig AS ys, x.ret AS xr, y.ret AS yr FROM q x JOIN q y ON y.fn = x.fn + 1)
SELECT a, round(flows, 6)::DOUBLE AS flows, round(0.6 * shapes + 0.4 * flows, 6)::DOUBLE AS combined, round((0.6 * shapes + 0.4 * flows) * CASE WHEN len(xl) >= 2 AND len(yl) >= 2 AND NOT list_has_any(xl, yl) THEN 0.5
  WHEN (len(xs) > 0 AND len(ys) > 0 AND NOT list_has_any(xs, ys)) OR (len(xr) > 0 AND len(yr) > 0 AND NOT list_has_any(xr, yr)) THEN 0.75 ELSE 1 END, 6)::DOUBLE AS evident FROM s""")
def flow_similarity(spark, sf_dir):
    """Likeness of data flow, of both flows together, and with the evidence of signals, literals and kinds of return (some events stand for those)."""
    refs, pairs = _pairs(spark, sf_dir)
    shape = flow.shape(*blocks_and_edges(spark, sf_dir))
    counts = refs.groupBy("fn").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{p}_{k}") for p, ks in (("d", _DEFS), ("u", _USES)) for k in ks])
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("fn"), "event_id", "event_type")
    some = lambda t, every, of: F.collect_set(F.when((F.col("event_type") == t) & (F.col("event_id") % every == 0), F.col("event_id") % of))
    sets = e.groupBy("fn").agg(some("signup", 7, 40).alias("sig"), some("view", 5, 60).alias("lit"), some("purchase", 4, 30).alias("ret"))
    both = _with_next(flow.flow_facts(refs, pairs).select("fn", "pairs", "chain", "crossing").join(shape, "fn").join(counts, "fn").join(sets, "fn"))
    x, y = F.col("x"), F.col("y")
    flows = flow.facts_likeness(x, y, _DEFS, _USES)
    base = flow.meaning_likeness(flow.shape_likeness(x, y), flows)
    evident = flow.with_evidence(base, (x["lit"], y["lit"]), (x["sig"], y["sig"]), (x["ret"], y["ret"]))
    return both.select("a", F.round(flows, 6).alias("flows"), F.round(base, 6).alias("combined"), F.round(evident, 6).alias("evident"))


# ---- groups of copies ----

_FOUND: dict[tuple[str, str], str] = {}


def copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clone_pairs(), searched once for a session and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOUND:
        path = scratch(spark, "clone-pairs")
        clone_pairs(spark, sf_dir).write.parquet(path)
        _FOUND[key] = path
    return spark.read.parquet(_FOUND[key])


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.col("lang").alias("file"), (n % 97).cast("long").alias("s"), (n % 97 + n % 53).cast("long").alias("e"))


LEVEL = 0.7
PAIRS = f"cp AS ({ORACLE['clone_pairs']})"
ITEMS = "items AS (SELECT doc_id AS id, lang AS file, length(text) % 97 AS s, length(text) % 97 + length(text) % 53 AS e FROM documents WHERE text IS NOT NULL)"
GROUPS = f"""{PAIRS}, u AS (SELECT a, b FROM cp WHERE similarity >= {LEVEL} UNION SELECT b, a FROM cp WHERE similarity >= {LEVEL}), r AS (SELECT DISTINCT a AS id, a AS x FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.x = u.a),
g AS (SELECT min(x) AS group_id, id FROM r GROUP BY id)"""
INSIDE = f"{GROUPS}, inside AS (SELECT p.group_id, cp.* FROM cp JOIN g p ON p.id = a JOIN g q ON q.id = b AND q.group_id = p.group_id)"
FACTS_OF = f"""{INSIDE}, facts AS (SELECT group_id, (SELECT count(*) FROM g WHERE g.group_id = i.group_id) AS size, round(avg(similarity), 6) AS similarity, arg_max(kind, (round(similarity, 9), -kind)) AS kind FROM inside i GROUP BY group_id)"""


def groups_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = copy_pairs(spark, sf_dir)
    return pairs, written(grouping.grouped(pairs, LEVEL), "groups")


@query(f"WITH RECURSIVE {GROUPS} SELECT group_id, id FROM g")
def group_connected(spark, sf_dir):
    return grouping.grouped(copy_pairs(spark, sf_dir), LEVEL)


@query(f"WITH RECURSIVE {FACTS_OF} SELECT * FROM facts")
def group_facts(spark, sf_dir):
    """Size, mean similarity and kind of each group."""
    pairs, groups = groups_of(spark, sf_dir)
    return grouping.described(groups, pairs)


@query(f"WITH RECURSIVE {FACTS_OF} SELECT (row_number() OVER (ORDER BY round(similarity, 9) DESC, size DESC, group_id) - 1)::BIGINT AS public_id, group_id FROM facts")
def group_ranks(spark, sf_dir):
    """Dense ids from 0 in order of similarity, size and first member."""
    pairs, groups = groups_of(spark, sf_dir)
    facts = grouping.described(groups, pairs)
    return metrics.numbered(facts, grouping.ordered(facts), "public_id").select("public_id", "group_id")


MAXIMAL = f"""{INSIDE}, {ITEMS}, m AS (SELECT g.group_id, items.* FROM g JOIN items USING (id)),
kept AS (SELECT group_id, id FROM m i WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.group_id = i.group_id AND o.file = i.file AND o.id <> i.id AND o.s <= i.s AND o.e >= i.e AND (o.s < i.s OR o.e > i.e OR o.id < i.id)))"""


@query(f"WITH RECURSIVE {MAXIMAL} SELECT group_id, id FROM kept WHERE group_id IN (SELECT group_id FROM kept GROUP BY group_id HAVING count(*) > 1)")
def group_members_maximal(spark, sf_dir):
    """Members that no other of their group and file contains."""
    return grouping.maximal_members(groups_of(spark, sf_dir)[1], fragments(spark, sf_dir))


@query(f"""WITH RECURSIVE {MAXIMAL}, gone AS (SELECT id FROM m WHERE (group_id, id) NOT IN (SELECT group_id, id FROM kept))
SELECT a, b, kind, similarity FROM cp WHERE a NOT IN (SELECT id FROM gone) AND b NOT IN (SELECT id FROM gone)""")
def pairs_without_members(spark, sf_dir):
    """Pairs that touch no member that another contains."""
    pairs, groups = groups_of(spark, sf_dir)
    order = Window.partitionBy("group_id", "file").orderBy("s", F.col("e").desc(), "id").rowsBetween(Window.unboundedPreceding, -1)
    gone = groups.join(fragments(spark, sf_dir), "id").withColumn("reach", F.max("e").over(order)).where("e <= reach").select("id")
    return grouping.without_members(pairs, gone)


@query(f"WITH RECURSIVE {INSIDE} SELECT a, b, kind, similarity FROM cp WHERE (a, b) NOT IN (SELECT a, b FROM inside WHERE group_id % 2 = 0)")
def pairs_without_pairs(spark, sf_dir):
    """Pairs less those inside groups of an even id."""
    pairs, groups = groups_of(spark, sf_dir)
    of = lambda c: groups.where("group_id % 2 = 0").select("group_id", F.col("id").alias(c))
    inside = of("a").join(of("b"), "group_id").select("a", "b")
    return grouping.without_pairs(pairs, inside)


def _strategy(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grouping.grouped(copy_pairs(spark, sf_dir), LEVEL, mode)

    run.__name__ = f"group_{mode}"
    run.__doc__ = f"Groups of copies by the strategy {mode}; tests hold it against plain Python."
    return query()(run)


group_k_core, group_star, group_complete_linkage, group_centroid, group_leader = map(_strategy, ("k_core", "star", "complete_linkage", "centroid", "leader"))


@query()
def group_report(spark, sf_dir):
    """Groups after all passes: members inside others, covered groups and groups without a pair are gone."""
    return grouping.report_groups(copy_pairs(spark, sf_dir), fragments(spark, sf_dir), LEVEL)


# ---- figures of copies ----


@query(f"WITH {PAIRS} SELECT kind, count(*) AS pairs, round(avg(similarity), 6) AS similarity, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM cp GROUP BY kind")
def clone_kinds(spark, sf_dir):
    """Pairs of each kind, their mean similarity and their share of all."""
    per = copy_pairs(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("similarity"))
    return per.withColumn("share", F.round(100.0 * F.col("pairs") / F.sum("pairs").over(Window.partitionBy()), 6))  # one row a kind


@query(f"""WITH RECURSIVE {GROUPS}, {ITEMS}, ids AS (SELECT a AS id FROM cp UNION SELECT b FROM cp UNION SELECT id FROM g)
SELECT (SELECT count(*) FROM cp) AS pairs, (SELECT round(avg(similarity), 6) FROM cp) AS similarity, (SELECT count(*) FROM ids) AS fragments, (SELECT count(DISTINCT (file, s, e)) FROM ids JOIN items USING (id)) AS places,
  (SELECT count(DISTINCT file) FROM ids JOIN items USING (id)) AS files, (SELECT count(DISTINCT group_id) FROM g) AS groups""")
def clone_statistics(spark, sf_dir):
    """One row: pairs, mean similarity, fragments in pairs or groups, their places and files, groups."""
    pairs, groups = groups_of(spark, sf_dir)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(groups.select("id")).distinct().join(fragments(spark, sf_dir), "id")
    one = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("similarity"), 6).alias("similarity"))
    two = ids.agg(F.count(F.lit(1)).alias("fragments"), F.countDistinct("file", "s", "e").alias("places"), F.countDistinct("file").alias("files"))
    return one.join(two).join(groups.agg(F.countDistinct("group_id").alias("groups")))  # one row each


@query(f"""WITH {PAIRS}, h AS (SELECT a % 2 AS half, kind, count(*) AS pairs, avg(similarity) AS mean FROM cp GROUP BY 1, 2)
SELECT kind, sum(pairs)::BIGINT AS pairs, round(sum(pairs * mean) / sum(pairs), 6) AS similarity FROM h GROUP BY kind""")
def merged_clone_statistics(spark, sf_dir):
    """Two partial statistics merged: means weigh by their pairs."""
    halves = copy_pairs(spark, sf_dir).groupBy((F.col("a") % 2).alias("half"), "kind").agg(F.count(F.lit(1)).alias("pairs"), F.avg("similarity").alias("mean"))
    return halves.groupBy("kind").agg(F.sum("pairs").alias("pairs"), F.round(F.sum(F.col("pairs") * F.col("mean")) / F.sum("pairs"), 6).alias("similarity"))


@query(f"WITH {PAIRS} SELECT a, b, kind, similarity FROM cp WHERE similarity >= 0.7 AND similarity <= 0.95 AND kind IN (1, 2, 4)")
def clone_filter(spark, sf_dir):
    """Pairs in a range of similarity and of the enabled kinds; no upper bound is 0, no list enables all."""
    return copy_pairs(spark, sf_dir).where(metrics.in_range(F.col("similarity"), 0.7, 0.95) & metrics.enabled(F.col("kind"), [1, 2, 4]))


@query(f"WITH {PAIRS} SELECT row_number() OVER (ORDER BY round(similarity, 9) DESC, a, b)::INTEGER AS rank, a, b, similarity FROM cp QUALIFY rank <= 25")
def pairs_topk(spark, sf_dir):
    """The most similar pairs, in a total order."""
    return metrics.top(copy_pairs(spark, sf_dir).select("a", "b", "similarity"), [F.round("similarity", 9).desc(), F.col("a"), F.col("b")], 25)


@query(f"""WITH {PAIRS}, {ITEMS} SELECT row_number() OVER (ORDER BY round(similarity, 9) DESC, x.file, x.s, x.e, a, y.file, y.s, y.e, b)::INTEGER AS rank, a, b FROM cp JOIN items x ON x.id = a JOIN items y ON y.id = b QUALIFY rank <= 40""")
def pairs_by_place(spark, sf_dir):
    """The most similar pairs, equal ones by the places of their fragments."""
    of = lambda p: fragments(spark, sf_dir).select(F.col("id").alias(p), *[F.col(c).alias(p + c) for c in ("file", "s", "e")])
    met = copy_pairs(spark, sf_dir).join(of("a"), "a").join(of("b"), "b")
    order = [F.round("similarity", 9).desc(), *[F.col(c).asc_nulls_last() for c in ("afile", "as", "ae", "a", "bfile", "bs", "be", "b")]]
    return metrics.top(met, order, 40).select("rank", "a", "b")


@query(f"WITH {PAIRS}, {ITEMS}, s AS (SELECT a AS id, a AS pa, b AS pb, 0 AS side FROM cp UNION ALL SELECT b, a, b, 1 FROM cp), f AS (SELECT file, s, e, id, pa, pb, side FROM s JOIN items USING (id)) SELECT file, s, e, id FROM f QUALIFY row_number() OVER (PARTITION BY file, s, e ORDER BY pa, pb, side) = 1")
def unique_clones(spark, sf_dir):
    """One fragment a place, the first met in order of pairs."""
    p = copy_pairs(spark, sf_dir)
    sides = p.select(F.col("a").alias("id"), F.struct("a", "b", F.lit(0).alias("side")).alias("at")).union(p.select(F.col("b").alias("id"), F.struct("a", "b", F.lit(1).alias("side"))))
    first = F.min(F.struct("at", "id"))["id"]
    return sides.join(fragments(spark, sf_dir), "id").groupBy("file", "s", "e").agg(first.alias("id"))


@query(f"""WITH {PAIRS}, {ITEMS}, d AS (SELECT doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) AS lines, len(string_split(text, ' ')) AS words FROM documents WHERE text IS NOT NULL)
SELECT a, b, NOT ((x.words + y.words) / 2.0 > 0 AND abs(x.words - y.words) / ((x.words + y.words) / 2.0) > 0.5) AND NOT (abs(x.lines - y.lines) > x.lines * 0.5 AND abs(x.lines - y.lines) > y.lines * 0.5) AS near_size,
  i.file = j.file AND NOT (i.e < j.s OR j.e < i.s) AS overlap, round(least(1.0, similarity + least((x.words + y.words) / 200.0, 0.2) + 0.1 * least(x.lines, y.lines) / greatest(x.lines, y.lines, 1)), 6)::DOUBLE AS confidence
FROM cp JOIN d x ON x.id = a JOIN d y ON y.id = b JOIN items i ON i.id = a JOIN items j ON j.id = b""")
def pair_checks(spark, sf_dir):
    """Whether sizes allow a copy, whether places overlap, and the confidence in the pair."""
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), lines.alias("lines"), F.size(F.split("text", " ")).alias("words")).join(fragments(spark, sf_dir), "id")
    met = copy_pairs(spark, sf_dir).join(d.select(F.col("id").alias("a"), F.struct("*").alias("x")), "a").join(d.select(F.col("id").alias("b"), F.struct("*").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    return met.select("a", "b", similarity.near_size(x["words"], y["words"], x["lines"], y["lines"]).alias("near_size"), similarity.overlap(x, y).alias("overlap"), F.round(similarity.confidence(F.col("similarity"), x["words"], y["words"], x["lines"], y["lines"]), 6).alias("confidence"))
