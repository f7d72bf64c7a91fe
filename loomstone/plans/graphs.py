"""Queries over the typed graph between beliefs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomstone import constants as C
from loomstone.functions import text as T
from loomstone.operators import beliefs as B
from loomstone.operators import graph as G
from loomstone.sources.adapters import symmetric_first

from .registry import query
from .retrieval import CLAIMS, claim_hits

R6 = T.rounded


def support(v):
    return G.edge_support(v.assertions)


def adjacency_of(v):
    return G.adjacency(G.active_edges(support(v), v.active))


def seeds(v):
    return v.active.select("id")


def found(v):
    """Where an expansion starts: the best hits of the belief search."""
    return G.cut(claim_hits(v).orderBy("rank", "id").limit(C.CONTEXT_SEEDS).select("id"))


FOUND = f"(SELECT id FROM {CLAIMS} ORDER BY rank, id LIMIT {C.CONTEXT_SEEDS})"


@query("edge_support", "SELECT src, dst, rel, n, round(weight, 6) AS weight FROM support")
def edge_support(v):
    return support(v).withColumn("weight", R6(F.col("weight")))


@query("active_edges", "SELECT src, dst, rel, n FROM active_support")
def active_edges(v):
    return G.active_edges(support(v), v.active).select("src", "dst", "rel", "n")


@query("belief_edges", "SELECT src AS id, dst AS other, rel, 'out' AS direction FROM edges UNION ALL SELECT dst, src, rel, 'in' FROM edges")
def belief_edges(v):
    out = v.edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel", F.lit("out").alias("direction"))
    return out.unionByName(v.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "rel", F.lit("in").alias("direction")))


@query("co_derived", """WITH m AS (SELECT DISTINCT session_id, belief_id FROM evidence), z AS (SELECT session_id, count(*) AS size FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
    SELECT a.belief_id AS src, b.belief_id AS dst, count(*) AS n_sessions, round(sum(1.0::DOUBLE / size), 6) AS weight FROM m a JOIN m b ON a.session_id = b.session_id AND a.belief_id < b.belief_id JOIN z ON z.session_id = a.session_id GROUP BY 1, 2""")
def co_derived(v):
    return G.co_derived(v.evidence, C.CLIQUE_LEAST, C.CLIQUE_MOST).withColumn("weight", R6(F.col("weight")))


@query("degree", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
def degree(v):
    return G.degree(v.edges)


@query("relation_counts", "SELECT rel, count(*) AS n FROM edges GROUP BY 1")
def relation_counts(v):
    return v.edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("adjacency", "SELECT src, dst, rel, round(weight, 6) AS weight FROM adj")
def adjacency(v):
    return adjacency_of(v).withColumn("weight", R6(F.col("weight")))


@query("neighbours", "SELECT src AS id, count(DISTINCT dst) AS n, round(max(weight), 6) AS strongest FROM adj GROUP BY 1")
def neighbours(v):
    return adjacency_of(v).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("n"), R6(F.max("weight")).alias("strongest"))


@query("khop", f"""WITH RECURSIVE r(id, depth) AS (SELECT id, 0::BIGINT FROM {FOUND} UNION SELECT a.dst, r.depth + 1 FROM r JOIN adj a ON a.src = r.id WHERE r.depth < 3)
    SELECT id, min(depth) AS depth FROM r GROUP BY 1""")
def khop(v):
    return G.khop(adjacency_of(v), found(v), 3)


@query("graph_expansion", f"""WITH RECURSIVE s AS MATERIALIZED (SELECT id FROM {FOUND}), r(id, depth) AS (SELECT id, 0::BIGINT FROM s UNION SELECT a.dst, r.depth + 1 FROM r JOIN adj a ON a.src = r.id WHERE r.depth < 2),
    near AS (SELECT dst, min(rel) AS rel FROM adj WHERE src IN (SELECT id FROM s) GROUP BY 1) SELECT id, min(depth) AS depth, coalesce(any_value(rel), 'reached') AS rel FROM r LEFT JOIN near ON dst = id GROUP BY id HAVING min(depth) > 0""")
def graph_expansion(v):
    """Nodes within two hops that are no hits; label: a direct relation (the first by name), else reached."""
    adj, own = adjacency_of(v), found(v)
    far = G.khop(adj, own, 2).where("depth > 0")
    label = adj.join(F.broadcast(own.withColumnRenamed("id", "src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("rel").alias("rel"))
    return far.join(label, "id", "left").select("id", "depth", F.coalesce("rel", F.lit("reached")).alias("rel"))


@query("best_path", """WITH RECURSIVE r(seed, id, score, hops) AS (SELECT id, id, 1.0::DOUBLE, 0 FROM beliefs WHERE status = 'active'
    UNION ALL SELECT r.seed, a.dst, r.score * greatest(a.weight, 1e-9), r.hops + 1 FROM r JOIN adj a ON a.src = r.id WHERE r.hops < 3) SELECT seed, id, round(max(score), 6) AS score FROM r GROUP BY 1, 2""")
def best_path(v):
    """The greatest product of weights over at most three hops."""
    return G.best_paths(adjacency_of(v), seeds(v), 3).select("seed", "id", R6(F.col("score")).alias("score"))


@query("simple_paths", """WITH RECURSIVE r(node, path, hops) AS (SELECT id, [id], 0::BIGINT FROM beliefs WHERE status = 'active'
    UNION ALL SELECT a.dst, list_append(r.path, a.dst), r.hops + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM adj) a ON a.src = r.node WHERE r.hops < 3 AND NOT list_contains(r.path, a.dst))
    SELECT array_to_string(path, '>') AS path, hops FROM r WHERE hops > 0""")
def simple_paths(v):
    return G.simple_paths(adjacency_of(v), seeds(v), 3)


COMPONENTS = """WITH RECURSIVE link AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r(id, c) AS (SELECT id, id FROM beliefs UNION SELECT link.b, r.c FROM r JOIN link ON link.a = r.id)"""


@query("components", COMPONENTS + " SELECT id, min(c) AS component FROM r GROUP BY 1")
def components(v):
    return G.components(v.beliefs.select("id"), v.edges)


@query("graph_stats", COMPONENTS + """, comp AS (SELECT id, min(c) AS component FROM r GROUP BY 1)
    SELECT (SELECT count(*) FROM beliefs) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT id) FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges)) AS bound,
    (SELECT count(DISTINCT component) FROM comp) AS components, (SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) AS largest""")
def graph_stats(v):
    comp = G.components(v.beliefs.select("id"), v.edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    one = v.beliefs.agg(F.count("*").alias("nodes")).crossJoin(v.edges.agg(F.count("*").alias("edges"))).crossJoin(G.degree(v.edges).agg(F.count("*").alias("bound")))
    return one.crossJoin(comp)


@query("hubs", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def hubs(v):
    return G.degree(v.edges).orderBy(F.desc("degree"), "id").limit(5)


@query("communities")
def communities(v):
    return G.communities(v.beliefs.select("id"), support(v))


@query("edge_repoint", """WITH m AS (SELECT id AS old, superseded_by AS new FROM beliefs WHERE superseded_by IS NOT NULL), x AS (SELECT coalesce(a.new, src) AS s, coalesce(b.new, dst) AS d, rel FROM edges LEFT JOIN m a ON a.old = src LEFT JOIN m b ON b.old = dst)
    SELECT DISTINCT CASE WHEN rel = 'contradicts' THEN least(s, d) ELSE s END AS src, CASE WHEN rel = 'contradicts' THEN greatest(s, d) ELSE d END AS dst, rel FROM x WHERE s <> d""")
def edge_repoint(v):
    return G.repoint(v.edges, B.survivors(v.beliefs))


@query("edge_insert_valid", """SELECT DISTINCT CASE WHEN rel = 'contradicts' THEN least(src, dst) ELSE src END AS src, CASE WHEN rel = 'contradicts' THEN greatest(src, dst) ELSE dst END AS dst, rel
    FROM (SELECT belief_id AS src, (belief_id * 31 + event_id) % (SELECT n + 20 FROM n_beliefs) AS dst, CASE note WHEN 'view' THEN 'depends_on' WHEN 'click' THEN 'contradicts' WHEN 'error' THEN 'likes' ELSE 'explains' END AS rel FROM evidence)
    WHERE rel IN ('depends_on', 'specializes', 'explains', 'contradicts', 'applies_when') AND src <> dst AND dst IN (SELECT id FROM beliefs)""")
def edge_insert_valid(v):
    """Candidates with unknown relations, self-loops or missing endpoints are refused; symmetric pairs are put in order."""
    return symmetric_first(valid_relations(v).where("reason = 'kept'")).select("src", "dst", "rel").distinct()


def valid_relations(v):
    n = v.beliefs.agg((F.count("*") + 20).alias("n"))
    rows = v.evidence.crossJoin(F.broadcast(n)).selectExpr("belief_id src", "(belief_id * 31 + event_id) % n dst", "case note when 'view' then 'depends_on' when 'click' then 'contradicts' when 'error' then 'likes' else 'explains' end rel", "event_id")
    rows = rows.join(v.beliefs.select(F.col("id").alias("dst"), F.lit(True).alias("there")), "dst", "left")
    reason = F.when(~F.col("rel").isin(*C.RELATIONS), "unknown_relation").when(F.col("src") == F.col("dst"), "self").when(F.col("there").isNull(), "missing").otherwise("kept")
    return rows.withColumn("reason", reason)


@query("relation_account", """SELECT CASE WHEN rel NOT IN ('depends_on', 'specializes', 'explains', 'contradicts', 'applies_when') THEN 'unknown_relation' WHEN src = dst THEN 'self' WHEN dst NOT IN (SELECT id FROM beliefs) THEN 'missing' ELSE 'kept' END AS reason,
    count(*) AS n FROM (SELECT belief_id AS src, (belief_id * 31 + event_id) % (SELECT n + 20 FROM n_beliefs) AS dst, CASE note WHEN 'view' THEN 'depends_on' WHEN 'click' THEN 'contradicts' WHEN 'error' THEN 'likes' ELSE 'explains' END AS rel FROM evidence) GROUP BY 1""")
def relation_account(v):
    return valid_relations(v).groupBy("reason").agg(F.count("*").alias("n"))


@query("relate_account", """SELECT src, count(*) FILTER (place <= 2) AS kept, count(*) FILTER (place > 2) AS dropped FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst, rel) AS place
    FROM edges JOIN beliefs ON id = dst AND status = 'active') GROUP BY 1""")
def relate_account(v):
    """At most two relations per conclusion, to active targets only."""
    rows = v.edges.join(v.active.select(F.col("id").alias("dst")), "dst", "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst", "rel")))
    return rows.groupBy("src").agg(F.count_if(F.col("place") <= 2).alias("kept"), F.count_if(F.col("place") > 2).alias("dropped"))


@query("mermaid_edges", """SELECT c AS component, src, dst, rel, 'n' || src || ' -->|' || rel || '| n' || dst AS line FROM edges JOIN
    (SELECT id, min(c) AS c FROM (""" + COMPONENTS + """ SELECT id, c FROM r) GROUP BY 1) ON id = src""")
def mermaid_edges(v):
    """Flowchart lines with their component; a body is its lines in the order of src, dst, rel, so no component is gathered."""
    comp = G.components(v.beliefs.select("id"), v.edges).select(F.col("id").alias("src"), "component")
    line = F.concat(F.lit("n"), F.col("src").cast("string"), F.lit(" -->|"), "rel", F.lit("| n"), F.col("dst").cast("string")).alias("line")
    return v.edges.join(comp, "src").select("component", "src", "dst", "rel", line)
