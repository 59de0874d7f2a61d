"""Queries of the graph operators over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import graph as G
from netquarry.operators import metrics as M
from netquarry.operators import traverse as T
from netquarry.plans.design_graph import GRAPH_SQL, design_graph, every_module
from netquarry.schema import PROPAGATION, TRUTH_RELATIONS, WEIGHTS
from netquarry.scratch import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _g(spark: SparkSession, sf_dir: str):
    """The graph, and every module as a run of its own."""
    g = design_graph(spark, sf_dir)
    return g, every_module(g)


def _short(df: DataFrame) -> DataFrame:
    return df.select("run", "node", "hop", F.round("risk", 6).alias("risk"))


def _walk(allowed: str, depth: int, where: str = "true", seeds: str = "seeds", edges: str = "edges") -> str:
    """SQL of a breadth first search: ``reach(run, node, hop)``."""
    cond = f"e.relation IN ({allowed})" if allowed else "true"
    return f"""walk AS (SELECT run, node, 0 AS hop FROM {seeds}
  UNION SELECT w.run, e.dst, w.hop + 1 FROM walk w JOIN {edges} e ON e.src = w.node JOIN nodes n ON n.id = e.dst WHERE w.hop < {depth} AND {cond} AND {where}),
reach AS (SELECT run, node, CAST(min(hop) AS INTEGER) AS hop FROM walk GROUP BY run, node)"""


_ALL = ", ".join(f"'{r}'" for r in PROPAGATION)


def _weight(overrides: dict[str, float]) -> str:
    return "CASE e.relation " + " ".join(f"WHEN '{r}' THEN {w}" for r, w in {**WEIGHTS, **overrides}.items()) + " ELSE 0.5 END"


def _layers(depth: int, alpha: float, least: float, overrides: dict[str, float]) -> str:
    out = ["r0 AS (SELECT run, node, CAST(1.0 AS DOUBLE) AS risk FROM seeds)"]
    for k in range(1, depth + 1):
        new = f"r.risk * CAST({_weight(overrides)} AS DOUBLE) * CAST({alpha} AS DOUBLE)"
        out.append(f"r{k} AS (SELECT r.run, e.dst AS node, max({new}) AS risk FROM r{k - 1} r JOIN edges e ON e.src = r.node WHERE {new} >= {least} GROUP BY 1, 2)")
    return ",\n".join(out)


def _path_max(depth: int, overrides: dict[str, float]) -> str:
    union = " UNION ALL ".join(f"SELECT run, node, risk FROM r{k}" for k in range(1, depth + 1))
    return f"""WITH {GRAPH_SQL}, {_layers(depth, 0.7, 0.01, overrides)}
SELECT run, node, round(max(risk), 6) AS risk FROM ({union}) WHERE (run, node) NOT IN (SELECT run, node FROM seeds) GROUP BY run, node"""


@query(f"WITH {GRAPH_SQL} SELECT 'node' AS kind, type AS label, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY relation")
def g_schema(spark, sf_dir):
    """Counts of nodes by type and of edges by relation."""
    return G.relation_counts(_g(spark, sf_dir)[0])


@query(f"WITH {GRAPH_SQL} SELECT src, dst, relation FROM edges")
def g_edges(spark, sf_dir):
    """All edges of the merged graph, last writer per pair."""
    return _g(spark, sf_dir)[0].edges.select("src", "dst", "relation")


@query(f"WITH {GRAPH_SQL} SELECT id, type, name, design, raw_line, summary FROM nodes")
def g_nodes(spark, sf_dir):
    """All nodes of the merged graph, the last value that is not null per column."""
    return _g(spark, sf_dir)[0].nodes.select("id", "type", "name", "design", "raw_line", "summary")


@query(f"""WITH {GRAPH_SQL} SELECT n.id, count(e.dst) FILTER (e.relation = 'instantiates') AS n_instantiates, count(e.dst) FILTER (e.relation = 'has_port') AS n_has_port,
count(e.dst) FILTER (e.relation = 'contains_register') AS n_contains_register, count(e.dst) FILTER (e.relation = 'verified_by') AS n_verified_by, count(e.dst) FILTER (e.relation = 'constrained_by') AS n_constrained_by
FROM nodes n LEFT JOIN edges e ON e.src = n.id WHERE n.type = 'Module' GROUP BY n.id""")
def g_degrees(spark, sf_dir):
    """Outgoing edges of each module by relation."""
    return G.degrees(_g(spark, sf_dir)[0])


@query(f"WITH {GRAPH_SQL} SELECT id, type, name, design FROM nodes WHERE type = 'Clock' AND lower(design) = 'hub_soc' ORDER BY id LIMIT 50")
def g_by_type(spark, sf_dir):
    """The clocks of one design."""
    return G.by_type(_g(spark, sf_dir)[0], "Clock", {"design": "HUB_SOC"}).select("id", "type", "name", "design")


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_walk(_ALL, 3)} SELECT run, node, hop, round(1.0 / (hop + 1), 6) AS risk FROM reach WHERE hop > 0")
def g_bfs(spark, sf_dir):
    """Impact of every module within three hops."""
    return _short(T.bfs(*_g(spark, sf_dir), paths=False))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_walk(_ALL, 3, "n.type NOT IN ('Net', 'Commit')")} SELECT run, node, hop, round(1.0 / (hop + 1), 6) AS risk FROM reach WHERE hop > 0""")
def g_bfs_excluding(spark, sf_dir):
    """The same without passing nets and commits."""
    return _short(T.bfs(*_g(spark, sf_dir), exclude_types=("Net", "Commit"), paths=False))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_walk("'instantiates', 'depended_by'", 5, "n.type = 'Module'")} SELECT run, node, hop, round(1.0 / (hop + 1), 6) AS risk FROM reach WHERE hop > 0""")
def g_structural(spark, sf_dir):
    """Impact along the module hierarchy only."""
    return _short(T.structural(*_g(spark, sf_dir), paths=False))


@query(_path_max(5, {}))
def g_weighted_path_max(spark, sf_dir):
    """Impact by the best walk of at most five steps."""
    return T.weighted_bfs(*_g(spark, sf_dir), mode="path_max", paths=False, columns=("run", "node", "risk")).select("run", "node", F.round("risk", 6).alias("risk"))


@query(_path_max(3, {"drives": 1.0, "has_port": 1.0, "connected_to": 1.0}))
def g_weighted_width(spark, sf_dir):
    """Impact of a width change: the weights of its relations replaced."""
    return T.weighted_bfs(*_g(spark, sf_dir), mode="path_max", max_depth=3, change_type="width", paths=False).select("run", "node", F.round("risk", 6).alias("risk"))


_LABELS = f"""labels AS (SELECT 0 AS k, run, node, CAST(1.0 AS DOUBLE) AS risk, 0 AS hop FROM seeds UNION ALL
  SELECT k, run, node, risk, hop FROM (
    SELECT t.k + 1 AS k, s.run, s.node, CAST(1.0 AS DOUBLE) AS risk, 0 AS hop FROM seeds s, (SELECT DISTINCT k FROM labels) t UNION ALL
    SELECT k + 1, run, dst, max(new), arg_min(hop + 1, (-new, -risk, node, relation, hop)) FROM (
      SELECT l.k, l.run, e.dst, l.risk * CAST({_weight({})} AS DOUBLE) * CAST(0.7 AS DOUBLE) AS new, l.risk, l.node, e.relation, l.hop FROM labels l JOIN edges e ON e.src = l.node
      WHERE l.hop < 5 AND e.relation IN ({_ALL}) AND e.dst <> l.run) WHERE new >= 0.01 GROUP BY 1, 2, 3) WHERE k <= 20)"""


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_LABELS} SELECT run, node, CAST(hop AS INTEGER) AS hop, round(risk, 6) AS risk FROM labels WHERE k = 20 AND node <> run")
def g_weighted_label(spark, sf_dir):
    """Impact of every module by best-first labels; in SQL, labels are derived from those of the round before, twenty times."""
    return _short(T.weighted_bfs(*_g(spark, sf_dir), paths=False, columns=("run", "node", "hop", "risk")))


_RANK = """fan AS (SELECT src, count(*) AS n FROM edges GROUP BY src), links AS MATERIALIZED (SELECT e.src, e.dst, f.n FROM edges e JOIN fan f ON f.src = e.src),
homes AS (SELECT s.run, d.n FROM seeds s JOIN nodes m ON m.id = s.node JOIN (SELECT design, count(*) AS n FROM nodes GROUP BY design) d ON d.design = m.design),
ranks AS (SELECT 0 AS k, run, node, CAST(1.0 AS DOUBLE) AS x, false AS done FROM seeds UNION ALL
  SELECT k, run, node, x, max(worst) OVER () < 1e-6 FROM (
    SELECT k, run, node, x, sum(abs(x - y)) OVER (PARTITION BY run) / n AS worst FROM (
      SELECT v.k, v.run, v.node, sum(v.x) AS x, sum(v.y) AS y, any_value(h.n) AS n FROM (
        SELECT r.k + 1 AS k, r.run, l.dst AS node, 0.85 * r.x / l.n AS x, 0 AS y FROM ranks r JOIN links l ON l.src = r.node WHERE NOT r.done UNION ALL
        SELECT r.k + 1, r.run, r.run, 0.15 * r.x, 0 FROM ranks r WHERE NOT r.done UNION ALL
        SELECT r.k + 1, r.run, r.run, 0.85 * r.x, 0 FROM ranks r WHERE NOT r.done AND r.node NOT IN (SELECT src FROM fan) UNION ALL
        SELECT r.k + 1, r.run, r.node, 0, r.x FROM ranks r WHERE NOT r.done) v JOIN homes h ON h.run = v.run WHERE v.k <= 200 GROUP BY 1, 2, 3)))"""


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_RANK}, last AS (SELECT * FROM ranks WHERE k = (SELECT max(k) FROM ranks)), top AS (SELECT run, max(x) AS t FROM last GROUP BY run)
SELECT x.run, x.node, round(x.x / t.t, 6) AS score FROM last x JOIN top t ON t.run = x.run WHERE x.x / t.t >= 0.0001 AND x.node <> x.run""")
def g_pagerank(spark, sf_dir):
    """Personalised rank from every module, iterated until it converges; in SQL, all rank mass of a run adds up to 1, of which 0.15 goes back."""
    return T.pagerank(*_g(spark, sf_dir)).select("run", "node", F.round("score", 6).alias("score"))


_BOTH = "(SELECT src, dst, relation FROM edges UNION ALL SELECT dst, src, relation FROM edges)"


@query(f"""WITH RECURSIVE {GRAPH_SQL}, bi AS {_BOTH}, {_walk("", 2, edges="bi")}
SELECT run, node, hop FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hop, node) AS k FROM reach) WHERE k <= 100""")
def g_neighborhood(spark, sf_dir):
    """The hundred nodes nearest to each module within two hops, directions ignored."""
    return T.neighborhood(*_g(spark, sf_dir), hops=2)


_EVERY_PAIR = "pairs AS (SELECT DISTINCT e.src || ' ' || e2.dst AS run, e.src AS source, e2.dst AS target FROM nodes n JOIN edges e ON e.src = n.id JOIN edges e2 ON e2.src = e.dst WHERE n.type = 'Module' AND e2.dst <> e.src)"


@query(f"""WITH {GRAPH_SQL}, {_EVERY_PAIR},
t AS (SELECT p.*, CASE WHEN e.src IS NULL THEN 2 ELSE 1 END AS total FROM pairs p LEFT JOIN edges e ON e.src = p.source AND e.dst = p.target)
SELECT run, source AS node, 0 AS distance, total FROM t UNION ALL SELECT run, target, total, total FROM t
UNION ALL SELECT DISTINCT t.run, e.dst, 1, 2 FROM t JOIN edges e ON e.src = t.source JOIN edges e2 ON e2.src = e.dst AND e2.dst = t.target WHERE t.total = 2""")
def g_paths(spark, sf_dir):
    """All nodes on shortest paths from every module to every node two steps away."""
    g, s = _g(spark, sf_dir)
    e = g.edges.select("src", "dst")
    two = s.join(e.select(F.col("src").alias("node"), F.col("dst").alias("mid")), "node").join(e.select(F.col("src").alias("mid"), F.col("dst").alias("target")), "mid").where("target <> node")
    pairs = two.select(F.concat_ws(" ", "node", "target").alias("run"), F.col("node").alias("source"), "target").distinct()
    return T.shortest_paths(g, pairs, most=2)


@query(f"""WITH {GRAPH_SQL},
c1 AS (SELECT run, node FROM (SELECT run, node, row_number() OVER (PARTITION BY run ORDER BY node) AS k FROM (SELECT DISTINCT s.run, e.dst AS node FROM seeds s JOIN edges e ON e.src = s.node JOIN nodes n ON n.id = e.dst WHERE e.relation = 'instantiates' AND n.type = 'Module')) WHERE k <= 20),
c2 AS (SELECT run, node FROM (SELECT run, node, row_number() OVER (PARTITION BY run ORDER BY node) AS k FROM (SELECT DISTINCT s.run, e.dst AS node FROM c1 s JOIN edges e ON e.src = s.node WHERE e.relation = 'modified_by')) WHERE k <= 20)
SELECT run, node, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT run, node, 0 AS hop FROM seeds UNION ALL SELECT run, node, 1 FROM c1 UNION ALL SELECT run, node, 2 FROM c2) GROUP BY run, node""")
def g_chain(spark, sf_dir):
    """Commits that modified the submodules of each module."""
    return T.chain(*_g(spark, sf_dir), [("instantiates", "Module"), ("modified_by", "")])


@query(f"""WITH {GRAPH_SQL}, bi AS {_BOTH}, one AS (SELECT run, node FROM seeds UNION SELECT s.run, b.dst FROM seeds s JOIN bi b ON b.src = s.node)
SELECT run, node FROM one UNION SELECT o.run, b.dst FROM one o JOIN nodes n ON n.id = o.node JOIN bi b ON b.src = o.node WHERE n.type IN ('Port', 'Register', 'Clock')""")
def g_context(spark, sf_dir):
    """Everything around each module, one step further from its ports and clocks."""
    return T.full_context(*_g(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, inside AS (SELECT id FROM nodes WHERE type IN ('Module', 'Port')) SELECT src, dst, relation FROM edges WHERE src IN (SELECT id FROM inside) AND dst IN (SELECT id FROM inside)""")
def g_induced(spark, sf_dir):
    """The edges among modules and ports."""
    g, _ = _g(spark, sf_dir)
    return T.context(g, g.nodes.where("type in ('Module', 'Port')").select(F.col("id").alias("node"))).edges.select("src", "dst", "relation")


def _changes(g, s: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in sorted(TRUTH_RELATIONS)])
    return s.select(F.concat_ws("/", "run", "change_type").alias("run"), "node", "change_type") if "change_type" in s.columns else _changes(g, s.withColumn("change_type", F.explode(kinds)))


_TRUTH_TABLE = ", ".join(f"('{t}', '{r}')" for t in sorted(TRUTH_RELATIONS) for r in TRUTH_RELATIONS[t])
_TRUTH = f"""tr(change_type, relation) AS (VALUES {_TRUTH_TABLE}),
chg AS (SELECT s.run || '/' || k.change_type AS run, s.node, k.change_type FROM seeds s, (SELECT DISTINCT change_type FROM tr) k),
tw AS (SELECT run, node, change_type, 0 AS hop FROM chg UNION
  SELECT w.run, e.dst, w.change_type, w.hop + 1 FROM tw w JOIN edges e ON e.src = w.node JOIN tr ON tr.change_type = w.change_type AND tr.relation = e.relation WHERE w.hop < 6),
truth AS (SELECT w.run, w.node, n.type AS artifact_type, CAST(min(w.hop) AS INTEGER) AS hop FROM tw w JOIN nodes n ON n.id = w.node GROUP BY 1, 2, 3 HAVING min(w.hop) > 0)"""


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_TRUTH} SELECT run, node, artifact_type, hop FROM truth")
def g_truth(spark, sf_dir):
    """What each of seven types of change to each module truly affects."""
    g, s = _g(spark, sf_dir)
    return T.ground_truth(g, _changes(g, s))


def _predictions(spark, sf_dir):
    """Stored rankings, one row per (design, method, node), and as truth the nodes near a change by any method."""
    rows = load(spark, sf_dir, "impacted_artifacts").where("node_id is not null and risk_score is not null and not isnan(risk_score)")
    best = rows.groupBy("design", "method_name", F.col("node_id").alias("node")).agg(F.min(F.struct(-F.col("risk_score"), F.col("hop_distance"), F.col("artifact_type"))).alias("b"))
    predicted = best.select("design", "method_name", "node", (-F.col("b.col1")).alias("risk"), F.col("b.hop_distance").alias("hop"), F.col("b.artifact_type").alias("artifact_type"))
    near = rows.where("hop_distance <= 1").select("design", F.col("node_id").alias("node"), "artifact_type").groupBy("design", "node").agg(F.min("artifact_type").alias("artifact_type"))
    methods = rows.select("design", "method_name").distinct()
    return predicted, near.join(methods, "design")


_PRED = """rows AS (SELECT * FROM impacted_artifacts WHERE node_id IS NOT NULL AND risk_score IS NOT NULL AND NOT isnan(risk_score)),
pred AS (SELECT design, method_name, node_id AS node, max(risk_score) AS risk, arg_min(hop_distance, (-risk_score, hop_distance IS NOT NULL, hop_distance, artifact_type)) AS hop, arg_min(artifact_type, (-risk_score, hop_distance IS NOT NULL, hop_distance, artifact_type)) AS artifact_type
         FROM rows GROUP BY 1, 2, 3),
near AS (SELECT design, node_id AS node, min(artifact_type) AS artifact_type FROM rows WHERE hop_distance <= 1 GROUP BY 1, 2),
truth AS (SELECT n.*, m.method_name FROM near n JOIN (SELECT DISTINCT design, method_name FROM rows) m ON m.design = n.design)"""
_SCORES = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"""


@query(f"""WITH {_PRED}, c AS (SELECT coalesce(p.design, t.design) AS design, coalesce(p.method_name, t.method_name) AS method_name, count(*) FILTER (p.node IS NOT NULL AND t.node IS NOT NULL) AS tp, count(*) FILTER (t.node IS NULL) AS fp, count(*) FILTER (p.node IS NULL) AS fn
FROM pred p FULL JOIN truth t ON p.design = t.design AND p.method_name = t.method_name AND p.node = t.node GROUP BY 1, 2) SELECT design, method_name, tp, fp, fn, {_SCORES} FROM c""")
def m_confusion(spark, sf_dir):
    """Precision, recall and f1 of each method in each design."""
    p, t = _predictions(spark, sf_dir)
    return M.confusion(p, t, ["design", "method_name"]).select("design", "method_name", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_PRED}, c AS (SELECT coalesce(p.design, t.design) AS design, coalesce(p.method_name, t.method_name) AS method_name, coalesce(p.artifact_type, t.artifact_type) AS artifact_type, count(*) FILTER (p.node IS NOT NULL AND t.node IS NOT NULL) AS tp, count(*) FILTER (t.node IS NULL) AS fp, count(*) FILTER (p.node IS NULL) AS fn
FROM pred p FULL JOIN truth t ON p.design = t.design AND p.method_name = t.method_name AND p.node = t.node AND p.artifact_type = t.artifact_type GROUP BY 1, 2, 3)
SELECT design, method_name, artifact_type, tp, fp, fn, {_SCORES} FROM c WHERE (design, method_name, artifact_type) IN (SELECT design, method_name, artifact_type FROM truth)""")
def m_per_type(spark, sf_dir):
    """The same by type of artifact."""
    p, t = _predictions(spark, sf_dir)
    return M.per_type(p, t, ["design", "method_name"]).select("design", "method_name", "artifact_type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {_PRED}, sized AS (SELECT design, method_name, count(*) AS n_truth FROM truth GROUP BY 1, 2),
ranked AS (SELECT p.*, t.node IS NOT NULL AS rel, row_number() OVER (PARTITION BY p.design, p.method_name ORDER BY p.risk DESC, p.hop, p.node) AS rank FROM pred p LEFT JOIN truth t ON p.design = t.design AND p.method_name = t.method_name AND p.node = t.node),
agg AS (SELECT design, method_name, max(CASE WHEN rel THEN 1.0 / rank END) AS mrr, count(*) FILTER (rel AND rank <= 5) AS h5, count(*) FILTER (rel AND rank <= 20) AS h20,
  sum(CASE WHEN rel AND rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS d20 FROM ranked GROUP BY 1, 2)
SELECT s.design, s.method_name, s.n_truth, round(coalesce(mrr, 0), 6) AS mrr, round(coalesce(h5, 0) / n_truth, 6) AS recall_at_5, round(coalesce(h20, 0) / n_truth, 6) AS recall_at_20,
  round(coalesce(d20, 0) / list_sum(list_transform(range(1, least(n_truth, 20) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_20
FROM sized s LEFT JOIN agg a ON a.design = s.design AND a.method_name = s.method_name""")
def m_ranking(spark, sf_dir):
    """Recall at k, reciprocal rank and discounted gain of each method in each design."""
    p, t = _predictions(spark, sf_dir)
    r = M.ranking(p.fillna(1 << 30, ["hop"]), t, ["design", "method_name"], (5, 20))
    return r.select("design", "method_name", "n_truth", *[F.round(c, 6).alias(c) for c in ("mrr", "recall_at_5", "recall_at_20", "ndcg_at_20")])


@query(f"""WITH {_PRED}, r AS (SELECT p.design, p.method_name, p.hop, avg(CASE WHEN t.node IS NOT NULL THEN 1.0 ELSE 0 END) AS rate FROM pred p LEFT JOIN truth t ON p.design = t.design AND p.method_name = t.method_name AND p.node = t.node GROUP BY 1, 2, 3)
SELECT k.design, k.method_name, CAST(h.h AS INTEGER) AS hop, round(coalesce(r.rate, 0), 6) AS rate FROM (SELECT DISTINCT design, method_name FROM pred) k, range(1, 6) h(h) LEFT JOIN r ON r.design = k.design AND r.method_name = k.method_name AND r.hop = h.h""")
def m_per_hop(spark, sf_dir):
    """The share of true predictions at each hop."""
    p, t = _predictions(spark, sf_dir)
    return M.per_hop(p, t, ["design", "method_name"]).select("design", "method_name", "hop", F.round("rate", 6).alias("rate"))


@query("""SELECT method_name, artifact_type, count(*) AS n, round(avg(risk_score), 6) AS risk_score, round(avg(hop_distance), 6) AS hop_distance FROM impacted_artifacts
WHERE risk_score IS NOT NULL AND NOT isnan(risk_score) GROUP BY ROLLUP (method_name, artifact_type)""")
def m_macro(spark, sf_dir):
    """Mean risk and distance by method and type, with totals."""
    rows = load(spark, sf_dir, "impacted_artifacts").where("risk_score is not null and not isnan(risk_score)")
    out = M.macro(rows, ["method_name", "artifact_type"], ["risk_score", "hop_distance"])
    return out.select("method_name", "artifact_type", "n", F.round("risk_score", 6).alias("risk_score"), F.round("hop_distance", 6).alias("hop_distance"))


@query("""WITH d AS (SELECT method_name, design, avg(risk_score) AS r, avg(hop_distance) AS h FROM impacted_artifacts WHERE risk_score IS NOT NULL AND NOT isnan(risk_score) GROUP BY 1, 2)
SELECT method_name, count(*) AS n_units, round(avg(r), 6) AS risk_score, round(avg(h), 6) AS hop_distance FROM d GROUP BY 1""")
def m_cross_design(spark, sf_dir):
    """Mean risk and distance by method, each design counting once."""
    rows = load(spark, sf_dir, "impacted_artifacts").where("risk_score is not null and not isnan(risk_score)")
    out = M.mean_of_means(rows, ["method_name"], "design", ["risk_score", "hop_distance"])
    return out.select("method_name", "n_units", F.round("risk_score", 6).alias("risk_score"), F.round("hop_distance", 6).alias("hop_distance"))
