"""Queries of the parsing, scalar and history operators over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.functions import scalars as S
from netquarry.operators import changes as changes_of
from netquarry.operators import history as H
from netquarry.operators import metrics as M
from netquarry.operators import questions as Q
from netquarry.operators import skew
from netquarry.operators import traverse as T
from netquarry.plans.design_graph import GRAPH_SQL, design_graph, every_module
from netquarry.scratch import load
from netquarry.sources import constraints as C
from netquarry.streaming import ingest

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{n}'" for n, p in S.COMMIT_CLASSES) + " END"


@query(f"SELECT coalesce({_CLASS}, 'other') AS label, count(DISTINCT commit_id) AS n FROM commits GROUP BY 1")
def t_commit_classes(spark, sf_dir):
    """Commits by the class of their message."""
    rows = load(spark, sf_dir, "commits").select("commit_id", F.coalesce(S.commit_class(F.col("message")), F.lit("other")).alias("label"))
    return rows.groupBy("label").agg(F.count_distinct("commit_id").alias("n"))


@query("""SELECT design, f AS file, count(DISTINCT commit_id) AS n_commits, max(commit_date) AS last_modified, count(DISTINCT author) AS n_authors
FROM (SELECT commit_id, commit_date, author, design, unnest(files_changed) AS f FROM commits) GROUP BY 1, 2""")
def t_file_history(spark, sf_dir):
    """Commits, last change and authors of each file."""
    return H.file_history(load(spark, sf_dir, "commits")).select("design", "file", "n_commits", "last_modified", "n_authors")


@query("""WITH f AS (SELECT design, author, commit_id, unnest(files_changed) AS file FROM commits) SELECT DISTINCT design, file, 'author' AS kind, author AS value FROM f WHERE author IS NOT NULL UNION SELECT design, file, 'commit', commit_id FROM f""")
def t_file_lists(spark, sf_dir):
    """The authors and commits of each file."""
    return H.file_lists(load(spark, sf_dir, "commits"))


@query("""SELECT design, m AS module, count(DISTINCT commit_id) AS change_frequency, max(commit_date) AS last_modified, count(DISTINCT author) AS num_authors
FROM (SELECT commit_id, commit_date, author, design, unnest(modules_modified) AS m FROM commits) GROUP BY 1, 2""")
def t_module_history(spark, sf_dir):
    """Change frequency, last change and authors of each module."""
    return H.module_history(load(spark, sf_dir, "commits"))


@query("""SELECT design, file, n_commits FROM (SELECT *, row_number() OVER (PARTITION BY design ORDER BY n_commits DESC, file) AS k FROM
(SELECT design, f AS file, count(DISTINCT commit_id) AS n_commits FROM (SELECT commit_id, design, unnest(files_changed) AS f FROM commits) GROUP BY 1, 2)) WHERE k <= 5""")
def t_top_files(spark, sf_dir):
    """The five most changed files of each design."""
    return H.top_files(load(spark, sf_dir, "commits"), 5)


@query(r"""SELECT DISTINCT commit_id, list_sort(list_distinct(list_filter(list_transform(files_changed, lambda f: nullif(regexp_extract(f, '([^/]+)\.(v|sv|vh|svh|vhd|vhdl)$', 1), '')), lambda m: m IS NOT NULL))) AS modules,
list_filter(files_changed, lambda f: regexp_matches(f, '^rtl/.*\.v$')) AS sources FROM commits""")
def t_modules_of_files(spark, sf_dir):
    """The modules and plain sources that each commit's files belong to."""
    rows = load(spark, sf_dir, "commits").select("commit_id", "files_changed")
    modules = F.array_sort(F.array_distinct(F.array_compact(F.transform("files_changed", S.module_of_file))))
    return rows.select("commit_id", modules.alias("modules"), S.keep_matching(F.col("files_changed"), ["rtl/*.v"]).alias("sources")).distinct()


@query(r"""SELECT constraint_type, count(*) AS n, count(*) FILTER (regexp_extract(raw_line, '^\s*(\S+)', 1) = constraint_type) AS n_command,
sum(len(list_filter(string_split(trim(translate(raw_line, '[]{}', '    ')), ' '), lambda w: regexp_full_match(w, '-?\d+(\.\d+)?')))) AS n_numbers,
count(*) FILTER (regexp_matches(raw_line, '(^|\s)-setup(\s|$)')) AS n_setup FROM (SELECT DISTINCT constraint_id, constraint_type, raw_line FROM sdc_constraints WHERE raw_line IS NOT NULL) GROUP BY 1""")
def t_commands(spark, sf_dir):
    """What the command lines of each type hold."""
    rows = load(spark, sf_dir, "sdc_constraints").where("raw_line is not null").select("constraint_id", "constraint_type", "raw_line").distinct()
    words = F.split(F.trim(F.translate("raw_line", "[]{}", "    ")), " ")
    return rows.groupBy("constraint_type").agg(
        F.count("*").alias("n"),
        F.count_if(S.command(F.col("raw_line")) == F.col("constraint_type")).alias("n_command"),
        F.sum(F.size(F.filter(words, lambda w: w.rlike(r"^-?\d+(\.\d+)?$")))).cast("decimal(38,0)").alias("n_numbers"),
        F.count_if(S.has_flag(F.col("raw_line"), "setup")).alias("n_setup"),
    )


@query(r"""SELECT constraint_id, constraint_type, period, round(1000 / period, 6) AS frequency_mhz, name FROM (SELECT DISTINCT constraint_id, constraint_type, TRY_CAST(regexp_extract(raw_line, '-period\s+(\S+)', 1) AS DOUBLE) AS period, regexp_extract(raw_line, '-name\s+(\S+)', 1) AS name
FROM sdc_constraints WHERE constraint_type = 'create_clock' AND regexp_matches(raw_line, '-period\s+\d') AND regexp_matches(raw_line, '-name\s+\w'))""")
def t_clocks(spark, sf_dir):
    """Period and frequency of each clock command."""
    rows = load(spark, sf_dir, "sdc_constraints").where((F.col("constraint_type") == "create_clock") & F.col("raw_line").rlike(r"-period\s+\d") & F.col("raw_line").rlike(r"-name\s+\w"))
    parsed = C.parse_commands(rows.select("constraint_id", "raw_line").distinct())
    return parsed.select("constraint_id", "constraint_type", "period", F.round("frequency_mhz", 6).alias("frequency_mhz"), F.col("clock_name").alias("name"))


@query(r"""WITH l AS (SELECT DISTINCT constraint_id, raw_line FROM sdc_constraints WHERE raw_line IS NOT NULL)
SELECT constraint_id, list_filter(flatten(list_transform(regexp_extract_all(raw_line, '\[get_\w+\s+([^\]]+)\]', 1), lambda g: regexp_split_to_array(translate(g, '{}', ''), '\s+'))), lambda w: w <> '') AS short,
list_filter(flatten(list_transform(regexp_extract_all(raw_line, '\[get_\w+\s+(\{[^{}]*\}|(?:[^\[\]\s{}]|\[[^\[\]]*\])*)\s*\]', 1), lambda g: regexp_split_to_array(translate(g, '{}', ''), '\s+'))), lambda w: w <> '') AS targets,
nullif(regexp_extract(raw_line, '\[get_(\w+)', 1), '') AS kind FROM l""")
def t_get_groups(spark, sf_dir):
    """The targets of each command line, whole and as cut off by the older reading."""
    rows = load(spark, sf_dir, "sdc_constraints").where("raw_line is not null").select("constraint_id", "raw_line").distinct()
    line = F.col("raw_line")
    return rows.select("constraint_id", S.get_targets_short(line).alias("short"), S.get_targets(line).alias("targets"), S.get_kind(line).alias("kind"))


@query("""SELECT design, constraint_id, design || '::sdc::' || lpad(CAST(row_number() OVER (PARTITION BY design ORDER BY file_path NULLS FIRST, line_number NULLS FIRST, constraint_id) AS VARCHAR), 6, '0') AS numbered
FROM (SELECT DISTINCT constraint_id, design, file_path, line_number FROM sdc_constraints)""")
def t_running_ids(spark, sf_dir):
    """Constraints numbered by file and line within their design."""
    rows = load(spark, sf_dir, "sdc_constraints").select("constraint_id", "design", "file_path", "line_number").distinct()
    rows = skew.ranked(rows, ["design"], [F.asc_nulls_first("file_path"), F.asc_nulls_first("line_number"), F.col("constraint_id")], "k")
    return rows.select("design", "constraint_id", F.concat(F.col("design"), F.lit("::sdc::"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("numbered"))


@query("""SELECT DISTINCT constraint_id, CASE WHEN length(raw_line) > 60 THEN substr(raw_line, 1, 60) || '...' ELSE raw_line END AS short_line FROM sdc_constraints""")
def t_shortened(spark, sf_dir):
    """Command lines of at most sixty characters."""
    return load(spark, sf_dir, "sdc_constraints").select("constraint_id", S.shorten(F.col("raw_line"), 60).alias("short_line")).distinct()


@query("""SELECT DISTINCT module_id, src_file || ':' || src_start_line || '-' || src_end_line AS place, src_file AS file, src_start_line AS first_line, src_end_line AS last_line
FROM modules WHERE src_file IS NOT NULL AND src_start_line IS NOT NULL AND src_end_line IS NOT NULL""")
def t_source_places(spark, sf_dir):
    """Source places written as one string and parsed again."""
    rows = load(spark, sf_dir, "modules").where("src_file is not null and src_start_line is not null and src_end_line is not null")
    place = F.concat(F.col("src_file"), F.lit(":"), F.col("src_start_line").cast("string"), F.lit("-"), F.col("src_end_line").cast("string"))
    return rows.select("module_id", place.alias("place")).select("module_id", "place", S.source_place(F.col("place")).alias("p")).select("module_id", "place", "p.*").distinct()


@query("""WITH q AS (SELECT DISTINCT question_id, qa_id, answer, question, list_distinct(coalesce(evidence_nodes, [])) AS want, list_distinct(regexp_extract_all(coalesce(retrieved_context, ''), 'id=(\\S+)', 1)) AS got FROM qa_results),
s AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(answer, '')), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(question, '')), '[a-z0-9_]+')) AS g FROM q),
n AS (SELECT *, len(list_intersect(a, g)) AS c, len(list_intersect(want, got)) AS f FROM s)
SELECT qa_id, round(CASE WHEN c > 0 THEN 2.0 * c / (len(a) + len(g)) ELSE 0 END, 6) AS token_f1, round(CASE WHEN len(want) > 0 THEN f / len(want) ELSE 0 END, 6) AS evidence_recall, round(CASE WHEN len(got) > 0 THEN f / len(got) ELSE 0 END, 6) AS evidence_precision FROM n""".replace("\\\\", "\\"))
def t_answer_scores(spark, sf_dir):
    """Token overlap of each answer with its question, and evidence scores of its context."""
    rows = _answers(spark, sf_dir)
    return M.answer_scores(rows).select("qa_id", *[F.round(c, 6).alias(c) for c in ("token_f1", "evidence_recall", "evidence_precision")])


def _answers(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "qa_results").select("question_id", "qa_id", "answer", F.col("question").alias("gold"), F.col("evidence_nodes").alias("evidence"), F.regexp_extract_all("retrieved_context", F.lit(r"id=(\S+)"), 1).alias("retrieved"), "method_name", "design")
    return rows.distinct()


@query("""WITH q AS (SELECT DISTINCT question_id, qa_id, answer, question, method_name, design, list_distinct(coalesce(evidence_nodes, [])) AS want, list_distinct(regexp_extract_all(coalesce(retrieved_context, ''), 'id=(\\S+)', 1)) AS got FROM qa_results),
n AS (SELECT method_name, CASE WHEN len(want) > 0 THEN len(list_intersect(want, got)) / len(want) ELSE 0 END AS r, CASE WHEN len(got) > 0 THEN len(list_intersect(want, got)) / len(got) ELSE 0 END AS p FROM q)
SELECT 'all' AS axis, '' AS label, count(*) AS n, round(avg(r), 6) AS evidence_recall, round(avg(p), 6) AS evidence_precision FROM n UNION ALL SELECT 'method_name', method_name, count(*), round(avg(r), 6), round(avg(p), 6) FROM n GROUP BY method_name""".replace("\\\\", "\\"))
def t_answer_summary(spark, sf_dir):
    """Means of the answer scores, over all and by method."""
    out = M.answer_summary(M.answer_scores(_answers(spark, sf_dir)), ["method_name"])
    return out.select("axis", "label", "n", F.round("evidence_recall", 6).alias("evidence_recall"), F.round("evidence_precision", 6).alias("evidence_precision"))


@query("""SELECT DISTINCT item_id, list_filter(regexp_extract_all(lower(gold_answer), '[a-z_][a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'are', 'has', 'with', 'that', 'this', 'from', 'not', 'have', 'module', 'modules')) AS entities FROM eval_items""")
def t_key_entities(spark, sf_dir):
    """The entities of each gold answer."""
    return load(spark, sf_dir, "eval_items").select("item_id", S.key_entities(F.col("gold_answer")).alias("entities")).distinct()


@query(f"""WITH {GRAPH_SQL}, w AS (SELECT DISTINCT s.run, n.design, unnest(list_distinct(list_filter(list_append(string_split(lower(n.name), '_'), lower(n.name)), lambda x: length(x) >= 3))) AS word FROM seeds s JOIN nodes n ON n.id = s.node),
k AS (SELECT run, count(*) AS n FROM w GROUP BY run),
h AS (SELECT id, design, lower(concat_ws(' ', name, raw_line, summary)) AS t FROM nodes),
m AS (SELECT w.run, h.id AS node, count(*) AS n FROM w JOIN h ON h.design = w.design AND contains(h.t, w.word) GROUP BY 1, 2)
SELECT m.run, m.node, round(least(1.0, m.n / k.n), 6) AS risk FROM m JOIN k ON k.run = m.run WHERE (m.run, m.node) NOT IN (SELECT run, node FROM seeds)""")
def g_lexical(spark, sf_dir):
    """Impact by the words of each module's name."""
    g = design_graph(spark, sf_dir)
    return T.lexical(g, every_module(g)).select("run", "node", F.round("risk", 6).alias("risk"))


@query(f"""WITH {GRAPH_SQL}, asked AS (SELECT child_module_name AS query FROM instances UNION SELECT regexp_extract(question, '[a-z0-9]+_[a-z0-9_]+') FROM qa_results UNION SELECT module_id FROM modules),
q AS (SELECT DISTINCT query, lower(query) AS q FROM asked WHERE query <> ''),
keys AS (SELECT DISTINCT id, type, unnest([lower(name), lower(string_split(id, '::')[-1])]) AS key FROM nodes),
by_id AS (SELECT query, id AS node, 1 AS rank FROM q JOIN nodes n ON n.id = q.query),
cand AS (SELECT q.query, k.id AS node, 2 AS rank FROM q JOIN keys k ON k.key = q.q),
near AS (SELECT DISTINCT q.query, k.id AS node, CASE WHEN k.type = 'Module' THEN 3 ELSE 4 END AS rank FROM q JOIN keys k ON contains(k.key, q.q) OR contains(q.q, k.key) WHERE k.key <> '' AND q.query NOT IN (SELECT query FROM cand))
SELECT query, node, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, rank > 2 AND NOT ends_with(node, '::' || query), node) AS k FROM (SELECT * FROM by_id UNION SELECT * FROM cand UNION SELECT * FROM near)) WHERE k = 1""")
def g_resolve(spark, sf_dir):
    """The node that each name means: of instances' children, in questions, and module ids."""
    g = design_graph(spark, sf_dir)
    asked = load(spark, sf_dir, "instances").select(F.col("child_module_name").alias("query"))
    asked = asked.unionByName(load(spark, sf_dir, "qa_results").select(F.regexp_extract("question", "[a-z0-9]+_[a-z0-9_]+", 0).alias("query")))
    asked = asked.unionByName(load(spark, sf_dir, "modules").select(F.col("module_id").alias("query")))
    return T.resolve_names(g, asked.where("query <> ''").distinct())


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)) + 1e-8) AS similarity FROM q, v)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def v_top_k(spark, sf_dir):
    """The ten vectors nearest to each query vector."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return T.vector_top_k(v, q, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {GRAPH_SQL} SELECT DISTINCT n.design, n.id AS module, 'ports' AS kind, 'What ports does module ' || n.name || ' have?' AS question_text, list_sort(list(DISTINCT p.name)) AS gold FROM nodes n JOIN edges e ON e.src = n.id AND e.relation = 'has_port' JOIN nodes p ON p.id = e.dst WHERE n.type = 'Module' GROUP BY 1, 2, 3, 4
UNION ALL SELECT n.design, n.id, 'submodules', 'What submodules does module ' || n.name || ' have?', list_sort(list(DISTINCT p.name)) FROM nodes n JOIN edges e ON e.src = n.id AND e.relation = 'instantiates' JOIN nodes p ON p.id = e.dst WHERE n.type = 'Module' GROUP BY 1, 2, 3, 4""")
def q_structural(spark, sf_dir):
    """Questions about the ports and submodules of every module, with their answers."""
    g = design_graph(spark, sf_dir)
    return Q.structural_questions(g).where(F.col("kind").isin("ports", "submodules")).select("design", "module", "kind", "question_text", "gold")


@query(f"""WITH {GRAPH_SQL} SELECT n.design, n.id AS module, 'Which commits modified module ' || n.name || '?' AS question_text, list_slice(list_sort(list(DISTINCT p.name)), 1, 5) AS gold, count(DISTINCT p.id) AS n FROM nodes n JOIN edges e ON e.src = n.id AND e.relation = 'modified_by' JOIN nodes p ON p.id = e.dst WHERE n.type = 'Module' GROUP BY 1, 2, 3""")
def q_temporal(spark, sf_dir):
    """Questions about the commits of every module."""
    return Q.commit_questions(design_graph(spark, sf_dir))


@query(f"""WITH {GRAPH_SQL}, bi AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), m AS (SELECT id FROM nodes WHERE type = 'Module'),
one AS (SELECT m.id AS module, b.dst AS node FROM m JOIN bi b ON b.src = m.id), two AS (SELECT module, node FROM one UNION SELECT o.module, b.dst FROM one o JOIN bi b ON b.src = o.node),
far AS (SELECT module, node FROM two WHERE node <> module)
SELECT f.module, n.type AS artifact_type, count(*) AS n FROM far f JOIN nodes n ON n.id = f.node WHERE f.module IN (SELECT module FROM far GROUP BY module HAVING count(*) >= 3) GROUP BY 1, 2""")
def q_what_if(spark, sf_dir):
    """Artifacts within two steps of every module with at least three, by type."""
    return Q.what_if_counts(design_graph(spark, sf_dir))


def _rule(k: int) -> str:
    """SQL of what the rules, in order, give for column ``k`` of a rule; null without a match."""
    return "CASE " + " ".join(f"WHEN regexp_matches(low, '{rule[0].replace(chr(39), chr(39) * 2)}') THEN {k(n, rule)}" for n, rule in enumerate(Q.RULES, 1)) + " END"


def _entity(group: int):
    def of(n: int, rule: tuple) -> str:
        pattern = rule[0].replace("'", "''")
        return f"regexp_extract(low, '{pattern}', {group})" if rule[0].count(Q._E) >= group else "CAST(NULL AS VARCHAR)"

    return of


_STOP = ", ".join(f"'{w}'" for w in Q.FALLBACK_STOP)


@query(f"""WITH l AS (SELECT DISTINCT question, lower(question) AS low FROM qa_results WHERE question IS NOT NULL),
r AS (SELECT *, {_rule(lambda n, rule: str(n))} AS n, {_rule(lambda n, rule: f"'{rule[1]}'")} AS c, {_rule(lambda n, rule: f"'{rule[2]}'")} AS o, {_rule(_entity(1))} AS e, {_rule(_entity(2))} AS e2,
  nullif(regexp_extract(low, '[`''"]([a-z_][a-z0-9_]+)[`''"]', 1), '') AS quoted, nullif(regexp_extract(low, '\\b([a-z][a-z0-9]*_[a-z0-9_]+)', 1), '') AS joined,
  list_filter(regexp_extract_all(low, '[a-z][a-z0-9]{{2,}}'), lambda w: w NOT IN ({_STOP}))[1] AS plain FROM l)
SELECT question, CAST(coalesce(n, 0) AS INTEGER) AS rule_no, coalesce(c, 'structural') AS category, coalesce(o, 'neighborhood') AS operation,
  coalesce(CASE WHEN n IS NOT NULL THEN rtrim(e, '.:') END, quoted, joined, plain) AS entity, rtrim(e2, '.:') AS entity2 FROM r""")
def q_parsed(spark, sf_dir):
    """The category, operation and entity that rules read from every question."""
    return Q.parse_questions(load(spark, sf_dir, "qa_results").select("question").where("question is not null").distinct())


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def s_activity(spark, sf_dir):
    """Events per day and type by the streaming transformation."""
    return ingest.activity(load(spark, sf_dir, "events"), "ts", "event_type")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def s_sessions(spark, sf_dir):
    """Each user's sessions by the streaming transformation."""
    return ingest.sessions(load(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


_FLAG = r"(?:^|\s)-{}\s+(\[[^\]]*\]|\{{[^}}]*\}}|[^\s\[\]-][^\s]*|-\d[^\s]*)"


def _times(flag: str, factor: str) -> str:
    """A line with the first occurrence of a flag's value multiplied; null if it is no number."""
    value = f"nullif(regexp_extract(raw_line, '{_FLAG.format(flag)}', 1), '')"
    return f"substr(raw_line, 1, instr(raw_line, {value}) - 1) || CAST(TRY_CAST({value} AS DOUBLE) * {factor} AS VARCHAR) || substr(raw_line, instr(raw_line, {value}) + length({value}))"


@query(f"""WITH p AS (SELECT DISTINCT constraint_id, constraint_type, raw_line FROM sdc_constraints WHERE raw_line IS NOT NULL),
v AS (SELECT constraint_id, 'remove' AS variant, raw_line AS old_text, '# ' || raw_line AS new_text FROM p WHERE constraint_type = 'set_false_path'
UNION ALL SELECT constraint_id, 'halve_period', raw_line, {_times("period", "0.5")} FROM p WHERE constraint_type = 'create_clock'
UNION ALL SELECT constraint_id, 'double_period', raw_line, {_times("period", "2.0")} FROM p WHERE constraint_type = 'create_clock'
UNION ALL SELECT constraint_id, 'double_delay', raw_line, coalesce({_times("max", "2.0")}, {_times("min", "2.0")}) FROM p WHERE constraint_type IN ('set_input_delay', 'set_output_delay'))
SELECT constraint_id, variant, old_text, new_text FROM v WHERE new_text IS NOT NULL AND new_text <> old_text""")
def c_constraint_changes(spark, sf_dir):
    """Every change of a constraint: periods halved and doubled, false paths removed, delays doubled."""
    rows = load(spark, sf_dir, "sdc_constraints").where("raw_line is not null").select("constraint_id", "constraint_type", "raw_line", F.lit("").alias("file_path")).distinct()
    changes = changes_of.constraint_changes(rows, "any", 1 << 30)
    return changes.where("new_text <> old_text").select(F.col("module").alias("constraint_id"), "variant", "old_text", "new_text")
