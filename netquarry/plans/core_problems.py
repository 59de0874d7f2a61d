"""Queries of the general data problems (numbers 1, 5 and 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators import hierarchy
from netquarry.scratch import load
from netquarry.sources import nested, quoted_rows

MAPS = tuple(f"changes{a}.ground_truth_by_{kind}" for a in ("", "[]") for kind in ("type", "hop"))


def _module_tree(spark: SparkSession, sf_dir: str, with_path: bool) -> DataFrame:
    nodes = load(spark, sf_dir, "modules").select(F.col("module_id").alias("node_id"))
    links = load(spark, sf_dir, "instances").select(F.col("parent_module").alias("parent_id"), F.col("child_module").alias("child_id"))
    return hierarchy.hierarchies(nodes, links, with_path=with_path)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and number of modules below of every module."""
    return _module_tree(spark, sf_dir, False).select(F.col("node_id").alias("module_id"), "root_id", "tree_depth", "n_below")


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every module's full path from its root, and whether it is on a cycle."""
    tree = _module_tree(spark, sf_dir, True)
    return tree.select(F.col("node_id").alias("module_id"), F.array_join("path", "/").alias("full_path"), "on_cycle")


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other module below every module, with its distance."""
    return hierarchy.descendants(_module_tree(spark, sf_dir, False)).select("ancestor_id", F.col("node_id").alias("module_id"), "distance")


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that form cycles, by the smallest module of the cycle."""
    return hierarchy.cycle_edges(_module_tree(spark, sf_dir, False)).select("component", "parent_id", F.col("node_id").alias("module_id"), "back_edge")


P5_TABLES = {
    "change": ("changes[]", ["change_id", "change_type", "description", "target_module", "synthesis_valid"]),
    "patch": ("changes[].patches[]", ["file_path", "old_text", "new_text", "line_number"]),
    "type": ("changes[].ground_truth_by_type{}[]", [""]),
    "hop": ("changes[].ground_truth_by_hop{}[]", [""]),
    # the older shape: lists of a key and its nodes
    "type_entry": ("changes[].ground_truth_by_type[]", ["artifact_type"]),
    "type_node": ("changes[].ground_truth_by_type[].nodes[]", [""]),
    "hop_entry": ("changes[].ground_truth_by_hop[]", ["hop"]),
    "hop_node": ("changes[].ground_truth_by_hop[].nodes[]", [""]),
}


def p5_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The flat tables of the change sets: change, patch, type and hop, tied by (record_id, change_pos)."""
    made = nested.flat_tables(load(spark, sf_dir, "changesets"), "changeset_id", "payload", P5_TABLES, MAPS)
    made = {name: t.withColumn("change_pos", F.get("ordinals", F.lit(0))) for name, t in made.items() if name != "errors"}
    out = {"change": made["change"].drop("pos", "parent_ordinals", "own_kind", "ordinals"), "patch": made["patch"].where("coalesce(own_kind, 'object') = 'object'")}
    for kind, key in (("type", "artifact_type"), ("hop", "hop")):
        second = F.get("ordinals", F.lit(1))
        as_map = made[kind].select("record_id", "change_pos", second.alias("parent_key"), "pos", "value", "own_kind")
        entry = made[f"{kind}_entry"].select("record_id", "change_pos", F.col("pos").alias("entry"), F.col(key).alias("parent_key"))
        node = made[f"{kind}_node"].select("record_id", "change_pos", second.alias("entry"), "pos", "value", "own_kind")
        as_list = node.join(entry, ["record_id", "change_pos", "entry"]).select("record_id", "change_pos", "parent_key", "pos", "value", "own_kind")
        out[kind] = as_map.unionByName(as_list).where("own_kind not in ('null', 'empty_array', 'empty_object')").drop("own_kind")
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch, type and hop entry of every change."""
    t = p5_tables(spark, sf_dir)
    patch = t["patch"].select("record_id", "change_pos", F.lit("patch").alias("child"), F.lit("").alias("parent_key"), "pos", F.coalesce("file_path", F.lit("")).alias("leaf"))
    parts = [patch]
    for kind in ("type", "hop"):
        parts.append(t[kind].select("record_id", "change_pos", F.lit(kind).alias("child"), "parent_key", "pos", F.col("value").alias("leaf")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    change = t["change"].where("change_id is not null").select("record_id", "change_pos", "change_id")
    out = every.join(change, ["record_id", "change_pos"])
    return out.select("change_id", "child", "parent_key", F.col("pos").cast("int").alias("pos"), "leaf").distinct()


def p7_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records, typed."""
    rows = quoted_rows.parse_constraint_rows(load(spark, sf_dir, "raw_constraint_rows").select("row_id", "raw_row"))
    return rows.where("reason is null").select("row_id", "constraint_id", "constraint_type", "raw_line", "line_number", "file_path")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rejected records with the first reason that holds."""
    rows = quoted_rows.parse_constraint_rows(load(spark, sf_dir, "raw_constraint_rows").select("row_id", "raw_row"))
    return rows.where("reason is not null").select("row_id", "reason")


_QUOTED_WELL = r'^([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*$'


def p7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well quoted records of files of up to 200 rows, cut into chunks anywhere, found again."""
    rows = load(spark, sf_dir, "raw_constraint_rows").where(F.col("raw_row").rlike(_QUOTED_WELL)).where("raw_row <> ''")
    rows = rows.select(F.floor(F.col("row_id") / 200).alias("file"), "row_id", "raw_row")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "raw_row"))), lambda r: r["raw_row"])
    files = rows.groupBy("file").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text"))
    size = 997
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    chunks = files.select(F.col("file").cast("string").alias("file"), "text", F.explode(cuts).alias("chunk_no"))
    found = quoted_rows.split_records(chunks.select("file", "chunk_no", F.substring("text", F.col("chunk_no") * size + 1, F.lit(size)).alias("text")))
    return found.select(F.col("file").cast("bigint").alias("file"), "record")


QUERIES = {"p7_records": p7_records, "p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p1_cycles": p1_cycles, "p5_found": p5_found, "p7_found": p7_found, "p7_parsed": p7_parsed}

# a walk upwards ends at a root, or with the first node that it meets again
_LINKS = """
  known AS (SELECT DISTINCT module_id AS node FROM modules WHERE module_id IS NOT NULL),
  up AS (SELECT child_module AS node, min(parent_module) AS parent FROM instances
         WHERE parent_module IN (SELECT node FROM known) AND child_module IN (SELECT node FROM known) GROUP BY 1),
  walk AS (SELECT k.node, k.node AS here, 0 AS d, [k.node] AS way, false AS again FROM known k
           UNION ALL
           SELECT w.node, u.parent, w.d + 1, list_append(w.way, u.parent), list_contains(w.way, u.parent)
           FROM walk w JOIN up u ON u.node = w.here WHERE NOT w.again)
"""


def _items(x: str) -> str:
    """A JSON value as a list of its elements, a single value as a list of one."""
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN json_extract({x}, '$[*]') WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE [CAST({x} AS JSON)] END"


def _truth(kind: str, key: str) -> str:
    """(change_id, child, parent_key, x) of one truth, a map of keys or a list of a key and its nodes."""
    field = f"c -> '$.ground_truth_by_{kind}'"
    return f"""SELECT change_id, '{kind}' AS child, k AS parent_key, json_extract(m, '$."' || k || '"') AS x FROM (SELECT change_id, {field} AS m, unnest(json_keys({field})) AS k FROM named WHERE json_type({field}) = 'OBJECT')
  UNION ALL SELECT change_id, '{kind}', e ->> '$.{key}', e -> '$.nodes' FROM (SELECT change_id, unnest(json_extract({field}, '$[*]')) AS e FROM named WHERE json_type({field}) = 'ARRAY')"""


def _paired(x: str, passes: int = 20) -> str:
    """A text's brackets and braces without those that close each other, nested up to ``passes`` deep."""
    out = f"regexp_replace({x}, '[^\\[\\]{{}}]', '', 'g')"
    for _ in range(passes):
        out = f"replace(replace({out}, '[]', ''), '{{}}', '')"
    return out


_JUDGED = rf"""cut AS (SELECT row_id, coalesce(raw_row, '') AS raw_row, raw_row IS NULL AS missing, regexp_matches(coalesce(raw_row, ''), '{_QUOTED_WELL}') AS fine FROM raw_constraint_rows),
  split AS (SELECT *, list_transform(regexp_extract_all(raw_row || ',', '("(?:[^"]|"")*"|[^",]*),', 1), lambda f: CASE WHEN f LIKE '"%' THEN replace(substr(f, 2, length(f) - 2), '""', '"') ELSE f END) AS f FROM cut),
  judged AS (SELECT *, CASE WHEN NOT fine THEN 'quoting' WHEN missing OR len(f) <> 5 THEN 'column_count' WHEN f[2] NOT IN ({", ".join(f"'{c}'" for c in quoted_rows.COMMANDS)}) THEN 'bad_command'
    WHEN NOT regexp_full_match(f[4], '[0-9]+') OR regexp_full_match(f[4], '0+') OR TRY_CAST(f[4] AS BIGINT) IS NULL THEN 'bad_line_number'
    WHEN {_paired("f[3]")} <> '' OR regexp_extract(f[3], '^\s*(\S+)', 1) <> f[2] THEN 'bad_raw_line' END AS reason FROM split)"""

SQL = {
    "p7_found": f"WITH {_JUDGED} SELECT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p7_parsed": f"WITH {_JUDGED} SELECT row_id, f[1] AS constraint_id, f[2] AS constraint_type, f[3] AS raw_line, CAST(f[4] AS BIGINT) AS line_number, f[5] AS file_path FROM judged WHERE reason IS NULL",
    "p1_found": f"""WITH RECURSIVE {_LINKS},
  ended AS (SELECT w.node, w.here AS root_id, w.d AS tree_depth FROM walk w
            WHERE w.here NOT IN (SELECT node FROM up)),
  below AS (SELECT here AS node, count(DISTINCT node) FILTER (WHERE node <> here) AS n FROM walk GROUP BY here)
SELECT k.node AS module_id, coalesce(e.root_id, 'CYCLE') AS root_id,
       CAST(coalesce(e.tree_depth, -1) AS INTEGER) AS tree_depth, CAST(b.n AS INTEGER) AS n_below
FROM known k LEFT JOIN ended e ON e.node = k.node JOIN below b ON b.node = k.node""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT here AS ancestor_id, node AS module_id, CAST(min(d) AS INTEGER) AS distance FROM walk WHERE here <> node GROUP BY 1, 2""",
    "p1_cycles": f"""WITH RECURSIVE {_LINKS},
  ring AS (SELECT node, min(here) AS component FROM walk WHERE node IN (SELECT node FROM walk WHERE d > 0 AND here = node) GROUP BY 1)
SELECT r.component, u.parent AS parent_id, r.node AS module_id, r.node = r.component AS back_edge FROM ring r JOIN up u ON u.node = r.node""",
    "p1_paths": f"""WITH RECURSIVE {_LINKS}
SELECT k.node AS module_id, array_to_string(list_reverse(w.way), '/') AS full_path, k.node IN (SELECT node FROM walk WHERE d > 0 AND here = node) AS on_cycle
FROM known k LEFT JOIN walk w ON w.node = k.node AND w.here NOT IN (SELECT node FROM up)""",
    "p7_records": rf"""SELECT CAST(row_id // 200 AS BIGINT) AS file, regexp_replace(raw_row, '\r$', '') AS record FROM raw_constraint_rows WHERE regexp_matches(raw_row, '{_QUOTED_WELL}') AND raw_row <> ''""",
    "p5_found": f"""WITH sets AS (SELECT changeset_id, CAST(payload AS JSON) -> '$.changes' AS x FROM changesets WHERE json_valid(payload)),
  chg AS (SELECT row_number() OVER () AS k, c FROM (SELECT unnest({_items("x")}) AS c FROM sets) WHERE json_type(c) = 'OBJECT'),
  named AS (SELECT k, c ->> '$.change_id' AS change_id, c FROM chg WHERE c ->> '$.change_id' IS NOT NULL),
  patch AS (SELECT change_id, 'patch' AS child, '' AS parent_key, pos, coalesce(p ->> '$.file_path', '') AS leaf
            FROM (SELECT change_id, unnest(l) AS p, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT change_id, {_items("c -> '$.patches'")} AS l FROM named)) WHERE json_type(p) = 'OBJECT'),
  truth AS ({" UNION ALL ".join(_truth(kind, key) for kind, key in (("type", "artifact_type"), ("hop", "hop")))}),
  node AS (SELECT change_id, child, parent_key, pos, n ->> '$' AS leaf
           FROM (SELECT change_id, child, parent_key, unnest(l) AS n, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT change_id, child, parent_key, {_items("x")} AS l FROM truth)) WHERE json_type(n) <> 'NULL')
SELECT DISTINCT change_id, child, parent_key, CAST(pos AS INTEGER) AS pos, leaf FROM (SELECT * FROM patch UNION ALL SELECT * FROM node)""",
}
