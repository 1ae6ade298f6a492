"""Queries of the general data problems over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veinstone.functions.ids import canonical_id
from veinstone.operators import hierarchy as tree, nested, orphans, snapshots
from veinstone.session import broadcast_if_small
from veinstone.sources.tables import current_rows, load


def _shredded(spark: SparkSession, d: str, with_fields: bool) -> nested.Shredded:
    contracts = load(spark, d, "contracts").select("function_id", "contract_json", "updated_at")
    current = current_rows(contracts, canonical_id("function_id"))
    return nested.shred(current, canonical_id("function_id"), "contract_json", "contracts", ("invariants", "io_examples"), with_fields)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the tables of repeated elements, with the item that their foreign key leads to."""
    return _shredded(spark, d, with_fields=False).links().withColumnRenamed("doc_id", "function_id")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows and flat columns of each table that the contracts become."""
    nodes = _shredded(spark, d, with_fields=True).nodes
    per_column = nodes.select("table_name", F.explode_outer(F.map_keys("fields")).alias("column_name"))
    return per_column.groupBy("table_name", "column_name").agg(F.count("*").alias("n_rows"))


def _normal(c: str) -> Column:
    return F.lower(F.btrim(F.col(c), F.lit(" \t\r\n")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Changes between consecutive scans of both snapshot tables."""
    parts = []
    for name, value in (("artifacts", "code_hash"), ("queue", "reason")):
        table = load(spark, d, "artifact_snapshots" if name == "artifacts" else "queue_snapshots")
        changes = snapshots.snapshot_changes(table, "scan_no", canonical_id("function_id"), _normal(value), "updated_at")
        parts.append(changes.select(F.lit(name).alias("src_table"), F.col("scan_no").cast("int").alias("scan_no"), F.col("key").alias("function_id"), "change_type"))
    return parts[0].unionByName(parts[1])


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Changes of the code hashes with the values before and after."""
    table = load(spark, d, "artifact_snapshots")
    changes = snapshots.snapshot_changes(table, "scan_no", canonical_id("function_id"), _normal("code_hash"), "updated_at", with_values=True)
    return changes.select(F.col("scan_no").cast("int").alias("scan_no"), F.col("key").alias("function_id"), "change_type", "old_value", "new_value")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """caller, callee, created_at of the edges that count."""
    library = load(spark, d, "library_functions").select(canonical_id("function_id").alias("fn")).filter("fn is not null").distinct()
    raw = load(spark, d, "dependencies").filter("caller_id is not null and callee_id is not null")  # pushed to the scan
    edges = raw.select(canonical_id("caller_id").alias("caller"), canonical_id("callee_id").alias("callee"), "created_at")
    for side in ("caller", "callee"):
        edges = edges.join(broadcast_if_small(library.withColumnRenamed("fn", side)), side, "left_anti")
    return edges


def call_links(spark: SparkSession, d: str) -> DataFrame:
    """node, parent: the functions of the counted edges, as callees with the caller of their earliest edge, as callers with null."""
    edges = _calls(spark, d)
    first = F.min(F.struct(F.col("created_at").isNull().alias("late"), "created_at", "caller"))
    parents = edges.groupBy("callee").agg(first.alias("first")).select(F.col("callee").alias("node"), F.col("first.caller").alias("parent"))
    return parents.unionByName(edges.select(F.col("caller").alias("node")).withColumn("parent", F.lit(None).cast("string")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every function in the calling hierarchy."""
    found = tree.hierarchy(call_links(spark, d))
    return found.select(F.col("node").alias("function_id"), F.col("root").alias("root_id"), F.col("depth").alias("tree_depth"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full calling path, number of descendants and cycle mark of every function."""
    found = tree.cut(tree.hierarchy(call_links(spark, d)))
    paths = tree.full_paths(found)
    return found.join(paths, "node").select(
        F.col("node").alias("function_id"), F.array_join("path", " > ").alias("call_path"), (F.col("leave") - F.col("enter") - 1).alias("n_descendants"), "in_cycle"
    )


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every function outside cycles, with their distance."""
    pairs = tree.descendant_pairs(tree.cut(tree.hierarchy(call_links(spark, d))))
    return pairs.select(F.col("node").alias("function_id"), F.col("descendant").alias("descendant_id"), "distance")


def _on_or_below_cycles(spark: SparkSession, d: str) -> DataFrame:
    return tree.cut(tree.hierarchy(call_links(spark, d)).filter("depth < 0"))


def p5_cycle_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path of every function on or below a cycle from the cycle's function it hangs from, for which p5_paths has null."""
    paths = tree.full_paths(_on_or_below_cycles(spark, d), from_cycles=True)
    return paths.select(F.col("node").alias("function_id"), F.array_join("path", " > ").alias("cycle_path"))


def p5_cycle_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of the functions on and below cycles, with their distance, which p5_descendants leaves out."""
    pairs = tree.descendant_pairs(_on_or_below_cycles(spark, d), from_cycles=True)
    return pairs.select(F.col("node").alias("function_id"), F.col("descendant").alias("descendant_id"), "distance")


def orphan_state(spark: SparkSession, d: str) -> DataFrame:
    """The orphan state after all scans, fed in order, and the artifacts as they are now as the last delivery."""
    library = load(spark, d, "library_functions").select(canonical_id("function_id").alias("key")).filter("key is not null").distinct()

    def references(after: Column | None, until: Column | None) -> list[orphans.Reference]:
        made = []
        at = F.col("created_at")
        for table, field in (("dependencies", "caller_id"), ("dependencies", "callee_id"), ("learning_history", "function_id")):
            rows = load(spark, d, table).filter(F.col(field).isNotNull())
            if after is not None:
                rows = rows.filter(at > after)
            if until is not None:
                rows = rows.filter((at <= until) if after is not None else at.isNull() | (at <= until))
            rows = rows.select(canonical_id(field).alias("key"), "created_at").join(broadcast_if_small(library), "key", "left_anti")
            made.append(orphans.Reference(rows, table, field, F.col("key"), at))
        return made

    artifacts, listings = load(spark, d, "artifacts"), load(spark, d, "artifact_snapshots")
    key = canonical_id("function_id")
    return orphans.track(references, (listings, key, "scan_no", "taken_at"), (artifacts, key, F.col("created_at")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The distinct orphan references per table, field and month."""
    return orphans.report(orphan_state(spark, d)).withColumnRenamed("key", "function_id").select("src_table", "src_field", "ref_month", "function_id", "orphan_kind")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of orphans per table, field, month and kind."""
    return orphans.counts(orphan_state(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_tables, p4_found, p4_values, p5_found, p5_paths, p5_descendants, p5_cycle_paths, p5_cycle_descendants, p6_found, p6_counts)}


def _canonical_sql(c: str) -> str:
    return rf"regexp_replace(replace(trim({c}, ' ' || chr(9)), '\', '/'), '^(\./)+', '')"


def _normal_sql(c: str) -> str:
    return f"lower(trim({c}, ' ' || chr(9) || chr(13) || chr(10)))"


_CALLS_SQL = f"""
library AS (SELECT {_canonical_sql("function_id")} AS fn FROM library_functions WHERE function_id IS NOT NULL),
edges AS (
  SELECT {_canonical_sql("caller_id")} AS caller, {_canonical_sql("callee_id")} AS callee, created_at FROM dependencies
  WHERE caller_id IS NOT NULL AND callee_id IS NOT NULL),
calls AS (SELECT * FROM edges WHERE caller NOT IN (FROM library) AND callee NOT IN (FROM library)),
parents AS (
  SELECT callee AS node, caller AS parent FROM calls
  QUALIFY row_number() OVER (PARTITION BY callee ORDER BY created_at ASC NULLS LAST, caller) = 1),
nodes AS (SELECT caller AS node FROM calls UNION SELECT callee FROM calls),
linked AS (SELECT node, parent FROM nodes LEFT JOIN parents USING (node)),
climb AS (
  SELECT node, node AS top, [node] AS path, false AS looped FROM linked
  UNION ALL
  SELECT c.node, l.parent, list_append(c.path, l.parent), list_contains(c.path, l.parent)
  FROM climb c JOIN linked l ON l.node = c.top WHERE l.parent IS NOT NULL AND NOT c.looped),
ended AS (
  SELECT c.node, c.top, c.path, c.looped FROM climb c LEFT JOIN linked l ON l.node = c.top WHERE c.looped OR l.parent IS NULL)
"""

_P4_SQL = f"""
WITH rows_ AS (
  SELECT 'artifacts' AS src_table, scan_no, {_canonical_sql("function_id")} AS function_id, {_normal_sql("code_hash")} AS v, updated_at FROM artifact_snapshots
  UNION ALL
  SELECT 'queue', scan_no, {_canonical_sql("function_id")}, {_normal_sql("reason")}, updated_at FROM queue_snapshots),
scans AS (
  SELECT src_table, scan_no, lag(scan_no) OVER (PARTITION BY src_table ORDER BY scan_no) AS prior
  FROM (SELECT DISTINCT src_table, scan_no FROM rows_ WHERE scan_no IS NOT NULL)),
best AS (
  SELECT src_table, scan_no, function_id, v FROM rows_ WHERE function_id IS NOT NULL AND scan_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src_table, scan_no, function_id ORDER BY updated_at DESC NULLS LAST) = 1),
now_ AS (SELECT b.*, s.prior FROM best b JOIN scans s USING (src_table, scan_no) WHERE s.prior IS NOT NULL),
old AS (SELECT b.src_table, s.scan_no, b.function_id, b.v FROM best b JOIN scans s ON s.src_table = b.src_table AND s.prior = b.scan_no)
SELECT src_table, CAST(scan_no AS INTEGER) AS scan_no, function_id,
  CASE WHEN o.hit IS NULL THEN 'added' WHEN n.hit IS NULL THEN 'removed' ELSE 'changed' END AS change_type, o.v AS old_value, n.v AS new_value
FROM (SELECT *, 1 AS hit FROM now_) n FULL JOIN (SELECT *, 1 AS hit FROM old) o USING (src_table, scan_no, function_id)
WHERE o.hit IS NULL OR n.hit IS NULL OR n.v IS DISTINCT FROM o.v
"""

_P6_ROWS_SQL = f"""
library AS (SELECT {_canonical_sql("function_id")} AS fn FROM library_functions WHERE function_id IS NOT NULL),
refs AS (
  SELECT 'dependencies' AS src_table, 'caller_id' AS src_field, {_canonical_sql("caller_id")} AS k, created_at FROM dependencies
  UNION ALL SELECT 'dependencies', 'callee_id', {_canonical_sql("callee_id")}, created_at FROM dependencies
  UNION ALL SELECT 'learning_history', 'function_id', {_canonical_sql("function_id")}, created_at FROM learning_history),
parents AS (SELECT {_canonical_sql("function_id")} AS k, min(created_at) AS since FROM artifacts WHERE function_id IS NOT NULL GROUP BY 1),
listed AS (SELECT DISTINCT {_canonical_sql("function_id")} AS k FROM artifact_snapshots WHERE function_id IS NOT NULL),
found AS (
  SELECT DISTINCT src_table, src_field, coalesce(strftime(r.created_at, '%Y-%m'), 'unknown') AS ref_month, r.k AS function_id,
    CASE WHEN p.k IS NOT NULL THEN CASE WHEN p.since > r.created_at THEN 'late' END
         WHEN l.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS orphan_kind
  FROM refs r LEFT JOIN parents p ON p.k = r.k LEFT JOIN listed l ON l.k = r.k
  WHERE r.k IS NOT NULL AND r.k NOT IN (FROM library))
"""

_P1_SQL = f"""
WITH cur AS (
  SELECT {_canonical_sql("function_id")} AS function_id, contract_json AS j FROM contracts WHERE function_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_canonical_sql("function_id")} ORDER BY updated_at DESC NULLS LAST) = 1),
valid AS (SELECT function_id, CASE WHEN json_type(j) = 'VARCHAR' THEN j->>'$' ELSE j END AS j FROM (SELECT * FROM cur WHERE j IS NOT NULL AND json_valid(j))),
docs AS (SELECT function_id, j FROM (SELECT * FROM valid WHERE json_valid(j)) WHERE json_type(j) = 'OBJECT'),
tree AS (SELECT d.function_id, t.fullkey AS p, t.type AS kind FROM docs d, json_tree(d.j::JSON) t),
single AS (SELECT function_id, p AS top FROM tree WHERE kind = 'OBJECT' AND p IN ('$.invariants', '$.io_examples')),
items AS (
  SELECT t.function_id, CASE WHEN s.top IS NULL THEN t.p ELSE s.top || '[0]' || substr(t.p, length(s.top) + 1) END AS p
  FROM tree t LEFT JOIN single s ON s.function_id = t.function_id AND (t.p = s.top OR starts_with(t.p, s.top || '.'))
  WHERE t.kind = 'OBJECT'),
objects AS (SELECT * FROM items WHERE ends_with(p, ']'))
SELECT n.function_id, coalesce(arg_max(a.p, length(a.p)), '$') AS parent_path, n.p AS node_path
FROM objects n LEFT JOIN objects a ON a.function_id = n.function_id AND starts_with(n.p, a.p || '.') GROUP BY n.function_id, n.p
"""

# labels are the names without indexes; a label has a table if it repeats, has several parents or is its own parent
_P1_TABLES_SQL = _P1_SQL[: _P1_SQL.index("items AS (")] + r"""
nodes AS (
  SELECT t.function_id, t.kind, CASE WHEN s.top IS NULL THEN t.p ELSE s.top || '[0]' || substr(t.p, length(s.top) + 1) END AS p
  FROM tree t LEFT JOIN single s ON s.function_id = t.function_id AND (t.p = s.top OR starts_with(t.p, s.top || '.'))
  UNION ALL SELECT function_id, 'ARRAY', top FROM single),
named AS (
  SELECT *, ends_with(p, ']') AS in_list, regexp_extract(p, '([^.\[]+)(\[\d+\])*$', 1) AS label,
    regexp_extract(regexp_replace(p, '\.[^.\[]+(\[\d+\])*$', ''), '([^.\[]+)(\[\d+\])*$', 1) AS above FROM nodes),
own AS (
  SELECT label FROM named WHERE p <> '$' AND (kind = 'OBJECT' OR in_list) GROUP BY label
  HAVING bool_or(in_list) OR count(DISTINCT above) > 1 OR bool_or(above = label)),
rows_ AS (SELECT function_id, p, CASE WHEN p = '$' THEN 'contracts' ELSE label END AS table_name FROM named WHERE kind = 'OBJECT' AND (p = '$' OR label IN (FROM own))),
fields AS (
  SELECT n.function_id, n.p, max(length(r.p)) AS n_row FROM named n JOIN rows_ r ON r.function_id = n.function_id AND starts_with(n.p, r.p || '.')
  WHERE n.p <> '$' AND NOT n.in_list GROUP BY ALL),
filled AS (SELECT r.table_name, r.function_id, r.p, substr(f.p, n_row + 2) AS column_name FROM fields f JOIN rows_ r ON r.function_id = f.function_id AND r.p = left(f.p, n_row))
SELECT table_name, column_name, count(*) AS n_rows FROM (
  SELECT r.table_name, f.column_name FROM rows_ r LEFT JOIN filled f ON f.function_id = r.function_id AND f.p = r.p
  UNION ALL SELECT label, 'value' FROM named WHERE in_list AND kind <> 'OBJECT') GROUP BY ALL
"""

SQL: dict[str, str] = {
    "p1_found": _P1_SQL,
    "p1_tables": _P1_TABLES_SQL,
    "p4_found": f"SELECT src_table, scan_no, function_id, change_type FROM ({_P4_SQL})",
    "p4_values": f"SELECT scan_no, function_id, change_type, old_value, new_value FROM ({_P4_SQL}) WHERE src_table = 'artifacts'",
    "p5_descendants": f"""
WITH RECURSIVE {_CALLS_SQL},
ups AS (SELECT node, unnest(path) AS up, generate_subscripts(path, 1) - 1 AS distance FROM ended WHERE NOT looped)
SELECT up AS function_id, node AS descendant_id, CAST(distance AS INTEGER) AS distance FROM ups WHERE distance > 0""",
    "p5_found": f"""
WITH RECURSIVE {_CALLS_SQL}
SELECT node AS function_id,
  CASE WHEN looped THEN list_min(list_slice(path, list_position(path, top), len(path))) ELSE top END AS root_id,
  CAST(CASE WHEN looped THEN -1 ELSE len(path) - 1 END AS INTEGER) AS tree_depth
FROM ended""",
    "p5_paths": f"""
WITH RECURSIVE {_CALLS_SQL},
in_cycle AS (SELECT node FROM ended WHERE looped AND top = node),
below AS (
  SELECT a.anc AS node, count(*) AS n FROM (SELECT e.node AS desc_, unnest(e.path[2:]) AS anc FROM ended e WHERE NOT e.looped
    UNION ALL
    SELECT node, unnest(hung) FROM (SELECT e.node, [x FOR x IN e.path[2:list_position(e.path, e.top)]] AS hung FROM ended e
      WHERE e.looped AND e.node NOT IN (FROM in_cycle))) a GROUP BY 1)
SELECT e.node AS function_id, CASE WHEN NOT looped THEN array_to_string(list_reverse(path), ' > ') END AS call_path,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n_descendants, e.node IN (FROM in_cycle) AS in_cycle
FROM ended e LEFT JOIN below b USING (node)""",
    "p6_found": f"WITH {_P6_ROWS_SQL} SELECT * FROM found WHERE orphan_kind IS NOT NULL",
    "p6_counts": f"""
WITH {_P6_ROWS_SQL}
SELECT src_table, src_field, ref_month, orphan_kind, count(*) AS n_keys FROM found WHERE orphan_kind IS NOT NULL GROUP BY ALL""",
}
