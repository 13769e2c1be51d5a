"""Queries of the general problems: nested records, orphan references, hierarchies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.operators import hierarchy, nested, orphans
from tarnfall.sources.tables import table

NESTED_FIELDS = {"memory_l0_raw": "payload", "memory_l3_dynamic": "payload", "graph_node": "properties"}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        nested.element_links(table(spark, folder, name, "id", field), "id", field).select(F.lit(name).alias("table_name"), "record_id", "node_path", "parent_path")
        for name, field in NESTED_FIELDS.items()
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def p2_node_types(spark: SparkSession, folder: str) -> DataFrame:
    """Per table and node type: nodes, records, deepest nesting, and linked parents by containment."""
    parts = [nested.node_table(table(spark, folder, name, "id", field).distinct(), "id", field).withColumn("table_name", F.lit(name)) for name, field in NESTED_FIELDS.items()]
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("table_name", "node_type")
        .agg(F.count(F.lit(1)).alias("nodes"), F.count("parent_path").alias("elements"), F.max("depth").alias("max_depth"))
    )


def p2_tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls as a flat table, linked to the messages that made them."""
    nodes = nested.node_table(table(spark, folder, "memory_l0_raw", "id", "payload").distinct(), "id", "payload")
    calls = nested.type_table(nodes, "$.messages[].tool_calls[]", ["id", "name"])
    messages = nested.type_table(nodes, "$.messages[]", ["role"])
    return nested.contained_in(calls, messages).select("record_id", "node_path", "id", "name", "parent_pre")


def _references(spark: SparkSession, folder: str) -> DataFrame:
    relation = table(spark, folder, "event_entity_relation", "id", "event_id", "entity_id", "created_time")
    edge = table(spark, folder, "graph_edge", "id", "source", "target", "properties")
    month = F.substring(F.get_json_object("properties", "$.created_time"), 1, 7)
    return orphans.references(relation, "event_entity_relation", "id", {"event_id": "event", "entity_id": "entity"}, F.col("created_time"), F.date_format("created_time", "yyyy-MM")).unionByName(
        orphans.references(edge, "graph_edge", "id", {"source": "node", "target": "node"}, None, month)
    )


def _states(spark: SparkSession, folder: str) -> DataFrame:
    event = table(spark, folder, "knowledge_event", "id", "status", "created_time", "updated_time")
    entity = table(spark, folder, "entity", "id", "created_time", "updated_time")
    node = table(spark, folder, "graph_node", "id", "properties")
    one = F.lit(None).cast("timestamp")
    return (
        orphans.target_state(event, "event", "id", F.upper(F.trim("status")) == "DELETED", F.col("created_time"), F.col("updated_time"))
        .unionByName(orphans.target_state(entity, "entity", "id", F.lit(False), F.col("created_time"), F.col("updated_time")))
        .unionByName(orphans.target_state(node, "node", "id", F.get_json_object(_object_text("properties"), "$.deleted_time").isNotNull(), None, one))
    )


def _object_text(column: str) -> F.Column:
    """JSON text; a text that holds a JSON text (an object stored as a string) is opened once."""
    return F.when(F.col(column).startswith('"'), F.from_json(F.concat(F.lit('{"x":'), F.col(column), F.lit("}")), "x string")["x"]).otherwise(F.col(column))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_references(_references(spark, folder), _states(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("table_name", "row_id", "field_name", "reason").distinct()


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, folder))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.parent_links(table(spark, folder, "knowledge_event", "id", "parent_id", "updated_time"), "id", "parent_id", F.col("updated_time"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, folder)).filter("parent is not null").select(F.col("id").alias("event_id"), "root_id", "depth")


def p7_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every event with root, depth, subtree size and its path as text."""
    return hierarchy.resolve(_links(spark, folder), with_path=True).select(F.col("id").alias("event_id"), "root_id", "depth", F.when(F.col("depth") >= 0, F.col("subtree_size")).alias("subtree_size"), F.array_join("path", "/").alias("path"))


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(_links(spark, folder), with_path=True))


QUERIES = {f.__name__: f for f in (p2_found, p2_node_types, p2_tool_calls, p3_found, p3_counts, p7_found, p7_paths, p7_descendants)}

_ORPHANS = """
WITH ev AS (SELECT id, upper(trim(arg_max(status, updated_time))) AS status, max(created_time) AS created FROM knowledge_event GROUP BY id),
en AS (SELECT id, max(created_time) AS created FROM entity GROUP BY id),
nd AS (SELECT id, bool_or(coalesce(CASE WHEN json_valid(t) THEN json_extract_string(t, '$.deleted_time') END IS NOT NULL, false)) AS deleted
       FROM (SELECT id, CASE WHEN starts_with(properties, '"') AND json_valid(properties) THEN json_extract_string(properties, '$') ELSE properties END AS t FROM graph_node) GROUP BY id),
rel AS (SELECT 'event_entity_relation' AS table_name, r.id AS row_id, f.field_name, f.key, r.created_time AS ref_time, strftime(r.created_time, '%Y-%m') AS period
        FROM event_entity_relation r, LATERAL (SELECT 'event_id' AS field_name, r.event_id AS key UNION ALL SELECT 'entity_id', r.entity_id) f),
edg AS (SELECT 'graph_edge' AS table_name, e.id AS row_id, f.field_name, f.key,
        substr(CASE WHEN json_valid(e.properties) THEN json_extract_string(e.properties, '$.created_time') END, 1, 7) AS period
        FROM graph_edge e, LATERAL (SELECT 'source' AS field_name, e.source AS key UNION ALL SELECT 'target', e.target) f),
found AS (
  SELECT table_name, row_id, field_name, rel.key, period, CASE
    WHEN field_name = 'event_id' AND ev.id IS NULL THEN 'missing' WHEN field_name = 'entity_id' AND en.id IS NULL THEN 'missing'
    WHEN field_name = 'event_id' AND ev.status = 'DELETED' THEN 'deleted'
    WHEN field_name = 'event_id' AND ev.created > ref_time THEN 'late' WHEN field_name = 'entity_id' AND en.created > ref_time THEN 'late' END AS reason
  FROM rel LEFT JOIN ev ON rel.key = ev.id AND field_name = 'event_id' LEFT JOIN en ON rel.key = en.id AND field_name = 'entity_id' WHERE rel.key <> ''
  UNION ALL
  SELECT table_name, row_id, field_name, key, period, CASE WHEN nd.id IS NULL THEN 'missing' WHEN nd.deleted THEN 'deleted' END
  FROM edg LEFT JOIN nd ON edg.key = nd.id WHERE key <> '')
"""

_TREE = """
WITH RECURSIVE e AS (SELECT id, nullif(arg_max(coalesce(parent_id, ''), updated_time), '') AS parent FROM knowledge_event WHERE id IS NOT NULL GROUP BY id),
t AS (SELECT e.id, e.parent, p.id AS up FROM e LEFT JOIN e p ON e.parent = p.id),
r AS (SELECT id, id AS root, 0::BIGINT AS depth, [id] AS path FROM t WHERE up IS NULL
      UNION ALL SELECT t.id, r.root, r.depth + 1, list_append(r.path, t.id) FROM r JOIN t ON t.up = r.id)
"""

ORACLE = {
    "p3_found": _ORPHANS + "SELECT DISTINCT table_name, row_id, field_name, reason FROM found WHERE reason IS NOT NULL",
    "p3_counts": _ORPHANS + "SELECT table_name, field_name, reason, period, count(*) AS orphans FROM (SELECT DISTINCT * FROM found WHERE reason IS NOT NULL) GROUP BY ALL",
    "p7_found": _TREE + "SELECT t.id AS event_id, coalesce(r.root, '') AS root_id, coalesce(r.depth, -1) AS depth FROM t LEFT JOIN r ON t.id = r.id WHERE t.parent IS NOT NULL",
    "p7_paths": _TREE + """, s AS (SELECT a AS id, count(*) AS n FROM (SELECT unnest(path) AS a FROM r) GROUP BY a)
SELECT t.id AS event_id, coalesce(r.root, '') AS root_id, coalesce(r.depth, -1) AS depth, s.n AS subtree_size, array_to_string(r.path, '/') AS path
FROM t LEFT JOIN r ON t.id = r.id LEFT JOIN s ON t.id = s.id""",
    "p7_descendants": _TREE + "SELECT a.a AS ancestor_id, a.id AS descendant_id, a.depth + 1 - a.i AS distance FROM (SELECT id, depth, unnest(path) AS a, generate_subscripts(path, 1) AS i FROM r) a WHERE a.i <= a.depth",
}
