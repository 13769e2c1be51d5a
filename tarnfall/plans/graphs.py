"""Queries on graphs, multi-hop search, entity edits and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnfall.operators import graph as G
from tarnfall.operators import multihop as H
from tarnfall.sources.tables import staging_root, table
from tarnfall.streaming import queries as S

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _edges(spark, folder):
    return table(spark, folder, "graph_edge", "id", "source", "target").filter("source <> '' and target <> ''").distinct()


_SEED = "(SELECT min(source) AS seed FROM graph_edge WHERE source <> '')"
_REACH = f"""WITH RECURSIVE e AS (SELECT source AS a, target AS b FROM graph_edge WHERE source <> '' AND target <> '' UNION SELECT target, source FROM graph_edge WHERE source <> '' AND target <> ''),
r AS (SELECT seed AS node, 0 AS hop FROM {_SEED} UNION SELECT e.b, r.hop + 1 FROM r JOIN e ON r.node = e.a WHERE r.hop < %d), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY node)
"""


def _seed(spark, folder):
    return _edges(spark, folder).agg(F.min("source").alias("seed"))


_WALK = """WITH RECURSIVE n AS (SELECT id, max(node_type) AS kind, max(CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.created_time') END) AS t FROM graph_node GROUP BY id),
ok AS (SELECT id FROM n WHERE kind IN ('Event', 'Entity') AND (t IS NULL OR t BETWEEN '2026-01' AND '2026-07')),
w AS (SELECT DISTINCT source AS a, target AS b FROM graph_edge WHERE edge_type = 'EventEntity' AND coalesce(json_extract_string(properties, '$.confidence')::DOUBLE, 0) >= 0.4),
e AS (SELECT a, b FROM w UNION SELECT b, a FROM w), s AS (SELECT min(g.source) AS id FROM graph_edge g JOIN ok ON g.source = ok.id),
r AS (SELECT id AS node, 0 AS hop FROM s UNION SELECT e.b, r.hop + 1 FROM r JOIN e ON r.node = e.a JOIN ok ON ok.id = e.b WHERE r.hop < 3)
SELECT node, min(hop) AS hop FROM r GROUP BY node"""


def _walk(spark, folder, **limits):
    nodes, edges = table(spark, folder, "graph_node", "id", "node_type", "properties"), table(spark, folder, "graph_edge", "id", "source", "target", "edge_type", "properties")
    period = ("2026-01", "2026-07")
    t = F.get_json_object("properties", "$.created_time")
    good = nodes.groupBy("id").agg(F.max(t).alias("t")).filter(F.col("t").isNull() | F.col("t").between(*period))
    root = edges.join(good.select(F.col("id").alias("source")), "source", "left_semi").agg(F.min("source")).first()[0]
    return G.traverse(nodes, edges, root, 3, "both", ["EventEntity"], 0.4, ["Event", "Entity"], period, **limits)


@query(_WALK)
def g1_filtered_reach(spark, folder):
    """Three steps by edges of one type and weight over nodes of a period, from the first such node with an edge."""
    return _walk(spark, folder, max_nodes=None, max_edges=None)


@query()
def g1_limited(spark, folder):
    """The same, with the usual limits of 1,000 nodes and 5,000 edges."""
    return _walk(spark, folder)


@query("""SELECT DISTINCT e.id FROM graph_edge e WHERE edge_type = 'EventEntity' AND coalesce(json_extract_string(properties, '$.confidence')::DOUBLE, 0) >= 0.5
AND source IN (SELECT id FROM graph_node WHERE node_type = 'Event') AND target IN (SELECT id FROM graph_node WHERE coalesce(CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.created_time') END, '2026-03') BETWEEN '2026-02' AND '2026-05')""")
def f12_five_filters(spark, folder):
    """Edges that go out of an event, of one type, heavy enough, to a node of a period."""
    n, e = table(spark, folder, "graph_node", "id", "node_type", "properties"), table(spark, folder, "graph_edge", "id", "source", "target", "edge_type", "properties")
    heavy = e.filter((F.col("edge_type") == "EventEntity") & (F.coalesce(F.get_json_object("properties", "$.confidence").cast("double"), F.lit(0.0)) >= 0.5))
    t = F.get_json_object("properties", "$.created_time")
    ends = n.filter(t.isNull() | t.between("2026-02", "2026-05")).select(F.col("id").alias("target"))
    return heavy.join(n.filter("node_type = 'Event'").select(F.col("id").alias("source")), "source", "left_semi").join(ends, "target", "left_semi").select("id").distinct()


@query(_REACH % 2 + "SELECT node, hop FROM m WHERE hop > 0")
def g2_neighbours(spark, folder):
    return G.reach(G.both_ways(_edges(spark, folder)).select("a", "b").distinct(), _seed(spark, folder), 2).filter("hop > 0").select("node", "hop")


@query(_REACH % 2 + "SELECT DISTINCT id, source, target FROM graph_edge WHERE source IN (SELECT node FROM m) AND target IN (SELECT node FROM m)")
def g3_subgraph(spark, folder):
    e = _edges(spark, folder)
    return G.induced_edges(e, G.reach(G.both_ways(e).select("a", "b").distinct(), _seed(spark, folder), 2))


@query("SELECT a AS node, count(DISTINCT id) AS edges FROM (SELECT id, source AS a FROM graph_edge WHERE source <> '' AND target <> '' UNION ALL SELECT id, target FROM graph_edge WHERE source <> '' AND target <> '') GROUP BY a")
def g4_incident_edges(spark, folder):
    return G.both_ways(_edges(spark, folder)).groupBy(F.col("a").alias("node")).agg(F.count_distinct("id").alias("edges"))


@query("SELECT DISTINCT id FROM graph_edge WHERE source IN (SELECT id FROM graph_node WHERE node_type = 'Event') AND target IN (SELECT id FROM graph_node WHERE node_type = 'Event' OR node_type = 'Entity')")
def g5_whole_edges(spark, folder):
    n = table(spark, folder, "graph_node", "id", "node_type").distinct()
    e = G.whole_edges(_edges(spark, folder), n.filter("node_type in ('Event', 'Entity')"))
    _, kept = G.remove_nodes(n, e.withColumnRenamed("target", "t").withColumn("target", F.col("source")), n.filter("node_type <> 'Event'"))
    return kept.select("id").distinct()


_LEVELS = """WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS a, id AS b FROM knowledge_event WHERE parent_id <> ''), n AS (SELECT a AS node FROM e UNION SELECT b FROM e),
r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT b FROM e) UNION SELECT e.b, r.level + 1 FROM r JOIN e ON e.a = r.node),
l AS (SELECT n.node, coalesce(max(r.level), -1) AS level FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node)
"""


def _tree_edges(spark, folder):
    return table(spark, folder, "knowledge_event", "id", "parent_id").filter("parent_id <> ''").select(F.col("parent_id").alias("a"), F.col("id").alias("b"))


@query(_LEVELS + "SELECT node, level FROM l")
def g6_topological_levels(spark, folder):
    return G.topological_levels(_tree_edges(spark, folder))


@query(_LEVELS + "SELECT node, level, row_number() OVER (ORDER BY level < 0, level, node) AS position FROM l")
def g6_topological_order(spark, folder):
    """Every event behind its parent, those of cycles appended."""
    return G.topological_order(_tree_edges(spark, folder))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT parent_id AS a, id AS b FROM knowledge_event WHERE parent_id <> ''), r AS (SELECT a AS start, b AS dest FROM e WHERE a IN (SELECT b FROM e) UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.dest),
c AS (SELECT start, dest FROM r WHERE EXISTS (SELECT 1 FROM r q WHERE q.start = r.start AND q.dest = r.start)) SELECT start AS node, least(start, min(dest)) AS cycle FROM c JOIN (SELECT DISTINCT start AS s FROM c) ON dest = s GROUP BY start""")
def g8_cycles(spark, folder):
    """Events whose chain of parents comes back to them, with the smallest of their cycle."""
    return G.cycles(_tree_edges(spark, folder))


_LATEST = "(SELECT id, max(parent_id) AS parent_id, arg_max(upper(status), updated_time) AS status FROM knowledge_event GROUP BY id)"


@query(f"SELECT id FROM {_LATEST} WHERE status = 'PENDING' AND id NOT IN (SELECT c.id FROM {_LATEST} c JOIN {_LATEST} p ON c.parent_id = p.id WHERE p.status <> 'COMPLETED')")
def g7_ready(spark, folder):
    t = table(spark, folder, "knowledge_event", "id", "parent_id", "status", "updated_time").groupBy("id").agg(F.max("parent_id").alias("parent_id"), F.upper(F.max_by("status", "updated_time")).alias("status"))
    edges = t.filter("parent_id <> ''").select(F.col("parent_id").alias("a"), F.col("id").alias("b"))
    return G.ready(t.select("id", "status"), edges, F.col("status") == "PENDING", F.col("status") == "COMPLETED").select("id")


_LINKS = "l AS (SELECT DISTINCT event_id, entity_id FROM event_entity_relation WHERE event_id <> '' AND entity_id <> '')"
_FIRST = "s AS (SELECT min(id) AS entity_id FROM entity WHERE entity_type_id = 'person')"


def _relations(spark, folder):
    return table(spark, folder, "event_entity_relation", "id", "event_id", "entity_id")


def _first(spark, folder):
    return table(spark, folder, "entity", "id", "entity_type_id").filter("entity_type_id = 'person'").agg(F.min("id").alias("entity_id"))


_FIRST_NAME = "(SELECT min(name) FROM entity WHERE id = (SELECT min(id) FROM entity WHERE entity_type_id = 'person'))"


def _first_name(spark, folder) -> str:
    person = table(spark, folder, "entity", "id", "entity_type_id", "name")
    return person.filter("entity_type_id = 'person'").groupBy("id").agg(F.min("name").alias("name")).orderBy("id").first()["name"]


def _kb(spark, folder):
    return table(spark, folder, "knowledge_event", "id", "chunk_id", "created_time"), _relations(spark, folder), table(spark, folder, "entity", "id", "name", "normalized_name")


@query(f"""WITH s AS (SELECT DISTINCT id FROM entity WHERE name = {_FIRST_NAME} OR normalized_name = lower(trim({_FIRST_NAME}))), t AS (SELECT id, max(created_time) AS t FROM knowledge_event GROUP BY id)
SELECT event_id, entity_id, 1.0::DOUBLE AS score, 1 AS hop FROM (SELECT DISTINCT r.event_id, r.entity_id, t.t FROM event_entity_relation r JOIN s ON r.entity_id = s.id JOIN t ON t.id = r.event_id ORDER BY t.t DESC, event_id, entity_id LIMIT 10)""")
def m1_atomic(spark, folder):
    """The ten newest events of the entities with one name, a hit for each pair."""
    events, relations, entities = _kb(spark, folder)
    return H.atomic(events, relations, entities, H.match_entities(entities, [_first_name(spark, folder)]))


@query(f"""WITH {_LINKS}, s AS (SELECT DISTINCT id FROM entity WHERE name <> '' AND contains('Who met ' || {_FIRST_NAME} || ' and why?', name)), c AS (SELECT id, max(chunk_id) AS chunk_id FROM knowledge_event GROUP BY id)
SELECT DISTINCT l.event_id, 1 AS hop, 1.0::DOUBLE AS score, c.chunk_id FROM l JOIN s ON l.entity_id = s.id JOIN c ON c.id = l.event_id ORDER BY l.event_id LIMIT 10""")
def m7_search(spark, folder):
    """The eight steps for a question that names a person."""
    return H.search(f"Who met {_first_name(spark, folder)} and why?", *_kb(spark, folder))[0].select("event_id", "hop", "score", "chunk_id")


@query()
def m7_trace(spark, folder):
    """What each of the eight steps did."""
    trace = H.search(f"Who met {_first_name(spark, folder)} and why?", *_kb(spark, folder))[1]
    return spark.createDataFrame([(t,) for t in trace], "step string")


@query("SELECT DISTINCT event_id FROM event_entity_relation WHERE event_id <> '' AND entity_id IN (SELECT id FROM entity WHERE entity_type_id = 'organization')")
def j3_subgraph(spark, folder):
    """The events of many entities at once, each once."""
    n = table(spark, folder, "entity", "id", "entity_type_id").filter("entity_type_id = 'organization'").select(F.col("id").alias("entity_id"))
    return H.events_of(_relations(spark, folder), n)


@query(f"""WITH RECURSIVE {_LINKS}, {_FIRST}, r AS (SELECT l.event_id, 1 AS hop FROM l JOIN s USING (entity_id) UNION SELECT b.event_id, r.hop + 1 FROM r JOIN l a ON a.event_id = r.event_id JOIN l b ON b.entity_id = a.entity_id WHERE r.hop < 2)
SELECT event_id, min(hop) AS hop, round(1 / min(hop), 6) AS score FROM r GROUP BY event_id""")
def m2_multi(spark, folder):
    """Two hops from one person, without the limits on rows and entities."""
    return H.expand(_relations(spark, folder), _first(spark, folder), 2, 1 << 60, 1 << 60)[0].select("event_id", "hop", "score")


@query(f"WITH {_LINKS}, {_FIRST} SELECT event_id, 1 AS hop FROM l JOIN s USING (entity_id)")
def m3_multi1(spark, folder):
    return H.expand(_relations(spark, folder), _first(spark, folder), 1)[0].select("event_id", "hop")


@query()
def m4_chosen_hops(spark, folder):
    return H.chosen_hops(_relations(spark, folder), _first(spark, folder))


@query(f"""WITH RECURSIVE {_LINKS}, s AS (SELECT DISTINCT id AS entity_id FROM entity WHERE contains(name, {_FIRST_NAME}) OR normalized_name = lower(trim({_FIRST_NAME}))),
r AS (SELECT DISTINCT l.event_id, 1 AS hop FROM l JOIN s USING (entity_id) UNION SELECT b.event_id, r.hop + 1 FROM r JOIN l a ON a.event_id = r.event_id JOIN l b ON b.entity_id = a.entity_id WHERE r.hop < 1)
SELECT event_id, min(hop) AS hop, round(1 / min(hop), 6) AS score, 'loose' AS strategy FROM r WHERE event_id IN (SELECT id FROM knowledge_event) GROUP BY event_id""")
def m5_loose_search(spark, folder):
    return H.loose_search(*_kb(spark, folder), _first_name(spark, folder), 1)


@query()
def m6_limited(spark, folder):
    """Three hops with the usual limits; ``warning`` names the limit that stopped it."""
    found, warning = H.expand(_relations(spark, folder), _first(spark, folder))
    return found.select("event_id", "hop", F.size("path").alias("steps"), F.lit(warning).alias("warning"))


@query(f"WITH {_LINKS}, {_FIRST} SELECT event_id, 1.0::DOUBLE AS score FROM l JOIN s USING (entity_id) ORDER BY event_id LIMIT 10")
def m8_rerank(spark, folder):
    return H.rerank(H.expand(_relations(spark, folder), _first(spark, folder), 1)[0].select("event_id", F.col("score").cast("double").alias("score")))


@query()
def m9_closed_hyperedges(spark, folder):
    """All closed hyperedges of the real relations."""
    return H.closed_hyperedges(_relations(spark, folder)).select("id", F.array_join("events", ",").alias("events"), F.array_join("entities", ",").alias("entities"))


@query()
def m11_activated_events(spark, folder):
    """The events of all closed hyperedges that hold the entity with the most events."""
    r = _relations(spark, folder)
    hub = r.filter("entity_id <> '' and event_id <> ''").distinct().groupBy("entity_id").agg(F.count_distinct("event_id").alias("n")).orderBy(F.desc("n"), "entity_id").first()["entity_id"]
    return H.activated_events(H.closed_hyperedges(r), [hub])


@query("SELECT DISTINCT id, event_id, CASE WHEN entity_id = (SELECT min(entity_id) FROM event_entity_relation WHERE entity_id <> '') THEN (SELECT max(entity_id) FROM event_entity_relation) ELSE entity_id END AS entity_id FROM event_entity_relation")
def m12_merge(spark, folder):
    r = _relations(spark, folder)
    lo, hi = r.filter("entity_id <> ''").agg(F.min("entity_id"), F.max("entity_id")).first()
    return H.merge_entities(r, lo, hi).select("id", "event_id", "entity_id").distinct()


@query("""WITH r AS (SELECT DISTINCT id, event_id, entity_id FROM event_entity_relation), x AS (SELECT *, row_number() OVER (ORDER BY event_id NULLS FIRST, id) AS n FROM r WHERE entity_id = (SELECT min(entity_id) FROM r WHERE entity_id <> ''))
SELECT id, CASE (n - 1) % 2 WHEN 0 THEN 'x' ELSE 'y' END AS entity_id FROM x UNION ALL SELECT id, entity_id FROM r WHERE entity_id IS NULL OR entity_id <> (SELECT min(entity_id) FROM r WHERE entity_id <> '')""")
def m13_split(spark, folder):
    r = _relations(spark, folder).distinct()
    return H.split_entity(r, r.filter("entity_id <> ''").agg(F.min("entity_id")).first()[0], ["x", "y"]).select("id", "entity_id")


@query("SELECT DISTINCT id, replace(title, 'queue', 'line') AS title, md5(replace(content, 'queue', 'line')) AS digest FROM knowledge_event")
def m14_rename(spark, folder):
    e = table(spark, folder, "knowledge_event", "id", "title", "summary", "content")
    return H.rename_entity(e, "queue", "line").select("id", "title", F.md5("content").alias("digest")).distinct()


_MENTIONS = "m AS (SELECT DISTINCT r.id, r.event_id, coalesce(e.entity_type_id, 'other') AS type, lower(trim(e.name)) AS normal, e.id AS own FROM event_entity_relation r JOIN entity e ON e.id = r.entity_id)"


def _saved(spark, folder):
    r = _relations(spark, folder).distinct()
    n = table(spark, folder, "entity", "id", "entity_type_id", "name").distinct()
    m = r.join(n.select(F.col("id").alias("entity_id"), F.coalesce("entity_type_id", F.lit("other")).alias("type"), F.lower(F.trim("name")).alias("normal")), "entity_id")
    return H.saved_mentions(m.select("id", "event_id", "type", "normal", F.col("entity_id").alias("own")).distinct())


@query(f"WITH {_MENTIONS} SELECT id, event_id, min(own) OVER (PARTITION BY type, normal) AS entity_id FROM m")
def i3_saved_relations(spark, folder):
    """Every mention as a relation of the one entity of its type and normalized name, none deduplicated."""
    return _saved(spark, folder)[0].select("id", "event_id", "entity_id")


@query(f"WITH {_MENTIONS} SELECT type, normal, min(own) AS entity_id, count(*) AS mentions, count(*) - 1 AS deduplicated FROM m GROUP BY type, normal")
def i3_saved_entities(spark, folder):
    return _saved(spark, folder)[1]


def _stream(spark, folder):
    path = f"{folder}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _places(spark):
    root = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    return f"{root}/checkpoint", f"{root}/sink"


@query("SELECT user_id, props AS message, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY user_id, props")
def x6_running_errors(spark, folder):
    s = S.running_errors(_stream(spark, folder).withColumnRenamed("props", "message"), "event_type", ["user_id", "message"], "ts")
    return S.run_once(spark, s, *_places(spark), mode="complete")


@query("SELECT date_trunc('hour', ts) AS started, event_type, count(*) AS records, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x5_windowed_usage(spark, folder):
    s = S.windowed_usage(_stream(spark, folder), "ts", "event_type", "value")
    return S.run_once(spark, s, *_places(spark), mode="complete").withColumn("total", F.round("total", 4))


@query("SELECT id, arg_max(status, {'u': updated_time, 'a': status}) AS status, max(updated_time) AS updated_time FROM knowledge_event GROUP BY id")
def x8_last_writer(spark, folder):
    """Of every event the status that was written last; of equal times the greater one."""
    return S.last_writer_wins(table(spark, folder, "knowledge_event", "id", "status", "updated_time"), "id", "status", "updated_time", "status")


@query("""WITH g AS (SELECT user_id, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 7200000000)::INTEGER, 0) AS x FROM events), s AS (SELECT user_id, ts, sum(x) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
w AS (SELECT user_id, min(ts) AS started, max(ts) + to_hours(2) AS ended, count(*) AS events FROM s GROUP BY user_id, k) SELECT * FROM w WHERE ended <= (SELECT max(ts) FROM events) - to_minutes(10)""")
def x7_idle_sessions(spark, folder):
    """Sessions that ended with two hours of silence, as a stream gives them out; those that may go on aren't there."""
    s = S.idle_sessions(_stream(spark, folder), "ts", "user_id")
    return S.run_once(spark, s, *_places(spark))


@query("SELECT user_id, count(*) AS events, max(ts) AS last_ts FROM events GROUP BY user_id")
def x1_cursor_batches(spark, folder):
    """Batches applied one after the other, each under its number; a batch that fails to be read three times is passed over."""
    checkpoint, sink = _places(spark)
    S.cursor_batches(_stream(spark, folder), checkpoint, S.numbered_writer(sink), most_failures=3)
    return spark.read.parquet(f"{sink}/*").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
