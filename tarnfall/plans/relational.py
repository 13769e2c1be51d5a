"""Queries on filters, joins, aggregates, windows, sorting and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.functions import text as T
from tarnfall.operators import aggregates as A
from tarnfall.operators import relational as R
from tarnfall.operators import windows as W
from tarnfall.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _now(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events", "ts").agg(F.max("ts").alias("now"))


@query("SELECT o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND (lower(c_name) LIKE '%1%' OR lower(c_mktsegment) LIKE '%1%')")
def f1_conjunctive_filter(spark, folder):
    o, c = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    keep = R.every(F.col("o_orderstatus") == "O", F.col("o_totalprice") >= 1000, None)
    return o.filter(keep).join(c.filter(R.contains_any_case("1", "c_name", "c_mktsegment")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority")


@query("SELECT id, 'number' AS how FROM knowledge_event WHERE level = 3 UNION ALL SELECT id, 'text' FROM knowledge_event WHERE contains(lower(title), 'queue') OR contains(lower(content), 'queue')")
def f2_number_or_text(spark, folder):
    e = table(spark, folder, "knowledge_event", "id", "level", "title", "content")
    pick = lambda q, how: e.filter(R.number_or_text(q, "level", "title", "content")).select("id", F.lit(how).alias("how"))
    return pick("#3", "number").unionByName(pick("QUEUE", "text"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND p_size > 10")
def f3_like_any_case(spark, folder):
    return table(spark, folder, "part", "p_partkey", "p_name", "p_size").filter(F.lower("p_name").like("%a%") & (F.col("p_size") > 10)).select("p_partkey")


@query("SELECT id FROM knowledge_event WHERE json_valid(keywords) AND list_contains(CAST(json_extract_string(keywords, '$[*]') AS VARCHAR[]), 'memory')")
def f4_tag_membership(spark, folder):
    return table(spark, folder, "knowledge_event", "id", "keywords").filter(R.has_tag("keywords", "memory")).select("id")


@query("SELECT coalesce(nullif(kb_id, ''), 'ungrouped') AS kb, count(*) AS n FROM documents GROUP BY 1")
def f5_ungrouped(spark, folder):
    d = table(spark, folder, "documents", "kb_id")
    return d.groupBy(F.when(R.blank("kb_id"), "ungrouped").otherwise(F.col("kb_id")).alias("kb")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE lang IS NOT DISTINCT FROM NULL")
def f6_null_safe_equal(spark, folder):
    return table(spark, folder, "documents", "doc_id", "lang").filter(F.col("lang").eqNullSafe(F.lit(None))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN ('chat_export', 'kb_wiki')")
def f7_null_or_not_in(spark, folder):
    return table(spark, folder, "documents", "doc_id", "source").filter(R.null_or_not_in("source", ["chat_export", "kb_wiki"])).select("doc_id")


@query("SELECT DISTINCT id FROM knowledge_event WHERE end_time IS NOT NULL AND end_time < TIMESTAMPTZ '2026-04-01 00:00:00+00'")
def f8_expired(spark, folder):
    return table(spark, folder, "knowledge_event", "id", "end_time").filter(R.expired("end_time", F.lit("2026-04-01").cast("timestamp"))).select("id").distinct()


@query("SELECT doc_id, regexp_matches(lower(text), 'rm -rf|rm -fr|drop table|drop database|truncate|delete from|force push|push --force|push -f|reset --hard|git clean -|mkfs|dd if=|> /dev/') AS destructive, "
       "regexp_matches(lower(text), '取消|放弃|跳过|稍后|暂不|退出|以后再|什么都不|都不选|不需要|cancel|skip|abort|quit|go back|none of|do nothing|nevermind|never mind') AS cancels FROM documents")
def f14_phrases(spark, folder):
    """Texts that would destroy something, and those that decline."""
    d = table(spark, folder, "documents", "doc_id", "text")
    return d.select("doc_id", R.any_phrase("text", R.DESTRUCTIVE).alias("destructive"), R.any_phrase("text", R.CANCELLING).alias("cancels"))


@query("SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 50")
def f15_recent_of_type(spark, folder):
    e = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value").filter("event_type = 'error'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "value")  # a top-k report


@query("""SELECT DISTINCT e.id AS event_id, n.id AS entity_id, n.entity_type_id FROM knowledge_event e JOIN event_entity_relation r ON r.event_id = e.id JOIN entity n ON n.id = r.entity_id
WHERE n.entity_type_id = 'organization' AND e.category = 'incident'""")
def j1_event_entity_join(spark, folder):
    e = table(spark, folder, "knowledge_event", "id", "category").filter("category = 'incident'").select(F.col("id").alias("event_id")).distinct()
    n = table(spark, folder, "entity", "id", "entity_type_id").filter("entity_type_id = 'organization'").select(F.col("id").alias("entity_id"), "entity_type_id").distinct()
    r = table(spark, folder, "event_entity_relation", "event_id", "entity_id").distinct()
    return r.join(e, "event_id").join(n, "entity_id").select("event_id", "entity_id", "entity_type_id")


@query("SELECT DISTINCT event_id FROM event_entity_relation WHERE entity_id IN (SELECT id FROM entity WHERE entity_type_id = 'person')")
def j2_semi_join(spark, folder):
    n = table(spark, folder, "entity", "id", "entity_type_id").filter("entity_type_id = 'person'").select(F.col("id").alias("entity_id"))
    return table(spark, folder, "event_entity_relation", "event_id", "entity_id").join(n, "entity_id", "left_semi").select("event_id").distinct()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j4_not_exists(spark, folder):
    o = table(spark, folder, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'")
    return table(spark, folder, "customer", "c_custkey").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("""SELECT DISTINCT l.id FROM memory_l3_dynamic l WHERE json_valid(l.payload) AND NOT EXISTS (SELECT 1 FROM memory_l0_raw r
WHERE json_valid(r.payload) AND coalesce(json_extract_string(r.payload, '$.conversation_id'), json_extract_string(r.payload, '$.call_id')) = coalesce(json_extract_string(l.payload, '$.episode'), json_extract_string(l.payload, '$.concept')))""")
def j5_not_exists_json(spark, folder):
    key = lambda a, b: F.coalesce(F.get_json_object("payload", a), F.get_json_object("payload", b))
    keep = F.try_parse_json("payload").isNotNull()
    left = table(spark, folder, "memory_l3_dynamic", "id", "payload").filter(keep).select("id", key("$.episode", "$.concept").alias("k"))
    right = table(spark, folder, "memory_l0_raw", "payload").filter(keep).select(key("$.conversation_id", "$.call_id").alias("k")).filter("k is not null").distinct()
    return left.join(right, "k", "left_anti").select("id").distinct()


@query("SELECT DISTINCT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def j6_bridge_distinct(spark, folder):
    c = table(spark, folder, "customer", "c_nationkey").distinct()
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").distinct()


@query("SELECT id, source AS node, target AS far FROM (SELECT DISTINCT id, source, target FROM graph_edge) UNION SELECT id, target, source FROM graph_edge")
def j9_both_directions(spark, folder):
    e = table(spark, folder, "graph_edge", "id", "source", "target")
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("far")), F.struct(F.col("target").alias("node"), F.col("source").alias("far")))
    return e.select("id", F.inline(ends)).distinct()


@query("""SELECT r.id, coalesce(r.relation_type, e.category, 'unknown') AS kind FROM (SELECT DISTINCT id, event_id, relation_type FROM event_entity_relation) r
LEFT JOIN (SELECT id, max(category) AS category FROM knowledge_event GROUP BY id) e ON r.event_id = e.id""")
def j10_fill_from_lookup(spark, folder):
    r = table(spark, folder, "event_entity_relation", "id", "event_id", "relation_type").distinct()
    e = table(spark, folder, "knowledge_event", "id", "category").groupBy(F.col("id").alias("event_id")).agg(F.max("category").alias("category"))
    return r.join(e, "event_id", "left").select("id", F.coalesce("relation_type", "category", F.lit("unknown")).alias("kind"))


@query("""WITH t AS (SELECT DISTINCT kb_id, id, unnest(CAST(json_extract_string(keywords, '$[*]') AS VARCHAR[])) AS tag FROM knowledge_event WHERE json_valid(keywords) AND kb_id IS NOT NULL),
c AS (SELECT kb_id, tag, count(DISTINCT id) AS events FROM t GROUP BY ALL) SELECT kb_id, tag, events, events * (events - 1) // 2 AS links FROM c WHERE events > 1""")
def j12_shared_tags(spark, folder):
    """Events of one base that share a tag: their number and that of their links, which are counted and not made."""
    e = table(spark, folder, "knowledge_event", "kb_id", "id", "keywords").filter("kb_id is not null")
    t = e.select("kb_id", "id", F.explode(F.from_json("keywords", "array<string>")).alias("tag")).distinct()
    c = t.groupBy("kb_id", "tag").agg(F.count(F.lit(1)).alias("events")).filter("events > 1")
    return c.withColumn("links", F.expr("cast(events * (events - 1) div 2 as bigint)"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def a1_count_by_pair(spark, folder):
    return table(spark, folder, "events", "user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


_TRAILING = """WITH a AS (SELECT max(ts) AS now FROM events), p(period, s) AS (VALUES ('minute', 60), ('hour', 3600), ('day', 86400), ('week', 604800), ('month', 2592000), ('all', NULL))
SELECT period, {k} round(sum(value), 4) AS total, count(*) AS records FROM events, a, p WHERE s IS NULL OR epoch_us(ts) >= epoch_us(now) - s * 1000000::BIGINT GROUP BY ALL"""


def _trailing(spark, folder, keys):
    e = table(spark, folder, "events", "ts", "event_type", "value")
    return A.trailing_stats(e, "ts", _now(spark, folder), keys, {"total": F.col("value")}).withColumn("total", F.round("total", 4))


@query(_TRAILING.format(k=""))
def a2_trailing_stats(spark, folder):
    return _trailing(spark, folder, [])


@query(_TRAILING.format(k="event_type,"))
def a3_trailing_stats_by_model(spark, folder):
    return _trailing(spark, folder, ["event_type"])


@query("SELECT user_id, count(*) AS calls, round(sum(value), 4) AS total, max(ts) AS last_call, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def a5_session_roll_up(spark, folder):
    e = table(spark, folder, "events", "user_id", "ts", "event_type", "value")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last_call"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("""WITH a AS (SELECT date_trunc('hour', max(ts)) AS e FROM events), s AS (SELECT e - to_hours(i::INTEGER) AS bucket FROM a, range(24) t(i)), g AS (SELECT date_trunc('hour', ts) AS bucket, sum(value) AS v, count(*) AS c FROM events GROUP BY 1)
SELECT s.bucket, round(coalesce(v, 0), 4) AS value, coalesce(c, 0) AS records FROM s LEFT JOIN g ON s.bucket = g.bucket""")
def a6_hourly_buckets(spark, folder):
    return A.filled_buckets(table(spark, folder, "events", "ts", "value"), "ts", _now(spark, folder), "hour", 24, F.col("value")).withColumn("value", F.round("value", 4))


@query("""SELECT kind, count(*) AS total, count(DISTINCT session_id) AS sessions, round(coalesce(avg(length(payload)), 0), 4) AS mean_size,
count(*) FILTER (ts >= (SELECT max(ts) FROM memory_l0_raw) - 604800) AS last_week FROM (SELECT DISTINCT * FROM memory_l0_raw) GROUP BY kind""")
def a7_memory_stats(spark, folder):
    m = table(spark, folder, "memory_l0_raw").distinct()
    now = table(spark, folder, "memory_l0_raw", "ts").agg(F.max("ts").alias("now"))
    rows = m.crossJoin(F.broadcast(now))  # one row
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_distinct("session_id").alias("sessions"), F.round(F.coalesce(F.avg(F.char_length("payload")), F.lit(0.0)), 4).alias("mean_size"), F.count(F.when(F.col("ts") >= F.col("now") - 604800, 1)).alias("last_week"))


def _terms(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "created_time", "text")
    return d.select("doc_id", "created_time", F.explode(T.all_terms(F.col("text"))).alias("term"))


@query()
def a8_all_terms(spark, folder):
    """As a8_term_frequency, with the words of every script."""
    return _terms(spark, folder).groupBy("term").agg(F.count_distinct("doc_id").alias("documents"), F.min("created_time").alias("first_seen"), F.max("created_time").alias("last_seen"))


@query()
def a8_term_documents(spark, folder):
    """The distinct documents of each term of a8_all_terms, a row each, numbered by first appearance, then id."""
    # parted by term at once, which serves the grouping, too
    t = _terms(spark, folder).repartition("term").groupBy("term", "doc_id").agg(F.min("created_time").alias("first_seen"))
    return t.select("term", "doc_id", F.row_number().over(Window.partitionBy("term").orderBy(F.asc_nulls_last("first_seen"), "doc_id")).alias("place"))


@query("SELECT user_id, props AS message, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE event_type = 'error' GROUP BY user_id, props")
def a9_error_patterns(spark, folder):
    e = table(spark, folder, "events", "user_id", "props", "ts", "event_type").filter("event_type = 'error'")
    return e.groupBy("user_id", F.col("props").alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n = 1")
def a10_best_strategy(spark, folder):
    return A.best_by(table(spark, folder, "events", "event_id", "user_id", "event_type", "value").filter("value is not null"), "user_id", "event_type", "value", "event_id")


_RELATED = "(SELECT DISTINCT * FROM event_entity_relation) WHERE entity_id <> '' AND event_id <> ''"


@query(f"SELECT 'entity' AS side, entity_id AS id, count(DISTINCT event_id) AS others, count(*) AS relations FROM {_RELATED} GROUP BY entity_id UNION ALL SELECT 'event', event_id, count(DISTINCT entity_id), count(*) FROM {_RELATED} GROUP BY event_id")
def a12_both_directions(spark, folder):
    """Of every entity its events, of every event its entities, and the relations of both, counted."""
    r = table(spark, folder, "event_entity_relation").distinct().filter("entity_id <> '' and event_id <> ''")
    ends = F.array(F.struct(F.lit("entity").alias("side"), F.col("entity_id").alias("id"), F.col("event_id").alias("other")), F.struct(F.lit("event").alias("side"), F.col("event_id").alias("id"), F.col("entity_id").alias("other")))
    return r.select(F.inline(ends)).groupBy("side", "id", "other").agg(F.count(F.lit(1)).alias("n")).groupBy("side", "id").agg(F.count(F.lit(1)).alias("others"), F.sum("n").alias("relations"))


@query(f"SELECT entity_id, event_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_id) AS place FROM (SELECT DISTINCT entity_id, event_id FROM {_RELATED})")
def a11_reverse_index(spark, folder):
    """The events of each entity in order, a row each, so that a hub makes no long row."""
    r = table(spark, folder, "event_entity_relation", "entity_id", "event_id").filter("entity_id <> '' and event_id <> ''").distinct()
    return r.select("entity_id", "event_id", F.row_number().over(Window.partitionBy("entity_id").orderBy("event_id")).alias("place"))


@query(f"SELECT count(DISTINCT entity_id) AS entities, count(DISTINCT event_id) AS events, count(*) AS relations FROM {_RELATED}")
def a17_row_counts(spark, folder):
    r = table(spark, folder, "event_entity_relation").distinct().filter("entity_id <> '' and event_id <> ''")
    return r.agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("event_id").alias("events"), F.count(F.lit(1)).alias("relations"))


@query("SELECT kb_id, coalesce(max(level), -1) + 1 AS next FROM knowledge_event GROUP BY kb_id")
def a15_next_number(spark, folder):
    return table(spark, folder, "knowledge_event", "kb_id", "level").groupBy("kb_id").agg((F.coalesce(F.max("level"), F.lit(-1)) + 1).alias("next"))


@query("SELECT id, count(*) AS copies FROM knowledge_event GROUP BY id HAVING count(*) > 1")
def a20_repeated_keys(spark, folder):
    return table(spark, folder, "knowledge_event", "id").groupBy("id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


@query("""WITH m AS (SELECT event_type, avg(value) AS mean, count(value) AS votes FROM events GROUP BY event_type)
SELECT event_type, round(mean, 6) AS mean, votes, row_number() OVER (ORDER BY mean DESC NULLS LAST, event_type) = 1 AS winner FROM m""")
def a21_mean_vote(spark, folder):
    return A.mean_vote(table(spark, folder, "events", "event_type", "value"), "event_type", "value").withColumn("mean", F.round("mean", 6))


_BALLOTS = "(SELECT user_id, event_type, max(value) AS score FROM events GROUP BY ALL)"


@query(f"SELECT event_type, sum(n - r)::BIGINT AS points FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM {_BALLOTS}) GROUP BY event_type")
def a22_borda_vote(spark, folder):
    b = table(spark, folder, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.max("value").alias("score"))
    return A.borda_vote(b, "user_id", "event_type", "score")


@query("""SELECT user_id, passes, verdicts, m = 0 AND passes >= verdicts // 2 + 1 AS majority, m = 0 AND passes = verdicts AS unanimous, m = 0 AND passes >= 3 AS enough FROM
(SELECT user_id, count(*) FILTER (value > 20) AS passes, count(*) AS verdicts, count(*) FILTER (value IS NULL) AS m FROM events GROUP BY user_id)""")
def a23_quorum(spark, folder):
    return A.quorum(table(spark, folder, "events", "user_id", "value"), "user_id", F.col("value") > 20, 3)


@query("SELECT user_id, min(ts) AS started, max(ts) AS ended, arg_max(event_type, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END * 1000000000::BIGINT + event_id) AS status FROM events GROUP BY user_id")
def a24_span_and_status(spark, folder):
    rank = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return table(spark, folder, "events", "user_id", "ts", "event_type", "event_id").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max_by("event_type", F.struct(rank, "event_id")).alias("status"))


@query("SELECT user_id, round(sum(value) FILTER (value > 0), 4) AS total FROM events GROUP BY user_id")
def a25_positive_totals(spark, folder):
    return table(spark, folder, "events", "user_id", "value").groupBy("user_id").agg(F.round(F.sum(F.when(F.col("value") > 0, F.col("value"))), 4).alias("total"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 30")
def w1_keep_newest(spark, folder):
    return W.keep_newest(table(spark, folder, "events", "event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).select("event_id", "user_id")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def w4_numbering(spark, folder):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", F.row_number().over(w).alias("number"))


_COLLAPSED = "(SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type OR b IS NULL)"


@query(f"SELECT event_id FROM {_COLLAPSED}")
def w5_collapse_repeats(spark, folder):
    return W.collapse_repeats(table(spark, folder, "events", "event_id", "user_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id")


_PATTERNS = f"""WITH c AS {_COLLAPSED}, l AS (SELECT user_id, event_type AS e0, lead(event_type, 1) OVER w AS e1, lead(event_type, 2) OVER w AS e2, lead(event_type, 3) OVER w AS e3, lead(event_type, 4) OVER w AS e4 FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, [e0, e1] AS p FROM l WHERE e1 IS NOT NULL UNION ALL SELECT user_id, [e0, e1, e2] FROM l WHERE e2 IS NOT NULL UNION ALL SELECT user_id, [e0, e1, e2, e3] FROM l WHERE e3 IS NOT NULL UNION ALL SELECT user_id, [e0, e1, e2, e3, e4] FROM l WHERE e4 IS NOT NULL),
g AS (SELECT array_to_string(p, ' > ') AS pattern, len(p)::INTEGER AS length, count(*) AS total, count(DISTINCT user_id) AS sessions FROM p GROUP BY ALL)
"""


def _patterns(spark, folder):
    return W.sequence_patterns(table(spark, folder, "events", "event_id", "user_id", "ts", "event_type"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


@query(_PATTERNS + "SELECT * FROM g")
def w6_sequence_patterns(spark, folder):
    return _patterns(spark, folder)


@query(_PATTERNS + "SELECT * FROM g WHERE sessions >= 3 AND total >= 5 AND NOT EXISTS (SELECT 1 FROM g h WHERE h.total >= 5 AND h.length > g.length AND h.sessions >= g.sessions AND contains(' > ' || h.pattern || ' > ', ' > ' || g.pattern || ' > '))")
def w7_maximal_patterns(spark, folder):
    return W.maximal_patterns(_patterns(spark, folder), 3, 5)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN count(*) OVER (PARTITION BY user_id) > 1 THEN greatest(1, count(*) OVER (PARTITION BY user_id) // 5) ELSE 0 END AS cut FROM events) WHERE n > cut")
def w11_drop_oldest(spark, folder):
    return W.drop_oldest(table(spark, folder, "events", "event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id")


@query("""WITH g AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000)::INTEGER, 0) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS events, CASE WHEN count(*) FILTER (event_type = 'view') >= 1 AND count(*) >= 3 THEN 'archive' ELSE 'skip' END AS decision FROM s GROUP BY ALL""")
def w12_idle_sessions(spark, folder):
    s = W.gaps(table(spark, folder, "events", "event_id", "user_id", "ts", "event_type"), ["user_id"], "ts", [F.col("ts"), F.col("event_id")], 7200)
    views = F.count(F.when(F.col("event_type") == "view", 1))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("events"), F.when((views >= 1) & (F.count(F.lit(1)) >= 3), "archive").otherwise("skip").alias("decision"))


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def w14_first_wins(spark, folder):
    return R.latest_wins(table(spark, folder, "documents", "doc_id", "lang", "source"), ["lang", "source"], [F.col("doc_id")])


@query("SELECT id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_time DESC, status DESC) AS n FROM knowledge_event) WHERE n = 1")
def w15_latest_attempt(spark, folder):
    return table(spark, folder, "knowledge_event", "id", "status", "updated_time").groupBy("id").agg(F.max_by("status", F.struct("updated_time", "status")).alias("status"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM events")
def w16_forward_fill(spark, folder):
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type")
    return W.forward_fill(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "purchase", F.col("event_id")), "turn").select("event_id", "turn")


_RUNS = """WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS c FROM events),
i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i)
"""


@query(_RUNS + "SELECT event_id, run FROM r WHERE run >= 3")
def w17_stable_runs(spark, folder):
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type")
    return W.run_lengths(e, ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").filter("run >= 3").select("event_id", "run")


@query("SELECT user_id, date_trunc('day', ts) AS day, array_to_string(list_sort(list(event_type)), '|') AS signature FROM events GROUP BY ALL")
def w18_turn_signatures(spark, folder):
    e = table(spark, folder, "events", "user_id", "ts", "event_type").withColumn("day", F.date_trunc("day", "ts"))
    return W.turn_signatures(e, ["user_id", "day"], "event_type")


@query("SELECT event_id FROM events WHERE floor(epoch_ms(ts) / 86400000) > floor((SELECT epoch_ms(max(ts)) FROM events) / 86400000) - 7")
def w19_newest_days(spark, folder):
    e = table(spark, folder, "events", "event_id", "ts").crossJoin(F.broadcast(_now(spark, folder)))  # one row
    return W.newest_days(e, F.unix_millis(F.col("ts").cast("timestamp")), F.unix_millis(F.col("now").cast("timestamp")), 7).select("event_id")


@query("WITH f AS (SELECT *, event_type = 'error' AS f FROM events), c AS (SELECT *, (f IS DISTINCT FROM lag(f) OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS c FROM f), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS run FROM i) WHERE f AND run % 3 = 0")
def x9_repeated_failures(spark, folder):
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type")
    return W.repeated_failures(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("event_type") == "error").select("event_id")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 20")
def l1_sorted_top(spark, folder):
    o = table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    return o.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")  # a top-k report


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY lower(c_name), c_custkey LIMIT 50 OFFSET 50")
def l3_offset_page(spark, folder):
    return R.page(table(spark, folder, "customer", "c_custkey", "c_name"), [F.lower("c_name"), F.col("c_custkey")], 2, 50)


@query("SELECT event_id, ts, true AS has_more FROM (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 40)")
def l4_keyset_page(spark, folder):
    import datetime

    return R.page_before(table(spark, folder, "events", "event_id", "ts"), "ts", "event_id", (datetime.datetime(2024, 1, 15), -1), 40)


@query("SELECT event_id FROM events WHERE NOT (ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id <= 5000))")
def l5_cursor_delete(spark, folder):
    gone = (F.col("ts") < F.lit("2024-01-15").cast("timestamp")) | ((F.col("ts") == F.lit("2024-01-15").cast("timestamp")) & (F.col("event_id") <= 5000))
    return table(spark, folder, "events", "event_id", "ts").filter(~gone).select("event_id")


@query("SELECT lpad(s[1], 8, '0') || '.' || CASE WHEN regexp_full_match(s[2], '[0-9]{1,8}') THEN lpad(s[2], 8, '0') ELSE '99999999' END AS k, p_partkey FROM (SELECT p_partkey, [p_size::VARCHAR, p_partkey::VARCHAR] AS s FROM part)")
def l15_natural_key(spark, folder):
    p = table(spark, folder, "part", "p_partkey", "p_size").withColumn("o", F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    return p.select(R.natural_key("o").alias("k"), "p_partkey")


@query("SELECT content_hash, model, ts FROM (SELECT *, row_number() OVER (PARTITION BY content_hash, model ORDER BY ts DESC) AS n FROM query_embedding_cache) WHERE n = 1")
def s10_upsert_latest(spark, folder):
    return R.latest_wins(table(spark, folder, "query_embedding_cache", "content_hash", "model", "ts"), ["content_hash", "model"], [F.desc("ts")])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT * FROM (VALUES (1000, 'Atlantis')) v(k, name)")
def s11_insert_missing(spark, folder):
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    new = spark.createDataFrame([(0, "ignored"), (1000, "Atlantis")], "k int, name string")
    return R.insert_missing(n, new, ["k"])


@query("""WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part), c AS (SELECT p_name, i, row_number() OVER (PARTITION BY p_name ORDER BY i) AS k FROM (SELECT p_name, count(*) AS m FROM part GROUP BY p_name), range(2, 2000) t(i)
WHERE i <= m + 1 AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_name = p_name || '-' || i)) SELECT p_partkey, CASE WHEN n.k = 0 THEN n.p_name ELSE n.p_name || '-' || c.i END AS unique_name FROM n LEFT JOIN c ON n.p_name = c.p_name AND n.k = c.k""")
def s15_free_names(spark, folder):
    return R.free_names(table(spark, folder, "part", "p_partkey", "p_name"), "p_name", [F.col("p_partkey")]).select("p_partkey", "unique_name")


@query("""SELECT doc_id, used, least(before + size, 61440)::BIGINT AS running FROM (SELECT doc_id, size, before, least(size, 61440 - before)::BIGINT AS used FROM (SELECT doc_id, size, coalesce(sum(size) OVER (PARTITION BY kb_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT doc_id, kb_id, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE least(coalesce(length(text), 0), 4096) END AS size, row_number() OVER (PARTITION BY kb_id ORDER BY doc_id) AS n FROM documents) WHERE n <= 20)) WHERE used > 0""")
def s17_budgeted_sample(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "kb_id", "text")
    size = F.when(F.col("text").rlike(r"^\s*$"), 0).otherwise(F.char_length("text"))
    return R.within_budget(d, [F.col("doc_id")], size, 4096, 61440, 20, "kb_id").select("doc_id", F.col("used").cast("bigint").alias("used"), F.col("running").cast("bigint").alias("running"))


@query("SELECT DISTINCT id, 'entity' AS kind FROM entity WHERE id = (SELECT min(id) FROM entity) UNION ALL SELECT DISTINCT id, 'event' FROM knowledge_event WHERE id = (SELECT min(id) FROM entity) AND NOT EXISTS (SELECT 1 FROM entity WHERE id = (SELECT min(id) FROM entity))")
def s2_point_lookup(spark, folder):
    """One record by id: an entity if there is one, else an event."""
    e = table(spark, folder, "entity", "id").select("id", F.lit("entity").alias("kind"), F.lit(0).alias("o"))
    v = table(spark, folder, "knowledge_event", "id").select("id", F.lit("event").alias("kind"), F.lit(1).alias("o"))
    wanted = table(spark, folder, "entity", "id").agg(F.min("id").alias("id"))
    return e.unionByName(v).join(F.broadcast(wanted), "id").orderBy("o").limit(1).select("id", "kind")  # a point lookup


@query("SELECT r.user_id, r.event_id, o.n FROM events r JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id) o USING (user_id) WHERE r.event_type = 'error'")
def j8_owner_scoped(spark, folder):
    e = table(spark, folder, "events", "user_id", "event_id", "event_type")
    own = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.filter("event_type = 'error'").join(own, "user_id").select("user_id", "event_id", "n")


@query("""WITH x AS (SELECT min(id) AS id FROM entity WHERE entity_type_id = 'person'), r AS (SELECT DISTINCT id, event_id FROM event_entity_relation WHERE entity_id = (SELECT id FROM x))
SELECT (SELECT count(DISTINCT event_id) FROM r) AS events, (SELECT count(*) FROM r) AS relations, (SELECT count(DISTINCT e.id) FROM knowledge_event e, (SELECT min(name) AS name FROM entity WHERE id = (SELECT id FROM x)) n WHERE contains(e.content, n.name)) AS texts""")
def a16_rename_impact(spark, folder):
    """What renaming one entity would touch: events, relations, texts with its name."""
    entity = table(spark, folder, "entity", "id", "entity_type_id", "name")
    one = F.broadcast(entity.filter("entity_type_id = 'person'").groupBy("id").agg(F.min("name").alias("name")).orderBy("id").limit(1))
    r = table(spark, folder, "event_entity_relation", "id", "event_id", "entity_id").distinct().join(one.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    texts = table(spark, folder, "knowledge_event", "id", "content").withColumnRenamed("id", "event").crossJoin(one).filter(F.contains("content", "name"))  # one row
    return r.agg(F.count_distinct("event_id").alias("events"), F.count(F.lit(1)).alias("relations")).crossJoin(texts.agg(F.count_distinct("event").alias("texts")))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY (kb_id IS NULL), coalesce(kb_id, ''), coalesce(lang, ''), doc_id) AS n FROM documents) WHERE n <= 25")
def l9_nulls_sorted(spark, folder):
    d = table(spark, folder, "documents", "doc_id", "kb_id", "lang")
    return d.orderBy(F.col("kb_id").isNull(), F.coalesce("kb_id", F.lit("")), F.coalesce("lang", F.lit("")), "doc_id").limit(25).select("doc_id")  # a top-k report


@query("SELECT id FROM (SELECT DISTINCT id, start_time, created_time FROM knowledge_event) ORDER BY (start_time IS NOT NULL) DESC, coalesce(start_time, created_time) DESC, id LIMIT 30")
def l6_pinned_first(spark, folder):
    e = table(spark, folder, "knowledge_event", "id", "start_time", "created_time").distinct()
    return e.orderBy(F.col("start_time").isNull(), F.desc(F.coalesce("start_time", "created_time")), "id").limit(30).select("id")  # a top-k report


@query("SELECT event_id FROM (SELECT event_id, ts FROM events WHERE event_type = 'click' AND contains(lower(props), '1') AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100)")
def l13_audit_search(spark, folder):
    import datetime

    e = table(spark, folder, "events", "event_id", "ts", "event_type", "props").filter(R.every(F.col("event_type") == "click", R.contains_any_case("1", "props")))
    return R.page_before(e.select("event_id", "ts"), "ts", "event_id", (datetime.datetime(2024, 1, 20), -1), 100).select("event_id")


@query("SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN p_type LIKE '%A%' THEN 2.0 ELSE 0 END + CASE WHEN p_size > 25 THEN 1.0 ELSE -1.0 END + CASE WHEN p_retailprice < 1200 THEN 0.5 ELSE 0 END AS score FROM part WHERE p_size > 5) ORDER BY score DESC, p_partkey LIMIT 40")
def l14_ranked_candidates(spark, folder):
    """Hard filters, then additive scores; ties to the smaller key."""
    p = table(spark, folder, "part", "p_partkey", "p_type", "p_size", "p_retailprice").filter("p_size > 5")
    add = lambda c, yes, no=0.0: F.when(c, yes).otherwise(no)
    score = add(F.col("p_type").like("%A%"), 2.0) + add(F.col("p_size") > 25, 1.0, -1.0) + add(F.col("p_retailprice") < 1200, 0.5)
    return p.select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(40)  # a top-k report
