"""Queries on memories, caches, queues, schedules, listings and index upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnfall.functions import schedule as D
from tarnfall.functions import text as T
from tarnfall.operators import aggregates as A
from tarnfall.operators import extraction as X
from tarnfall.operators import relational as R
from tarnfall.operators import retrieval as V
from tarnfall.operators import windows as W
from tarnfall.plans.text import _BM25, _WORDS
from tarnfall.sources.tables import snapshot, staging_root, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Sources and sinks


@query("SELECT id, ts FROM (SELECT DISTINCT id, ts FROM memory_l3_dynamic) ORDER BY ts DESC, id LIMIT 200")
def s8_newest_memories(spark, folder):
    return table(spark, folder, "memory_l3_dynamic", "id", "ts").distinct().orderBy(F.desc("ts"), "id").limit(200)  # the feature's own limit


@query("""SELECT doc_id, lines, bytes, lines > 200 OR bytes > 25000 AS cut, md5(array_to_string(l[:200], chr(10))) AS digest FROM (SELECT doc_id, string_split(t, chr(10)) AS l, len(string_split(t, chr(10)))::INTEGER AS lines, strlen(t)::INTEGER AS bytes
FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents WHERE text IS NOT NULL))""")
def s9_truncated_index(spark, folder):
    """Texts cut to 200 lines, then to 25 kB at a line end."""
    d = table(spark, folder, "documents", "doc_id", "text").filter("text is not null")
    t = F.regexp_replace("text", r"^[ \t\n\r]+|[ \t\n\r]+\z", "")
    lines, size = F.size(F.split(t, "\n")), F.octet_length(t)
    return d.select("doc_id", lines.alias("lines"), size.alias("bytes"), ((lines > 200) | (size > 25_000)).alias("cut"), F.md5(T.truncated_index(t, 200, 25_000)).alias("digest"))


def _place(spark) -> str:
    return f"{staging_root(spark)}/kept-{uuid.uuid4().hex}"


@query("SELECT 'node' AS part, node_type AS kind, count(*) AS rows FROM (SELECT DISTINCT * FROM graph_node) GROUP BY node_type UNION ALL SELECT 'edge', edge_type, count(*) FROM (SELECT DISTINCT * FROM graph_edge) GROUP BY edge_type")
def s12_graph_kept(spark, folder):
    """A graph written and read again: both tables replace what was there."""
    parts = {p: snapshot(table(spark, folder, f"graph_{p}").distinct(), _place(spark)) for p in ("node", "edge")}
    count = lambda p: parts[p].groupBy(F.col(f"{p}_type").alias("kind")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(p).alias("part"), "kind", "rows")
    return count("node").unionByName(count("edge"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dims, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS square FROM embeddings")
def s13_vectors_kept(spark, folder):
    """A vector index written and read again."""
    e = snapshot(table(spark, folder, "embeddings", "vec_id", "embedding"), _place(spark))
    return e.select("vec_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x), 4).alias("square"))


@query("SELECT DISTINCT * FROM mix_target")
def s14_snapshot(spark, folder):
    return snapshot(table(spark, folder, "mix_target").distinct(), _place(spark))


@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, ' ')) AS c FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, CASE WHEN trim(c) = '' THEN 'null' WHEN regexp_full_match(c, '-?[0-9]+(\.[0-9]+)?') THEN 'number' WHEN lower(c) IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind FROM c)
SELECT doc_id, kind, count(*) AS cells FROM k GROUP BY doc_id, kind""")
def s16_typed_cells(spark, folder):
    """The cells of every text, parted by spaces, by the type that they have as JSON."""
    c = table(spark, folder, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.explode(F.split("text", " ")).alias("c"))
    return c.groupBy("doc_id", T.cell_kind(F.col("c")).alias("kind")).agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT name, folder FROM (SELECT DISTINCT kb_id AS name, true AS folder FROM documents WHERE kb_id IS NOT NULL UNION ALL SELECT source, false FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) ORDER BY folder DESC, lower(name), name LIMIT 200")
def s18_listing(spark, folder):
    """Bases as folders and sources as files: folders first, then by name in any case."""
    d = table(spark, folder, "documents", "kb_id", "source")
    of = lambda c, f: d.filter(F.col(c).isNotNull()).select(F.col(c).alias("name"), F.lit(f).alias("folder")).distinct()
    return of("kb_id", True).unionByName(of("source", False)).orderBy(F.desc("folder"), F.lower("name"), "name").limit(200)  # the feature's own limit


# Filters and joins


@query("SELECT DISTINCT id FROM memory_l3_dynamic WHERE kind = 'semantic' AND json_valid(payload) AND (contains(lower(json_extract_string(payload, '$.concept')), 'ai') OR contains(lower(json_extract_string(payload, '$.facts')), 'memory'))")
def f13_memory_filter(spark, folder):
    """Memories of one type with a text in one of their fields."""
    m = table(spark, folder, "memory_l3_dynamic", "id", "kind", "payload").filter("kind = 'semantic'")
    field = lambda p: F.lower(F.get_json_object("payload", p))
    return m.filter(F.try_parse_json("payload").isNotNull() & (F.contains(field("$.concept"), F.lit("ai")) | F.contains(field("$.facts"), F.lit("memory")))).select("id").distinct()


@query("SELECT event_id, ts FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100")
def f16_audit_of_caller(spark, folder):
    """The newest hundred calls of one caller."""
    e = table(spark, folder, "events", "event_id", "ts", "user_id")
    caller = F.broadcast(e.agg(F.min("user_id").alias("user_id")))  # one row
    return e.join(caller, "user_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query("SELECT DISTINCT d.source, e.kb_id FROM documents d JOIN knowledge_event e ON d.kb_id = e.kb_id WHERE d.source IS NOT NULL")
def j7_bindings(spark, folder):
    """Which sources are bound to which bases that have events."""
    bound = table(spark, folder, "documents", "source", "kb_id").filter("source is not null").distinct()
    return bound.join(table(spark, folder, "knowledge_event", "kb_id").distinct(), "kb_id", "left_semi").select("source", "kb_id")


@query("""WITH e AS (SELECT DISTINCT id, doc_id, created_time FROM knowledge_event WHERE contains(lower(content), 'queue')), x AS (SELECT e.id, d.source, e.created_time FROM e JOIN documents d ON e.doc_id = 'doc-' || d.doc_id)
SELECT id, source, (SELECT count(*) FROM x) AS total FROM x ORDER BY created_time DESC, id, source LIMIT 20 OFFSET 20""")
def j11_message_search(spark, folder):
    """Events with a text, with the source of their document; the second page."""
    e = table(spark, folder, "knowledge_event", "id", "doc_id", "created_time", "content").filter(F.contains(F.lower("content"), F.lit("queue"))).select("id", "doc_id", "created_time").distinct()
    d = table(spark, folder, "documents", "doc_id", "source").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("doc_id"), "source")
    return R.page(e.join(d, "doc_id"), [F.desc("created_time"), F.col("id"), F.col("source")], 2, 20).select("id", "source", "total")


@query("""WITH c AS (SELECT DISTINCT id, json_extract_string(payload, '$.concept') AS subject FROM memory_l3_dynamic WHERE kind = 'semantic' AND json_valid(payload)), t AS (SELECT DISTINCT id, title FROM knowledge_event)
SELECT DISTINCT t.id AS event_id, c.id AS memory_id FROM t JOIN c ON c.subject <> '' AND contains(t.title, c.subject) WHERE regexp_matches(c.subject, '^[\\p{L}\\p{N}]+$') AND list_contains(regexp_extract_all(t.title, '[\\p{L}\\p{N}]+'), c.subject)""")
def j12_content_subject(spark, folder):
    """Events whose title holds the concept of a memory as a word: titles are taken apart, so words meet by equality."""
    c = table(spark, folder, "memory_l3_dynamic", "id", "kind", "payload").filter("kind = 'semantic'").select(F.col("id").alias("memory_id"), F.get_json_object("payload", "$.concept").alias("word")).filter("word <> ''").distinct()
    words = table(spark, folder, "knowledge_event", "id", "title").select(F.col("id").alias("event_id"), F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word")).distinct()
    return words.join(c, "word").select("event_id", "memory_id").distinct()


@query("""WITH m AS (SELECT DISTINCT id, payload FROM memory_l0_raw WHERE json_valid(payload)), c AS (SELECT DISTINCT json_extract_string(t, '$.id') AS call_id, json_extract_string(t, '$.name') AS asked FROM (SELECT unnest(json_extract(payload, '$.messages[*].tool_calls[*]')) AS t FROM m))
SELECT m.id, c.call_id, c.asked FROM m JOIN c ON json_extract_string(payload, '$.call_id') = c.call_id""")
def j13_tool_results(spark, folder):
    """Tool results with the name of the tool that the call with their id asked for."""
    m = table(spark, folder, "memory_l0_raw", "id", "payload").distinct().filter(F.try_parse_json("payload").isNotNull())
    calls = F.from_json(F.get_json_object("payload", "$.messages[*].tool_calls[*]"), "array<struct<id:string,name:string>>")
    asked = m.select(F.explode(calls).alias("c")).select(F.col("c.id").alias("call_id"), F.col("c.name").alias("asked")).filter("call_id is not null").distinct()
    return m.select("id", F.get_json_object("payload", "$.call_id").alias("call_id")).filter("call_id is not null").join(asked, "call_id").select("id", "call_id", "asked")


@query()
def j14_topic_matches(spark, folder):
    """Events that speak of one of the ten hottest topics: its whole title, or two of its keywords; at most five topics each."""
    e = table(spark, folder, "knowledge_event", "id", "title", "summary", "created_time").distinct()
    topics = [r[0] for r in e.filter("title <> ''").groupBy("title").agg(F.max("created_time").alias("t")).orderBy(F.desc("t"), "title").limit(10).select("title").collect()]  # a hot list of ten
    return W.topic_matches(e.select("id", F.coalesce("summary", F.lit("")).alias("text")), topics, 5)


# Aggregates


@query("SELECT user_id, count(*) AS records, round(sum(value), 4) AS total, max(ts) AS last_ts FROM events GROUP BY user_id")
def a4_merged_parts(spark, folder):
    """Sums of days merged to sums of users; the same as summing all rows."""
    e = table(spark, folder, "events", "user_id", "ts", "value")
    days = e.groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count(F.lit(1)).alias("records"), F.sum("value").alias("total"), F.max("ts").alias("last_ts"))
    return A.merged(days, ["user_id"]).withColumn("total", F.round("total", 4))


def _buckets(unit, n):
    interval = {"day": "to_days(i::INTEGER)", "month": "to_months(i::INTEGER)"}[unit]
    return f"""WITH a AS (SELECT date_trunc('{unit}', max(ts)) AS e FROM events), s AS (SELECT (e - {interval})::TIMESTAMP AS bucket FROM a, range({n}) t(i)), g AS (SELECT date_trunc('{unit}', ts)::TIMESTAMP AS bucket, sum(value) AS v, count(*) AS c FROM events GROUP BY 1)
SELECT s.bucket, round(coalesce(v, 0), 4) AS value, coalesce(c, 0) AS records FROM s LEFT JOIN g ON s.bucket = g.bucket"""


def _filled(spark, folder, unit, n):
    e = table(spark, folder, "events", "ts", "value")
    return A.filled_buckets(e, "ts", e.agg(F.max("ts").alias("now")), unit, n, F.col("value")).select("bucket", F.round("value", 4).alias("value"), "records")


@query(_buckets("day", 30))
def a6_daily_buckets(spark, folder):
    return _filled(spark, folder, "day", 30)


@query(_buckets("month", 12))
def a6_monthly_buckets(spark, folder):
    return _filled(spark, folder, "month", 12)


@query("""WITH m AS (SELECT DISTINCT 'L0' AS layer, id, ts FROM memory_l0_raw UNION SELECT DISTINCT 'L3', id, ts FROM memory_l3_dynamic), n AS (SELECT max(ts) AS now FROM m), l(layer) AS (VALUES ('L0'), ('L1'), ('L2'), ('L3'), ('L4'), ('L5'))
SELECT l.layer, count(m.id) AS total, count(*) FILTER (m.ts >= now - 604800) AS recent, count(*) FILTER (m.ts + 2592000 BETWEEN now AND now + 604800) AS expiring FROM l CROSS JOIN n LEFT JOIN m ON m.layer = l.layer GROUP BY l.layer""")
def a7_layers(spark, folder):
    """Memories of each of six layers, zero-filled; those of the last week, and those that end within the next, kept for thirty days."""
    parts = [table(spark, folder, t, "id", "ts").distinct().withColumn("layer", F.lit(layer)) for layer, t in (("L0", "memory_l0_raw"), ("L3", "memory_l3_dynamic"))]
    m = parts[0].unionByName(parts[1])
    m = m.crossJoin(F.broadcast(m.agg(F.max("ts").alias("now"))))  # one row
    ends = F.col("ts") + 30 * 86_400
    got = m.groupBy("layer").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("ts") >= F.col("now") - 604_800, 1)).alias("recent"), F.count(F.when(ends.between(F.col("now"), F.col("now") + 604_800), 1)).alias("expiring"))
    layers = spark.createDataFrame([(f"L{k}",) for k in range(6)], "layer string")
    return layers.join(got, "layer", "left").na.fill(0, ["total", "recent", "expiring"])


@query("WITH e AS (SELECT kb_id, count(DISTINCT id) AS events FROM knowledge_event WHERE kb_id IS NOT NULL GROUP BY kb_id), d AS (SELECT kb_id, count(*) AS docs FROM documents GROUP BY kb_id) SELECT e.kb_id, events + 5 * coalesce(docs, 0) AS xp, floor(sqrt((events + 5 * coalesce(docs, 0)) / 100))::BIGINT + 1 AS level FROM e LEFT JOIN d ON e.kb_id = d.kb_id")
def a19_levels(spark, folder):
    e = table(spark, folder, "knowledge_event", "kb_id", "id").filter("kb_id is not null").distinct().groupBy("kb_id").agg(F.count("id").alias("events"))
    d = table(spark, folder, "documents", "kb_id").groupBy("kb_id").agg(F.count(F.lit(1)).alias("docs"))
    xp = F.col("events") + 5 * F.coalesce("docs", F.lit(0))
    return e.join(d, "kb_id", "left").select("kb_id", xp.alias("xp"), A.level_for(xp).alias("level"))


# Windows and sequences


@query("""WITH c AS (SELECT * FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type OR b IS NULL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS steps FROM c)
SELECT user_id, steps, string_agg(event_type, ' > ' ORDER BY k) AS first_steps, min(ts) AS start_ts, max(ts) AS end_ts FROM n WHERE steps >= 5 AND k <= 8 GROUP BY user_id, steps ORDER BY user_id LIMIT 10""")
def w8_long_sessions(spark, folder):
    """The first ten sessions of five steps or more, repeats collapsed, with their first eight."""
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type")
    return W.long_sessions(e, "user_id", [F.col("ts"), F.col("event_id")], "event_type", "ts", 5, 8).orderBy("user_id").limit(10)  # the feature's own limit


@query("""WITH n AS (SELECT user_id, strlen(props) // 4 AS freed, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type IN ('click', 'view'))
SELECT user_id, count(*) FILTER (k > 5) AS cleared, coalesce(sum(freed) FILTER (k > 5), 0)::BIGINT AS freed FROM n GROUP BY user_id""")
def w9_freed_tokens(spark, folder):
    """Of each user's results of some kinds all but the newest five are cleared; four bytes are a token."""
    e = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type", "props").filter(F.col("event_type").isin("click", "view"))
    return W.freed_tokens(e, "user_id", [F.desc("ts"), F.desc("event_id")], "props", 5)


@query("""WITH g AS (SELECT user_id, max(ts) AS last_ts, count(*) FILTER (event_type = 'view') AS asked, sum(strlen(props)) AS chars FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, CASE WHEN epoch_us(now) - epoch_us(last_ts) < 1800000000 THEN 'wait' WHEN asked >= 1 AND chars >= 400 THEN 'archive' ELSE 'skip' END AS decision FROM g, n""")
def w12_idle_decision(spark, folder):
    """Whether a session still waits, is archived or passed over: half an hour of silence, a question and 400 characters."""
    e = table(spark, folder, "events", "user_id", "ts", "event_type", "props")
    g = e.groupBy("user_id").agg(F.max("ts").alias("last_ts"), F.count(F.when(F.col("event_type") == "view", 1)).alias("asked"), F.sum(F.char_length("props")).alias("chars"))
    g = g.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))  # one row
    idle = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))
    return g.select("user_id", W.idle_decision(idle / 1000, F.col("asked"), F.col("chars"), 30, 400).alias("decision"))


@query("""SELECT user_id, event_id, '[' || CASE WHEN event_type = 'view' THEN '用户' ELSE '伙伴' END || '] ' || left(props, 1500) AS line FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 300""")
def w13_digest_lines(spark, folder):
    """The last 300 messages of each session as lines of a digest, 1,500 characters each."""
    e = table(spark, folder, "events", "user_id", "event_id", "ts", "event_type", "props")
    who = F.when(F.col("event_type") == "view", "用户").otherwise("伙伴")
    return W.keep_newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 300).select("user_id", "event_id", F.concat(F.lit("["), who, F.lit("] "), F.left("props", F.lit(1500))).alias("line"))


@query("""WITH s AS (SELECT user_id, date_trunc('day', ts) AS day, array_to_string(list_sort(list(event_type)), '|') AS sig FROM events GROUP BY ALL), c AS (SELECT *, (sig IS DISTINCT FROM lag(sig) OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS c FROM s), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS island FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS run FROM i) SELECT user_id, day, CASE WHEN run >= 4 THEN 'abort' WHEN run >= 2 THEN 'nudge' ELSE 'go on' END AS action FROM r""")
def w18_loop_guard(spark, folder):
    """Turns with the same calls in any order: a nudge at the second in a row, an end at the fourth."""
    e = table(spark, folder, "events", "user_id", "ts", "event_type").withColumn("day", F.date_trunc("day", "ts"))
    return W.loop_guard(W.turn_signatures(e, ["user_id", "day"], "event_type"), ["user_id"], [F.col("day")], "signature", 2).select("user_id", "day", "action")


# Sorts, pages, queues


@query("SELECT p_partkey FROM part ORDER BY lower(p_name), p_partkey LIMIT 30")
def l2_any_case(spark, folder):
    return table(spark, folder, "part", "p_partkey", "p_name").orderBy(F.lower("p_name"), "p_partkey").limit(30).select("p_partkey")  # a page


@query("""WITH l AS (SELECT id, arg_max(upper(status), updated_time) AS status, max(category) AS tag, max(level) AS level, min(created_time) AS created FROM knowledge_event GROUP BY id)
SELECT id, 'RUNNING' AS status, 1 AS attempt FROM l WHERE status = 'PENDING' AND coalesce(tag, '') NOT IN (SELECT coalesce(tag, '') FROM l WHERE status = 'FAILED' AND tag IS NOT NULL) ORDER BY level DESC, created, id LIMIT 1""")
def l8_queue_claim(spark, folder):
    """The first pending event by level and age, unless its category has a failed one; a claim is one row by its nature."""
    e = table(spark, folder, "knowledge_event", "id", "status", "updated_time", "category", "level", "created_time")
    t = e.groupBy("id").agg(F.upper(F.max_by("status", "updated_time")).alias("status"), F.max("category").alias("tag"), F.max("level").alias("level"), F.min("created_time").alias("created"))
    return R.claim(t, F.col("status") == "PENDING", t.filter("status = 'FAILED'").select("tag"), "tag", [F.desc("level"), F.col("created"), F.col("id")]).select("id", F.lit("RUNNING").alias("status"), F.lit(1).alias("attempt"))


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def l10_page_slice(spark, folder):
    """The third page of 25, counted from 0."""
    return R.page_slice(table(spark, folder, "customer", "c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 2, 25).select("c_custkey")


@query("SELECT key, min(place)::INTEGER AS place FROM (SELECT DISTINCT kb_id AS key, 0 AS place FROM documents WHERE kb_id IS NOT NULL UNION ALL SELECT DISTINCT kb_id, 1 FROM knowledge_event WHERE kb_id IS NOT NULL) GROUP BY key")
def l12_first_wins(spark, folder):
    """Contributions of two tables; of equal keys that of the first holds."""
    parts = [table(spark, folder, t, "kb_id").filter("kb_id is not null").select(F.col("kb_id").alias("key")).distinct() for t in ("documents", "knowledge_event")]
    return R.first_wins(parts, ["key"])


@query("""WITH n AS (SELECT max(ts) AS now FROM events), x AS (SELECT event_id, ts FROM events, n WHERE event_type = 'click' AND contains(lower(props), '1') AND ts >= now - INTERVAL 10 DAY ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT event_id, ts, (SELECT min(ts) FROM x) AS next_ts FROM x""")
def l13_audit_page(spark, folder):
    """Calls of one kind with a text, of the last ten days; the time to go on from stands in every row."""
    e = table(spark, folder, "events", "event_id", "ts", "event_type", "props")
    recent = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).filter(F.col("ts") >= F.col("now") - F.expr("interval 10 days"))  # one row
    found = recent.filter(R.every(F.col("event_type") == "click", R.contains_any_case("1", "props"))).orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return found.select("event_id", "ts", F.min("ts").over(Window.partitionBy(F.lit(1))).alias("next_ts"))  # one page


@query("""WITH l AS (SELECT id, arg_max(upper(status), updated_time) AS status, max(created_time) AS created FROM knowledge_event GROUP BY id)
(SELECT 'newest' AS list, id FROM l WHERE status = 'COMPLETED' ORDER BY created DESC, id LIMIT 20) UNION ALL (SELECT 'unfinished', id FROM l WHERE status NOT IN ('COMPLETED', 'DELETED') ORDER BY created, id LIMIT 20)""")
def l16_status_lists(spark, folder):
    """The newest completed events, and the oldest unfinished ones; twenty each."""
    e = table(spark, folder, "knowledge_event", "id", "status", "updated_time", "created_time")
    t = e.groupBy("id").agg(F.upper(F.max_by("status", "updated_time")).alias("status"), F.max("created_time").alias("created"))
    done = t.filter("status = 'COMPLETED'").orderBy(F.desc("created"), "id").limit(20).select(F.lit("newest").alias("list"), "id")
    return done.unionByName(t.filter("status not in ('COMPLETED', 'DELETED')").orderBy("created", "id").limit(20).select(F.lit("unfinished").alias("list"), "id"))


@query("SELECT DISTINCT id, name, length(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) >= 3 OR name IN ('AI', 'ML') AS allowed FROM entity WHERE name IS NOT NULL")
def t20_search_guard(spark, folder):
    """Names as search terms: three letters or digits, unless they are a tool's exact name."""
    e = table(spark, folder, "entity", "id", "name").filter("name is not null").distinct()
    return e.select("id", "name", T.searchable(F.col("name"), ["AI", "ML"]).alias("allowed"))


@query()
def t13_cited_names(spark, folder):
    """Names of cited files in the blocks of documents and payloads, in order, each once."""
    d = table(spark, folder, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("row_id"), "text")
    m = table(spark, folder, "memory_l0_raw", "id", "payload").distinct().select(F.col("id").alias("row_id"), F.col("payload").alias("text"))
    return d.unionByName(m).select("row_id", F.posexplode(T.cited_names(F.col("text"))).alias("n", "name"))


# Dates


@query("""SELECT event_id, CASE WHEN (SELECT min(ts) FROM events) + to_days(5) > ts THEN (SELECT min(ts) FROM events) + to_days(5) END AS at_run, ts + to_seconds(900) AS every_run, CASE WHEN ts < date_trunc('hour', ts) + to_minutes(30) THEN date_trunc('hour', ts) + to_minutes(30) ELSE date_trunc('hour', ts) + to_minutes(90) END AS cron_run FROM events""")
def d2_next_runs(spark, folder):
    """Once, five days after the first event; every 15 minutes from each; at the next half past an hour."""
    e = table(spark, folder, "events", "event_id", "ts")
    e = e.crossJoin(F.broadcast(e.agg(F.min("ts").alias("first"))))  # one row
    once = D.next_at(F.col("first") + F.expr("interval 5 days"), F.col("ts"))
    return e.select("event_id", once.alias("at_run"), D.next_every(F.col("ts"), 900).alias("every_run"), D.next_cron("30 * * * *", "ts").alias("cron_run"))


@query("SELECT doc_id, created_time + to_days(CASE source WHEN 'chat_export' THEN 1 WHEN 'tool_log' THEN 3 WHEN 'forum' THEN 30 END) AS ends FROM documents")
def d3_expiry(spark, folder):
    """When a record ends by its priority: after 1, 3 or 30 days, or never."""
    d = table(spark, folder, "documents", "doc_id", "source", "created_time")
    priority = F.when(F.col("source") == "chat_export", "transient").when(F.col("source") == "tool_log", "short_term").when(F.col("source") == "forum", "long_term").otherwise("permanent")
    return d.select("doc_id", D.expiry("created_time", priority).alias("ends"))


@query("""WITH n AS (SELECT max(created_time) AS now FROM documents), a AS (SELECT doc_id, (epoch_us(now) - epoch_us(created_time)) / 86400000000.0 AS days FROM documents, n)
SELECT doc_id, CASE WHEN days <= 1 THEN '近 1 天' WHEN days <= 3 THEN '近 3 天' WHEN days <= 7 THEN '近 1 周' WHEN days <= 30 THEN '近 1 月' WHEN days <= 182 THEN '近 6 月' WHEN days <= 365 THEN '近 1 年' END AS label FROM a""")
def d4_period_labels(spark, folder):
    """The shortest period up to now that a document falls into."""
    d = table(spark, folder, "documents", "doc_id", "created_time")
    rows = d.crossJoin(F.broadcast(d.agg(F.max("created_time").alias("now"))))  # one row
    return rows.select("doc_id", D.period_label((F.unix_micros("now") - F.unix_micros("created_time")) / 86_400_000_000).alias("label"))


@query("SELECT event_id, greatest(value, 50.0) AS most FROM events WHERE value IS NOT NULL")
def d6_greater(spark, folder):
    return table(spark, folder, "events", "event_id", "value").filter("value is not null").select("event_id", F.greatest("value", F.lit(50.0)).alias("most"))


# Retrieval


_ASKED = "(SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 50 = 0)"


@query(f"""SELECT layer, query, id, distance FROM (SELECT label AS layer, query, vec_id AS id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]) ** 2))), 5) AS distance, row_number() OVER (PARTITION BY label, query ORDER BY round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]) ** 2))), 5), vec_id) AS k
FROM embeddings, {_ASKED}) WHERE k <= 3""")
def r4_layer_nearest(spark, folder):
    """Of every layer the three vectors nearest to each query, by distance."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    return V.nearest_in_layers(e, "label", "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 3)


@query(f"SELECT query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS score FROM embeddings, (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id = 50) QUALIFY row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) DESC, vec_id) <= 20")
def r6_normalised_index(spark, folder):
    """Vectors are brought to unit length once; similarity is a product then."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    index = e.select("vec_id", V.unit("embedding").alias("u"))
    asked = F.broadcast(index.filter("vec_id = 50").select(F.col("vec_id").alias("query"), F.col("u").alias("q")))  # one row
    scored = index.join(asked, F.lit(True)).select("query", F.col("vec_id").alias("id"), F.round(V.product("u", "q"), 5).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(20)  # a top-k report


@query("SELECT model, count(*) AS vectors, CASE WHEN count(*) < 1000 THEN 'exact' ELSE 'lists' END AS backend, CASE WHEN count(*) < 1000 THEN 8 WHEN count(*) < 10000 THEN 16 WHEN count(*) < 100000 THEN 32 ELSE 48 END AS m, CASE WHEN count(*) < 1000 THEN 50 WHEN count(*) < 10000 THEN 100 WHEN count(*) < 100000 THEN 200 ELSE 300 END AS ef_search FROM (SELECT DISTINCT content_hash, model FROM query_embedding_cache) GROUP BY model")
def r8_index_advice(spark, folder):
    """Per model which search suits its number of vectors, and with what parameters."""
    c = table(spark, folder, "query_embedding_cache", "content_hash", "model").distinct().groupBy("model").agg(F.count(F.lit(1)).alias("vectors"))
    p = V.index_parameters(F.col("vectors"))
    return c.select("model", "vectors", V.backend_for(F.col("vectors")).alias("backend"), p["m"].alias("m"), p["ef_search"].alias("ef_search"))


@query("SELECT doc_id, kb_id, source FROM documents WHERE kb_id IS NULL OR kb_id <> 'kb-core-handbook' UNION ALL SELECT doc_id, kb_id, 'again' FROM documents WHERE kb_id = 'kb-core-handbook' AND lang = 'en'")
def r12_reindexed(spark, folder):
    """One base is indexed again, with fewer documents: all its old rows go."""
    d = table(spark, folder, "documents", "doc_id", "kb_id", "source", "lang")
    new = d.filter("kb_id = 'kb-core-handbook' and lang = 'en'").select("doc_id", "kb_id", F.lit("again").alias("source"))
    return V.reindexed(d.select("doc_id", "kb_id", "source"), new, "kb_id")


@query()
def r13_histograms(spark, folder):
    """Names as histograms of code points at unit length, in place of a model's vectors: the highest part and how many aren't 0."""
    n = table(spark, folder, "entity", "id", "name").filter("name <> ''").distinct()
    v = T.histogram("name")
    return n.select("id", F.round(F.array_max(v), 5).alias("peak"), F.size(F.filter(v, lambda x: x > 0)).alias("filled"))


@query()
def r14_byte_vectors(spark, folder):
    """Names as vectors of their bytes, 384 numbers: sum and last."""
    n = table(spark, folder, "entity", "id", "name").filter("name is not null").distinct()
    v = T.byte_vector("name")
    return n.select("id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.element_at(v, -1), 6).alias("last"))


@query("""WITH l AS (SELECT content_hash, model, arg_max(dim, ts) AS dim FROM query_embedding_cache GROUP BY ALL) SELECT content_hash, model, dim = CASE model WHEN 'ember-m-96' THEN 96 WHEN 'lark-mini-32' THEN 32 ELSE 64 END AS hit FROM l""")
def r16_cache(spark, folder):
    """Every cached query asked for again: a hit only with the dimensions that its model has."""
    c = table(spark, folder, "query_embedding_cache", "content_hash", "model", "dim", "ts")
    dims = F.when(F.col("model") == "ember-m-96", 96).when(F.col("model") == "lark-mini-32", 32).otherwise(64)
    return V.cached(c, c.select("content_hash", "model").distinct(), dims)


@query(_BM25 + "SELECT s.id, s.score, left(d.text, 200) AS snippet FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) s JOIN documents d ON d.doc_id = s.id")
def r17_snippets(spark, folder):
    """The search of the interface; it never gives more than 20."""
    return V.snippets(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", _WORDS, 50)


@query(_BM25 + "SELECT source, id, score FROM (SELECT d.source, s.id, s.score, row_number() OVER (PARTITION BY d.source ORDER BY s.score DESC, s.id) AS k FROM s JOIN documents d ON d.doc_id = s.id) WHERE k <= 3")
def r19_citation_set(spark, folder):
    """Of each source the three best hits, by score, then id."""
    d = table(spark, folder, "documents", "doc_id", "text", "source")
    hits = V.bm25(d, "doc_id", "text", _WORDS).join(d.select(F.col("doc_id").alias("id"), "source"), "id")
    return R.keep_first(hits, ["source"], [F.desc("score"), F.col("id")], 3).select("source", "id", "score")


# Extraction


def _words(spark, folder):
    n = table(spark, folder, "entity", "name", "entity_type_id").filter("name <> ''")
    kind = F.when(F.col("entity_type_id") == "person", "PERSON").when(F.col("entity_type_id") == "organization", "ORGANIZATION").when(F.col("entity_type_id") == "location", "LOCATION").otherwise("OTHER")
    return n.select(kind.alias("kind"), F.col("name").alias("word"))


@query()
def t10_mentions(spark, folder):
    """Times, numbers and names of known entities in every event's content."""
    e = table(spark, folder, "knowledge_event", "id", "content").distinct()
    return X.mentions(e, "id", "content", _words(spark, folder))


@query()
def i1_extracted_events(spark, folder):
    """Events of each document's chunks, in order, from the mentions in them, as no model answers here."""
    return X.extracted_events(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text", _words(spark, folder))


@query()
def t11_answers(spark, folder):
    """Payloads read as a model's answers: as they are, repaired, as a sentence, or by their mentions."""
    m = table(spark, folder, "memory_l0_raw", "id", "payload").filter("payload is not null").distinct()
    events = X.extracted_events(m, "id", "payload", _words(spark, folder), "payload", 1 << 30, 0)
    return events.groupBy("id", "level").agg(F.count(F.lit(1)).alias("events"))


# Stream-like


@query("SELECT id, status, updated_time FROM knowledge_event QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_time DESC, status DESC) = 1")
def s10_upserted(spark, folder):
    """The table's older rows, with the latest of every id put in their place."""
    e = table(spark, folder, "knowledge_event", "id", "status", "updated_time").distinct()
    new = R.latest_wins(e, ["id"], [F.desc("updated_time"), F.desc("status")])
    return R.upsert(e, new, ["id"])


@query("SELECT event_type, props AS suggestion, min(ts) AS created, max(ts) AS touched, count(*) AS times FROM events GROUP BY event_type, props")
def x4_touched(spark, folder):
    """A repeated suggestion touches the row that is there; it never makes another."""
    return A.touched(table(spark, folder, "events", "event_type", "props", "ts"), ["event_type", "props"], "ts").select("event_type", F.col("props").alias("suggestion"), "created", "touched", "times")


@query("""WITH d AS (SELECT p_partkey AS k, p_retailprice * 0.9 AS strength FROM part WHERE p_retailprice * 0.9 >= 850), r AS (SELECT k, strength + CASE WHEN k % 3 = 0 THEN 50 ELSE 0 END AS strength FROM d WHERE k % 10 <> 0)
SELECT k, round(strength, 4) AS strength FROM r UNION ALL SELECT k, 1000.0 FROM (SELECT p_partkey + 1000000 AS k FROM part WHERE p_partkey % 10 = 0)""")
def x3_applied(spark, folder):
    """Decay, then reinforce, then supersede, then insert: parts as memories, their price as strength."""
    p = table(spark, folder, "part", "p_partkey", "p_retailprice").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("strength"))
    gone = p.filter("k % 10 = 0").select("k")
    new = gone.select((F.col("k") + 1_000_000).alias("k"), F.lit(1000.0).alias("strength"))
    return A.applied(p, 0.9, 850.0, p.filter("k % 3 = 0").select("k"), 50.0, gone, new).withColumn("strength", F.round("strength", 4))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def x2_history(spark, folder):
    """The bounded history that a late subscriber gets."""
    e = table(spark, folder, "events", "event_id", "user_id", "ts")
    return W.keep_newest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id")

