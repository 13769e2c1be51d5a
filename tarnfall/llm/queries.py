"""The registered queries on training text, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfall.llm import leaks, mixing, names, neardup, similar, splitting, visual
from tarnfall.sources.tables import table


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_groups(table(spark, folder, "entity", "id", "entity_type_id", "name", "normalized_name"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.variant_pairs(_names(spark, folder)).select(F.col("id_a").alias("entity_id_a"), F.col("id_b").alias("entity_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _names(spark, folder).withColumnRenamed("id", "entity_id")


def _similar(spark: SparkSession, folder: str) -> DataFrame:
    return similar.most_similar(similar.usable_vectors(table(spark, folder, "query_embedding_cache", "content_hash", "model", "embedding", "dim", "ts")), k=5)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _similar(spark, folder).select("model", F.least("hash", "other").alias("hash_a"), F.greatest("hash", "other").alias("hash_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return _similar(spark, folder)


def _near_duplicates(spark: SparkSession, folder: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, folder, "knowledge_event", "id", "content", "summary"), "id", ["content", "summary"], similarity=0.7)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _near_duplicates(spark, folder).pairs().select(F.col("id_a").alias("event_id_a"), F.col("id_b").alias("event_id_b"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _near_duplicates(spark, folder).groups().withColumnRenamed("id", "event_id")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.pieces(table(spark, folder, "knowledge_event", "id", "chunk_id", "content"), "id", "chunk_id", "content", limit=2000, overlap=150)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).select("event_id").distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def _corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_item", "item_id", "lang", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(*_corpus(spark, folder))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item: in how many documents it stands."""
    return leaks.leaks(*_corpus(spark, folder)).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.without_leaks(*_corpus(spark, folder))


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(table(spark, folder, "documents", "doc_id", "text", "source", "lang"), table(spark, folder, "mix_target"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).chosen.withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shares()


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    return visual.form_digests(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    return visual.visual_classes(_digests(spark, folder)).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return visual.visual_twins(_digests(spark, folder)).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_texts(spark: SparkSession, folder: str) -> DataFrame:
    return visual.normalized_texts(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p4_found, p4_neighbours, p5_found, p5_groups, p6_found, p6_pieces, p8_found, p8_items, p8_clean, p9_mix, p9_shares, p10_classes, p10_found, p10_texts)}

_NEIGHBOURS = """
WITH latest AS (SELECT model, content_hash AS hash, max({'t': ts, 'd': dim, 'v': embedding}) AS x FROM query_embedding_cache GROUP BY model, content_hash),
usable AS (SELECT model, hash, x.v::DOUBLE[] AS v FROM latest WHERE len(x.v) = x.d AND len(list_filter(x.v, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x.v, lambda e: e <> 0)) > 0),
near AS (SELECT a.model, a.hash, b.hash AS other, round(list_cosine_similarity(a.v, b.v), 6) AS similarity
         FROM usable a JOIN usable b ON a.model = b.model AND len(a.v) = len(b.v) AND a.hash <> b.hash),
best AS (SELECT *, row_number() OVER (PARTITION BY model, hash ORDER BY similarity DESC, other)::INTEGER AS place FROM near QUALIFY place <= 5)
"""

_NEAR_DUPLICATES = r"""
WITH t AS (SELECT DISTINCT id, trim(regexp_replace(lower(CASE WHEN content IS NULL OR regexp_matches(content, '^\s*$') THEN summary ELSE content END), '[^\p{L}\p{N}]+', ' ', 'g')) AS x FROM knowledge_event),
c AS (SELECT x, row_number() OVER () AS c FROM (SELECT DISTINCT x FROM t WHERE length(x) >= 5)),
g AS (SELECT DISTINCT c, substr(x, k, 5) AS g FROM (SELECT c, x, unnest(generate_series(1, length(x) - 4)) AS k FROM c)),
f AS (SELECT g, count(*) AS f FROM g GROUP BY g),
r AS (SELECT g.c, g.g, row_number() OVER (PARTITION BY g.c ORDER BY f.f, g.g) AS k, count(*) OVER (PARTITION BY g.c) AS n FROM g JOIN f ON g.g = f.g),
p AS (SELECT c, g, n FROM r WHERE k <= n - ceil(0.7 * n) + 1),
d AS (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.c < b.c AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n),
i AS (SELECT d.a, d.b, any_value(d.na) AS na, any_value(d.nb) AS nb, count(*) AS shared FROM d JOIN g x ON x.c = d.a JOIN g y ON y.c = d.b AND y.g = x.g GROUP BY d.a, d.b),
s AS (SELECT a, b FROM i WHERE shared >= 0.7 * (na + nb - shared) UNION ALL SELECT c, c FROM c)
SELECT DISTINCT least(u.id, v.id) AS event_id_a, greatest(u.id, v.id) AS event_id_b
FROM s JOIN c ca ON ca.c = s.a JOIN c cb ON cb.c = s.b JOIN t u ON u.x = ca.x JOIN t v ON v.x = cb.x WHERE u.id <> v.id
"""

ORACLE = {
    "p4_found": _NEIGHBOURS + "SELECT DISTINCT model, least(hash, other) AS hash_a, greatest(hash, other) AS hash_b FROM best",
    "p4_neighbours": _NEIGHBOURS + "SELECT model, hash, other, similarity, place FROM best",
    "p5_found": _NEAR_DUPLICATES,
    "p6_found": "SELECT DISTINCT id AS event_id FROM knowledge_event WHERE length(content) > 2000",
}
