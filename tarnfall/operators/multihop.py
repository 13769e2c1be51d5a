"""Multi-hop search over events and entities, and edits of entities.

Limits stop the expansion and keep what was found: most hops, most entities on the way,
most join rows. ``warning`` tells which one did.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.functions.text import byte_vector
from tarnfall.operators.relational import numbered
from tarnfall.operators.retrieval import top_k_vectors
from tarnfall.sources.tables import stage

MAX_HOP, MAX_ENTITIES, MAX_ROWS, TOP_K = 3, 100, 10_000, 10


def match_entities(entities: DataFrame, names: list[str], loose: bool = False) -> DataFrame:
    """``entity_id``: entities with one of the names or normalized names; loose also inside the name."""
    low = [n.strip().lower() for n in names]
    hit = F.col("name").isin(names) | F.col("normalized_name").isin(low)
    for n in names if loose else ():
        hit = hit | F.contains("name", F.lit(n))
    return entities.filter(hit).select(F.col("id").alias("entity_id")).distinct()


def expand(relations: DataFrame, seeds: DataFrame, max_hop: int = MAX_HOP, max_entities: int = MAX_ENTITIES, max_rows: int = MAX_ROWS) -> tuple[DataFrame, str]:
    """``event_id, hop, score, path`` of events reached from ``seeds`` (``entity_id``), and the warning.

    Each event keeps its first hop and, of the paths of entities that lead to it, the
    smallest. The score is 1 / hop. No seeds, no rows.
    """
    links = relations.filter("event_id <> '' and entity_id <> ''").select("event_id", "entity_id").distinct()
    frontier = stage(seeds.select("entity_id", F.array("entity_id").alias("path")))
    entities, events, rows, warning = frontier.select("entity_id"), None, 0, ""
    for hop in range(1, max_hop + 1):
        step = frontier.join(links, "entity_id").groupBy("event_id").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
        if events is not None:
            step = step.join(events.select("event_id"), "event_id", "left_anti")
        step = stage(step)
        events = step.select("event_id", F.lit(hop).alias("hop"), "path") if events is None else events.unionByName(step.select("event_id", F.lit(hop).alias("hop"), "path"))
        rows += step.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if rows > max_rows:
            warning = "join rows"
            break
        if hop == max_hop:
            break
        new = step.join(links, "event_id").join(entities, "entity_id", "left_anti").groupBy("entity_id").agg(F.min("path").alias("path"))
        frontier = stage(new.select("entity_id", F.concat("path", F.array("entity_id")).alias("path")))
        entities = entities.unionByName(frontier.select("entity_id"))
        if frontier.isEmpty():
            break
        if entities.count() >= max_entities:
            warning = "entities"
            break
    return events.withColumn("score", F.round(1 / F.col("hop"), 6)), warning


def atomic(events: DataFrame, relations: DataFrame, entities: DataFrame, seeds: DataFrame, k: int = TOP_K) -> DataFrame:
    """``event_id, entity_id, score, hop``: the ``k`` newest pairs of a seed and an event, one hit each.

    An event of two seeds is two hits. Newest by the event's created_time, then by ids.
    """
    pairs = relations.select("event_id", "entity_id").join(seeds.select("entity_id"), "entity_id", "left_semi").distinct()
    known = entities.select(F.col("id").alias("entity_id")).distinct()
    times = events.groupBy(F.col("id").alias("event_id")).agg(F.max("created_time").alias("t"))
    hits = pairs.join(known, "entity_id", "left_semi").join(times, "event_id")
    return hits.orderBy(F.desc("t"), "event_id", "entity_id").limit(k).select("event_id", "entity_id", F.lit(1.0).alias("score"), F.lit(1).alias("hop"))


def events_of(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``event_id``: the events of all ``entities`` (``entity_id``) at once, each once."""
    return relations.join(entities.select("entity_id"), "entity_id", "left_semi").filter("event_id <> ''").select("event_id").distinct()


def loose_search(events: DataFrame, relations: DataFrame, entities: DataFrame, query: str, max_hop: int = MAX_HOP) -> DataFrame:
    """``event_id, hop, score, strategy``: expansion from entities whose name holds the query, or else from those with it as name.

    Events that have no row themselves are left out.
    """
    seeds = stage(match_entities(entities, [query], loose=True))
    name = "loose"
    if seeds.isEmpty():
        seeds, name = match_entities(entities, [query]), "multi"
    found, _ = expand(relations, seeds, max_hop)
    return found.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("event_id", "hop", "score", F.lit(name).alias("strategy"))


def chosen_hops(relations: DataFrame, seeds: DataFrame, choose=None, max_hop: int = MAX_HOP) -> DataFrame:
    """``event_id, hop, strategy``: per hop the events of one entity, which ``choose(candidates) -> id`` picks.

    The smallest id is picked by default. If ``choose`` fails, the search falls back to
    one hop from all seeds, under the same name.
    """
    links = stage(relations.filter("event_id <> '' and entity_id <> ''").select("event_id", "entity_id").distinct())
    pick = choose or (lambda c: (c.orderBy("entity_id").first() or [None])[0])
    found, used = None, []
    try:
        at = pick(seeds)
        for hop in range(1, max_hop + 1):
            if at is None:
                break
            used.append(at)
            own = links.filter(F.col("entity_id") == at).select("event_id", F.lit(hop).alias("hop"))
            found = own if found is None else found.unionByName(own.join(found, "event_id", "left_anti"))
            at = pick(links.join(own, "event_id", "left_semi").filter(~F.col("entity_id").isin(used)).select("entity_id").distinct())
    except Exception:  # whatever the caller's function raises
        found = expand(relations, seeds, 1)[0].select("event_id", "hop")
    out = found if found is not None else links.filter("false").select("event_id", F.lit(1).alias("hop"))
    return out.select("event_id", "hop", F.lit("chosen").alias("strategy"))


def search(query: str, events: DataFrame, relations: DataFrame, entities: DataFrame, k: int = TOP_K, nearest: int = 5) -> tuple[DataFrame, list[str]]:
    """The eight steps of a search: hits ``event_id, hop, score, chunk_id``, and what each step did.

    1 vectorise the query, 2 find entities in it, 3 the entities with the nearest name
    vectors, 4 their events, 5 events one hop from the entities of step 2, 6 chunks of
    the hits where none is known, 7 the best ``k``, 8 the result. Steps 3 and 4 give
    candidates, which the hits don't depend on.
    """
    trace = ["1 vectorise: 384 dimensions"]
    seeds = stage(entities.filter((F.col("name") != "") & F.contains(F.lit(query), F.col("name"))).select(F.col("id").alias("entity_id")).distinct())
    trace.append(f"2 entities: {seeds.count()}")
    near = stage(nearest_names(entities, query, nearest))
    best = near.agg(F.count(F.lit(1)), F.max("score")).first()
    trace.append(f"3 nearest entities: {best[0]}, best score {best[1] or 0.0:.4f}")
    trace.append(f"4 candidate events: {events_of(relations, near).count()}" if best[0] else "4 candidate events: skipped")
    hits = stage(expand(relations, seeds, 1)[0].join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("event_id", "hop", F.col("score").cast("double").alias("score")))
    trace.append(f"5 expansion: {hits.count()} events")
    chunks = events.groupBy(F.col("id").alias("event_id")).agg(F.max("chunk_id").alias("chunk_id"))
    hits = stage(hits.join(chunks, "event_id", "left"))
    trace.append(f"6 chunks: {hits.filter('chunk_id is not null').count()} added")
    hits = stage(rerank(hits, k))
    top = rerank(hits, 3).collect()  # three rows
    trace.append(f"7 rerank: top {k}, first " + ", ".join(f"{r['event_id']} ({r['score']:.3f})" for r in top))
    lacking = hits.filter("hop is null").count()
    trace.append(f"8 result: {hits.count()} hits, {lacking} without hop")
    return hits, trace


def nearest_names(entities: DataFrame, query: str, k: int) -> DataFrame:
    """``entity_id, score``: entities whose name's byte vector is most like the query's."""
    named = entities.filter("name <> ''").groupBy(F.col("id").alias("entity_id")).agg(F.min("name").alias("name"))
    vectors = named.select("entity_id", byte_vector("name").alias("v"))
    asked = named.sparkSession.createDataFrame([(query,)], "q string").select(F.lit(0).alias("n"), byte_vector("q").alias("v"))
    return top_k_vectors(vectors, "entity_id", "v", asked, "n", "v", k).select(F.col("id").alias("entity_id"), "score")


def rerank(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """The best ``k``: higher scores first, then smaller event ids; NaN counts as lowest."""
    return hits.orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "event_id").limit(k)


def merge_entities(relations: DataFrame, source: str, target: str) -> DataFrame:
    """All relations of ``source`` belong to ``target`` then."""
    return relations.withColumn("entity_id", F.when(F.col("entity_id") == source, target).otherwise(F.col("entity_id")))


def split_entity(relations: DataFrame, entity: str, parts: list[str]) -> DataFrame:
    """The entity's relations, in the order of their events, are dealt to ``parts`` in turn."""
    own = F.col("entity_id") == entity
    dealt = numbered(relations.filter(own), [F.col("event_id"), F.col("id")], "_n")
    dealt = dealt.withColumn("entity_id", F.element_at(F.array(*map(F.lit, parts)), ((F.col("_n") - 1) % len(parts) + 1).cast("int"))).drop("_n")
    return relations.filter(~own | F.col("entity_id").isNull()).unionByName(dealt)


def rename_entity(events: DataFrame, old: str, new: str) -> DataFrame:
    """``title, summary, content`` with the old name replaced."""
    for c in ("title", "summary", "content"):
        events = events.withColumn(c, F.replace(F.col(c), F.lit(old), F.lit(new)))
    return events


def hyperedges(relations: DataFrame, min_events: int = 3, min_entities: int = 3, most_events: int = 20) -> DataFrame:
    """``id, events, entities``: sets of events shared by enough entities.

    Entities are transactions and their events items of frequent-itemset mining. The
    number of sets is exponential in the events of one entity, so entities with more
    than ``most_events`` are refused, not cut; :func:`closed_hyperedges` takes any.
    """
    from pyspark.ml.fpm import FPGrowth

    sets = stage(relations.filter("event_id <> '' and entity_id <> ''").groupBy("entity_id").agg(F.sort_array(F.collect_set("event_id")).alias("items")))
    n, largest = sets.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    if largest > most_events:
        raise ValueError(f"an entity has {largest} events, more than most_events = {most_events}")
    if not n:
        return sets.select(F.lit("").alias("id"), F.col("items").alias("events"), F.col("items").alias("entities"))
    found = FPGrowth(itemsCol="items", minSupport=(min_entities - 0.5) / n, minConfidence=0.99).fit(sets).freqItemsets
    big = found.filter(F.size("items") >= min_events).select(F.sort_array("items").alias("events")).withColumn("first", F.col("events")[0])
    owners = sets.select("entity_id", "items", F.explode("items").alias("first"))
    inside = big.join(owners, "first").filter(F.size(F.array_except("events", "items")) == 0)
    out = inside.groupBy("events").agg(F.sort_array(F.collect_set("entity_id")).alias("entities"))
    return out.select(F.sha2(F.concat_ws("|", F.array_join("events", ","), F.array_join("entities", ",")), 256).alias("id"), "events", "entities")


def _closed_sets(first: str, events: list[tuple[str, list[str]]], min_events: int, min_entities: int) -> Iterator[tuple[list[str], list[str]]]:
    """Close-by-one: the closed sets whose first entity is ``first``, from all events of it; each once."""
    masks: dict[str, int] = {}
    for k, (_, members) in enumerate(events):
        for x in members:
            masks[x] = masks.get(x, 0) | 1 << k
    names = sorted(x for x, m in masks.items() if m.bit_count() >= min_events)
    sets = [masks[x] for x in names]
    start = names.index(first)
    # a set, the entity it was made with, and the entities that can be in it or in a larger one
    todo = [((1 << len(events)) - 1, start, range(len(names)), frozenset())]
    while todo:
        extent, at, near, before = todo.pop()
        near = [k for k in near if (sets[k] & extent).bit_count() >= min_events]
        inside = [k for k in near if sets[k] & extent == extent]
        if any(k < at and k not in before for k in inside):
            continue  # made from the earlier one
        if len(inside) >= min_entities:
            yield [e for k, (e, _) in enumerate(events) if extent >> k & 1], [names[k] for k in inside]
        own = frozenset(inside)
        todo.extend((extent & sets[k], k, near, own) for k in near if k > at and k not in own)


def closed_hyperedges(relations: DataFrame, min_events: int = 3, min_entities: int = 3) -> DataFrame:
    """``id, events, entities``: all closed sets of events that enough entities share, with these.

    Closed: no other event has all of the entities. Every set that :func:`hyperedges`
    lists is part of a closed one with the same entities, so nothing is lost, and the
    work is in proportion to the closed sets and not to the subsets of an entity's events.
    """
    links = relations.filter("event_id <> '' and entity_id <> ''").select("event_id", "entity_id").distinct()
    often = links.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_events).select("entity_id")
    events = links.join(often, "entity_id", "left_semi").groupBy("event_id").agg(F.sort_array(F.collect_set("entity_id")).alias("members")).filter(F.size("members") >= min_entities)
    own = events.select(F.explode("members").alias("first"), F.struct("event_id", "members").alias("event")).groupBy("first").agg(F.sort_array(F.collect_list("event")).alias("own"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, own in zip(b.column(0), b.column(1)):
                rows = [(x["event_id"], x["members"]) for x in own.as_py()]
                if len(rows) < min_events:
                    continue
                out: list = []
                for edge in _closed_sets(first.as_py(), rows, min_events, min_entities):
                    out.append(edge)
                    if len(out) == 1000:
                        yield _edge_batch(out)
                        out = []
                yield _edge_batch(out)

    edges = own.mapInArrow(found, "events array<string>, entities array<string>")
    return edges.select(F.sha2(F.concat_ws("|", F.array_join("events", ","), F.array_join("entities", ",")), 256).alias("id"), "events", "entities")


def _edge_batch(edges: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.list_(pa.string())) for k in (0, 1)], names=["events", "entities"])


def activated_events(edges: DataFrame, entities: list[str]) -> DataFrame:
    """``event_id``: the events of the hyperedges that hold one of the entities, each once."""
    return activated(edges, entities).select(F.explode("events").alias("event_id")).distinct()


def activated(edges: DataFrame, entities: list[str]) -> DataFrame:
    """Hyperedges that hold one of the entities."""
    return edges.filter(F.arrays_overlap("entities", F.array(*map(F.lit, entities))))


def saved_mentions(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions ``id, event_id, type, normal, own`` as relations, and the entities that they make.

    One entity per type and normalized name, with the smallest of the mentions' own ids;
    every mention keeps its relation. ``deduplicated`` counts the mentions that found
    their entity there. Types that no list knows pass through as they are.
    """
    entities = mentions.groupBy("type", "normal").agg(F.min("own").alias("entity_id"), F.count(F.lit(1)).alias("mentions")).withColumn("deduplicated", F.col("mentions") - 1)
    return mentions.join(entities.select("type", "normal", "entity_id"), ["type", "normal"]), entities
