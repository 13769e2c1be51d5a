"""Nested records, orphan references and hierarchies against small brute-force versions."""

import json
import random

import pytest

from pyspark.sql import functions as F

from tarnfall.operators import components, hierarchy, nested, orphans


def test_links_follow_strings_and_arrays(spark):
    rows = [
        ("a", '{"x":[{"y":[1,{"z":"[{\\"k\\":[{}]}]"}]},[{"w":1}]]}', 1),
        ("a", '{"x":[{"y":[1,{"z":"[{\\"k\\":[{}]}]"}]},[{"w":1}]]}', 1),
        ("b", '"{\\"m\\":[{\\"n\\":null}]}"', 1), ("c", "{bad", 1), ("d", "", 1), ("e", None, 1), ("f", "[NaN,{}]", 1), (None, "[{}]", 1), ("g", "[]", 1),
    ]
    df = spark.createDataFrame(rows, "record_id string, payload string, node_path int")
    got = {tuple(r) for r in nested.element_links(df, "record_id", "payload").collect()}
    assert got == {
        ("a", "$.x[0]", "$"), ("a", "$.x[0].y[1]", "$.x[0]"), ("a", "$.x[0].y[1].z[0]", "$.x[0].y[1]"), ("a", "$.x[0].y[1].z[0].k[0]", "$.x[0].y[1].z[0]"),
        ("a", "$.x[1][0]", "$"), ("b", "$.m[0]", "$"), (None, "$[0]", "$"),
    }
    assert nested.element_links(df.filter("false"), "record_id", "payload").count() == 0


def test_intervals_enclose_exactly_what_paths_do(spark):
    r = random.Random(3)

    def value(d):
        k = r.random()
        return {c: value(d - 1) for c in "abc"[: r.randint(0, 3)]} if d and k < 0.45 else [value(d - 1) for _ in range(r.randint(0, 3))] if d and k < 0.9 else r.choice([1, None, "t", True])

    df = spark.createDataFrame([(str(i), json.dumps(value(6))) for i in range(60)], "id string, j string")
    nodes = nested.node_table(df, "id", "j").cache()
    a = nodes.select("record_id", F.col("node_path").alias("p"), F.col("pre").alias("pre1"), F.col("post").alias("post1"))
    both = nodes.join(a, "record_id").select("node_path", "p", ((F.col("pre1") < F.col("pre")) & (F.col("post1") > F.col("post"))).alias("inside")).collect()
    assert len(both) > 100
    for x in both:
        assert x.inside == (x.node_path != x.p and x.node_path.startswith(x.p) and x.node_path[len(x.p)] in ".[")


def test_very_deep_and_long_numbers():
    deep = "[" * 50_000 + "{}" + "]" * 50_000
    nodes = nested.label_nodes(nested.parse_json(deep))
    assert len(nodes) == 50_001 and [n[0][0] for n in nested.enclosing_cases(nodes)] == [50_000]
    assert nested.parse_json("[" + "9" * 5000 + "]")
    for bad in ("", "{", '{"a":1,}', "NaN", "[1 2]", '{"a" 1}', "1 1", "[1,]", '{"a":}', "]"):
        for parse in (nested.parse_json, nested._parse_deep):
            with pytest.raises(ValueError):
                parse(bad)


def test_flat_tables_link_by_containment(spark):
    df = spark.createDataFrame([("r", '{"m":[{"role":"u","c":[{"id":"1"},{"id":"2"}]},{"role":"v","c":[{"id":"3"}]}]}')], "id string, j string")
    nodes = nested.node_table(df, "id", "j")
    calls, messages = nested.type_table(nodes, "$.m[].c[]", ["id"]), nested.type_table(nodes, "$.m[]", ["role"])
    linked = nested.contained_in(calls, messages).join(messages.select(F.col("pre").alias("parent_pre"), "role"), "parent_pre")
    assert sorted((r.id, r.role) for r in linked.collect()) == [("1", "u"), ("2", "u"), ("3", "v")]


def test_orphans_heavy_and_light(spark):
    import datetime as d

    day = lambda n: d.datetime(2026, 1, n)
    links = [("hot%d" % i, "gone", day(5)) for i in range(3000)] + [("ok%d" % i, "e1", day(5)) for i in range(3000)]
    links += [("late", "e2", day(5)), ("dead", "e3", day(5)), ("dead", "e3", day(5)), ("null", None, day(5)), ("empty", "", day(5)), ("notime", "e2", None), (None, "zz", day(5))]
    refs = spark.createDataFrame(links, "id string, key string, t timestamp")
    events = spark.createDataFrame([("e1", "DONE", day(1), day(1)), ("e2", "DONE", day(9), day(9)), ("e3", "DONE", day(1), day(1)), ("e3", "DELETED", day(1), day(2)), (None, "x", day(1), day(1))], "id string, status string, c timestamp, u timestamp")
    states = orphans.target_state(events, "event", "id", F.col("status") == "DELETED", F.col("c"), F.col("u"))
    r = orphans.references(refs, "rel", "id", {"key": "event"}, F.col("t"), F.date_format("t", "yyyy-MM"))
    found = orphans.orphan_references(r, states)
    got = {(x.row_id, x.reason) for x in found.collect()}
    assert got == {("hot%d" % i, "missing") for i in range(3000)} | {("late", "late"), ("dead", "deleted"), (None, "missing")}
    counts = {(x.reason, x.period): x.orphans for x in orphans.orphan_counts(found).collect()}
    assert counts == {("missing", "2026-01"): 3001, ("late", "2026-01"): 1, ("deleted", "2026-01"): 1}
    assert orphans.orphan_references(r.filter("false"), states).count() == 0
    assert orphans.orphan_references(r, states.filter("false")).select("row_id").distinct().count() == 6004


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_walks(spark, seed):
    r = random.Random(seed)
    parent = {f"n{i}": (f"n{r.randrange(max(1, i - 9), i)}" if i > 1 and r.random() < 0.9 else r.choice([None, "", "nowhere"])) for i in range(1, 200)}
    parent |= {"c1": "c2", "c2": "c3", "c3": "c1", "below": "c2", "below2": "below", "own": "own"}
    parent |= {f"d{i}": f"d{i + 1}" for i in range(60)} | {f"y{i}": f"y{(i + 1) % 17}" for i in range(17)} | {f"z{i}": f"z{i + 1}" for i in range(9)} | {"z9": "y3"}
    rows = [(k, v, 1) for k, v in parent.items()] + [("n5", parent["n5"], 0), (None, "n1", 1)]
    df = spark.createDataFrame(rows, "id string, parent_id string, v int")
    got = {x.id: x for x in hierarchy.resolve(hierarchy.parent_links(df, "id", "parent_id", F.col("v")), True).collect()}
    assert set(got) == set(parent)
    above = {}
    for k in parent:
        path = [k]
        while parent.get(path[0]) in parent and len(path) <= len(parent):
            path.insert(0, parent[path[0]])
        above[k] = path if len(path) <= len(parent) else None
    for k, path in above.items():
        assert (got[k].root_id, got[k].depth, got[k].path) == ((path[0], len(path) - 1, path) if path else ("", -1, None))
        if path:
            assert got[k].subtree_size == sum(1 for p in above.values() if p and k in p)
    pairs = hierarchy.descendants(hierarchy.resolve(hierarchy.parent_links(df, "id", "parent_id", F.col("v")), True)).count()
    assert pairs == sum(len(p) - 1 for p in above.values() if p)


def test_hierarchy_of_a_chain(spark):
    """A chain of 200,000 nodes takes a logarithmic number of rounds."""
    n = 200_000
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.lit(1).alias("v"))
    got = hierarchy.resolve(hierarchy.parent_links(df, "id", "parent_id", F.col("v")))
    right = (F.col("root_id") == "0") & (F.col("depth") == F.col("id").cast("long")) & (F.col("subtree_size") == n - F.col("id").cast("long"))
    assert got.agg(F.count(F.when(right, 1))).first()[0] == got.count() == n


def test_hierarchy_of_nothing(spark):
    df = spark.createDataFrame([], "id string, parent_id string, v int")
    assert hierarchy.resolve(hierarchy.parent_links(df, "id", "parent_id", F.col("v")), True).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    group = {}
    for a, b in edges:
        if a is not None:
            group.setdefault(a, a), group.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            if a is not None and group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                moved = True
    assert got == group
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("chunk", [7, components.CHUNK])
def test_components_of_many_parts(spark, monkeypatch, chunk):
    """Long chains, a hub and self-links, whether one chunk holds all edges or not; in few jobs if one does."""
    monkeypatch.setattr(components, "CHUNK", chunk)
    chains = [(1000 * k + i, 1000 * k + i + 1) for k in range(5) for i in range(60)]
    edges = [*chains, *((9000, 9001 + i) for i in range(60)), (5, 5), (9999, 9999), (None, 8888), (8888, None)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame(edges, "a int, b int").repartition(4)
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = components.connected_components(df)
    taken = jobs() - before
    right = {1000 * k + i: 1000 * k for k in range(5) for i in range(61)} | {9000 + i: 9000 for i in range(61)} | {9999: 9999}
    assert sorted(map(tuple, got.collect())) == sorted(right.items())
    assert chunk == 7 or taken <= 8


def test_json_functions(spark):
    from tarnfall.functions import json as J

    df = spark.createDataFrame([('{"bA":[{"x":1,"y":null},{"x":2,"y":"z"}],"a":1}',), ("bad {",), ("",), (None,), ('say {"k": "}"} now',)], "j string")
    got = [tuple(r) for r in df.select(J.canonical("j"), J.snake_keys("j"), J.first_object("j")).collect()]
    assert got[0][0] == '{"a":1,"bA":[{"x":1,"y":null},{"x":2,"y":"z"}]}' and got[0][1].startswith('{"b_a":')
    assert got[1:4] == [(None, None, None)] * 3 and got[4][2] == '{"k": "}"}'
    assert df.select(J.as_table(F.get_json_object("j", "$.bA"))).first()[0] == "[2]{x,y}:\n  1,null\n  2,z"
