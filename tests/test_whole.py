"""Queries over whole tables, against brute force on small ones."""

import random
from itertools import combinations

import pytest

from tarnfall.operators import multihop as H
from tarnfall.plans import relational, text
from tarnfall.streaming import queries as S


def _relations(spark, links):
    return spark.createDataFrame(sorted(links), "event_id string, entity_id string")


def test_closed_hyperedges(spark):
    r = random.Random(2)
    links = {(f"v{e:02}", f"x{r.randrange(8)}") for e in range(40) for _ in range(5)} | {(f"v{e:02}", "x0") for e in range(40)}
    of = {x: {e for e, y in links if y == x} for _, x in links}
    assert max(map(len, of.values())) > 20  # which hyperedges() refuses
    truth = set()
    for n in range(3, len(of) + 1):
        for xs in combinations(sorted(of), n):
            events = set.intersection(*(of[x] for x in xs))
            if len(events) >= 3:
                truth.add((tuple(sorted(events)), tuple(sorted(x for x in of if events <= of[x]))))
    got = [(tuple(x.events), tuple(x.entities)) for x in H.closed_hyperedges(_relations(spark, links)).collect()]
    assert len(got) == len(set(got)) and set(got) == truth and len(truth) > 20


def test_closed_hyperedges_stand_for_all(spark):
    r = random.Random(3)
    rel = _relations(spark, {(f"v{r.randrange(9)}", f"x{r.randrange(7)}") for _ in range(45)})
    closed = {tuple(x.entities): set(x.events) for x in H.closed_hyperedges(rel).collect()}
    every = H.hyperedges(rel).collect()
    assert every and all(set(x.events) <= closed[tuple(x.entities)] for x in every)
    assert {tuple(x.entities) for x in every} == set(closed)
    assert H.closed_hyperedges(rel.filter("false")).count() == 0


NAMES = ["Zoë Müller", "ＡＢＣ Ｌｔｄ", "王小明 老师", "Иван Петров", "O’Neil — Co", "Plain Name", "  Ärzte  ", "…", "", "é" * 80, None, "😀 ok", "Straße 7"]


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def _entities(spark, folder):
    rows = [(str(k), n, m) for k, (n, m) in enumerate(zip(NAMES, ["zoe müller", "abc ltd", "王小名", "иван петров", "o'neil - co", "plain name", "ärzte", "...", "", "e" * 80, "x", None, "strasse 7"]))]
    spark.createDataFrame(rows, "id string, name string, normalized_name string").write.parquet(f"{folder}/entity.parquet")
    return rows


def test_edit_distance_of_all_names(spark, tmp_path):
    rows, want = _entities(spark, tmp_path), {}
    for i, n, m in rows:
        if n is not None and m is not None:
            a, b = " ".join(n.split()), " ".join(m.split())
            d = _levenshtein(a, b) / max(len(a), len(b), 1)
            want[i] = (round(d, 6), d < 0.2)
    assert {x.id: (x.distance, x.same) for x in text.t3_edit_distance(spark, str(tmp_path)).collect()} == want and len(want) == 11


def test_slug_of_all_names(spark, tmp_path):
    rows, want = _entities(spark, tmp_path), {}
    for i, n, _ in rows:
        if n is not None:
            s = "".join((c.lower() if c.isascii() else c) if c.isalnum() else "-" for c in n)
            want[i] = "-".join(x for x in s.split("-") if x)[:60] or "memory"
    assert {x.id: x.slug for x in text.t22_slug(spark, str(tmp_path)).collect()} == want and len(want) == 12


def test_terms_of_every_script(spark, tmp_path):
    rows = [(1, 20, "La qualité du café, 知识图谱 与检索。"), (2, 10, "память и QUALITÉ `x y` this"), (3, None, "知识图谱 https://a.b/c память память"), (3, None, "知识图谱"), (4, 5, None), (5, 7, "")]
    spark.createDataFrame(rows, "doc_id long, created_time long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.term: (x.documents, x.first_seen, x.last_seen) for x in relational.a8_all_terms(spark, str(tmp_path)).collect()}
    once = lambda t: (1, t, t)
    assert got == {"qualité": (2, 10, 20), "café": once(20), "知识图谱": (2, 20, 20), "与检索": once(20), "память": (2, 10, 10), "x y": once(10), "https://a.b/c": once(None), "https": once(None)}
    ids: dict = {}
    for x in relational.a8_term_documents(spark, str(tmp_path)).orderBy("term", "place").collect():
        ids.setdefault(x.term, []).append((x.place, x.doc_id))
    assert ids["qualité"] == [(1, 2), (2, 1)] and ids["知识图谱"] == [(1, 1), (2, 3)] and ids["память"] == [(1, 2), (2, 3)]
    assert {t: len(v) for t, v in ids.items()} == {t: v[0] for t, v in got.items()}


def test_blocks_and_tags_of_whole_texts(spark, tmp_path):
    docs = [(1, "a <thinking>one\ntwo</thinking> b <thinking stage='x'>three</thinking> c"), (2, "<p>Tom &amp; <b>Ann</b></p><script>x<y</script>end"), (3, "<thinking>open"), (4, None)]
    memories = [("m1", '{"text": "<thinking>four</thinking>"}'), ("m1", '{"text": "<thinking>four</thinking>"}'), ("m2", None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(memories, "id string, payload string").write.parquet(f"{tmp_path}/memory_l0_raw.parquet")
    got = sorted(tuple(x) for x in text.t14_thinking_found(spark, str(tmp_path)).collect())
    assert got == [("documents", "1", 0, "", "one\ntwo"), ("documents", "1", 1, "x", "three"), ("memory_l0_raw", "m1", 0, "", "four")]
    plain = {x.doc_id: x.plain for x in text.t18_plain_texts(spark, str(tmp_path)).collect()}
    assert plain == {1: "a one\ntwo b three c", 2: "Tom & Ann\nend", 3: "open", 4: None}


def _file(spark, folder, rows):
    spark.createDataFrame(rows, "k string, at string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _streamed(spark, folder):
    return spark.readStream.schema("k string, at string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_idle_sessions(spark, tmp_path):
    _file(spark, tmp_path, [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:30:00"), ("a", "2024-01-01 05:00:00")])
    _file(spark, tmp_path, [("c", "2024-01-02 00:00:00")])  # moves the watermark over the others' ends
    found = S.run_once(spark, S.idle_sessions(_streamed(spark, tmp_path), "at", "k"), f"{tmp_path}/checkpoint", f"{tmp_path}/sink").collect()
    assert sorted((x.k, str(x.started), str(x.ended), x.events) for x in found) == [
        ("a", "2024-01-01 00:00:00", "2024-01-01 03:00:00", 2),
        ("a", "2024-01-01 05:00:00", "2024-01-01 07:00:00", 1),
        ("b", "2024-01-01 00:30:00", "2024-01-01 02:30:00", 1),
    ]  # c may go on


def test_cursor_batches(spark, tmp_path):
    seen: list = []

    def failing(df, n):
        raise RuntimeError("not applied")

    def kept(df, n):
        seen.append((n, sorted(x.k for x in df.collect())))

    run = lambda f: S.cursor_batches(_streamed(spark, tmp_path), f"{tmp_path}/checkpoint", f)
    _file(spark, tmp_path, [("a", ""), ("b", "")])
    with pytest.raises(Exception, match="not applied"):
        run(failing)
    run(kept)
    assert seen == [(0, ["a", "b"])]  # what failed comes again, under its number
    _file(spark, tmp_path, [("c", "")])
    run(kept)
    run(kept)
    assert seen == [(0, ["a", "b"]), (1, ["c"])]


def test_unreadable_batches_are_passed_over(spark, tmp_path):
    tries: list = []

    def bad(df, n):
        tries.append(n)
        raise S.BadBatch

    run = lambda f: S.cursor_batches(_streamed(spark, tmp_path), f"{tmp_path}/checkpoint", f)
    _file(spark, tmp_path, [("a", "")])
    run(bad)
    assert tries == [0, 0, 0]
    _file(spark, tmp_path, [("b", "")])
    run(S.numbered_writer(f"{tmp_path}/out"))
    assert [r.k for r in spark.read.parquet(f"{tmp_path}/out/*").collect()] == ["b"]
