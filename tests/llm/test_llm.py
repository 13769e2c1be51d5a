"""Operators on training text against brute force, exact round trips and edge cases."""

import random
import re
import unicodedata

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarnfall.llm import leaks, mixing, names, neardup, similar, splitting, visual

ZW = chr(0x200B)


def test_consistent_form():
    same = ["The cat, Zoë 12", "Тhе саt, Zoë 12", "Ｔｈｅ cat, Zoë １２", f"The{ZW} cat, Zo­ë 12"]
    assert len({visual.consistent_form(t) for t in same}) == 1
    apart = ["Resume", "resume", "Résumé", "Resume1", "Resume¹", "Resume!", "Resume！"]
    assert len({visual.consistent_form(t) for t in apart}) == len(apart)
    assert visual.consistent_form("Он сказал: Hello") == "Он сказал: Hello"
    assert visual.consistent_form("⼭⽔ ﬁn") == "山水 fin"
    assert visual.consistent_form("") == "" and visual.skeleton("") == ""


def test_forms_depend_on_looks_only():
    r = random.Random(5)
    words = ["Jose", "соре", "граф", "memory", "Axe", "о", "Beta", "ВЕТА", "x1", "Hello"]
    twins = {p[0]: [q[1] for ps in visual.TWINS.values() for q in ps.split() if q[0] == p[0]] + [p[0]] for ps in visual.TWINS.values() for p in ps.split()}
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(6))
        other = "".join(r.choice(twins.get(visual._PROTO.get(c, c), [c])) for c in text)
        assert visual.consistent_form(other) == visual.consistent_form(text)
        assert visual.skeleton(other) == visual.skeleton(text)


def test_visual_twins(spark):
    rows = [(1, "cat"), (2, "cаt"), (3, "cat"), (4, "Cat"), (5, None), (6, ""), (7, ZW), (2, "cаt"), (8, "dog")]
    d = visual.form_digests(spark.createDataFrame(rows, "form long, stored string"), "form", "stored")
    assert {tuple(x) for x in visual.visual_twins(d).collect()} == {(1, 2), (2, 3), (6, 7)}
    assert visual.visual_twins(d.filter("false")).count() == 0
    classes = {(x.id, x.class_id): x.spellings for x in visual.visual_classes(d).collect()}
    assert len(classes) == 7 and sorted(classes.values()) == [1, 1, 2, 2, 2, 2, 2]
    assert [r[1] for r in visual.normalized_texts(spark.createDataFrame([(1, None), (2, "")], "id int, text string"), "id", "text").collect()] == [None, ""]


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 7)))
    items = [(k, "en", " ".join(word() for _ in range(25))) for k in range(12)] + [(90, "en", "short"), (91, "en", None), (92, "fr", "x " * 80), (93, "zh", "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往")]
    docs = []
    for k in range(60):
        t = " ".join(word() for _ in range(30))
        if k % 3 == 0:
            x = items[k % 12][2]
            at = r.randrange(20)
            t = t[:40] + " " + x[at : at + r.randint(40, 110)].upper().replace(" ", ", " + ZW) + " " + t[40:]
        docs.append((k, t))
    docs += [(100, None), (101, ""), (102, "前 天地玄黄，宇宙洪荒。日月盈昃辰宿列张 后"), (0, docs[0][1])]
    d, i = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id long, lang string, text string")
    got = {tuple(x) for x in leaks.leaks(d, i).collect()}
    flat = lambda t: "".join(c for c in leaks._lowered(t) if c.isalnum())
    want = set()
    for n, lang, t in items:
        w = leaks.WIDTHS.get(lang, leaks.OTHER_WIDTH)
        if t:
            grams = {flat(t)[k : k + w] for k in range(len(flat(t)) - w + 1)}
            want |= {(k, n) for k, x in docs if x and any(flat(x)[m : m + w] in grams for m in range(len(flat(x)) - w + 1))}
    assert got == want and (102, 93) in got and len(got) > 5
    clean = leaks.without_leaks(d, i)
    assert leaks.leaks(clean, i).count() == 0
    assert clean.filter("cut_chars > 0").select("doc_id").distinct().count() == len({k for k, _ in got})
    assert leaks.leaks(d.filter("false"), i).count() == leaks.leaks(d, i.filter("false")).count() == 0
    with pytest.raises(ValueError):
        leaks.leaks(d, i, max_gram_chars=10)


def test_pieces_round_trip(spark):
    r = random.Random(8)
    texts = ["x" * 9001, "word " * 3000, "。" * 5000, "á" * 4000, "\n\n" * 4000, "hi.\n\n" + "y" * 1990 + "\n\n" + "z" * 1800, "a" * 2000, "a" * 2001, "", None]
    texts += ["".join(r.choice(["Alpha beta. ", "gamma, ", "\n", "\n\n", "delta" * r.randint(1, 60) + " ", "天地。"]) for _ in range(r.randint(50, 900))) for _ in range(25)]
    df = spark.createDataFrame([(str(k), None, t, 1) for k, t in enumerate(texts)] * 2, "event_id string, chunk_id string, piece string, position int")
    rows = splitting.pieces(df, "event_id", "chunk_id", "piece").orderBy("event_id", "position").collect()
    by = {}
    for x in rows:
        by.setdefault(x.event_id, []).append(x)
    assert set(by) == {str(k) for k, t in enumerate(texts) if t and len(t) > 2000}
    for k, ps in by.items():
        t = texts[int(k)]
        assert [p.position for p in ps] == list(range(len(ps))) and ps[0].start == 0 and ps[-1].end == len(t)
        assert all(len(p.piece) <= 2000 and t[p.start : p.end] == p.piece for p in ps)
        assert all(b.start == a.end - 150 for a, b in zip(ps, ps[1:]))
        assert ps[0].piece + "".join(p.piece[150:] for p in ps[1:]) == t
    assert splitting.split_points("A" * 1500 + ".\n\n" + "B" * 1500, 2000, 150) == [0, 1503]
    with pytest.raises(ValueError):
        splitting.pieces(df, "event_id", "chunk_id", "piece", 100, 90)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = []
    for k in range(120):
        t = [word() for _ in range(r.randint(3, 120))]
        rows.append((f"a{k}", " ".join(t), None))
        for m in range(r.randint(0, 2)):
            u = [w if r.random() > 0.02 * (m + 1) else word() for w in t]
            rows.append((f"a{k}v{m}", ", ".join(u).upper() if m else " ".join(u), "x"))
    rows += [("n1", None, rows[0][1]), ("n2", " \n", rows[0][1]), ("e1", "", ""), ("e2", None, None), ("s1", "abc", None), ("s2", "abc", None), (None, "abcdef", None), rows[3]]
    df = spark.createDataFrame(rows, "id string, text string, c1 string")
    nd = neardup.NearDuplicates(df, "id", ["text", "c1"], similarity=0.7)
    got = {tuple(x) for x in nd.pairs().collect()}
    sets = {}
    for i, a, b in rows:
        t = re.sub(r"[\W_]+", " ", (a if a and a.strip() else b or "").lower()).strip()
        if i and len(t) >= 5:
            sets[i] = {t[k : k + 5] for k in range(len(t) - 4)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50
    groups = {x.id: x for x in nd.groups().collect()}
    assert set(groups) == set(sets)
    assert all(groups[a].group_id == groups[b].group_id for a, b in got)
    assert groups["n1"].class_id == groups["n2"].class_id == groups[rows[0][0]].class_id
    assert neardup.NearDuplicates(df.filter("false"), "id", ["text"]).pairs().count() == 0


def test_signatures_agree_as_often_as_sets():
    r = random.Random(1)
    for n in (12, 60, 3000):
        base = "".join(r.choice("abcdefgh ") for _ in range(n + 5))
        a, b = neardup.normalized([base, base[: int(n * 0.8)] + "z" * int(n * 0.2)])
        hashes, owner = neardup.distinct_shingles(*neardup.shingle_hashes([a, b], 5))
        s = neardup.signatures(hashes, owner, 2, 4000)
        x, y = ({t[k : k + 5] for k in range(len(t) - 4)} for t in (a, b))
        assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_large_nodes_are_dealt_in_blocks(spark, monkeypatch):
    """A node of many paths gives the same pairs, whatever the size of the blocks, at every level."""
    r = random.Random(9)
    rows = [(h, r.choice([0, 1, 1 << 40, 7 << 24]) << 8 | r.choice([60, 61, 64]), 1000 * h + k) for h, m in ((1, 57), (2, 1), (3, 7), (4, 200)) for k in range(m)]
    df = spark.createDataFrame(rows, "head long, tail long, c1 long")
    for level in (0, 1):
        want = {}
        for h, t, c in rows:
            for g, u, d in rows:
                n = next((k for k in range(neardup.LEVELS) if (t >> 40 - 16 * k) & 0xFFFF != (u >> 40 - 16 * k) & 0xFFFF), neardup.LEVELS)
                if h == g and c < d and abs((t & 255) - (u & 255)) <= 2 and (n >= 1 if level else n == 0):
                    want[c, d] = n
        for run in (5, 40, 1000):
            monkeypatch.setattr(neardup, "RUN", run)
            assert {(x.c1, x.d1): x.n for x in neardup.trie_pairs(df, 2, level).collect()} == want


def test_bins_rule_out_no_similar_pair(spark):
    import pyarrow as pa

    r = random.Random(4)
    texts = ["".join(r.choice("abcdefghij ") for _ in range(n)) for n in (8, 300, 300, 9000, 40000)]
    texts += [t[: int(len(t) * f)] for t in texts for f in (0.9, 0.75, 0.5)]
    table = pa.table({"id": [str(k) for k in range(len(texts))], "text": texts})
    codes = {}

    class Source:
        def select(self, *_):
            return self

        filter = select

        def mapInArrow(self, f, _):
            for b in f(iter(table.to_batches())):
                codes.update({i: (s, x) for i, s, x in zip(*(b.column(k).to_pylist() for k in (0, 3, 4)))})

    neardup.coded(Source(), "id", ["text"], 5, 26, 5)
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in neardup.normalized(texts)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if str(a) in codes and str(b) in codes]
    columns = list(zip(*[(a, b, 0, *codes[str(a)], *codes[str(b)]) for a, b in pairs]))
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list("abcdefg"))
    kept = {(x["c1"], x["d1"]) for b in neardup._possible(0.7)(iter([batch])) for x in b.to_pylist()}
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert near <= kept and len(near) >= 8 and len(kept) < len(pairs)


def test_similar_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    vectors = np.concatenate([centres[k % 12] + rng.standard_normal(32) * rng.choice([0.05, 0.6]) for k in range(900)]).reshape(-1, 32).astype(np.float32)
    vectors[700:740] = vectors[0] * 2  # a hot group of equal directions
    rows = [(f"h{k:04d}", "m", v.tolist(), 32, 1) for k, v in enumerate(vectors)] + [(f"q{k}", "n", rng.standard_normal(8).tolist(), 8, 1) for k in range(4)]
    rows += [("h0001", "m", vectors[5].tolist(), 32, 0), ("bad1", "m", None, 32, 1), ("bad2", "m", [0.0] * 32, 32, 1), ("bad3", "m", [float("nan")] * 32, 32, 1), ("bad4", "m", [1.0], 32, 1), ("bad5", "m", [float("inf")] * 32, 32, 1), (None, "m", [1.0] * 32, 32, 1), rows[2]]
    df = spark.createDataFrame(rows, "content_hash string, model string, embedding array<float>, dim int, ts long")
    monkeypatch.setattr(similar, "SHARD", 150)
    monkeypatch.setattr(similar, "QUERIES", 100)
    usable = similar.usable_vectors(df)
    assert usable.count() == 904
    got = {}
    for x in similar.most_similar(usable, 5, probes=16).collect():
        got.setdefault((x.model, x.hash), []).append((x.place, x.other))
    units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    hit = 0
    for k in range(900):
        s = np.round(units @ units[k], 6)
        s[k] = -9
        want = [f"h{j:04d}" for j in np.argsort(-s, kind="stable")[:5]]
        hit += len(set(want) & {o for _, o in got[("m", f"h{k:04d}")]})
    assert hit / 4500 > 0.95
    assert [o for _, o in sorted(got[("m", "h0710")])] == ["h0000", "h0700", "h0701", "h0702", "h0703"]
    assert all(len(got[("n", f"q{k}")]) == 3 for k in range(4))
    assert similar.most_similar(usable.filter("false")).count() == 0


def test_budgets_pour_to_siblings_first():
    leaves = [{"path": ("a", "en", "x"), "weight": 0.4, "capacity": 10}, {"path": ("a", "en", "y"), "weight": 0.2, "capacity": 100}, {"path": ("b", "en", "z"), "weight": 0.4, "capacity": 100}]
    mixing.budgets(leaves, 100)
    assert [round(x["got"], 6) for x in leaves] == [10, 50, 40]
    mixing.budgets(leaves, 300)
    assert [round(x["got"], 6) for x in leaves] == [10, 100, 100]
    mixing.budgets([], 5)


def test_mix_meets_shares(spark):
    r = random.Random(6)
    docs = [(k, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.randint(5, 60))), s, r.choice(["en", "de", None])) for k, s in enumerate(r.choices(["x", "y", "z", None, "other"], [60, 30, 4, 3, 3], k=1500))]
    docs += [(5000, None, "x", "en"), (5001, "", "y", "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    t = spark.createDataFrame([("x", 0.5, 1), ("y", 0.3, 2), ("z", 0.15, 5), ("none", 0.05, 3)], "source string, target_share double, max_repeats int")
    for total in (None, 8000, 60_000):
        m = mixing.Mix(d, t, total_tokens=total, domains={"x": "a", "y": "a", "z": "b", "none": "b"})
        rows = {x.source: x for x in m.shares().collect()}
        chosen = m.chosen.collect()
        assert all(1 <= x.repeats <= {"x": 1, "y": 2, "z": 5}[x.source] and x.tokens > 0 for x in chosen)
        assert len({x.id for x in chosen}) == len(chosen) and abs(sum(x.actual_share for x in rows.values()) - 1) < 1e-4
        if total != 60_000:
            assert abs(sum(x.tokens for x in rows.values()) - m.total_tokens) < 0.03 * m.total_tokens
            assert abs(rows["x"].actual_share - 0.5) < 0.08 and abs(rows["y"].actual_share - 0.3) < 0.08
    assert {(x.id, x.repeats) for x in mixing.Mix(d, t).chosen.collect()} == {(x.id, x.repeats) for x in mixing.Mix(d, t).chosen.collect()}
    empty = mixing.Mix(d.filter("false"), t)
    assert empty.chosen.count() == 0 and all(x.tokens == 0 and x.actual_share == 0 for x in empty.shares().collect())


def test_near_duplicates_of_repetitive_texts(spark):
    r = random.Random(6)
    rows = []
    for k in range(30):
        passage = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
        rows += [(f"{k}a", passage * 20 + passage[:4]), (f"{k}b", passage + passage[:4])]  # the same 60 shingles
    found = {tuple(x) for x in neardup.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id", ["text"]).pairs().collect()}
    assert found == {(f"{k}a", f"{k}b") for k in range(30)}


SPELLINGS = names.Spellings({"joseph": "joseph", "josephine": "josephine", "fred": "frederick", "frederick": "frederick", "dan": "daniel", "daniel": "daniel", "bill": "william", "william": "william"}, {"兰": "岚"})


def _verdicts(spark, rows):
    """Forms with their suffixes, and the pairs that the blocks find with their verdicts."""
    shared = spark.sparkContext.broadcast(SPELLINGS)
    names.use(SPELLINGS)
    forms = {k + " " + " ".join(t): {x[0] for x in names._keys(k, t)} for k, t in (names.parse(n, e) for n, e in rows) if t}
    df = spark.createDataFrame([(f,) for f in forms], "written string").mapInArrow(names._keyed(shared), names._KEYED)
    got = names.blocked_pairs(df).mapInArrow(names._compared(shared), "a string, b string, verdict int, lack_a boolean, lack_b boolean").filter("verdict > 0").select("a", "b", "verdict").collect()
    return forms, {tuple(x) for x in got}


def test_names_of_a_common_block(spark):
    r = random.Random(3)
    surnames = {"jal" + "".join(r.choice("bdfgkmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(100)}
    rows = [(f"Daniel {s}", "person") for s in surnames] + [("Daniel Jalehalel", "person"), ("Daniel Jalehaell", "person")]
    _, got = _verdicts(spark, rows)
    assert ("p daniel jalehaell", "p daniel jalehalel") in {x[:2] for x in got}


def test_name_pairs_against_all_with_a_common_suffix(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("bdklmnrst") + r.choice("aeio") for _ in range(n))

    def typo(s):
        k = r.randrange(1, len(s) - 1)
        return r.choice([s[:k] + s[k + 1 :], s[:k] + "e" + s[k:], s[:k] + s[k + 1] + s[k] + s[k + 2 :], s[:k] + "o" + s[k + 1 :]])

    rows = []
    for family, given in [(word(4), r.choice(["Daniel", "Dan", "William", "Bill", word(3)])) for _ in range(40)] + [("Durelejin", word(3)) for _ in range(30)]:
        middle = r.choice(["", "", word(3), "k"])
        for f, g in ((family, given), (typo(family), given), (family, given[0]), (family, typo(given)), (typo(typo(family)), given), ("Durelejin", given)):
            rows.append((f"{g} {middle} {f}", "person"))
    for _ in range(40):
        w = [r.choice(["Systems", "Research", "Ecosystems"]), word(4), word(3), r.choice(["Administration", word(7)])]
        for x in (w, [w[0], typo(w[1]), *w[2:]], [w[0], w[1], w[2], w[3][:5]], [w[0], "".join(v[0] for v in w[1:])], [typo(w[0]), *w[1:]], w[:2], [w[0], typo(w[1])]):
            rows.append((" ".join([*x, r.choice(["", "Ltd"])]), "organization"))
    suffixes, found = _verdicts(spark, rows)
    same = {"p": names._same_person, "o": lambda a, b: int(names._same_organisation(a, b))}
    truth = {(a, b, v) for a in suffixes for b in suffixes if a < b and a[0] == b[0] and suffixes[a] & suffixes[b] and (v := same[a[0]](a[2:].split(" "), b[2:].split(" ")))}
    assert found <= truth and len(truth) > 300
    far = [(a, b) for a, b, _ in truth - found]  # only what differs in more letters than is looked for
    assert len(far) < 0.01 * len(truth), far


def test_names(spark):
    rows = [
        ("1", "person", "Frederick Bidifumis", None, 0), ("2", "person", "  BIDIFUMIS, Fred ", "", 0), ("3", "other", "Ｆ. Bidifumis", "f. bidifumis", 0), ("4", "person", "Frederik Bidífumis (new)", "x", 0),
        ("5", "person", "Josephine Bidifumis", None, 0), ("6", "person", "Joseph Bidifumis", None, 0), ("7", "person", "J. Bidifumis", None, 0), ("8", "product", "Frederick Bidifumis", None, 0),
        ("9", "organization", "Misonaheth Textile Dyes Laboratories", None, 0), ("10", "organization", "Misonaheth TDL", None, 0), ("11", None, "Textile Dyes Labs, Misonaheth", None, 0), ("12", "organization", "Misonaheth Robotics Institute", None, 0),
        ("13", "person", "坝尾岚岚", None, 0), ("14", "person", "坝尾 兰岚博士", None, 0), ("15", "person", None, None, 0), ("16", "person", "...", "", 0), (None, "person", "Frederick Bidifumis", None, 0),
        ("1", "person", "Frederick Bidifumis", None, 0), ("17", "person", None, "frederick bidifumis", 0), ("18", "person", "Q" * 5000, None, 0),
    ]
    df = spark.createDataFrame(rows, "id string, entity_type_id string, name string, normalized_name string, form int")
    got = {tuple(x) for x in names.variant_pairs(names.name_groups(df, spellings=SPELLINGS)).collect()}
    groups = [{"1", "2", "3", "4", "17"}, {"9", "10", "11"}, {"13", "14"}]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}
    assert names.variant_pairs(names.name_groups(df.filter("false"))).count() == 0


def test_short_forms_and_characters_are_learnt(spark):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("bdklmnrst") + r.choice("aeio") for _ in range(n))
    given = {"margaret": ["peggy", "meg"], "robert": ["bob"], "ulrika": [], "oliver": ["ollie"], "edward": []}
    forms = set()
    for _ in range(400):
        family = word(4)
        for head in r.sample(sorted(given), r.choice([1, 1, 1, 2])):  # relatives share a family name
            forms.add(f"p {' '.join(sorted([head, family]))}")
            forms |= {f"p {' '.join(sorted([short, family]))}" for short in given[head] if r.random() < 0.3}
            if r.random() < 0.2:
                forms.add(f"p {' '.join(sorted([head, family, 'vinox']))}")
    for _ in range(300):
        name = "".join(r.choice("岚旻桐箴颂黛霏") for _ in range(4))
        forms.add("P " + name)
        if r.random() < 0.2 and "岚" in name:
            forms.add("P " + name.replace("岚", "兰", 1))
    got = names.learn(spark.createDataFrame([(f,) for f in sorted(forms)], "written string"))
    assert {a: b for a, b in got.given.items() if a != b} == {"peggy": "margaret", "meg": "margaret", "bob": "robert", "ollie": "oliver"}
    assert set(given) <= set(got.given) and got.characters == {"兰": "岚"}
    nothing = names.learn(spark.createDataFrame([], "written string"))
    assert nothing.given == {} and nothing.characters == {}


def test_lcs_ratio_against_table():
    r = random.Random(9)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert abs(names.lcs_ratio(a, b) - 2 * t[-1][-1] / (len(a) + len(b))) < 1e-12


def test_names_take_few_jobs(spark):
    """The driver keeps something of each job, so a small table's names must not take many."""
    rows = [(str(i), "person", f"{given} {family}") for i, (given, family) in enumerate((g, f) for f in ("Bidifumis", "Konarelot", "Misonaheth") for g in ("Frederick", "Fred", "F.", "Frederick J."))]
    df = spark.createDataFrame(rows, "id string, entity_type_id string, name string").withColumn("normalized_name", F.lit(None).cast("string"))
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    got = names.name_groups(df)
    taken = jobs() - before
    assert got.count() == len(rows) and taken <= 78
