"""Variant spellings of the names of people and organisations.

Names are parsed into a form without titles, remarks, widths, accents and order; equal
forms are one class. Classes are blocked by token suffixes, each refined with the other
tokens of the name: a suffix is a block only together with a token that matches one of
the other name, so no suffix is too common, and none is dropped without another key that
finds the same pairs. Pairs are compared by the ratio of the longest common subsequence
of their tokens, with short forms, initials, abbreviations and acronyms counting as what
they stand for. Names that give initials only, or no middle name, join a group only if
there is exactly one for them.

Which tokens are given names, which are short for which, and which Chinese characters
get written for which, is learnt from the names themselves (:func:`learn`), over all of
them: a short form stands beside the family names of its full form far more often than
beside those of any other, and a mistaken character hardly ever stands where the same name
isn't also written with the right one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.operators.components import connected_components
from tarnfall.sources.tables import stage

#: Shortest suffix in the index.
SUFFIX = 5
#: Tokens whose longest common subsequence reaches this part of their mean length are
#: spellings of one: about one typing error. The first holds up to six letters.
RATIO, LONG_RATIO = 0.8, 0.85
#: The same for two names beside an equal family name that no list has.
LOOSE_RATIO = 0.75
#: Chinese names of so many characters may differ in one.
HAN_LONG = 7
#: Tokens are compared if they are equal without this many letters of each at most: two typing errors.
LETTERS = 2
#: Tokens of more letters are compared if they begin or end alike.
LONG, ENDS = 30, 10

#: A token is a short form of another if it shares at least so many family names with it,
#: so large a part of its own, and so many times as many as with the next one.
SHORT_SHARED, SHORT_PART, SHORT_LEAD = 4, 0.4, 2
#: Tokens in this part of all names of people, and in so many at least, are given names.
GIVEN_PART, GIVEN_LEAST = 0.005, 5
#: A character is another one's spelling if so large a part of the names with it, and so many, exist with the other, too.
CHARACTER_PART, CHARACTER_LEAST = 0.8, 2
#: Most entries of what is learnt, about 50 bytes each in every Python worker; more are refused.
MOST_LEARNT = 500_000

# Words before, after or beside a name that don't belong to it.
TITLES = "dr prof professor doctor mr mrs ms miss sir dame eng ing dipl phd md jr sr esq hon rev"
# Chinese titles behind a name.
HAN_TITLES = "老师 博士 工程师 先生 女士 教授 主任 经理 总监 总 同学 医生 律师 小姐"
# Kinds of organisation, each with its short forms.
LEGAL = """
corporation corp corpn; company co comp; limited ltd ltda; international intl int; institute inst; association assoc assn; department dept dep;
laboratories laboratory labs lab; group grp; incorporated inc; foundation fdn; university univ; agency agcy; society soc; gmbh; plc; llc; sa; ag
"""
HAN_LEGAL = "股份有限公司 有限责任公司 有限公司 研究院 研究所 公司 集团 协会 大学 院 所"
SMALL_WORDS = "the of and for & de la le und et der die das"
def _table(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for group in text.replace("\n", " ").split(";"):
        words = group.split()
        for w in words:
            out.setdefault(w, []).append(words[0])
    return out


_LEGAL = {w: forms[0] for w, forms in _table(LEGAL).items()}
_TITLES, _SMALL = set(TITLES.split()), set(SMALL_WORDS.split())
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_HAN_TITLE = re.compile("(?:" + "|".join(HAN_TITLES.split()) + ")$")
_HAN_LEGAL = re.compile("(?:" + "|".join(HAN_LEGAL.split()) + ")$")


@lru_cache(maxsize=100_000)
def _masks(token: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(token):
        out[c] = out.get(c, 0) | 1 << k
    return out


@lru_cache(maxsize=500_000)
def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of the lengths; bit-parallel."""
    if a == b:
        return 1.0
    masks, full = _masks(a), (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b)) if a and b else 0.0


def alike(a: str, b: str) -> bool:
    return lcs_ratio(a, b) >= (LONG_RATIO if max(len(a), len(b)) > 6 else RATIO)


def plain(text: str) -> str:
    """Compatibility forms, no accents, lower case."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return unicodedata.normalize("NFC", text).casefold()


class Spellings:
    """What was learnt: given names with the full names they may stand for, and characters with the one they are written for."""

    def __init__(self, given: dict[str, str], characters: dict[str, str]):
        self.given, self.characters = given, characters
        self._near: dict = {}
        for w in given:
            for end in (f"<{w[0]}", f">{w[-1]}"):
                self._near.setdefault((len(w), end), []).append(w)

    def full(self, token: str) -> frozenset[str]:
        if token in self.given:
            return frozenset([self.given[token]])
        if len(token) < 3:
            return frozenset()
        near = {w for n in (-1, 0, 1) for end in (f"<{token[0]}", f">{token[-1]}") for w in self._near.get((len(token) + n, end), ()) if len(w) > 3 or len(token) > 3}
        best = max(((lcs_ratio(token, w), w) for w in near), default=(0, ""))
        return frozenset([self.given[best[1]]]) if best[0] >= (RATIO if len(token) > 5 else LOOSE_RATIO) else frozenset()

    def plain(self, text: str) -> str:
        return "".join(self.characters.get(c, c) for c in text)


_spellings = Spellings({}, {})


def use(spellings: Spellings) -> None:
    """What the functions of this module go by from now on, in this process."""
    global _spellings
    if spellings is not _spellings:
        _spellings = spellings
        given_names.cache_clear()


@lru_cache(maxsize=200_000)
def given_names(token: str) -> frozenset[str]:
    """The full given names that a token may stand for, typing errors included; else none."""
    return _spellings.full(token)


def parse(name: str, entity_type: str | None) -> tuple[str, list[str]]:
    """(kind, tokens): kind is p or o, in Chinese script P or O; tokens sorted where order says nothing.

    No tokens are left of a name without letters.
    """
    text = plain(name)
    if _HAN.search(text):
        remark = re.compile(r"\(([^)]*)\)")
        text = remark.sub(lambda m: m[1] if m[1] in HAN_LEGAL.split() else "", text.replace("（", "(").replace("）", ")"))
        text = "".join(c for c in text if c.isalnum())
        legal = _HAN_LEGAL.search(text)
        if entity_type == "organization" or (entity_type != "person" and legal and len(text) >= 6):
            while (m := _HAN_LEGAL.search(text)) and m.start() > 2:
                text = text[: m.start()]
            return "O", [text]
        while (m := _HAN_TITLE.search(text)) and m.start() > 1:
            text = text[: m.start()]
        return "P", [text] if text else []
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text).replace("'", "").replace("’", "")
    text = re.sub(r"\b((?:\w\.){2,}\w?\b)", lambda m: m[1].replace(".", "") + " ", text) if entity_type != "person" else text
    tokens = [t for t in re.split(r"[\W_]+", text) if t]
    is_org = entity_type == "organization" or (entity_type != "person" and any(t in _LEGAL and len(t) > 2 for t in tokens))
    if is_org:
        tokens = [_LEGAL.get(t, t) for t in tokens if t not in _SMALL]
        return "o", sorted(set(tokens))
    return "p", sorted(t for t in tokens if t not in _TITLES)


def _families(tokens: list[str]) -> list[str]:
    long = [t for t in tokens if len(t) >= 5 and not given_names(t)]
    return [max(long, key=len)] if long else [t for t in tokens if len(t) > 1]


def _refs(kind: str, tokens: list[str], at: int, legal: set[str]) -> set[tuple[str, str, str]]:
    """(tag, value, beside): what a pair with a common suffix of token ``at`` shares besides, if it is to be a variant.

    Such a pair has two matches of tokens, or one and an acronym, and at most one of them
    is of the two tokens with the suffix. A tag tells how a value is compared:
    S, O: token ``at`` or another, alike an O; R: alike an R, loosely; G: equal;
    i, f: initial or full, an i with both; A, L: acronym and long form. ``beside`` is a
    token that has to be alike, too.
    """
    t, others = tokens[at], tokens[:at] + tokens[at + 1 :]
    if kind == "o":
        out = {("S", kind + t, "")} | {("O", kind + x, beside) for x in others for beside in ("", kind + t)}
        if len(others) == 1 and len(others[0]) <= 4:
            out.add(("A", "".join(sorted(others[0])), kind + t))
        letters = [x[0] for x in others]
        return out | {("L", "".join(sorted([*letters, *g])), kind + t) for g in ("", *(x[0] for x in legal))}
    families = _families(tokens)
    out = {("O", kind + x, "") for x in others if x in families}
    if t in families:  # the match may be of the family names, then one of the rest is needed
        out.add(("S", kind + t, ""))
        for x in others:
            given = given_names(x)
            out |= {("G", g, kind + t) for g in given}
            out |= {("i", x, kind + t)} if len(x) == 1 else {("f", c, kind + t) for c in {x[0], *(g[0] for g in given)}}
            if len(x) > 1 and not given:
                out.add(("R", kind + x, kind + t))
    return out


def _keys(kind: str, tokens: list[str]) -> list[tuple[str, str, str, str]]:
    """(suffix, tag, value, beside) of each long token, see :func:`_refs`; a name of one token is its own reference."""
    if kind in "PO":
        t = tokens[0]
        half = len(t) // 2
        # one character in seven may be another: it leaves the first half or the last
        return [(k, tag, kind + t, "") for k in (kind + "<" + t[:half], kind + t[half:]) for tag in "SO"] if len(t) >= HAN_LONG else []
    out = []
    content = [t for t in tokens if t not in _LEGAL] if kind == "o" else tokens
    legal = {t for t in tokens if t in _LEGAL} if kind == "o" else set()
    for at, t in enumerate(content):
        names = given_names(t) if kind == "p" else ()  # a short form is indexed as the name, too
        refs = _refs(kind, content, at, legal) if len(content) > 1 else {("S", kind + t, ""), ("O", kind + t, "")}
        for word in {t, *names} if len(t) >= SUFFIX - 1 else names:
            out += [(kind + word[-SUFFIX:], *r) for r in sorted(refs)]
    return out


def _abbreviates(a: str, b: str) -> bool:
    return len(a) >= 3 and len(a) < len(b) and b.startswith(a)


def _same_organisation(a: list[str], b: list[str]) -> bool:
    la, lb = {t for t in a if t in _LEGAL}, {t for t in b if t in _LEGAL}
    ca, cb = [t for t in a if t not in _LEGAL], [t for t in b if t not in _LEGAL]
    if la and lb and not la & lb:
        return False
    rest_b, rest_a, whole = list(cb), [], 0
    for t in sorted(ca, key=len, reverse=True):
        best = max(((1.0 if t == x else 0.95 if _abbreviates(t, x) or _abbreviates(x, t) else lcs_ratio(t, x), x) for x in rest_b), default=(0.0, ""))
        if best[0] >= 0.95 or (best[1] and alike(t, best[1])):
            rest_b.remove(best[1])
            whole += max(len(t), len(best[1])) >= 6
        else:
            rest_a.append(t)
    if not whole:
        return False
    if not rest_a and not rest_b:
        return True
    short, long, legal = (rest_a, rest_b, lb) if len(rest_a) == 1 and len(rest_a[0]) <= 4 else (rest_b, rest_a, la)
    if len(short) == 1 and len(short[0]) <= 4 and long:  # an acronym of the rest, in any order of words
        letters = sorted(x[0] for x in long)
        return sorted(short[0]) == letters or any(sorted(short[0]) == sorted([*letters, g[0]]) for g in legal)
    return False


#: What two names say: no; yes; yes if no middle name tells otherwise; yes if the initial or
#: short form fits nobody else; the same, with an initial over that the other name lacks.
NO, YES, MIDDLE, INITIAL, LOOSE = range(5)


def _vague(tokens: list[str]) -> bool:
    """Whether no token is a given name of one reading."""
    return not any(len(given_names(t)) == 1 for t in tokens)


def _same_person(a: list[str], b: list[str]) -> int:
    fa, fb = max(a, key=len), max(b, key=len)
    if len(a) < 2 or len(b) < 2:
        return 1 if len(a) == len(b) == 1 and len(fa) > 5 and alike(fa, fb) else 0
    best = max(((lcs_ratio(x, y), x, y) for x in _families(a) for y in _families(b)), default=(0.0, "", ""))
    if not alike(best[1], best[2]):
        return 0
    rest_a, rest_b = list(a), list(b)
    rest_a.remove(best[1])
    rest_b.remove(best[2])
    weak, given = False, False

    def pair(x: str, y: str) -> int:
        if len(x) == 1 or len(y) == 1:
            return int(x[0] == y[0] or any(n[0] in (x, y) for n in given_names(x) | given_names(y)))
        gx, gy = given_names(x), given_names(y)
        if gx and gy:
            return (3 if len(gx) == len(gy) == 1 or gx == gy else 1) if gx & gy else 0
        return 2 if not (gx or gy) and lcs_ratio(x, y) >= LOOSE_RATIO else 0

    while rest_a and rest_b:
        score, x, y = max((pair(x, y), x, y) for x in rest_a for y in rest_b)
        if not score:
            return 0
        rest_a.remove(x)
        rest_b.remove(y)
        if score == 1:
            weak = weak or bool(len(x) == len(y) or given_names(x) or given_names(y) or not (rest_a or rest_b or given))
        else:
            given = True
    if not given:
        weak = True
    left = rest_a or rest_b
    if len(left) > 1 or any(given_names(t) and not given for t in left):
        return 0
    if weak and not given:
        return LOOSE if left and len(left[0]) == 1 else INITIAL
    return MIDDLE if left else YES


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, types, forms = [], [], []
        for i, t, name, normalized in zip(*(b.column(k).to_pylist() for k in range(4))):
            text = name if name and name.strip() else normalized or ""
            kind, tokens = parse(text, t)
            if tokens:
                ids.append(i)
                types.append(t if t in ("person", "organization") else None)
                forms.append(kind + " " + " ".join(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(types, pa.string()), pa.array(forms, pa.string())], names=["id", "type", "written"])


def _short_forms(forms: DataFrame) -> DataFrame:
    """``a, b``: tokens of people's names, and the given name that each is or is short for.

    Tokens that stand together in a name are linked, the one with more partners as given
    name to the one with fewer as family name; so a hub never meets its own links.
    """
    tokens = F.filter(F.split(F.substring("written", 3, 1 << 30), " "), lambda t: F.char_length(t) > 1)
    names = forms.filter("written like 'p %'").select(F.array_distinct(tokens).alias("t")).filter("size(t) > 1")
    total = names.agg(F.count(F.lit(1)).alias("total"))
    both = stage(names.select(F.explode("t").alias("a"), "t").select("a", F.explode("t").alias("b")).filter("a <> b").distinct())
    links = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    linked = both.join(links, "a").join(links.select(F.col("a").alias("b"), F.col("n").alias("m")), "b").filter("n > m or (n = m and a > b)")
    own = linked.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHORT_SHARED)
    kept = stage(linked.select("a", "b").join(own, "a"))
    other = kept.select(F.col("a").alias("c"), "b", F.col("n").alias("m"))
    shared = kept.join(other, "b").filter("a <> c").groupBy("a", "c", "n", "m").agg(F.count(F.lit(1)).alias("s"))
    shared = shared.join(both.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti")  # a full name doesn't stand beside its short form
    ranked = shared.groupBy("a", "n").agg(F.max(F.struct("s", F.col("m"), "c")).alias("x"), F.sort_array(F.collect_list(F.when(F.col("s") * (SHORT_LEAD / SHORT_PART) >= F.col("n"), F.col("s"))), asc=False).alias("all"))
    leads = (F.size("all") < 2) | (F.col("x.s") >= SHORT_LEAD * F.col("all")[1])
    short = ranked.filter((F.col("x.s") >= SHORT_SHARED) & (F.col("x.s") >= SHORT_PART * F.col("n")) & (F.col("x.m") > F.col("n")) & leads).select("a", F.col("x.c").alias("b"))
    often = names.select(F.explode("t").alias("a")).groupBy("a").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one row
    often = often.filter((F.col("n") >= GIVEN_LEAST) & (F.col("n") >= GIVEN_PART * F.col("total"))).select("a", F.col("a").alias("b"))
    return short.unionByName(often)


def _characters(forms: DataFrame) -> DataFrame:
    """``a, b``: Chinese characters that are written for others: the names with the one exist with the other, too."""
    names = forms.filter("written like 'P %' or written like 'O %'").select("written", F.explode(F.sequence(F.lit(3), F.char_length("written"))).alias("k"))
    at = names.select(F.concat(F.expr("left(written, k - 1)"), F.lit("*"), F.expr("substring(written, k + 1)")).alias("rest"), F.expr("substring(written, k, 1)").alias("a")).distinct()
    n = at.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CHARACTER_LEAST)
    at = stage(at.join(n, "a"))
    pairs = at.join(at.select("rest", F.col("a").alias("b"), F.col("n").alias("m")), "rest").filter("m > n").groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("s"))
    best = pairs.groupBy("a", "n").agg(F.max(F.struct("s", "m", "b")).alias("x"))
    return best.filter((F.col("x.s") >= CHARACTER_LEAST) & (F.col("x.s") >= CHARACTER_PART * F.col("n"))).select("a", F.col("x.b").alias("b"))


def _small(pairs: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Of ``a, b``, those that differ and those that don't."""
    rows = pairs.limit(2 * MOST_LEARNT + 1).collect()  # to refuse more, not to use a part
    out = {r[0]: r[1] for r in rows if r[0] != r[1]}, {r[0]: r[1] for r in rows if r[0] == r[1]}
    if max(map(len, out)) > MOST_LEARNT:
        raise ValueError(f"more than MOST_LEARNT = {MOST_LEARNT} spellings were learnt")
    return out


def _resolved(to: dict[str, str]) -> dict[str, str]:
    """Each key with the end of its chain; a chain that runs in a circle ends at its smallest member."""
    out = {}
    for a in to:
        seen = [a]
        while (b := to.get(seen[-1])) and b not in seen:
            seen.append(b)
        out[a] = min(seen[seen.index(b) :]) if b else seen[-1]
    return out


def learn(forms: DataFrame) -> Spellings:
    """Short forms, given names and mistaken characters of all forms (column ``written``)."""
    short, own = _small(_short_forms(forms))
    short = _resolved(short)
    given = own | {b: b for b in short.values()} | short
    return Spellings(given, _resolved(_small(_characters(forms))[0]))


_KEYED = "written string, form string, keys array<struct<key:string,tag:string,value:string,beside:string>>"


def _keyed(spellings):
    """Distinct written forms with the form that they are compared in and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt = spellings.value
        use(learnt)
        for b in batches:
            forms, keys = [], []
            for written in b.column(0).to_pylist():
                kind, text = written[0], written[2:]
                text = learnt.plain(text) if kind in "PO" else text
                forms.append(kind + " " + text)
                keys.append([dict(zip(("key", "tag", "value", "beside"), k)) for k in _keys(kind, text.split(" "))])
            kind = pa.list_(pa.struct([(c, pa.string()) for c in ("key", "tag", "value", "beside")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array(keys, kind)], names=["written", "form", "keys"])

    return run


def _compared(spellings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use(spellings.value)
        yield from map(_verdicts, batches)

    return run


def _verdicts(batch: pa.RecordBatch) -> pa.RecordBatch:
    verdicts, lacks = [], ([], [])
    for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        kind, a, b = x[0], x[2:].split(" "), y[2:].split(" ")
        if kind != y[0]:
            verdict = NO
        elif kind == "p":
            verdict = _same_person(a, b)
        elif kind == "o":
            verdict = YES if _same_organisation(a, b) else NO
        else:
            verdict = YES if lcs_ratio(a[0], b[0]) >= LONG_RATIO else NO
        verdicts.append(verdict)
        for lack, own, other in ((lacks[0], a, b), (lacks[1], b, a)):
            lack.append(_vague(own) if verdict >= INITIAL else len(own) < len(other))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.int32()), *(pa.array(x, pa.bool_()) for x in lacks)], names=["a", "b", "verdict", "lack_a", "lack_b"])


def _most_left_out(n: int, ratio: float) -> int:
    """How many of ``n`` letters a token may have besides those common with one that reaches ``ratio``."""
    return n - ceil(ratio * n / (2 - ratio) - 1e-9)


def _token_keys(token: str, loose: bool) -> list[tuple[str, int]]:
    """Keys of a token after its kind; tokens that are alike or abbreviations meet in one, 0 with 0 or 1 with 2."""
    kind, t = token[0], token[1:]
    n, ratio = len(t), LOOSE_RATIO if loose else RATIO if len(t) <= 6 else LONG_RATIO
    if n > LONG:
        return [(f"{kind}<{t[:ENDS]}", 0), (f"{kind}>{t[-ENDS:]}", 0)]
    out = [(kind + v, 0) for d in range(min(LETTERS, _most_left_out(n, ratio)) + 1) for v in set(map("".join, combinations(t, n - d)))]
    if kind == "o" and n >= 3:
        out += [(f"o<{t}", 1), *((f"o<{t[:k]}", 2) for k in range(3, n))]
    return out


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(k, t, loose, side) for t, loose in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, side in _token_keys(t, loose)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int32()))], names=["key", "token", "loose", "side"])


def _token_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        close, near = [], []
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            p, q = x[1:], y[1:]
            close.append(alike(p, q) or (x[0] == "o" and (_abbreviates(p, q) or _abbreviates(q, p))))
            near.append(lcs_ratio(p, q) >= LOOSE_RATIO)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(close, pa.bool_()), pa.array(near, pa.bool_())], names=["x", "y", "close", "near"])


def _near_tokens(tokens: DataFrame) -> DataFrame:
    """``value, to, close, near``: of ``token, loose``, those that are alike, closely or, at least, loosely."""
    rows = stage(tokens.mapInArrow(_token_rows, "key string, token string, loose boolean, side int"))
    a = rows.filter("side < 2").select("key", F.col("token").alias("a"))
    b = rows.filter("side <> 1").select("key", F.col("token").alias("b"))
    met = a.join(b, "key").filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    found = stage(met.mapInArrow(_token_matches, "x string, y string, close boolean, near boolean").filter("close or near"))
    both = found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"), "close", "near"))
    return both.withColumnsRenamed({"x": "value", "y": "to"})


def blocked_pairs(forms: DataFrame) -> DataFrame:
    """``a < b``: forms with a common suffix of which a reference of one matches one of the other.

    ``forms`` has ``form, keys``. A block is a suffix with a reference, and with a token
    that is alike where the reference says nothing by itself. Organisations agree in all
    words but an acronym, so on one side the rarest word is among those that match: blocks
    of common words, which rarer ones cover, aren't made.
    """
    refs = stage(forms.select("form", F.inline("keys")).distinct())
    tag = F.col("tag")
    tokens = refs.filter(tag.isin("S", "O", "R")).groupBy(F.col("value").alias("token")).agg(F.max(tag == "R").alias("loose"))
    near = _near_tokens(tokens)
    word = refs.filter(tag.isin("S", "O") & F.startswith("value", F.lit("o"))).select("form", "value").distinct()
    rarest = word.join(word.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value").groupBy("form").agg(F.min(F.struct("n", "value"))["value"].alias("rarest"))
    often = refs.filter(tag.isin("S", "O", "R")).groupBy("value").agg(F.count_distinct("form").alias("n"))
    both = near.join(often, "value").join(often.withColumnsRenamed({"value": "to", "n": "m"}), "to")
    up = stage(both.filter("m > n or (m = n and to > value)").select("value", "to", "close"))

    def widened(rows: DataFrame) -> DataFrame:
        """With rows for the more common tokens that the own ones are like; so of two that are alike, both have the more common."""
        more = rows.filter(tag.isin("S", "O", "R")).join(up, "value").filter(F.col("close") | (tag == "R")).withColumn("value", F.col("to"))
        rows = rows.unionByName(more.select(rows.columns))
        more = rows.filter("beside <> ''").join(up.filter("close").select(F.col("value").alias("beside"), "to"), "beside").withColumn("beside", F.col("to"))
        return rows.unionByName(more.select(rows.columns))

    left = widened(refs.filter(~tag.isin("S", "f", "L")).withColumnRenamed("form", "a"))
    right = refs.filter("tag <> 'A'").withColumnRenamed("form", "b").join(rarest.withColumnRenamed("form", "b"), "b", "left")
    right = right.filter(~tag.isin("S", "O") | F.col("rarest").isNull() | (F.col("value") == F.col("rarest")) | (F.col("beside") == F.col("rarest"))).drop("rarest")
    meets = F.when(tag == "S", "O").when(tag == "f", "i").when(tag == "L", "A").otherwise(tag)
    met = left.join(widened(right).withColumn("tag", meets), ["key", "tag", "value", "beside"]).filter("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _only_choice(links: DataFrame, core: DataFrame) -> DataFrame:
    """``a, b``: of the groups of ``core`` and the forms in none, those that lack a part and fit just one other, with that one.

    ``links`` are weak ones between forms; their ``lack_a`` and ``lack_b`` tell which form lacks the part.
    """
    ends = links.filter("lack_a").select("a", "b", "verdict").union(links.filter("lack_b").select(F.col("b").alias("a"), F.col("a").alias("b"), "verdict"))
    for end in ("a", "b"):
        ends = ends.join(core.withColumnRenamed("node", end), end, "left").withColumn(f"g{end}", F.coalesce("component", end)).drop("component")
    loose = F.col("verdict") == LOOSE  # counts only where nothing closer is there
    of = lambda c: (F.count_distinct(F.when(c, F.col("gb"))), F.min(F.when(c, F.col("gb"))))
    (c1, g1), (c2, g2) = of(~loose), of(loose)
    choice = ends.filter("ga <> gb").groupBy("ga").agg(c1.alias("c1"), g1.alias("g1"), c2.alias("c2"), g2.alias("g2"))
    return choice.filter("c1 = 1 or (c1 = 0 and c2 = 1)").select(F.col("ga").alias("a"), F.coalesce("g1", "g2").alias("b"))


def _with_choices(core: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component``: the groups of ``core`` joined up by their only choices.

    A group goes by its smallest form, so the choices are joined up by themselves, and only they.
    """
    chosen = connected_components(_only_choice(links, core))
    nodes = core.unionByName(chosen.select("node", F.col("node").alias("component"))).distinct()
    return nodes.join(chosen.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def name_groups(df: DataFrame, id_column: str = "id", type_column: str = "entity_type_id", name_column: str = "name", normalized_column: str = "normalized_name", spellings: Spellings | None = None) -> DataFrame:
    """``id, type, form, group``: every person or organisation with the group of its name.

    Rows of other types are left out, as are names without letters (null, empty,
    punctuation) and null ids. ``type`` is null where it was ``other`` or null. Repeated
    rows count once; an id with several names is in several groups. ``spellings`` are
    learnt from the rows if not given.
    """
    t = F.col(type_column)
    rows = df.filter((t.isNull() | t.isin("person", "organization", "other")) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("id"), t.alias("t"), F.col(name_column).alias("n"), F.col(normalized_column).alias("m"))
    parsed = stage(rows.mapInArrow(_parsed, "id string, type string, written string"))
    written = parsed.select("written").distinct()
    spellings = rows.sparkSession.sparkContext.broadcast(learn(written) if spellings is None else spellings)
    keyed = stage(written.mapInArrow(_keyed(spellings), _KEYED))
    forms = keyed.groupBy("form").agg(F.first("keys").alias("keys"))
    parsed = parsed.join(keyed.select("written", "form"), "written").select("id", "type", "form")
    verdicts = stage(blocked_pairs(forms).mapInArrow(_compared(spellings), "a string, b string, verdict int, lack_a boolean, lack_b boolean").filter("verdict > 0"))
    named = stage(_with_choices(connected_components(verdicts.filter("verdict = 1")), verdicts.filter(F.col("verdict") == MIDDLE)))
    groups = _with_choices(named, verdicts.filter(F.col("verdict") >= INITIAL))
    return parsed.select("id", "type", "form").distinct().join(groups.withColumnRenamed("node", "form"), "form", "left").select("id", "type", "form", F.coalesce("component", "form").alias("group"))


def variant_pairs(groups: DataFrame) -> DataFrame:
    """``id_a < id_b`` of one group, all pairs; ids typed person never meet ids typed organisation.

    The result is the quadratic part; nothing larger than it is made.
    """
    several = groups.groupBy("group").agg(F.count_distinct("id").alias("n")).filter("n > 1").select("group")
    g = groups.join(several, "group", "left_semi").select("group", "id", "type").distinct()
    h = g.select("group", F.col("id").alias("other"), F.col("type").alias("other_type"))
    agree = F.col("type").isNull() | F.col("other_type").isNull() | (F.col("type") == F.col("other_type"))
    return g.join(h, "group").filter((F.col("id") < F.col("other")) & agree).select(F.col("id").alias("id_a"), F.col("other").alias("id_b")).distinct()
