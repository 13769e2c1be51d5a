"""One consistent form for texts that look the same.

Three steps, each on one text alone:

1. Characters that can't be seen go; spaces of any kind become a space; wide, narrow and
   ligature forms of letters and digits, and radical signs, become the plain letters.
   Forms that a reader can tell apart (superscripts, circled digits, punctuation) stay.
2. Combining marks are composed (NFC).
3. Look-alike letters: the scripts in which each letter of a token could be written are
   intersected over the token. One script left: the token gets its spelling. Several
   left (every letter has a twin): the script that prevails among the text's
   unmistakable letters decides. None left (truly mixed): the unmistakable letters stay
   and the others follow their majority.

Only letters without twins decide anything, and those are the same in all texts that
look the same; so such texts get the same form.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfall.sources.tables import stage

# Letters of other scripts that look like a Latin letter, as pairs.
TWINS = {
    "Cyrillic": "aа cс eе iі jј oо pр sѕ xх yу dԁ hһ qԛ wԝ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ GԌ QԚ WԜ",
    "Greek": "oο jϳ cϲ AΑ BΒ EΕ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ XΧ YΥ ZΖ JͿ CϹ",
    "Armenian": "oօ hհ nո uս gց qզ OՕ SՏ LԼ UՍ",
}
# Characters that take no room in print, besides the format characters (Cf).
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
# Format characters that do print a sign of their own.
SEEN_FORMAT = "؀؁؂؃؄؅۝܏࢐࢑࣢"

_PROTO = {pair[1]: pair[0] for pairs in TWINS.values() for pair in pairs.split()}
_SPELL = {"Latin": {pair[0]: pair[0] for pairs in TWINS.values() for pair in pairs.split()}} | {s: {p[0]: p[1] for p in pairs.split()} for s, pairs in TWINS.items()}
_SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
_PLAIN_FORMS = ("<wide>", "<narrow>", "<compat>", "<isolated>", "<initial>", "<medial>", "<final>", "<vertical>")


def _form(o: int) -> str | None:
    """What the character o becomes in step 1; None if it stays."""
    ch = chr(o)
    kind = unicodedata.category(ch)
    if ch in UNSEEN or (kind == "Cf" and ch not in SEEN_FORMAT) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF:
        return ""
    if kind == "Cc":
        return None if ch in "\n\r" or ch == " " else " " if ch == "\t" else "\n" if ch == "\x85" else ""
    if kind == "Zs":
        return None if ch == " " else " "
    if kind in ("Zl", "Zp"):
        return "\n"
    tag, _, _ = unicodedata.decomposition(ch).partition(" ")
    if tag in _PLAIN_FORMS and ch != "ſ" and ch != "ﬅ" and not 0x3D0 <= o <= 0x3FF:
        plain = unicodedata.normalize("NFKC", ch)
        if all(unicodedata.category(c)[0] in "LNM" for c in plain) and not (kind == "No" or unicodedata.category(plain[0]) == "Mn"):
            return plain
    return None


@lru_cache(maxsize=1)
def _tables() -> tuple[re.Pattern, dict[str, str]]:
    forms = {chr(o): f for o in range(sys.maxunicode + 1) if not 0xD800 <= o <= 0xDFFF and not (0x4E00 <= o <= 0x9FFF or 0xAC00 <= o <= 0xD7A3) and (f := _form(o)) is not None}
    spans, points = [], sorted(map(ord, forms))
    for o in points:
        if spans and spans[-1][1] == o - 1:
            spans[-1][1] = o
        else:
            spans.append([o, o])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"), forms


_OTHER_SCRIPT = re.compile("[Ͱ-֏ᲀ-᲏ἀ-῿ⷠ-ⷿꙀ-ꚟ]")
_TOKEN = re.compile("[A-Za-zªµºÀ-֏ᲀ-᲏ᴀ-῿Ⱡ-Ɀⷠ-ⷿꙀ-ꚟ꜠-ꟿ0-9]+")


def plain_forms(text: str) -> str:
    """Steps 1 and 2."""
    if text.isascii() and text.isprintable():
        return text
    pattern, forms = _tables()
    text = pattern.sub(lambda m: forms[m[0]], text.replace("\r\n", "\n").replace("\r", "\n"))
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=200_000)
def _script(ch: str) -> str | None:
    if not ch.isalpha():
        return None
    name = unicodedata.name(ch, "")
    return next((s for s in _SCRIPTS if name.startswith(s.upper())), None)


@lru_cache(maxsize=100_000)
def _resolve(token: str) -> tuple[str, frozenset, tuple]:
    """The token's letters as prototypes (decomposed), its possible scripts, its unmistakable letters by script."""
    out, scripts, own = [], set(_SCRIPTS), Counter()
    for ch in unicodedata.normalize("NFD", token):
        proto = _PROTO.get(ch, ch)
        out.append(proto)
        s = _script(ch)
        if s is None:
            continue
        if proto in _SPELL["Latin"]:
            scripts &= {x for x in _SCRIPTS if proto in _SPELL[x]}
        else:
            scripts &= {s}
            own[s] += 1
    return "".join(out), frozenset(scripts), tuple(own.items())


def consistent_form(text: str) -> str:
    """The one form of all texts that look like ``text``; steps 1 to 3."""
    text = plain_forms(text)
    if not _OTHER_SCRIPT.search(text):
        return text
    counts: Counter = Counter()
    for token in _TOKEN.findall(text):
        for s, n in _resolve(token)[2]:
            counts[s] += n
    prevailing = sorted(_SCRIPTS, key=lambda s: (-counts[s], _SCRIPTS.index(s)))

    def spell(m: re.Match) -> str:
        proto, scripts, own = _resolve(m[0])
        if scripts:
            script = next(s for s in prevailing if s in scripts)
        else:
            most = dict(own)
            script = max(most, key=lambda s: (most[s], -prevailing.index(s)))
        letters = _SPELL[script]
        return unicodedata.normalize("NFC", "".join(letters.get(c, c) for c in proto))

    return _TOKEN.sub(spell, text)


def skeleton(text: str) -> str:
    """Every letter that has a Latin twin as that twin: equal for texts of equal consistent form.

    Unlike the consistent form it doesn't look at neighbours, so a passage's skeleton is
    the same wherever it stands.
    """
    text = plain_forms(text)
    if not _OTHER_SCRIPT.search(text):
        return text
    return unicodedata.normalize("NFC", "".join(_PROTO.get(c, c) for c in unicodedata.normalize("NFD", text)))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def normalized_texts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id_column, text``: every text in its consistent form; null stays null, empty stays empty."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else consistent_form(t) for t in b.column(1).to_pylist()], pa.string())], names=[id_column, "text"])

    return df.select(F.col(id_column), F.col(text_column)).mapInArrow(run, f"`{id_column}` {kind}, text string")


def form_digests(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, form, stored``: 128-bit digests of each text's consistent form and of the text as stored.

    Rows without a text are left out. Only digests leave the scan's tasks.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_digest(consistent_form(t)) for t in texts], pa.binary()), pa.array([_digest(t) for t in texts], pa.binary())], names=["id", "form", "stored"])

    return df.select(F.col(id_column), F.col(text_column)).filter(F.col(text_column).isNotNull()).mapInArrow(run, f"id {kind}, form binary, stored binary")


def visual_twins(digests: DataFrame) -> DataFrame:
    """Pairs ``id_a < id_b`` whose texts look the same although they are stored differently.

    Works on the distinct stored texts of each form, of which forms with one are dropped
    first; copies of one stored text meet only in the last join, which makes nothing but
    result rows. Repeated ids give each pair once; an id is never paired with itself.
    """
    digests = stage(digests)  # read three times below
    kinds = digests.select("form", "stored").distinct()
    several = kinds.groupBy("form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("form")
    members = digests.join(several, "form", "left_semi").distinct()
    a = members.select("form", F.col("stored").alias("stored_a")).distinct()
    pairs = a.join(a.withColumnRenamed("stored_a", "stored_b"), "form").filter("stored_a < stored_b")
    left = members.select(F.col("form"), F.col("stored").alias("stored_a"), F.col("id").alias("x"))
    right = members.select(F.col("form"), F.col("stored").alias("stored_b"), F.col("id").alias("y"))
    return (
        pairs.join(left, ["form", "stored_a"])
        .join(right, ["form", "stored_b"])
        .filter("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def visual_classes(digests: DataFrame) -> DataFrame:
    """``id, class_id, stored_id, spellings``: each text's form, its stored text, and how many stored texts have the form.

    Nothing is made of pairs, so a form that a third of all texts have is only counted.
    """
    digests = stage(digests)
    kinds = digests.select("form", "stored").distinct().groupBy("form").agg(F.count(F.lit(1)).alias("spellings"))
    return digests.distinct().join(kinds, "form").select("id", F.lower(F.hex("form")).alias("class_id"), F.lower(F.hex("stored")).alias("stored_id"), "spellings")
