"""Documents and workbooks as text: the Office Open XML formats, read with the standard library.

Files come as ``path, content`` (Spark's binaryFile source). What can't be read gives a
row with an error and no text: a file over the size limit, an unknown or damaged format,
or one that takes too long. PDF needs a library that isn't there and is an error, too.
"""

from __future__ import annotations

import io
import json
import re
import time
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame

#: Most bytes of a file, packed and unpacked together, and seconds that reading it may take.
MAX_BYTES, MAX_SECONDS = 100 * 1024 * 1024, 30

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class _Package:
    """A zip whose parts are read within the limits."""

    def __init__(self, content: bytes):
        if len(content) > MAX_BYTES:
            raise ValueError(f"over {MAX_BYTES} bytes")
        self._zip, self._left, self._end = zipfile.ZipFile(io.BytesIO(content)), MAX_BYTES, time.monotonic() + MAX_SECONDS

    def xml(self, name: str) -> ET.Element:
        if time.monotonic() > self._end:
            raise ValueError(f"over {MAX_SECONDS} seconds")
        with self._zip.open(name) as f:
            data = f.read(self._left + 1)
        self._left -= len(data)
        if self._left < 0:
            raise ValueError(f"over {MAX_BYTES} bytes unpacked")
        if b"<!DOCTYPE" in data[:2000]:
            raise ValueError("a document type isn't allowed")
        return ET.fromstring(data)

    def has(self, name: str) -> bool:
        return name in self._zip.namelist()


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, list[list], list[str]]]:
    """(name, rows, merged ranges) of each sheet; cells are None, bool, int, float or str, errors None, rows as long as they are."""
    p = _Package(content)
    shared = ["".join(t.text or "" for t in s.iter(_SHEET + "t")) for s in p.xml("xl/sharedStrings.xml").iter(_SHEET + "si")] if p.has("xl/sharedStrings.xml") else []
    links = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in p.xml("xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in p.xml("xl/workbook.xml").iter(_SHEET + "sheet"):
        root = p.xml("xl/" + links[sheet.get(_LINK)])
        rows: list[list] = []
        for row in root.iter(_SHEET + "row"):
            at = int(row.get("r") or len(rows) + 1) - 1
            rows += [[] for _ in range(min(at, 1_048_576) + 1 - len(rows))]
            for cell in row.iter(_SHEET + "c"):
                k = _column(cell.get("r")) if cell.get("r") else len(rows[at])
                rows[at] += [None] * (k + 1 - len(rows[at]))
                rows[at][k] = _value(cell, shared)
        out.append((sheet.get("name"), rows, [m.get("ref") for m in root.iter(_SHEET + "mergeCell")]))
    return out


def _value(cell: ET.Element, shared: list[str]):
    kind, v = cell.get("t", "n"), cell.find(_SHEET + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_SHEET + "t"))
    if v is None or v.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind != "n":
        return v.text
    x = float(v.text)
    return int(x) if x.is_integer() and abs(x) < 2**53 else x


def _shown(value) -> str:
    return "" if value is None else ("TRUE" if value else "FALSE") if isinstance(value, bool) else str(value)


def workbook_text(content: bytes) -> str:
    """Each sheet as a line ``[Sheet: name]`` and its rows, cells parted by tabs; errors and empty cells are empty."""
    return "".join(f"[Sheet: {name}]\n" + "".join("\t".join(map(_shown, r)) + "\n" for r in rows) for name, rows, _ in sheets(content))


def workbook_json(content: bytes) -> str:
    """Each sheet's name, typed cells and merged ranges as JSON."""
    return json.dumps([{"name": n, "data": rows, "merges": merged} for n, rows, merged in sheets(content)], ensure_ascii=False)


def document_text(content: bytes) -> str:
    """The paragraphs of a text document, a line each."""
    body = _Package(content).xml("word/document.xml")
    return "\n".join("".join(t.text or "" for t in p.iter(_WORD + "t")) for p in body.iter(_WORD + "p"))


READERS = {"docx": document_text, "xlsx": workbook_text, "txt": lambda c: c.decode("utf-8", "replace"), "md": lambda c: c.decode("utf-8", "replace")}


def parsed_files(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """``path, text, error`` of files ``path, content``, by the ending of their names; exactly one of text and error is null."""
    own = READERS if readers is None else readers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = error = None
                try:
                    ending = path.rsplit(".", 1)[-1].lower()
                    if ending not in own:
                        raise ValueError(f"no reader for .{ending}")
                    if len(content) > MAX_BYTES:
                        raise ValueError(f"over {MAX_BYTES} bytes")
                    text = own[ending](content)
                except Exception as e:  # a damaged file must not end the job
                    error = f"{type(e).__name__}: {e}"
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").filter("path is not null and content is not null").mapInArrow(run, "path string, text string, error string")
