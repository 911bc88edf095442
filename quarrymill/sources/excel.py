"""Excel workbooks (.xlsx) as frames: the first sheet, its first row as names.

Spark reads the files' bytes, so that any store that Spark reaches will do; a task streams one workbook's sheet as XML, row by row, and hands
on rows of (kind, text) cells. Workbooks of a folder or pattern are read by as many tasks. A sheet has 1,048,576 rows at
most by its format, which bounds a task. The cells are stored once; types are told by one aggregate over all rows.

Numbers under a date format are times. Types are the narrowest that hold a column's cells: booleans, whole numbers, numbers, times, else
strings. Errors and the usual strings for missing values are NULL. Rows that the sheet leaves out between others are rows of NULLs.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import stored

#: The numbers of the format's built-in formats for dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
CELLS = "book string, row long, kinds array<string>, texts array<string>"
BATCH = 2000


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _events(zipped: zipfile.ZipFile, entry: str, wanted: str) -> Iterator[ElementTree.Element]:
    """The elements of one name in an entry, each emptied after it was used, so that memory doesn't grow with the sheet."""
    with zipped.open(entry) as f:
        above: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if _name(element.tag) == wanted:
                yield element
                element.clear()
                if above:
                    above[-1].clear()


def _texts(element: ElementTree.Element) -> str:
    """The text of a string item without its phonetic hints."""
    return "".join(t.text or "" for part in element if _name(part.tag) != "rPh" for t in part.iter() if _name(t.tag) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _dated(zipped: zipfile.ZipFile) -> set[int]:
    """The numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in zipped.namelist():
        return set()
    root = ElementTree.fromstring(zipped.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")): e.get("formatCode") or "" for e in root.iter() if _name(e.tag) == "numFmt"}
    plain = lambda code: re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]|_.|\*.', "", code.lower())
    times = {k for k, code in own.items() if re.search(r"[dyhs]|m", plain(code)) and "general" not in plain(code)}
    styles = next((e for e in root.iter() if _name(e.tag) == "cellXfs"), [])
    return {i for i, x in enumerate(styles) if int(x.get("numFmtId") or 0) in (DATE_FORMATS - own.keys()) | times}


def sheet_rows(content: bytes) -> Iterator[tuple[int, list[tuple[str, str] | None]]]:
    """(number from 0, cells) of the rows of a workbook's first sheet that have a cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as zipped:
        book = ElementTree.fromstring(zipped.read("xl/workbook.xml"))
        first = next(e for e in book.iter() if _name(e.tag) == "sheet")
        relation = next(v for k, v in first.attrib.items() if _name(k) == "id")
        links = ElementTree.fromstring(zipped.read("xl/_rels/workbook.xml.rels"))
        target = next(e.get("Target") for e in links if e.get("Id") == relation)
        entry = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        from_1904 = any(_name(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in book.iter())
        start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30)
        dated = _dated(zipped)
        shared = [_texts(e) for e in _events(zipped, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in zipped.namelist() else []
        at = -1
        for row in _events(zipped, entry, "row"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            cells: list[tuple[str, str] | None] = []
            for c in row:
                place = _column(c.get("r")) if c.get("r") else len(cells)
                kind, value = c.get("t") or "n", next((v.text for v in c if _name(v.tag) == "v"), None)
                if kind == "inlineStr":
                    found = ("s", "".join(_texts(v) for v in c if _name(v.tag) == "is"))
                elif value is None or kind == "e":
                    found = None
                elif kind == "s":
                    found = ("s", shared[int(value)])
                elif kind == "b":
                    found = ("b", "true" if value.strip() in ("1", "true") else "false")
                elif kind == "d":
                    found = ("t", value)
                elif kind == "n" and int(c.get("s") or 0) in dated:
                    found = ("t", (start + datetime.timedelta(microseconds=round(float(value) * 86_400_000) * 1000)).isoformat(" "))
                else:
                    found = ("n" if kind == "n" else "s", value)
                cells += [None] * (place + 1 - len(cells))
                cells[place] = found
            if any(cells):
                yield at, cells


def cells(books: DataFrame) -> DataFrame:
    """The rows of (path, content) workbooks, gaps between rows included."""

    def run(batches):
        import pyarrow as pa

        def batch(path, rows):
            kinds, texts = ([[c and c[i] for c in r] for _, r in rows] for i in (0, 1))
            of = pa.list_(pa.string())
            return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([n for n, _ in rows], pa.int64()), pa.array(kinds, of), pa.array(texts, of)], names=["book", "row", "kinds", "texts"])

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                waiting, last = [], None
                for n, found in sheet_rows(content.as_py()):
                    for gap in range(n if last is None else last + 1, n):
                        waiting.append((gap, []))
                    waiting.append((n, found))
                    last = n
                    if len(waiting) >= BATCH:
                        yield batch(path, waiting)
                        waiting = []
                if waiting:
                    yield batch(path, waiting)

    return books.select("path", "content").mapInArrow(run, CELLS)


def frame(books: DataFrame, missing: tuple[str, ...]) -> DataFrame:
    """The workbooks' rows below their first ones, by the names of the first workbook's first row."""
    rows, _ = stored(cells(books), "sheet")
    firsts = rows.groupBy("book").agg(F.min("row").alias("first"), F.max(F.size("kinds")).alias("width"))  # one row a workbook
    head = rows.join(firsts, "book").where(F.col("row") == F.col("first")).orderBy("book").select("texts").first()
    if head is None:
        raise ValueError("the sheet is empty")
    width = firsts.agg(F.max("width")).first()[0]
    names: list[str] = []
    for i in range(width):
        name = (head.texts[i] if i < len(head.texts) else None) or f"Unnamed: {i}"
        twin = 0
        while name in names:
            twin += 1
            name = f"{(head.texts[i] if i < len(head.texts) else None) or f'Unnamed: {i}'}.{twin}"
        names.append(name)
    body = rows.join(F.broadcast(firsts.select("book", "first")) if firsts.count() <= 10_000 else firsts.select("book", "first"), "book").where(F.col("row") > F.col("first"))
    text = lambda i: F.when(~F.get("texts", i).isin(*missing), F.get("texts", i))
    kind = lambda i: F.when(text(i).isNotNull(), F.get("kinds", i))
    whole = lambda i: F.when(kind(i) == "n", F.floor(text(i).try_cast("double")) == text(i).try_cast("double"))
    told = body.agg(*(x for i in range(width) for x in (F.collect_set(kind(i)).alias(f"k{i}"), F.min(whole(i)).alias(f"w{i}")))).first()  # four kinds at most
    out = []
    for i, name in enumerate(names):
        kinds = set(told[f"k{i}"])
        if kinds == {"b"}:
            value = text(i).cast("boolean")
        elif kinds == {"n"}:
            value = text(i).cast("double")
            value = value.cast("bigint") if told[f"w{i}"] else value
        elif kinds == {"t"}:
            value = text(i).try_cast("timestamp_ntz")
        else:
            value = text(i)
        out.append(value.alias(name))
    return body.select(*out)


def read_excel(spark: SparkSession, path: str, missing: tuple[str, ...] = ()) -> DataFrame:
    """path: a workbook, or a folder or pattern of workbooks with the same columns."""
    return frame(spark.read.format("binaryFile").load(path), missing)



def workbook(names: list[str], rows: Iterable[tuple]) -> bytes:
    """A workbook of one sheet with inline strings, numbers, booleans, and times under the built-in format 22."""
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, datetime.datetime):
            return f'<c s="1"><v>{(v - datetime.datetime(1899, 12, 30)) / datetime.timedelta(days=1)!r}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {main}><sheetData>".encode())
            for row in chain([tuple(names)], rows):
                f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()
