"""Datasets as workbooks: a sheet for each time point, rows of objects, then a section of edges.

Workbooks are read as binary files by Spark, so that any store will do, and taken apart with the
standard library alone; each file is small and is parsed in one task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.dataset import DEFAULTS, EDGES, NODES

COLUMNS = [f.name for f in NODES if f.name not in ("sheet_index", "row_ord")]
MANDATORY = ("x", "y", "z", "size", "size_alpha", "spin_x", "spin_y", "spin_z", "color_r", "color_g", "color_b")
WHOLE = {"note": (0, 127), "instrument": (0, 365), "channel": (0, 15), "velocity": (0, 127), "beats": (0, 2**32 - 1)}
MAX_BYTES = 128 * 1024 * 1024
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    out = 0
    for x in re.match("[A-Z]+", ref)[0]:
        out = out * 26 + ord(x) - 64
    return out - 1


def _name(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def read_workbook(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, cells as text) of each sheet, blank cells as empty strings."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        texts = ["".join(t.text or "" for t in x.iter(f"{MAIN}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}row"):
                cells: list[str] = []
                for c in row.iter(f"{MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    raw = c.findtext(f"{MAIN}v") or ""
                    cells[at] = texts[int(raw)] if c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if c.get("t") == "inlineStr" else raw
                at = int(row.get("r") or len(rows) + 1) - 1
                rows += [[]] * (at - len(rows)) + [cells]
            out.append((sheet.get("name"), rows))
        return out


def write_workbook(sheets: list[tuple[str, list[list[object]]]]) -> bytes:
    """A workbook with inline strings and numbers."""
    out = io.BytesIO()
    n = range(1, len(sheets) + 1)

    def cell(k: int, r: int, v: object) -> str:
        if v is None or v == "":
            return ""
        at = f"{_name(k)}{r}"
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' if isinstance(v, str) else f'<c r="{at}"><v>{v!r}</v></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n)
        book.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        book.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        entries = "".join(f'<sheet name="{escape(name, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, (name, _) in zip(n, sheets, strict=True))
        book.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{entries}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n) + "</Relationships>")
        for k, (_, rows) in zip(n, sheets, strict=True):
            body = "".join(f'<row r="{r}">' + "".join(cell(c, r, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1) if row)
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def _value(name: str, raw: str, where: str) -> object:
    if name == "shape":
        return raw.strip().lower() or DEFAULTS[name]
    if not raw.strip():
        if name in MANDATORY:
            raise ValueError(f"{where}: {name} is missing")
        return DEFAULTS[name]
    number = float(raw)
    if name in WHOLE:
        low, high = WHOLE[name]
        if number != int(number) or not low <= number <= high:
            raise ValueError(f"{where}: {name} is no whole number from {low} to {high}")
        return int(number)
    return number


def parse_dataset(data: bytes) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of nodes, edges and sheets. Rows without a label are left out; edges begin at a row whose first cell is "from"."""
    nodes, edges, sheets = [], [], []
    for s, (name, rows) in enumerate(read_workbook(data)):
        sheets.append((s, name))
        body = rows[1:]
        cut = next((k for k, r in enumerate(body) if r and r[0].strip().lower() == "from"), len(body))
        found = [r + [""] * (len(COLUMNS) - len(r)) for r in body[:cut] if r and r[0].strip()]
        if not found:
            raise ValueError(f"sheet {name} has no rows")
        for k, r in enumerate(found):
            nodes.append((s, k, r[0], *(_value(c, v, f"{name}, row {k + 1}") for c, v in zip(COLUMNS[1:], r[1:], strict=False))))
        for k, r in enumerate(x for x in body[cut + 1 :] if len(x) > 1 and x[0].strip() and x[1].strip()):
            edges.append((s, k, r[0], r[1], float(r[2]) if len(r) > 2 and r[2].strip() else 1.0))
    if not sheets:
        raise ValueError("the workbook has no sheets")
    return nodes, edges, sheets


def read_xlsx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges, with `path`, of the workbooks at `path`."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content").where(F.when(F.col("length") > MAX_BYTES, F.raise_error(F.lit("workbook too large"))).otherwise(True))

    def parser(part: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [f.name for f in (NODES, EDGES)[part]]
            for batch in batches:
                for p, data in zip(batch["path"], batch["content"], strict=True):
                    table = pd.DataFrame(parse_dataset(data)[part], columns=names)
                    table.insert(0, "path", p)
                    yield table

        return run

    ddl = lambda schema: "path string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return files.mapInPandas(parser(0), ddl(NODES)), files.mapInPandas(parser(1), ddl(EDGES))


def dataset_workbook(nodes: DataFrame, edges: DataFrame, sheets: DataFrame) -> bytes:
    """The dataset as a workbook. A workbook is one file made on the driver: for datasets of a size for people."""
    rows, links = nodes.orderBy("sheet_index", "row_ord").collect(), edges.orderBy("sheet_index", "edge_ord").collect()
    out = []
    for s in sheets.orderBy("sheet_index").collect():
        cells: list[list[object]] = [list(COLUMNS), *([r[c] for c in COLUMNS] for r in rows if r.sheet_index == s.sheet_index)]
        own = [[e["from"], e["to"], e["strength"]] for e in links if e.sheet_index == s.sheet_index]
        out.append((s["name"], cells + ([[], ["from", "to", "strength"], *own] if own else [])))
    return write_workbook(out)
