"""Spreadsheets: a reader of .xlsx files over Spark's binary files, and a writer of styled sheets."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import rules
from tallyweave.functions.text import sheet_number

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def column_number(ref: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def deduplicated(headers: list[str]) -> list[str]:
    """Repeated headers get .1, .2 and so on, before they are trimmed; blank ones are named by their place."""
    seen: dict[str, int] = {}
    out = []
    for i, h in enumerate(headers):
        h = h if h else f"Unnamed: {i}"
        k = seen[h] = seen.get(h, -1) + 1
        out.append((f"{h}.{k}" if k else h).strip())
    return out


def sheet_rows(data: bytes, sheet: str | int = 0) -> Iterator[list[str]]:
    """Rows of a sheet, by name or number, as texts; missing cells are ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{MAIN}sheets")
        names = [s.get("name") for s in sheets]
        if isinstance(sheet, str) and sheet not in names:
            raise ValueError(f"no sheet named {sheet}: {', '.join(names)}")
        rel = sheets[names.index(sheet) if isinstance(sheet, str) else sheet].get(f"{REL}id")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        path = targets[rel].lstrip("/")
        for row in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{MAIN}row"):
            out: list[str] = []
            for c in row:
                at = column_number(c.get("r")) if c.get("r") else len(out)
                out += [""] * (at + 1 - len(out))
                v = c.find(f"{MAIN}v")
                if c.get("t") == "s":
                    out[at] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    out[at] = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                else:
                    out[at] = "" if v is None else v.text or ""
            yield out


def read_sheets(spark: SparkSession, path: str, sheet: str | int = 0, most_bytes: int = 16 << 20) -> DataFrame:
    """(batch_id, row_ord, cells MAP<STRING, STRING>) of all .xlsx files that Spark finds at `path`; a file is a batch.

    Spark's own reader lists and opens the files, so the path may be on any store; a file over `most_bytes` fails the read.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".xlsx"))
    refused = F.raise_error(F.concat(F.lit(f"larger than {most_bytes} bytes: "), "path")).cast("binary")
    files = files.select("path", F.when(F.col("length") > most_bytes, refused).otherwise(F.col("content")).alias("content"))

    return parsed(files, sheet)


def parsed(files: DataFrame, sheet: str | int = 0) -> DataFrame:
    """(batch_id, row_ord, cells) of workbooks (path, content); headers are trimmed and told apart."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name, content in zip(batch.path, batch.content, strict=True):
                rows = sheet_rows(bytes(content), sheet)
                head = deduplicated(next(rows, []))
                out += [(name.rsplit("/", 1)[-1], i, dict(zip(head, row, strict=False))) for i, row in enumerate(rows)]
            yield pd.DataFrame(out, columns=["batch_id", "row_ord", "cells"])

    return files.select("path", "content").mapInPandas(run, "batch_id string, row_ord long, cells map<string,string>")


def columns_of(sheets: DataFrame, names: dict[str, str]) -> DataFrame:
    """Chosen cells as columns (new name -> header); a header that a file lacks gives ''."""
    return sheets.select("batch_id", "row_ord", *[F.coalesce(F.try_element_at("cells", F.lit(h)), F.lit("")).alias(c) for c, h in names.items()])


def table_columns(df: DataFrame, wanted: tuple[str, ...] = rules.SHORT_COLUMNS) -> DataFrame:
    """Those of the wanted columns that are there, in the wanted order, numeric ones as whole numbers."""
    return df.select(*[(sheet_number(F.col(f"`{c}`")) if c in rules.NUMERIC_COLUMNS else F.col(f"`{c}`")).alias(c) for c in wanted if c in df.columns])


def sheet_bytes(columns: list[str], rows: Iterator[tuple]) -> bytes:
    """One sheet with a frozen, bold first row and banded even rows; whole numbers are numbers."""

    def cell(value, style: int) -> str:
        text = "" if value is None else str(value)
        if re.fullmatch(r"-?\d{1,15}", text) and not re.match(r"-?0\d", text):
            return f'<c s="{style}"><v>{text}</v></c>'
        return f'<c s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    lines = [f"<row>{''.join(cell(c, 1) for c in columns)}</row>"]
    lines += [f"<row>{''.join(cell(v, 2 if i % 2 else 0) for v in row)}</row>" for i, row in enumerate(rows)]
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    own = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    xml = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{own}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{own}"><sheets><sheet name="result" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{own}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{own}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{ns}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFF0F4F9"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetFormatPr defaultColWidth="11"/><sheetData>{"".join(lines)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in xml.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def write_sheets(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(batch_id, content): one workbook per batch, the size of one file, made where the batch's rows are."""

    def run(group):
        import pandas as pd

        # Headers may hold dots, which grouped functions don't take; columns go by number.
        rows = group.sort_values([f"o{i}" for i in range(len(order))])[[f"c{i}" for i in range(len(columns))]].astype(object)
        rows = rows.where(rows.notna(), None)
        return pd.DataFrame({"batch_id": [group.batch_id.iloc[0]], "content": [sheet_bytes(columns, rows.itertuples(index=False, name=None))]})

    chosen = df.select("batch_id", *[F.col(f"`{c}`").alias(f"{k}{i}") for k, cs in (("o", order), ("c", columns)) for i, c in enumerate(cs)])
    return chosen.groupBy("batch_id").applyInPandas(run, f"batch_id {df.schema['batch_id'].dataType.simpleString()}, content binary")
