"""Exports of matches: CSV, JSON, Markdown and XLSX.

``export_rows`` and ``json_records`` are DataFrames that Spark's writers store in parallel (``write_csv_parts``,
``write_json_lines``). The single-file forms stream rows to the driver with toLocalIterator and publish the file in one step.
"""

from __future__ import annotations

import csv
import json
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import cells, labels

# fixed values: column widths of the XLSX sheet, and its header colours
WIDTHS = (8, 25, 40, 20, 12, 22, 14, 45, 30)
HEADER_FILL, HEADER_FONT = "FF0F766E", "FFFFFFFF"
FIELDS = ("id", "file_name", "full_path", "sheet_name", "cell_address", "shape_name", "match_type", "content", "formula")


class ExportError(ValueError):
    """An export that can't be written."""


def export_rows(matches: DataFrame, language: str = "en", sanitize: bool = True) -> DataFrame:
    """The nine export columns, under internal names; texts on one line if ``sanitize``."""
    text = cells.csv_field if sanitize else (lambda c: c)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return matches.select(
        "id", "file_name", cells.export_path(F.col("full_path")).alias("full_path"), "sheet_name", "cell_address", text(blank("shape_name")).alias("shape_name"),
        labels.label_of(F.col("match_type"), F.lit(language)).alias("match_type"), text(F.col("full_content")).alias("content"), text(blank("formula")).alias("formula"))


def json_records(matches: DataFrame) -> DataFrame:
    """(id, record): one JSON object per match; null formula and shape_name are left out."""
    return matches.select("id", F.to_json(F.struct(
        "id", "file_name", cells.export_path(F.col("full_path")).alias("full_path"), "sheet_name", "cell_address", "row_index", "col_index",
        "match_type", "full_content", "snippet", "formula", "shape_name")).alias("record"))


def write_csv_parts(matches: DataFrame, path: str, language: str = "en") -> None:
    export_rows(matches, language).toDF(*labels.titles(language)).write.option("header", True).option("escape", '"').csv(path)


def write_json_lines(matches: DataFrame, path: str) -> None:
    json_records(matches).select("record").write.text(path)


def publish(target: str, write: Callable[[str], None], overwrite: bool = False, inputs: tuple[str, ...] = ()) -> None:
    """Write to a file beside ``target`` and put it there in one step; never over a link, a folder or an input."""
    if os.path.islink(target) or os.path.isdir(target):
        raise ExportError(f"the output is a link or a folder: {target}")
    if any(os.path.exists(i) and os.path.exists(target) and os.path.samefile(i, target) for i in inputs):
        raise ExportError(f"the output is an input: {target}")
    if os.path.exists(target) and not overwrite:
        raise ExportError(f"the output exists: {target}")
    fd, part = tempfile.mkstemp(dir=Path(target).resolve().parent, prefix=".export-")
    os.close(fd)
    try:
        write(part)
        if overwrite:
            os.replace(part, target)
        else:
            os.link(part, target)  # fails if someone else made it meanwhile
    finally:
        if os.path.exists(part):
            os.unlink(part)


def _rows(matches: DataFrame, language: str, sanitize: bool = True):
    return export_rows(matches.orderBy("id"), language, sanitize).toLocalIterator(prefetchPartitions=True)


def write_csv(matches: DataFrame, path: str, language: str = "en", bom: bool = True) -> None:
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(labels.titles(language))
        out.writerows([r[c] for c in FIELDS] for r in _rows(matches, language))


def write_json(matches: DataFrame, path: str) -> None:
    total = matches.count()
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "total_matches": %d,\n  "matches": [' % total)
        for k, r in enumerate(json_records(matches.orderBy("id")).toLocalIterator()):
            body = json.dumps(json.loads(r["record"]), ensure_ascii=False, indent=2).replace("\n", "\n    ")
            f.write(("," if k else "") + "\n    " + body)
        f.write(("\n  " if total else "") + "]\n}\n")


def write_markdown(sections: DataFrame, path: str) -> None:
    """Sections (full_path, section_text and, for sheets, sheet_name), with a rule between them; nothing if there is none."""
    keys = [c for c in ("full_path", "sheet_name") if c in sections.columns]
    with open(path, "w", encoding="utf-8") as f:
        last = None
        for r in sections.orderBy(*keys).toLocalIterator():
            f.write(r["section_text"] if last is None else "\n\n---\n\n" + r["section_text"])
            last = r
        if last is not None:
            f.write("\n")


def write_xlsx(matches: DataFrame, path: str, language: str = "en") -> None:
    """One styled sheet: header row, widths, borders, a filter if there are rows. Rows stream into the archive."""
    columns = "ABCDEFGHI"
    # XML can't hold most control characters
    clean = lambda s: escape("".join(c for c in s if c >= " " or c in "\t\n\r"))
    cell = lambda at, v, style: (
        f'<c r="{at}" s="{style}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{clean(v)}</t></is></c>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/>'
                   f'<Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(labels.EXPORT_SHEET.get(language, labels.EXPORT_SHEET["en"]))}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/>'
                   f'<Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        edge = "".join(f'<{s} style="thin"/>' for s in ("left", "right", "top", "bottom"))
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/><color rgb="{HEADER_FONT}"/></font></fonts>'
                   f'<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{HEADER_FILL}"/></patternFill></fill></fills>'
                   f'<borders count="2"><border/><border>{edge}</border></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
                   '<cellXfs count="3"><xf/><xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1"/><xf borderId="1" applyBorder="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            put = lambda s: f.write(s.encode())
            put(f'<worksheet xmlns="{main}"><cols>' + "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, w in enumerate(WIDTHS, 1)) + "</cols><sheetData>")
            put('<row r="1">' + "".join(cell(f"{c}1", t, 1) for c, t in zip(columns, labels.titles(language))) + "</row>")
            n = 1
            for r in _rows(matches, language, sanitize=False):
                n += 1
                put(f'<row r="{n}">' + "".join(cell(f"{c}{n}", r[name], 2) for c, name in zip(columns, FIELDS)) + "</row>")
            put("</sheetData>" + (f'<autoFilter ref="A1:I{n}"/>' if n > 1 else "") + "</worksheet>")
