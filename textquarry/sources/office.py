"""Office files as units: Spark lists and reads the files (binaryFile, any store), one small parser per file turns parts into rows.

Sheets, shared strings and document parts are read as streams, whole, of any size; rows leave in chunks. Drawings and comments
of workbooks are read up to 50 MB a part and 200 MB of each kind a file, as in the reference; one beyond that gives a row with
``issue`` beside the file's units. A file or part that can't be read gives such a row too, after the units before the damage; its other
parts and the job go on. Supported: .xlsx, .xlsm (values,
formulas, comments, drawing text) and .docx, .docm (paragraphs, comments, headers and footers, text boxes). Older binary
formats give an issue.
"""

from __future__ import annotations

import io
import itertools
import os
import posixpath
import re
import zipfile
from array import array
from decimal import Decimal
from typing import BinaryIO
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.functions.patterns import PathFilter
from textquarry.operators.shipping import ship_package
from textquarry.operators.storage import stored
from textquarry.operators.units import UNITS
from textquarry.sources.listing import distinct_files, list_tree

PART_LIMIT, KIND_LIMIT = 50 << 20, 200 << 20  # of drawings and comments of workbooks only
CHUNK_ROWS = 10_000
TASK_BYTES = 64 << 20  # of files as they lie in the store
SHAPE_DEPTH = 128
_COLUMNS = [f.name for f in UNITS.fields]
PARSED = T.StructType([*UNITS.fields, T.StructField("issue", T.StringType())])


def files(spark: SparkSession, roots: str | list[str], wanted: PathFilter) -> DataFrame:
    """Files below ``roots`` (folders, none inside another) that pass the filter: path, relative_path, length, content; a root that is a file
    is one with its own name as relative path. Spark's reader skips names that start with ``_`` or ``.``."""
    roots = [roots] if isinstance(roots, str) else roots
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    full = F.regexp_replace("path", r"^file:/*", "/")
    relative = F.substring_index(full, "/", -1)
    for root in roots:
        base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
        relative = F.when(full.startswith(base), F.substring(full, F.lit(len(base) + 1), F.length(full))).otherwise(relative)
    return found.withColumn("full_path", full).withColumn("relative_path", relative).where(wanted.accepts(F.col("relative_path")))


def checked_roots(spark: SparkSession, roots: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(roots that exist, each once and none inside another, in the order given; (root, cause) of the others). ``~`` is the home folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    good, folders, bad = {}, set(), []
    for root in roots:
        path = os.path.expanduser(root) if root == "~" or root.startswith("~/") else root
        path = path.rstrip("/") or "/"
        try:
            at = jvm.org.apache.hadoop.fs.Path(path)
            status = at.getFileSystem(conf).getFileStatus(at)
        except Exception as e:  # a missing folder, no permission, an unknown store
            bad.append((root, str(getattr(e, "java_exception", e)).splitlines()[0]))
            continue
        full = status.getPath().toString()  # with its store, so that two ways to name it are one
        good.setdefault(full, path)
        if status.isDirectory():
            folders.add(full)
    inside = lambda full: any(full[:k] in folders for k, c in enumerate(full) if c == "/" and k)
    return [path for full, path in good.items() if not inside(full)], bad


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str):
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


class _Package:
    def __init__(self, opened: BinaryIO):
        self.z = zipfile.ZipFile(opened)
        self.names = set(self.z.namelist())
        self.read = {}
        if "EncryptedPackage" in self.names:
            raise ValueError("Password-protected or encrypted")

    def xml(self, name: str):
        return ET.fromstring(self.z.read(name))

    def events(self, name: str):
        """("start" or "end", local name, element) of a part as it is read; elements are dropped when they have ended."""
        around = []
        with self.z.open(name) as f:
            for event, e in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    around.append(e)
                    yield event, _local(e), e
                    continue
                around.pop()
                yield event, _local(e), e
                if around:
                    around[-1].remove(e)

    def fits(self, kind: str, name: str) -> bool:
        """Whether a part is within the limits of its kind; those that are add up."""
        size = self.z.getinfo(name).file_size
        total = self.read.get(kind, 0) + size
        if size > PART_LIMIT or total > KIND_LIMIT:
            return False
        self.read[kind] = total
        return True

    def stream(self, name: str, wanted: str):
        """(element, elements around it) of the outermost elements of a local name, as they end; all are dropped after use."""
        around, inside = [], 0
        with self.z.open(name) as f:
            for event, e in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    around.append(e)
                    inside += _local(e) == wanted
                    continue
                around.pop()
                if _local(e) == wanted:
                    inside -= 1
                    if not inside:
                        yield e, around
                if not inside and around:
                    around[-1].remove(e)

    def links(self, part: str) -> dict[str, tuple[str, str]]:
        """Relationship id -> (last word of its type, target part)."""
        folder, base = posixpath.split(part)
        rels = f"{folder}/_rels/{base}.rels".lstrip("/")
        if rels not in self.names:
            return {}
        out = {}
        for e in self.xml(rels):
            target = _attr(e, "Target") or ""
            full = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[_attr(e, "Id")] = ((_attr(e, "Type") or "").rpartition("/")[2], full)
        return out


def _text(e) -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == "t")


def _cell_string(e) -> str:
    """The text of a string cell, without the readings of its characters (phonetic runs)."""
    return "".join((x.text or "") if _local(x) == "t" else _cell_string(x) for x in e if _local(x) != "rPh")


class _Strings:
    """The shared strings of a workbook in one buffer."""

    def __init__(self, package: _Package):
        self.raw, self.ends = bytearray(), array("q", [0])
        if "xl/sharedStrings.xml" in package.names:
            for e, _ in package.stream("xl/sharedStrings.xml", "si"):
                self.raw += _cell_string(e).encode()
                self.ends.append(len(self.raw))

    def __getitem__(self, k: int) -> str:
        return self.raw[self.ends[k]: self.ends[k + 1]].decode()


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Za-z]+)([0-9]+)", ref).groups()
    col = 0
    for c in letters.upper():
        col = col * 26 + ord(c) - 64
    return int(row), col


def _number(v: str) -> str:
    try:
        return _plain(float(v))
    except ValueError:
        return v


def _plain(x: float) -> str:
    """Shortest decimal text of a double, without exponent."""
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else str(x)
    s = format(Decimal(repr(x)), "f")
    return s.rstrip("0").rstrip(".") if "." in s else s


def _shapes(package: _Package, part: str):
    """(name, text, row, column) of a drawing's shapes; group names lead."""
    def walk(e, names, at, depth=0):
        if depth > SHAPE_DEPTH:
            raise ValueError(f"drawing nested too deeply: {part}")
        kind = _local(e)
        if kind in ("oneCellAnchor", "twoCellAnchor"):
            start = next((x for x in e if _local(x) == "from"), None)
            if start is not None:
                place = {_local(x): int(x.text) for x in start}
                at = (place.get("row", -1) + 1, place.get("col", -1) + 1)
        if kind == "grpSp":
            own = next((_attr(x, "name") for p in e if _local(p) == "nvGrpSpPr" for x in p if _local(x) == "cNvPr"), None)
            names = [*names, own] if own else names
        if kind == "sp":
            about = next((x for p in e if _local(p) == "nvSpPr" for x in p if _local(x) == "cNvPr"), None)
            name = (_attr(about, "name") or _attr(about, "id") or "") if about is not None else ""
            text = "\n".join(_text(p) for p in e.iter() if _local(p) == "p").rstrip("\n")
            if text.strip():
                yield " / ".join([*names, name]), text, *at
            return
        for x in e:
            yield from walk(x, names, at, depth + 1)

    yield from walk(package.xml(part), [], (0, 0))


def _workbook(package: _Package):
    book, links = package.xml("xl/workbook.xml"), package.links("xl/workbook.xml")
    strings = _Strings(package)
    sheets = [e for e in book.iter() if _local(e) == "sheet"]
    names = [_attr(e, "name") for e in sheets]
    for pos, e in enumerate(sheets):
        base = {"sheet_name": names[pos], "sheet_pos": pos, "sheet_hidden": (_attr(e, "state") or "visible") != "visible", "sheets_in_workbook": names}
        part = links.get(_attr(e, "id"), ("", ""))[1]
        yield from _guarded(_sheet(package, part, base, strings), part or names[pos])
        for kind, target in package.links(part).values():
            if kind in ("comments", "drawing"):
                if target in package.names and not package.fits(kind, target):
                    yield {"issue": f"part too large: {target}"}
                else:
                    yield from _guarded((_comments if kind == "comments" else _drawing)(package, target, base), target)


def _guarded(rows, part: str):
    """The rows of a part; damage gives an issue row after those read, and the other parts go on."""
    try:
        yield from rows
    except Exception as e:
        yield {"issue": f"{part}: {type(e).__name__}: {e}"}


def _sheet(package: _Package, part: str, base: dict, strings: _Strings):
    row = col = 0
    last = None
    for c, around in package.stream(part, "c"):
        if around and around[-1] is not last:  # another row: cells without an address follow one another
            last, col = around[-1], 0
            row = int(_attr(last, "r") or row + 1) if _local(last) == "row" else row
        ref = _attr(c, "r")
        row, col = _place(ref) if ref else (max(row, 1), col + 1)
        kind = _attr(c, "t") or "n"
        raw = next((x.text for x in c if _local(x) == "v"), None)
        value = next((_cell_string(x) for x in c if _local(x) == "is"), "") if kind == "inlineStr" else None if raw is None else strings[int(raw)] if kind == "s" else (
            "true" if raw == "1" else "false") if kind == "b" else _number(raw) if kind == "n" else raw
        formula = next((x.text for x in c if _local(x) == "f"), None)
        at = base | {"row_index": row, "col_index": col, "formula": formula}
        if value:
            yield at | {"unit_kind": "value", "text": value}
        if formula:
            yield at | {"unit_kind": "formula", "text": formula}


def _comments(package: _Package, part: str, base: dict):
    for c in (x for x in package.xml(part).iter() if _local(x) == "comment"):
        row, col = _place(_attr(c, "ref"))
        yield base | {"unit_kind": "comment", "text": _text(c), "row_index": row, "col_index": col}


def _drawing(package: _Package, part: str, base: dict):
    for name, text, row, col in _shapes(package, part):
        yield base | {"unit_kind": "shape", "text": text, "shape_name": name, "row_index": row, "col_index": col}


def _paragraphs(package: _Package, part: str, unit: str):
    """Paragraphs of a part that aren't blank, counted from 1 as they end; those that end in a drawing or text box are shapes.

    A paragraph that starts inside another one takes its place: of the outer text only what follows the inner one stays.
    """
    at, text, boxes = 0, "", {"drawing": False, "txbxContent": False}
    for event, name, e in package.events(part):
        if name in boxes:
            boxes[name] = event == "start"
        elif name == "p":
            if event == "end" and text.strip():
                at += 1
                boxed = any(boxes.values())
                yield {"unit_kind": "shape" if boxed else unit, "text": text, "row_index": at, "shape_name": "TextBox" if boxed else None}
            text = ""
        elif name == "t" and event == "end":
            text += e.text or ""


def _document(package: _Package):
    base = {"sheet_name": "Word", "sheet_pos": 0, "sheet_hidden": False, "col_index": 0, "sheets_in_workbook": ["Word"]}
    parts = [("word/document.xml", "word"), ("word/comments.xml", "comment")]
    parts += [(n, "word") for n in sorted(package.names) if re.fullmatch(r"word/(header|footer)[^/]*\.xml", n)]
    for part, unit in parts:
        if part in package.names:
            for row in _guarded(_paragraphs(package, part, unit), part):
                yield row if "issue" in row else base | row


def rows_of(path: str, opener: Callable[[], BinaryIO]):
    """Rows of one file as they are read: its units, and a row with an issue for what can't be read. ``opener`` opens it."""
    own = {"full_path": path, "file_name": path.rpartition("/")[2], "col_index": 0, "row_index": 0}
    try:
        ext = path.lower().rpartition(".")[2]
        if ext not in ("xlsx", "xlsm", "docx", "docm"):
            raise ValueError(f"format not supported: .{ext}")
        with opener() as opened:
            for r in (_workbook if ext in ("xlsx", "xlsm") else _document)(_Package(opened)):
                yield own | r
    except Exception as e:  # any damage in a file is an issue of that file
        yield own | {"issue": f"{type(e).__name__}: {e}"}


def parse(path: str, content: bytes) -> list[dict]:
    return list(rows_of(path, lambda: io.BytesIO(content)))


def _frames(rows):
    """Rows of a file in frames of bounded length."""
    for some in itertools.batched(rows, CHUNK_ROWS):
        yield pd.DataFrame(some).reindex(columns=[*_COLUMNS, "issue"]).astype(object).where(lambda d: d.notna(), None)


def parsed(found: DataFrame) -> DataFrame:
    """Units and issues of files (full_path, content): no shuffle; each file is parsed in the task that read it."""

    def run(frames):
        for pdf in frames:
            for path, content in zip(pdf["full_path"], pdf["content"]):
                yield from _frames(rows_of(path, lambda: io.BytesIO(content)))

    return found.select("full_path", "content").mapInPandas(run, PARSED)


def parsed_listing(listed: DataFrame) -> DataFrame:
    """Units and issues of listed files (full_path, size), which the tasks open under their paths and read as streams: no file is a row.

    Files are dealt by path, about ``TASK_BYTES`` to a task.
    """

    def run(frames):
        for pdf in frames:
            for path in pdf["full_path"]:
                yield from _frames(rows_of(path, lambda: open(path, "rb")))

    total = listed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return listed.select("full_path").repartition(tasks, "full_path").mapInPandas(run, PARSED)


def units_and_issues(spark: SparkSession, roots: str | list[str], wanted: PathFilter) -> tuple[DataFrame, DataFrame]:
    """(units, issues) of all files below the roots; a root may be a folder or a file, roots inside others count once.

    Issues (full_path, stage, cause): of files; of roots that can't be read (stage ``root``); of pattern lists that can't be read,
    which let every file pass (their field as path and stage).
    """
    ship_package(spark)
    good, wanted, told = _request(spark, roots, wanted)
    if not good:
        return spark.createDataFrame([], UNITS), told
    units, issues = _split(parsed(files(spark, good, wanted)))
    return units, issues.unionByName(told)


def units_of_tree(spark: SparkSession, roots: str | list[str], wanted: PathFilter, once: bool = True) -> tuple[DataFrame, DataFrame]:
    """(units, issues) as ``units_and_issues`` gives them, of a listing by ``listing.list_tree``.

    So ignored folders are not entered, links are not followed, names that start with ``_`` or ``.`` count, a folder that can't be read is
    an issue (stage ``listing``), a file named as a root (in no other root) is not tested for being a lock file, and with ``once`` a file that several names
    lead to is read under the first of them. Needs local or mounted folders, at the same paths on every executor.
    """
    ship_package(spark)
    good, wanted, told = _request(spark, roots, wanted)
    listed = list_tree(spark, good, wanted)
    found = stored(distinct_files(listed) if once else listed, "files")
    units, issues = _split(parsed_listing(found.where("kind = 'file'")))
    unread = found.where("kind = 'issue'").select("full_path", F.lit("listing").alias("stage"), "cause")
    return units, issues.unionByName(unread).unionByName(told)


def _request(spark: SparkSession, roots: str | list[str], wanted: PathFilter) -> tuple[list[str], PathFilter, DataFrame]:
    """(roots to read, the filter without lists that can't be read, issues of both)."""
    good, bad = checked_roots(spark, [roots] if isinstance(roots, str) else list(roots))
    wanted, lists = wanted.checked()
    other = [(r, "root", c) for r, c in bad] + [(f, f, c) for f, c in lists]
    return good, wanted, spark.createDataFrame(other, "full_path string, stage string, cause string")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("issue is null").drop("issue"), rows.where("issue is not null").select(
        "full_path", F.lit("workbook").alias("stage"), F.col("issue").alias("cause"))
