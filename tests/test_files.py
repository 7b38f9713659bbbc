import csv
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from textquarry.functions.patterns import ALL_EXTENSIONS, PathFilter
from textquarry.operators import context, units
from textquarry.operators import search as search_ops
from textquarry.operators.search import SearchRequest, search
from textquarry.sinks import export
from textquarry.sources.office import checked_roots, parse, units_and_issues, units_of_tree
from textquarry.streaming.incremental import arriving_units, search_stream, write_matches

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def rels(*items):
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{t}" Target="{x}"/>' for i, t, x in items) + "</Relationships>"


def workbook(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="Data" r:id="r1"/><sheet name="Old" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "/xl/worksheets/sheet2.xml")))
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>cell </t><r><t>needle</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c><c r="C1"><v>0.1</v></c></row>'
                   '<row r="2"><c r="A2" t="inlineStr"><is><t>inline &amp; more</t></is></c><c r="B2" t="str"><f>CONCAT("need","le")</f><v>needle!</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><c r="AA10" t="inlineStr"><is><t>hidden needle</t></is></c></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rels(("d", "drawing", "../drawings/drawing1.xml"), ("c", "comments", "../comments1.xml")))
        z.writestr("xl/comments1.xml", '<comments><comment ref="A2"><text><r><t>a needle </t></r><r><t>note</t></r></text></comment></comments>')
        z.writestr("xl/drawings/drawing1.xml", '<wsDr><twoCellAnchor><from><col>2</col><row>1</row></from><grpSp><nvGrpSpPr><cNvPr id="1" name="Group"/></nvGrpSpPr>'
                   '<sp><nvSpPr><cNvPr id="4" name="Text Box"/></nvSpPr><txBody><p><r><t>shape </t></r><r><t>needle</t></r></p><p><r><t>two</t></r></p><p/></txBody></sp></grpSp></twoCellAnchor>'
                   '<sp><nvSpPr><cNvPr id="9"/></nvSpPr><txBody><p><r><t>free needle</t></r></p></txBody></sp></wsDr>')


def document(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", '<document><body><p><r><t>revenue grew</t></r></p><p/><p><r><t xml:space="preserve"> second needle </t></r>'
                   "<drawing><txbxContent><p><r><t>boxed needle</t></r></p></txbxContent></drawing></p></body></document>")
        z.writestr("word/comments.xml", "<comments><comment><p><r><t>the budget needle</t></r></p></comment></comments>")
        z.writestr("word/header1.xml", "<hdr><p><r><t>header needle</t></r></p></hdr>")


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    workbook(tmp_path / "book.XLSX")
    document(tmp_path / "sub" / "text.docx")
    (tmp_path / "broken.xlsx").write_bytes(b"broken workbook")
    (tmp_path / "~$book.xlsx").write_bytes(b"lock")
    (tmp_path / "plain.txt").write_text("needle")
    with zipfile.ZipFile(tmp_path / "locked.docx", "w") as z:
        z.writestr("EncryptedPackage", "x")
    return str(tmp_path)


def test_files_become_units_and_issues(spark, folder):
    u, issues = units_and_issues(spark, folder, PathFilter(extensions=ALL_EXTENSIONS))
    got = {(r["file_name"], r["sheet_name"], r["unit_kind"], r["row_index"], r["col_index"], r["text"]) for r in u.collect()}
    assert got == {
        ("book.XLSX", "Data", "value", 1, 1, "cell needle"), ("book.XLSX", "Data", "value", 1, 2, "5"), ("book.XLSX", "Data", "value", 1, 3, "0.1"),
        ("book.XLSX", "Data", "value", 2, 1, "inline & more"), ("book.XLSX", "Data", "value", 2, 2, "needle!"), ("book.XLSX", "Data", "formula", 2, 2, 'CONCAT("need","le")'),
        ("book.XLSX", "Data", "value", 2, 3, "true"), ("book.XLSX", "Data", "comment", 2, 1, "a needle note"),
        ("book.XLSX", "Data", "shape", 2, 3, "shape needle\ntwo"), ("book.XLSX", "Data", "shape", 0, 0, "free needle"), ("book.XLSX", "Old", "value", 10, 27, "hidden needle"),
        ("text.docx", "Word", "word", 1, 0, "revenue grew"), ("text.docx", "Word", "shape", 2, 0, "boxed needle"),
        ("text.docx", "Word", "comment", 1, 0, "the budget needle"), ("text.docx", "Word", "word", 1, 0, "header needle")}
    told = {r["full_path"].rpartition("/")[2]: r["cause"] for r in issues.collect()}
    assert set(told) == {"broken.xlsx", "locked.docx"} and "encrypted" in told["locked.docx"]
    shapes = {r["shape_name"] for r in u.where("unit_kind = 'shape'").collect()}
    assert shapes == {"Group / Text Box", "9", "TextBox"}


def test_old_formats_are_issues():
    assert "not supported" in parse("/x/a.xls", b"")[0]["issue"]


def big_parts(path):
    """A sheet, shared strings and a picture over 50 MB each, 200 MB together, and a second sheet whose comments are over 50 MB."""
    pad = " " * (1 << 20)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="Big" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "worksheets/sheet2.xml")))
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>first</t></si>" + pad * 51 + "<si><t>läst</t></si></sst>")
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b"<worksheet><sheetData>")
            for k in range(1, 52):
                f.write(f'<row r="{k}"><c r="A{k}" t="s"><v>{k % 2}</v></c><c r="B{k}"><f>1+{k}</f><v>{k}</v></c></row>{pad}'.encode())
            f.write(b"</sheetData></worksheet>")
        z.writestr("xl/media/image1.png", bytes(120 << 20))
        z.writestr("xl/worksheets/sheet2.xml", '<worksheet><c r="A1" t="inlineStr"><is><t>readable</t></is></c></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet2.xml.rels", rels(("c", "comments", "../comments1.xml"), ("d", "drawing", "../drawings/drawing1.xml")))
        z.writestr("xl/comments1.xml", "<comments>" + pad * 51 + "</comments>")
        z.writestr("xl/drawings/drawing1.xml", '<wsDr><sp><nvSpPr><cNvPr id="9"/></nvSpPr><txBody><p><r><t>free</t></r></p></txBody></sp></wsDr>')


def test_large_parts_are_read_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    big_parts(tmp_path / "in" / "big.xlsx")
    with zipfile.ZipFile(tmp_path / "in" / "big.docx", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        z.writestr("word/document.xml", "<document><body><p><r><t>top</t></r></p>" + " " * (51 << 20) + "<drawing><p><r><t>boxed</t></r></p></drawing></body></document>")
    u, issues = units_and_issues(spark, str(tmp_path / "in"), PathFilter(extensions=ALL_EXTENSIONS))
    got = sorted((r["sheet_name"], r["unit_kind"], r["row_index"], r["col_index"], r["text"]) for r in u.collect())
    want = [x for k in range(1, 52) for x in (
        ("Big", "value", k, 1, "läst" if k % 2 else "first"), ("Big", "value", k, 2, str(k)), ("Big", "formula", k, 2, f"1+{k}"))]
    want += [("Two", "value", 1, 1, "readable"), ("Two", "shape", 0, 0, "free"), ("Word", "word", 1, 0, "top"), ("Word", "shape", 2, 0, "boxed")]
    assert got == sorted(want)
    assert [r["cause"] for r in issues.collect()] == ["part too large: xl/comments1.xml"]


def matches(spark):
    rows = [("/f/a.xlsx", "a.xlsx", "S", 0, False, "value", 2, 2, " sow in line\n\nwater \r\nwait ", "B\r7", None, ["S"]),
            ("/f/b.docx", "b.docx", "Word", 0, False, "word", 3, 0, 'straight line, "weir" 畑', None, None, ["Word"])]
    return search(spark.createDataFrame(rows, units.UNITS), SearchRequest("line"))


def test_csv_json_and_xlsx(spark, tmp_path):
    m = matches(spark)
    export.publish(str(tmp_path / "o.csv"), lambda p: export.write_csv(m, p, "ja"))
    raw = (tmp_path / "o.csv").read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\n") == 3
    rows = list(csv.reader(raw.decode("utf-8-sig").splitlines()))
    assert rows[0][1] == "ファイル名" and rows[1][6:] == ["値", "sow in line  water  wait", "B 7"] and rows[2][7] == 'straight line, "weir" 畑'
    export.write_json(m, str(tmp_path / "o.json"))
    got = json.loads((tmp_path / "o.json").read_text())
    assert got["total_matches"] == 2 and got["matches"][1]["full_content"] == 'straight line, "weir" 畑' and "formula" not in got["matches"][1]
    export.write_json(m.where("id < 0"), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == {"total_matches": 0, "matches": []}
    export.write_xlsx(m, str(tmp_path / "o.xlsx"))
    back = [r for r in parse("/o.xlsx", (tmp_path / "o.xlsx").read_bytes())]
    assert [r["text"] for r in back if r["row_index"] == 1][:2] == ["ID", "File name"]
    assert [r["text"] for r in back if r["col_index"] == 8][1] == " sow in line\n\nwater \r\nwait ".replace("\r\n", "\n")
    export.write_json_lines(m, str(tmp_path / "lines"))
    export.write_csv_parts(m, str(tmp_path / "parts"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "parts")).count() == 2


def test_publishing_never_harms_other_files(tmp_path):
    write = lambda p: open(p, "w").close()
    target = tmp_path / "x.csv"
    export.publish(str(target), write)
    with pytest.raises(export.ExportError):
        export.publish(str(target), write)
    export.publish(str(target), write, overwrite=True)
    with pytest.raises(export.ExportError):
        export.publish(str(target), write, overwrite=True, inputs=(str(target),))
    os.symlink(target, tmp_path / "link.csv")
    for bad in ("link.csv", ""):
        with pytest.raises(export.ExportError):
            export.publish(str(tmp_path / bad), write, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["link.csv", "x.csv"]


def grid(spark, cells):
    rows = [("/g.xlsx", "g.xlsx", "Sheet1", 0, False, "value", r, c, v, None, None, ["Sheet1"]) for r, c, v in cells]
    return spark.createDataFrame(rows, units.UNITS)


def test_header_and_key_of_a_titled_grid(spark):
    u = grid(spark, [(1, 2, "Harbour log"), (3, 1, "Berth"), (3, 2, "Ship"), (3, 3, "Cargo"), (4, 1, "north 2"), (4, 2, "Aurora"), (4, 3, "timber"), (5, 3, "salt"), (6, 2, "Brise")])
    told = lambda word: [tuple(r)[1:] for r in context.header_context(search(u, SearchRequest(word)), u).collect()]
    assert told("timber") == [(3, 1, "Cargo", "north 2")]
    assert told("salt") == [(4, 2, "timber", "Row 5")]  # nothing left of it in its row: the key column is that of the first row
    assert told("Brise") == [(4, 1, "Aurora", "Row 6")]
    assert told("Harbour") == [(1, 1, "Harbour log", "Row 1")]


def test_markdown_of_a_grid(spark, tmp_path):
    u = grid(spark, [(1, 1, "Well"), (1, 2, "Depth"), (2, 1, "Mill lane"), (2, 2, "17 | 18"), (3, 1, "Old square"), (3, 2, "9")])
    sections = context.sheet_context(search(u, SearchRequest("17")), u)
    text = sections.collect()[0]["section_text"]
    assert text == ("### g.xlsx - Sheet1\n- Target Cell: [Sheet1] B2 (Column: Depth, Row: Mill lane)\n  - Matched Value: **17 \\| 18**\n\n"
                    "| Well | Depth |\n| --- | --- |\n| Mill lane | **17 \\| 18** |")
    export.write_markdown(sections, str(tmp_path / "s.md"))
    assert (tmp_path / "s.md").read_text() == text + "\n"
    export.write_markdown(sections.where("false"), str(tmp_path / "none.md"))
    assert (tmp_path / "none.md").read_text() == ""


def test_wide_grid_shows_a_window(spark):
    u = grid(spark, [(1, c, f"day {c}") for c in range(1, 31)] + [(2, c, f"t{c:02d}") for c in range(1, 31)])
    lines = context.sheet_context(search(u, SearchRequest("t17")), u, window=2).collect()[0]["section_text"].splitlines()
    assert lines[-3:] == ["| day 1 | ... | day 15 | day 16 | day 17 | day 18 | day 19 | ... |", "| " + " | ".join(["---"] * 8) + " |",
                          "| t01 | ... | t15 | t16 | **t17** | t18 | t19 | ... |"]


def test_pages_of_a_sheet(spark):
    u = grid(spark, [(2, 2, "a|b"), (4, 3, "x\ny"), (5, 1, "end")])
    page = lambda *a: [(r["row_number"], r["line"]) for r in context.sheet_page(u, *a).orderBy("row_number").collect()]
    assert page() == page(0, 0) == [(1, "| 1 |  |  |  |"), (2, "| 2 |  | a\\|b |  |"), (3, "| 3 |  |  |  |"), (4, "| 4 |  |  | x y |"), (5, "| 5 | end |  |  |")]
    assert page(4, 1) == [(4, "| 4 |  |  | x y |")] and page(6, 5) == []
    text = context.sheet_preview(u, 4, 9).collect()[0]["page"]
    assert text == "Preview of 'Sheet1' in /g.xlsx (Rows 4-5 of 5, 3 columns):\n\n| Row | A | B | C |\n|---|---|---|---|\n| 4 |  |  | x y |\n| 5 | end |  |  |"


def test_result_texts(spark):
    m = matches(spark)
    text = search_ops.result_text(m, "line").collect()[0]["result_text"]
    assert text.startswith("Found 2 match(es):\n\n- File: /f/a.xlsx\n  Sheet: S\n  Cell: B2 (Row 2, Col 2)\n  Type: CellValue\n  Content: sow in line\n\nwater \r\nwait\n  Snippet: ")
    assert "  Formula: B\r7\n" in text
    assert search_ops.result_text(m, "line", 1).collect()[0]["result_text"].startswith("Found 2 matches (truncated to maximum 1 results):\n\n- File: /f/a.xlsx")
    assert search_ops.result_text(m.where("id < 0"), "line").collect()[0]["result_text"] == "No matches found for query: 'line'."


def test_several_roots_files_and_issues(spark, folder, tmp_path_factory):
    other = tmp_path_factory.mktemp("other")
    document(other / "one.docx")
    workbook(other / "two.xlsx")
    roots = [folder, f"{folder}/sub", f"{folder}/", f"file:{folder}", str(other / "one.docx"), str(other / "gone"), f"{folder}/sub/text.docx"]
    good, bad = checked_roots(spark, roots)
    assert good == [folder, str(other / "one.docx")] and [r for r, _ in bad] == [str(other / "gone")]
    u, issues = units_and_issues(spark, roots, PathFilter(include="*.docx", ignore="[unclosed", extensions=ALL_EXTENSIONS))
    assert sorted({r["full_path"] for r in u.select("full_path").collect()}) == sorted([f"{folder}/sub/text.docx", str(other / "one.docx")])
    assert u.where("text = 'header needle'").count() == 2
    told = {(r["full_path"].rpartition("/")[2], r["stage"]) for r in issues.collect()}
    assert told == {("gone", "root"), ("ignore_patterns", "ignore_patterns"), ("locked.docx", "workbook")}
    u, issues = units_and_issues(spark, [str(other / "gone")], PathFilter())
    assert u.collect() == [] and issues.count() == 1


def test_patterns_that_cant_be_read_let_everything_pass():
    for bad in ('"open quote', "a[b", "[z-a]x", "dangling\\"):
        good, issues = PathFilter(include=bad, ignore="ok*").checked()
        assert good.include == "" and good.ignore == "ok*" and [f for f, _ in issues] == ["file_patterns"], bad
    assert PathFilter(include="[a-z]*, [!x]?, []a].docx").checked()[1] == []


def package(parts):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return raw.getvalue()


def test_readings_and_large_integers(tmp_path):
    book = package({
        "xl/workbook.xml": f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml")),
        "xl/sharedStrings.xml": '<sst><si><t>大阪</t><rPh sb="0" eb="2"><t>オオサカ</t></rPh></si></sst>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="3"><c t="s"><v>0</v></c><c><v>12345678901234567890</v></c><c r="F3"><v>1e21</v></c><c><v>250</v></c></row>'
        '<row><c t="inlineStr"><is><r><t>京</t></r><rPh><t>キョウ</t></rPh><r><t>都</t></r></is></c><c><v>-0.5</v></c></row></sheetData></worksheet>'})
    got = [(r["row_index"], r["col_index"], r["text"]) for r in parse("/b.xlsx", book)]
    assert got == [(3, 1, "大阪"), (3, 2, "12345678901234567000"), (3, 6, "1000000000000000000000"), (3, 7, "250"), (4, 1, "京都"), (4, 2, "-0.5")]


def test_text_boxes_end_first():
    doc = package({"word/document.xml": "<document><p><r><t>lost before</t></r><drawing><txbxContent><p><r><t>box one</t></r></p><p><r><t>box two</t></r></p></txbxContent></drawing><r><t>after</t></r></p>"
                   "<p><r><t>plain</t></r></p></document>"})
    assert [(r["unit_kind"], r["row_index"], r["text"]) for r in parse("/d.docx", doc)] == [("shape", 1, "box one"), ("shape", 2, "box two"), ("word", 3, "after"), ("word", 4, "plain")]


def test_damaged_parts_leave_the_others():
    book = package({
        "xl/workbook.xml": f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="A" r:id="r1"/><sheet name="B" r:id="r2"/><sheet name="C" r:id="r9"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml"), ("r2", "worksheet", "worksheets/sheet2.xml")),
        "xl/worksheets/sheet1.xml": '<worksheet><row r="1"><c r="A1"><v>1</v></c></row><row r="2"><c r="A2"><v>2</v></c></row><broken', "xl/worksheets/sheet2.xml": '<worksheet><c r="B2"><v>7</v></c></worksheet>',
        "xl/worksheets/_rels/sheet2.xml.rels": rels(("c", "comments", "../gone.xml"))})
    rows = parse("/b.xlsx", book)
    assert [r["text"] for r in rows if "text" in r] == ["1", "2", "7"] and sum("issue" in r for r in rows) == 3
    doc = package({"word/document.xml": "<d><p><r><t>read</t></r></p><", "word/header1.xml": "<h><p><r><t>head</t></r></p></h>"})
    rows = parse("/d.docx", doc)
    assert [r["text"] for r in rows if "text" in r] == ["read", "head"] and sum("issue" in r for r in rows) == 1
    deep = "<grpSp>" * 200 + "</grpSp>" * 200
    book = package({"xl/workbook.xml": f'<workbook xmlns:r="{OFFICE}"><sheets><sheet name="A" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "s.xml")),
                    "xl/s.xml": '<worksheet><c r="A1"><v>1</v></c></worksheet>', "xl/_rels/s.xml.rels": rels(("d", "drawing", "d.xml")), "xl/d.xml": f"<wsDr>{deep}</wsDr>"})
    assert [r.get("text", r.get("issue")) for r in parse("/b.xlsx", book)] == ["1", "xl/d.xml: ValueError: drawing nested too deeply: xl/d.xml"]


def test_stream_finds_each_match_once(spark, tmp_path):
    u = grid(spark, [(1, 1, "needle one"), (2, 1, "other")])
    u.write.parquet(str(tmp_path / "in/a"))
    u.write.parquet(str(tmp_path / "in/b"))  # the same unit again
    stream = lambda: arriving_units(spark, str(tmp_path / "in/*"), max_files=1)

    def run():
        q = write_matches(search_stream(stream(), SearchRequest("needle")), str(tmp_path / "out"), str(tmp_path / "state"))
        assert q.awaitTermination(120)
        return [r["full_content"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("full_content").collect()]

    assert run() == ["needle one"]
    grid(spark, [(3, 1, "needle two")]).write.parquet(str(tmp_path / "in/c"))
    assert run() == ["needle one", "needle two"]


def test_stream_with_a_bounded_state(spark, tmp_path):
    u = grid(spark, [(1, 1, "needle one"), (2, 1, "needle two")])
    for k in "ab":
        u.write.parquet(str(tmp_path / "in" / k))
    found = search_stream(arriving_units(spark, str(tmp_path / "in/*"), max_files=1), SearchRequest("needle"), within="1 hour")
    q = write_matches(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert q.awaitTermination(120)
    assert [r["full_content"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("full_content").collect()] == ["needle one", "needle two"]


def test_heading_before(spark):
    u = units.paragraph_units(spark.createDataFrame([("d", "# Top\ntext\n1. Part\nmore")], "k string, t string"), F.col("k"), F.col("k"), F.col("t"))
    assert [r["section"] for r in context.headings_before(u).orderBy("row_index").collect()] == ["Document Section", "# Top", "# Top", "1. Part"]


def test_units_of_a_listed_tree(spark, tmp_path):
    """Names that Spark's reader skips, links, two names of a file, ignored folders, an explicit lock file, damage and missing roots."""
    root = tmp_path / "in"
    for folder in ("a/b", "_under", ".dot", "skip/more"):
        (root / folder).mkdir(parents=True)
    workbook(root / "a/one.xlsx")
    for name in ("_under/_u.xlsx", "skip/more/in.xlsx", "a/~$lock.xlsx"):
        workbook(root / name)
    document(root / ".dot/.d.docx")
    (root / "a/b/broken.xlsx").write_bytes(b"no archive")
    os.link(root / "a/one.xlsx", root / "a/two.xlsx")
    os.symlink(root / "a", root / "link")
    workbook(tmp_path / "~$named.xlsx")
    roots, wanted = [str(root), str(tmp_path / "~$named.xlsx"), str(tmp_path / "none"), str(root / "a")], PathFilter(ignore="skip/", extensions=ALL_EXTENSIONS)
    u, issues = units_of_tree(spark, roots, wanted)
    by_file = {os.path.relpath(r["full_path"], tmp_path): r["count"] for r in u.groupBy("full_path").count().collect()}
    each = len([r for r in parse("/x.xlsx", (root / "a/one.xlsx").read_bytes()) if "issue" not in r])
    text = len(parse("/x.docx", (root / ".dot/.d.docx").read_bytes()))
    assert by_file == {"in/a/one.xlsx": each, "in/_under/_u.xlsx": each, "in/.dot/.d.docx": text, "~$named.xlsx": each}
    told = {(os.path.relpath(r["full_path"], tmp_path), r["stage"]) for r in issues.collect()}
    assert told == {("in/a/b/broken.xlsx", "workbook"), ("none", "root")}
    both = units_of_tree(spark, [str(root / "a")], wanted, once=False)[0]
    assert sorted(r[0].rpartition("/")[2] for r in both.select("full_path").distinct().collect()) == ["one.xlsx", "two.xlsx"]
    found = search(u, SearchRequest("needle", hidden_sheets=True)).groupBy("file_name").count().collect()
    assert {r["file_name"] for r in found} == {"one.xlsx", "_u.xlsx", ".d.docx", "~$named.xlsx"}


def test_a_listed_file_that_is_gone_is_an_issue(spark, tmp_path):
    from textquarry.sources.listing import list_tree
    from textquarry.sources.office import parsed_listing

    workbook(tmp_path / "here.xlsx")
    workbook(tmp_path / "gone.xlsx")
    listed = list_tree(spark, [str(tmp_path)], PathFilter())
    os.remove(tmp_path / "gone.xlsx")
    rows = parsed_listing(listed).collect()
    assert {r["full_path"].rpartition("/")[2] for r in rows if r["issue"]} == {"gone.xlsx"} and len({r["full_path"] for r in rows}) == 2
    u, issues = units_of_tree(spark, [str(tmp_path / "none")], PathFilter())
    assert u.count() == 0 and [r["stage"] for r in issues.collect()] == ["root"]
