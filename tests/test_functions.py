import random
import time
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.functions import cells, matching, patterns
from textquarry.operators import paths, units
from textquarry.operators.search import InvalidRequest, SearchRequest, hits, project, refine, search, sorted_by


def one(spark, column, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}").orderBy("k").select(column.alias("y")).collect()]


def test_addresses(spark):
    assert one(spark, cells.column_name(F.col("x")), 0, 25, 26, 701, 702, 16383, kind="long") == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    got = one(spark, cells.parse_address(F.col("x")), "A1", "xfd1048576", "B", "12", "A0", "", None)
    assert [tuple(r) if r else None for r in got] == [(0, 0), (1048575, 16383), None, None, None, None, None]


def test_numbers(spark):
    values = [0.0, 5.0, 100.0, 1234567.85, 1e21, 1.5e-7, -2.5, 123456789012345680.0, 0.1, 1e7, 12345678.9, -1e-10, 3.0e10]
    values += [random.Random(1).uniform(-1, 1) * 10 ** e for e in range(-20, 20)]
    plain = lambda v: (lambda s: s.rstrip("0").rstrip(".") if "." in s else s)(format(Decimal(repr(v)), "f"))
    assert one(spark, cells.render_number(F.col("x")), *values, kind="double") == [plain(v) for v in values]
    assert one(spark, cells.render_number(F.col("x")), float("inf"), float("nan"), kind="double") == ["inf", "NaN"]


def test_text_rules(spark):
    assert one(spark, cells.csv_field(F.col("x")), "\u00a0 a\r\nb\rc\nd \n") == ["a b c d"]
    assert one(spark, cells.markdown_cell(F.col("x")), "\t|left| right\r\n\nlow\rend ") == ["\\|left\\| right<br><br>low<br>end"]
    assert one(spark, cells.markdown_preview_cell(F.col("x")), "a|b\r\nc ") == ["a\\|b  c "]
    shapes = [r"\\?\C:\a", r"\\?\UNC\srv\b", r"\\?\unc\srv\b", "//?/C:/x", "//?/uNC/srv/b", r"\/?\x", "/plain", "", None]
    assert one(spark, cells.display_path(F.col("x")), *shapes) == [r"C:\a", r"\\srv\b", r"\\srv\b", "C:/x", r"\\srv/b", r"\/?\x", "/plain", "", None]
    assert one(spark, cells.export_path(F.col("x")), *shapes) == [r"C:\a", r"\\srv\b", r"unc\srv\b", "//?/C:/x", "//?/uNC/srv/b", r"\/?\x", "/plain", "", None]
    assert one(spark, cells.is_heading(F.col("x")), "# t", "1. Intro", "Chapter two", "第1章", "1. Ends.", "plain", "Section " + "x" * 90) == [True, True, True, True, False, False, False]


def test_snippets(spark):
    text, at = "0123456789" * 5 + "<needle>" + "abcdefghij" * 5, 52
    got = one(spark, matching.snippet(F.col("x"), F.lit(at), F.lit(6)), text)[0]
    assert got == "..." + text[21:50] + "&lt;" + matching.MARK_OPEN + "needle" + matching.MARK_CLOSE + "&gt;" + text[58:87] + "..."
    assert one(spark, matching.snippet(F.col("x"), F.lit(2), F.lit(99)), "猫&") == ["猫" + matching.MARK_OPEN + "&amp;" + matching.MARK_CLOSE]


def test_regex_dialect(spark):
    for bad in ("a(?=b)", r"(a)\1", "(?<!x)y", "(?>a)"):
        with pytest.raises(matching.InvalidPattern):
            SearchRequest(bad, is_regex=True).validated()
    assert one(spark, matching.regex_position(F.col("x"), "É"), "xé") == [2]
    assert one(spark, matching.regex_hit(F.col("x"), r"\w+", True), "«été»") == ["été"]
    assert one(spark, matching.regex_hit(F.col("x"), r"\\+X"), r"a\\x") == [r"\\x"]


def test_token_lists():
    assert patterns.split_list('a, "b,c" ,, "d ""q"""') == ["a", "b,c", 'd "q"']
    assert patterns.split_list(r'm\"n,o", "p\"q"') == [r'm\n,o', 'p"q']
    assert patterns.split_roots('/srv/maps, "/srv/old, new"') == ["/srv/maps", "/srv/old, new"]
    for none in ('a, "b', "", " ", ' ,"",, '):
        with pytest.raises(ValueError):
            patterns.split_roots(none)
    assert patterns.complement(["plan?", "harvest.XLS", "dot..", "a.b"], [".xlsm", ".docx"]) == ["plan?.xlsm", "plan?.docx", "harvest.XLS", "dot.xlsm", "dot.docx", "a.b.xlsm", "a.b.docx"]


@given(st.lists(st.text(alphabet='ab ,"*.', min_size=1, max_size=8).map(str.strip).filter(bool), max_size=5))
def test_token_lists_round_trip(tokens):
    assert patterns.split_list(patterns.join_list(tokens), escapes=False) == tokens


def test_path_filters(spark):
    names = ["crops/wheat-02.xlsx", "soil_ph.xlsm", "weather.xlsx", "~$wheat.xlsx", "old/wheat.xlsx", "farm/barley.xls", "diary.docx", "cache/deep/wheat.xlsx", "draft.bak.xlsx", "prices.xlsx"]
    keep = lambda **kw: [n for n, ok in zip(names, one(spark, patterns.PathFilter(**kw).accepts(F.col("x")), *names)) if ok]
    assert keep(include="*wheat*, soil_*") == ["crops/wheat-02.xlsx", "soil_ph.xlsm", "old/wheat.xlsx", "cache/deep/wheat.xlsx"]
    assert keep(include="*wheat*", ignore="old/*, cache/") == ["crops/wheat-02.xlsx"]
    assert keep(ignore="*.xlsx, !prices.xlsx") == ["soil_ph.xlsm", "farm/barley.xls", "prices.xlsx"]
    assert keep(include="*.docx") == ["diary.docx"]
    assert "diary.docx" not in keep()


def test_nested_roots(spark):
    df = spark.createDataFrame([("/srv/maps",), ("/srv/maps-2",), ("/srv/maps/north",), ("/srv/./maps//north/../south/",), ("/opt",), ("/opt/x/..",)], "path string")
    assert sorted(r[0] for r in paths.prune_nested(df).collect()) == ["/opt", "/srv/maps", "/srv/maps-2"]


def test_paragraph_rules(spark):
    assert one(spark, units.paragraphs(F.col("x")), "  Rain fell.\r\rThen\x0bsnow\x07cell one\x07\r\x0c \x01\nLast\x0c") == [
        ["Rain fell.", "Then snow\tcell one", "Last"]]


def unit_rows(spark):
    rows = [("/f/a.xlsx", "a.xlsx", "S", 0, False, "value", 2, 2, "Needle & co", "=A1", None, ["S", "H"]),
            ("/f/a.xlsx", "a.xlsx", "S", 0, False, "formula", 2, 2, "CONCAT(needle)", "CONCAT(needle)", None, ["S", "H"]),
            ("/f/a.xlsx", "a.xlsx", "H", 1, True, "value", 1, 1, "needle", None, None, ["S", "H"]),
            ("/f/a.xlsx", "a.xlsx", "S", 0, False, "comment", 1, 1, "", None, None, ["S", "H"]),
            ("/f/a.xlsx", "a.xlsx", "S", 0, False, "shape", 0, 0, "a needle", None, "Box", ["S", "H"]),
            ("/f/b.docx", "b.docx", "Word", 0, False, "word", 3, 0, "the needle", None, None, ["Word"])]
    return spark.createDataFrame(rows, units.UNITS)


def test_scopes_and_kinds(spark):
    u = unit_rows(spark)
    got = search(u, SearchRequest("NEEDLE", hidden_sheets=True)).orderBy("id").collect()
    assert [(r["id"], r["match_type"], r["cell_address"]) for r in got] == [
        (1, "CellValue", "B2"), (2, "Formula", "B2"), (3, "Shape", ""), (4, "HiddenSheet", "A1"), (5, "WordText", "-")]
    kinds = lambda **kw: sorted(r["match_type"] for r in project(hits(u, SearchRequest("needle", **kw))).collect())
    assert kinds() == ["CellValue", "Formula", "Shape", "WordText"]
    assert kinds(match_case=True) == ["Formula", "Shape", "WordText"]
    assert kinds(values=False, formulas=False, comments=False, shapes=False) == ["WordText"]
    assert not SearchRequest.for_command_line("x").shapes and SearchRequest("x").shapes
    assert sorted(r["match_type"] for r in project(hits(u, SearchRequest("^$", is_regex=True))).collect()) == ["Comment"]
    with pytest.raises(InvalidRequest):
        SearchRequest("  ").validated()


def test_refine_and_sort(spark):
    m = search(unit_rows(spark), SearchRequest("needle"))
    assert refine(m, "BOX").count() == 1 and refine(m, " ").count() == m.count() and refine(m, "b.docx").count() == 1
    assert [r["cell_address"] for r in sorted_by(m, "cell_address", descending=True).collect()][:2] == ["B2", "B2"]


def test_children_of_what_is_typed(spark):
    from textquarry.operators import paths

    dirs = spark.createDataFrame([(p,) for p in ("/a/one/x", "/a/one/y", "/a/on", "/a/two", "/b/one", "/a")], "path string")
    told = lambda t: [r["path"] for r in paths.complete_children(dirs, t).collect()]
    assert told("/a/on") == ["/a/on", "/a/one"] and told("/a/") == ["/a/on", "/a/one", "/a/two"] and told("/") == ["/a", "/b"]
    assert told("/a/one/") == ["/a/one/x", "/a/one/y"] and told("a/") == [] and told("") == [] and told("/zz") == []


def test_permitted_folders(spark):
    from textquarry.operators import paths

    df = spark.createDataFrame([(p,) for p in ("/a/b", "/a/bc", "/a/b/c", "/x", "/a", "/a/b/../secret", "/y/../x/z", "/a/./b//d", "/../x", "/x/../..", None)], "path string")
    folders = spark.createDataFrame([("/a/q/../b/",), ("/x",)], "path string")
    assert {r["path"] for r in paths.permitted(df, folders).where("allowed").collect()} == {"/a/b", "/a/b/c", "/x", "/y/../x/z", "/a/./b//d", "/../x"}
    assert paths.permitted(df, folders.limit(0)).where("allowed").count() == 11


def test_canonical_paths(spark):
    told = {"/a/../b": "/b", "/..": "/", "/": "/", "a/./b/": "a/b", "../a": "a", "a/../../b": "b", ".": "", "": "", "/a/..b/.c": "/a/..b/.c", "//a///b": "/a/b", None: None}
    assert one(spark, paths.canonical(F.col("x")), *told) == list(told.values())


def test_many_rules_as_one_by_one(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["a", "b", "log", "tmp", "x.tmp", "x.log", "deep", "y.tar.gz", "é"])
    files = ["/".join(word() for _ in range(rnd.randint(1, 5))) for _ in range(400)] + ["", "a/", "a//b"]
    lines = [rnd.choice(["", "!"]) + rnd.choice([word(), f"{word()}/", f"{word()}/{word()}", f"/{word()}", "*.tmp", "*.log", "*.tar.gz", "x*", "**/deep", "a/**", f"**/{word()}/*", "?", "[ab]/"]) for _ in range(60)]
    df = spark.createDataFrame([(f,) for f in files], "path string")
    one_by_one = patterns.PathFilter(ignore=patterns.join_list(lines)).ignored(F.col("path"))
    want = {r["path"]: r["w"] for r in df.select("path", one_by_one.alias("w")).collect()}
    assert {r["path"]: r["ignored"] for r in paths.ignored_by_rules(df, lines).collect()} == want
    assert len(set(want.values())) == 2 and paths.ignored_by_rules(df, []).where("ignored").count() == 0


def test_a_tagged_search_stops(spark):
    import threading
    import time

    from textquarry.operators import runs

    ended = []

    def work():
        with runs.tagged(spark, "slow-search"):
            try:
                spark.range(1 << 40).selectExpr("sum(id % 7 * id)").collect()
            except Exception as e:
                ended.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    for _ in range(200):
        time.sleep(0.1)
        if runs.progress(spark)[1] and runs.cancel(spark, "slow-search"):
            break
    t.join(60)
    assert not t.is_alive() and ended
    assert runs.progress(spark)[1] >= 0


def test_natural_order(spark):
    names = ["", "9", "10", "010", "a", "Ą", "ą1", "a2", "A10", "a10b", "b 9", "B 123456789012345678901234567890", "b 123456789012345678901234567891", "Łódź", "lodz 2", "ō", "P", "x007y", "X7z"]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy(cells.natural_key(F.col("n")), "k").collect()
    assert [r["n"] for r in got] == names


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_a_long_column_is_scanned_in_blocks(spark, monkeypatch, block):
    """The header of a hit far down a column, and of hits in the first row, against a plain walk."""
    from textquarry.operators import context

    monkeypatch.setattr(context, "BLOCK_ROWS", block)
    rnd = random.Random(2)
    grid = {(r, c): f"v{r}.{c}" for r in range(1, 400) for c in range(1, 4) if rnd.random() < (0.05 if r > 20 else 0.7)}
    rows = [("/f", "f", "S", 0, False, "value", r, c, v, None, None, ["S"]) for (r, c), v in grid.items()]
    hits_ = spark.createDataFrame([(r * 10 + c, "/f", "S", r, c) for r, c in grid], "id long, full_path string, sheet_name string, row_index long, col_index long")
    got = {r["id"]: (r["header_row"], r["column_header"]) for r in context.header_context(hits_, spark.createDataFrame(rows, units.UNITS)).collect()}
    size = {r: sum((r, c) in grid for c in range(1, 4)) for r, _ in grid}
    first = min(size)
    for (r, c), v in grid.items():
        above = [q for q in range(r - 1, 0, -1) if (q, c) in grid]
        dense = next((q for q in above if size[q] >= 2), None)
        best = max(above, key=lambda q: (size[q], q), default=None)
        row = r if r <= first else dense or best or first
        assert got[r * 10 + c] == (row, grid.get((row, c), "Column " + "ABC"[c - 1])), (r, c)


def test_counters_come_from_the_write(spark, tmp_path):
    from textquarry.operators import report

    matches = spark.range(25).select("id")
    files = spark.createDataFrame([("a", None), ("b", "broken"), ("b", "again"), ("c", None)], "full_path string, cause string")
    got = report.written(matches, files, lambda df: df.write.parquet(f"{tmp_path}/out")).first()
    assert tuple(got) == (3, 2, 1, 25, report.PARTIAL)
    assert report.written(matches.limit(0), files.where("full_path = 'b'"), lambda df: df.write.parquet(f"{tmp_path}/none")).first()["status"] == report.FAILURE
    assert tuple(report.written(matches, files.where("cause is null"), lambda df: df.write.format("noop").mode("overwrite").save()).first()) == (2, 2, 0, 25, report.SUCCESS)


def test_positions_where_lower_casing_changes_a_length(spark):
    def span(text, word):
        low, at = text.lower(), text.lower().find(word.lower())
        ends = [len(text[: k + 1].lower()) for k in range(len(text))]
        first = sum(e < at + 1 for e in ends)
        return first + 1, sum(e - len(c.lower()) < at + len(word.lower()) for e, c in zip(ends, text)) - first

    texts = ["İİ needle", "needle İ", "xİneedleİ", "🙂İ NEEDLE", "no İ but needle İ needle", "plain needle"]
    u = spark.createDataFrame([("/f", "f", "Word", 0, False, "word", k, 0, t, None, None, ["Word"]) for k, t in enumerate(texts)], units.UNITS)
    for word in ("needle", "e İ", "İ", "i\u0307"):
        got = {r["row_index"]: (r["hit_pos"], r["hit_len"]) for r in hits(u, SearchRequest(word)).collect()}
        assert got == {k: span(t, word) for k, t in enumerate(texts) if word.lower() in t.lower()}, word
    shown = project(hits(u, SearchRequest("needle"))).where("row_index = 0").first()["snippet"]
    assert shown == "İİ " + matching.MARK_OPEN + "needle" + matching.MARK_CLOSE


def _spans(spark, texts, word):
    u = spark.createDataFrame([("/f", "f", "Word", 0, False, "word", k, 0, t, None, None, ["Word"]) for k, t in enumerate(texts)], units.UNITS)
    return {r["row_index"]: (r["hit_pos"], r["hit_len"]) for r in hits(u, SearchRequest(word)).collect()}


def _span(text, word):
    """By characters: the place in ``text`` of each lower-cased character."""
    at = text.lower().find(word.lower())
    sources = [k for k, c in enumerate(text) for _ in c.lower()][at: at + len(word.lower())]
    return sources[0] + 1, sources[-1] - sources[0] + 1


def test_positions_among_dots(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choices("İi̇Inß🙂. ", k=pick.randint(1, 25))) for _ in range(300)]
    for word in ("n", "i̇", "̇", "İn", "̇N", "🙂İ", ". "):
        assert _spans(spark, texts, word) == {k: _span(t, word) for k, t in enumerate(texts) if word.lower() in t.lower()}, word


def test_positions_in_a_locale_that_changes_other_letters(spark):
    """In Lithuanian Ì becomes three characters: lengths of all characters are summed up to the hit."""
    locale = spark._jvm.java.util.Locale
    usual = locale.getDefault()
    try:
        locale.setDefault(locale.forLanguageTag("lt"))
        assert spark.range(1).select(F.length(F.lower(F.concat(F.lit("Ì"), F.substring(F.col("id").cast("string"), 2, 1))))).first()[0] == 3
        assert _spans(spark, ["ÌÌ needle", "İÌ needle Ì", "plain needle"], "Needle") == {0: (4, 6), 1: (4, 6), 2: (7, 6)}
    finally:
        locale.setDefault(usual)


def test_one_letter_grows_when_it_is_lower_cased(spark):
    letters = spark.createDataFrame([(chr(k),) for k in range(0x110000) if not 0xD800 <= k < 0xE000], "c string")
    assert [r[0] for r in letters.where(F.length(F.lower("c")) != 1).collect()] == ["İ"]


def test_white_space_is_as_in_expressions(spark):
    letters = spark.createDataFrame([(chr(k),) for k in range(0x110000) if not 0xD800 <= k < 0xE000], "c string")
    assert sorted(r[0] for r in letters.where(F.col("c").rlike(r"(?U)^\s$") | (F.col("c") == "\n")).collect()) == sorted(units.WHITE_SPACE)
    blanks = units.WHITE_SPACE.translate({ord(c): None for c in "\r\n\f\x0b\x85"})
    text = f"{blanks}a{blanks}b\x0b{blanks}\r\x07\f{blanks}\n\x07c\x07d\x0be\x01\x85"
    assert one(spark, units.paragraphs(F.col("x")), text, "plain", "", None) == [[f"a{blanks}b", "c\td e"], ["plain"], [], None]


def test_work_of_a_hit_is_up_to_its_end(spark):
    """What lies behind a hit is not taken apart; runs of blanks inside a paragraph are passed once."""
    def seconds(frame):
        start = time.time()
        assert frame.where("hit_len = 6").count() == 16
        return time.time() - start

    ids = spark.range(16)
    behind = units.paragraph_units(ids, F.lit("/f"), F.lit("f"), F.concat(F.lit("İ needle"), F.repeat(F.lit("İx"), F.lit(1_000_000) + F.col("id").cast("int"))))
    assert seconds(hits(behind, SearchRequest("Needle")).where("hit_pos = 3")) < 20
    inner = units.paragraph_units(ids, F.lit("/f"), F.lit("f"), F.concat(F.lit("needle"), F.repeat(F.lit(" "), F.lit(200_000) + F.col("id").cast("int")), F.lit(".")))
    assert seconds(hits(inner, SearchRequest("needle"))) < 20
