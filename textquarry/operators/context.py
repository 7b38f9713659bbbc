"""Context of hits: surrounding cells, header row and key column, preceding headings, Markdown for prompts.

All are joins, windows and aggregates on units. Hits meet only the cells of their own rows and columns: band joins go over
exploded neighbour keys, header look-ups over aggregates of the sheets that have hits, whose values are stored once; no sheet
and no column is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import cells
from textquarry.operators.storage import stored

SHEET = ["full_path", "sheet_name"]
PREVIEW_ROWS, PREVIEW_COLS = 3, 2
WINDOW_DEFAULT, WINDOW_MIN, WINDOW_MAX = 5, 1, 20
BLOCK_ROWS = 1 << 16  # rows of a column in one window


def values(units: DataFrame) -> DataFrame:
    return units.where(F.col("unit_kind") == "value").select(*SHEET, F.col("row_index").alias("r"), F.col("col_index").alias("c"), F.col("text").alias("v"))


def values_of_hit_sheets(hits: DataFrame, units: DataFrame) -> DataFrame:
    """``values`` of the sheets with hits, stored: the look-ups of a context read them several times."""
    return stored(values(units).join(hits.select(*SHEET).distinct(), SHEET, "left_semi"), "sheet-values")


def grid_preview(hits: DataFrame, units: DataFrame, rows: int = PREVIEW_ROWS, cols: int = PREVIEW_COLS) -> DataFrame:
    """The cells around each hit (id, full_path, sheet_name, row_index, col_index): a window of rows and columns, cut at the
    sheet's edge, with each cell's formula. Equi-joins on the exploded neighbour cells."""
    near = (
        hits.select("id", *SHEET, "row_index", "col_index")
        .withColumn("r", F.explode(F.sequence(F.greatest(F.lit(1), F.col("row_index") - rows), F.col("row_index") + rows)))
        .withColumn("c", F.explode(F.sequence(F.greatest(F.lit(1), F.col("col_index") - cols), F.col("col_index") + cols)))
        .withColumn("r", F.col("r").cast("long")))
    formulas = units.where(F.col("unit_kind") == "formula").select(*SHEET, F.col("row_index").alias("r"), F.col("col_index").alias("c"), F.col("text").alias("cell_formula"))
    return near.join(values(units), [*SHEET, "r", "c"]).join(formulas, [*SHEET, "r", "c"], "left").select(
        "id", *SHEET, "r", "c", F.col("v").alias("text"), "cell_formula", ((F.col("r") == F.col("row_index")) & (F.col("c") == F.col("col_index"))).alias("is_target"))


def header_context(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Column header and row key of each hit: ``header_rows`` on the sheets with hits."""
    found = stored(hits.select("id", *SHEET, "row_index", "col_index"), "hits")
    return header_rows(found, values_of_hit_sheets(found, units))


def header_rows(hits: DataFrame, all_values: DataFrame) -> DataFrame:
    """Column header and row key of each hit: id, header_row, key_col, column_header, row_key (rows and columns from 1).

    Header: going up from the hit, the first row with a cell in the hit's column and at least two cells in all; else, of the
    rows with a cell in that column, the fullest (nearest on ties); else the sheet's first row. Key: the leftmost cell left of
    the hit in its row; else in the sheet's first row; else the first column.
    """
    v = all_values.where(cells.trim_unicode(F.col("v")) != "")
    rows = stored(v.groupBy(*SHEET, "r").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("left")), "sheet-rows")
    edge = rows.groupBy(*SHEET).agg(F.min("r").alias("first_row"), F.min("left").alias("first_col"), F.min_by("left", "r").alias("top_left"))
    h = hits.select("id", *SHEET, F.col("row_index").alias("hr"), F.col("col_index").alias("hc")).join(edge, SHEET, "left").select(
        "id", *SHEET, "hr", "hc", F.coalesce("first_row", "hr").alias("first_row"), F.coalesce("first_col", "hc").alias("first_col"), "top_left")
    # as-of: along each column with hits, the cells above a hit: the last row of two cells or more, or the last at all (where no row has
    # two, all are as full). Rows go in blocks, so a window holds a block of a column; one row per block carries what lies above it
    in_columns = v.select(*SHEET, F.col("c").alias("hc"), "r").join(hits.select(*SHEET, F.col("col_index").alias("hc")).distinct(), [*SHEET, "hc"], "left_semi")
    cells_ = in_columns.join(rows.select(*SHEET, "r", "n"), [*SHEET, "r"]).withColumn("_asks", F.lit(0))
    asked = h.withColumn("r", F.col("hr")).withColumn("_asks", F.lit(-1))  # before the cells of its own row
    along = asked.unionByName(cells_, allowMissingColumns=True).select("*", F.floor(F.col("r") / BLOCK_ROWS).alias("block"))
    seen = {"dense": F.when(F.col("n") >= 2, F.col("r")), "any": F.when(F.col("n").isNotNull(), F.col("r"))}
    block = [*SHEET, "hc", "block"]
    above = Window.partitionBy(*SHEET, "hc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = along.groupBy(*block).agg(*[F.max(c).alias(x) for x, c in seen.items()]).select(*block, *[F.max(x).over(above).alias(f"{x}_above") for x in seen])
    inside = Window.partitionBy(*block).orderBy("r", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    h = along.select(*h.columns, "block", "_asks", *[F.max(c).over(inside).alias(x) for x, c in seen.items()]).where("_asks < 0").join(carried, block, "left")
    h = h.select(*asked.drop("r", "_asks").columns, *[F.coalesce(x, f"{x}_above").alias(x) for x in seen])
    h = h.withColumn("header_row", F.when(F.col("hr") <= F.col("first_row"), F.col("hr")).otherwise(F.coalesce("dense", "any", "first_row")))
    h = h.join(v.select(*SHEET, F.col("r").alias("header_row"), F.col("c").alias("hc"), F.col("v").alias("header")), [*SHEET, "header_row", "hc"], "left")
    h = h.join(rows.select(*SHEET, F.col("r").alias("hr"), F.col("left").alias("own_left")), [*SHEET, "hr"], "left")
    left = [F.when(F.col(c) < F.col("hc"), F.col(c)) for c in ("own_left", "top_left")]
    h = h.withColumn("key_col", F.when(F.col("hc") <= F.col("first_col"), F.col("hc")).otherwise(F.coalesce(*left, F.col("first_col"))))
    key_cell = v.select(*SHEET, F.col("r").alias("hr"), F.col("c").alias("key_col"), F.col("v").alias("key_text"))
    return h.join(key_cell, [*SHEET, "hr", "key_col"], "left").select(
        "id", "header_row", "key_col", F.coalesce("header", F.concat(F.lit(cells.COLUMN_PREFIX), cells.column_name(F.col("hc") - 1))).alias("column_header"),
        F.coalesce("key_text", F.concat(F.lit(cells.ROW_PREFIX), F.col("hr").cast("string"))).alias("row_key"))


def window_columns(hits: DataFrame, keys: DataFrame, units: DataFrame, window: int = WINDOW_DEFAULT) -> DataFrame:
    """Columns to show per sheet: those within ``window`` of a hit inside the used range, and the key column; ``gap_before``
    where columns are left out, ``gap_after`` on the last if used ones follow. ``keys``: full_path, sheet_name, key_col."""
    return columns_around(hits, keys, values(units), window)


def columns_around(hits: DataFrame, keys: DataFrame, all_values: DataFrame, window: int = WINDOW_DEFAULT) -> DataFrame:
    w = max(WINDOW_MIN, min(WINDOW_MAX, window))
    used = all_values.groupBy(*SHEET).agg(F.min("c").alias("first_col"), F.max("c").alias("last_col"))
    lo, hi = F.greatest(F.col("first_col"), F.col("col_index") - w), F.least(F.col("last_col"), F.col("col_index") + w)
    around = hits.select(*SHEET, "col_index").distinct().join(used, SHEET).where(lo <= hi).select(*SHEET, F.explode(F.sequence(lo, hi)).alias("c"))
    cols = around.unionByName(keys.select(*SHEET, F.col("key_col").alias("c"))).distinct().join(used.select(*SHEET, "last_col"), SHEET)
    order = Window.partitionBy(*SHEET).orderBy("c")
    return cols.select(*SHEET, "c", (F.col("c") > F.lag("c").over(order) + 1).alias("gap"), (F.lead("c").over(order).isNull() & (F.col("c") < F.col("last_col"))).alias("gap_after")).select(
        *SHEET, "c", F.coalesce("gap", F.lit(False)).alias("gap_before"), "gap_after")


def headings_before(units: DataFrame) -> DataFrame:
    """Paragraphs with the nearest heading before them (``section``)."""
    paras = units.where(F.col("unit_kind") == "word")
    before = Window.partitionBy("full_path").orderBy("row_index").rowsBetween(Window.unboundedPreceding, -1)
    text = cells.trim_unicode(F.col("text"))
    return paras.withColumn("section", F.coalesce(F.last(F.when(cells.is_heading(F.col("text")), text), ignorenulls=True).over(before), F.lit(cells.NO_HEADING)))


def word_context(matches: DataFrame, units: DataFrame, headings: bool = True) -> DataFrame:
    """One Markdown section per document with hits: (full_path, section_text); ``matches``: full_path, file_name, row_index, snippet.

    A document's hits meet in one row, which is the document's own text at most.
    """
    paras = headings_before(units).select("full_path", "row_index", "text", "section")
    m = matches.select("full_path", "file_name", "row_index", "snippet").join(paras, ["full_path", "row_index"])
    bold = cells.highlight(F.col("text"), F.col("snippet"))
    place = F.concat(F.lit("- Location: Paragraph "), F.col("row_index").cast("string"))
    entry = F.concat(place, F.lit("\n- Section: "), F.col("section"), F.lit("\n\n### "), F.col("section"), F.lit("\n> "), bold) if headings else F.concat(place, F.lit("\n\n> "), bold)
    return m.groupBy("full_path", "file_name").agg(F.array_sort(F.collect_list(F.struct("row_index", entry.alias("e")))).alias("es")).select(
        "full_path", F.concat_ws("\n\n", F.concat(F.lit("### "), F.col("file_name")), F.col("es.e")).alias("section_text"))


def sheet_context(matches: DataFrame, units: DataFrame, table: bool = True, window: int = WINDOW_DEFAULT) -> DataFrame:
    """One Markdown section per sheet with hits: target lines, then (``table``) the hit rows in a window of columns.

    The header row and key column of the table are those of the sheet's first hit. A section is one text, so a sheet's hits and the
    cells shown beside them meet in one row.
    """
    m = stored(matches.select("id", "file_name", *SHEET, "cell_address", "row_index", "col_index", "full_content"), "matches")
    v = values_of_hit_sheets(m, units)
    ctx = header_rows(m, v)
    lines = m.join(ctx, "id").select(
        *SHEET, "file_name", "id", "header_row", "key_col", F.concat(
            cells.target_line(F.col("sheet_name"), F.col("cell_address"), F.col("column_header"), F.col("row_key")),
            F.lit("\n  - Matched Value: **"), cells.markdown_cell(F.col("full_content")), F.lit("**")).alias("line"))
    head = stored(lines, "lines").groupBy(*SHEET, "file_name").agg(
        F.min(F.struct("id", "header_row", "key_col")).alias("first"), F.array_sort(F.collect_list(F.struct("id", "line"))).alias("ls"))
    title = F.concat(F.lit("### "), F.col("file_name"), F.lit(" - "), F.col("sheet_name"))
    if not table:
        return head.select(*SHEET, F.concat_ws("\n", title, F.col("ls.line")).alias("section_text"))
    cols = columns_around(m, head.select(*SHEET, F.col("first.key_col").alias("key_col")), v, window)
    shown = head.select(*SHEET, F.col("first.header_row").alias("r")).withColumn("kind", F.lit(0)).unionByName(
        m.select(*SHEET, F.col("row_index").alias("r")).distinct().withColumn("kind", F.lit(1)))
    hit = m.select(*SHEET, F.col("row_index").alias("r"), F.col("col_index").alias("c")).distinct().withColumn("hit", F.lit(True))
    body = shown.join(cols, SHEET).join(v, [*SHEET, "r", "c"], "left").join(hit, [*SHEET, "r", "c"], "left")
    text = cells.markdown_cell(F.coalesce("v", F.lit("")))
    label = F.when((F.col("kind") == 0) & (text == ""), F.concat(F.lit(cells.COLUMN_PREFIX), cells.column_name(F.col("c") - 1))).when(
        (F.col("kind") == 1) & F.col("hit"), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)
    cell = F.concat(F.when(F.col("gap_before"), "... | ").otherwise(""), label, F.when(F.col("gap_after"), " | ...").otherwise(""))
    rows = body.groupBy(*SHEET, "kind", "r").agg(F.array_sort(F.collect_list(F.struct("c", cell.alias("t"), F.when(F.col("gap_before"), 1).otherwise(0).alias("g1"), F.when(F.col("gap_after"), 1).otherwise(0).alias("g2")))).alias("cs"))
    row_line = F.concat(F.lit("| "), F.array_join("cs.t", " | "), F.lit(" |"))
    width = F.size("cs") + F.aggregate("cs", F.lit(0), lambda a, x: a + x["g1"] + x["g2"])
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    rows = rows.select(*SHEET, "kind", "r", F.when(F.col("kind") == 0, F.concat(row_line, F.lit("\n"), rule)).otherwise(row_line).alias("t"))
    tables = rows.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("kind", "r", "t"))).alias("ts"))
    return head.join(tables, SHEET).select(*SHEET, F.concat_ws("\n", title, F.col("ls.line"), F.lit(""), F.col("ts.t")).alias("section_text"))


def sheet_list(units: DataFrame) -> DataFrame:
    """The sheets of each workbook that hold anything, in order: full_path, sheet_pos, sheet_name, sheet_hidden, n_cells."""
    return units.where(F.col("unit_kind") != "word").groupBy("full_path", "sheet_pos", "sheet_name", "sheet_hidden").agg(
        F.count_if(F.col("unit_kind") == "value").alias("n_cells"))


def sheet_page(units: DataFrame, start_row: int = 1, max_rows: int = 100) -> DataFrame:
    """A page of each sheet as Markdown lines: full_path, sheet_name, row_number, line; 0 for ``start_row`` or ``max_rows`` is
    their default. All columns up to the last used one, and blank rows too; page_rows and page_columns say how many there are."""
    first, n = start_row or 1, max_rows or 100
    v = values(units)
    used = v.groupBy(*SHEET).agg(F.max("r").alias("page_rows"), F.max("c").alias("page_columns"))
    rows = used.where(F.col("page_rows") >= first).withColumn("r", F.explode(F.sequence(F.lit(first).cast("long"), F.least(F.lit(first + n - 1).cast("long"), F.col("page_rows")))))
    told = v.where(F.col("r").between(first, first + n - 1)).groupBy(*SHEET, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", cells.markdown_preview_cell(F.col("v"))))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.col("page_columns")), lambda c: F.coalesce(F.get(F.map_values(F.map_filter("m", lambda k, _: k == c)), F.lit(0)), F.lit(""))), " | ")
    return rows.join(told, [*SHEET, "r"], "left").select(
        *SHEET, "page_rows", "page_columns", F.col("r").alias("row_number"), F.concat(F.lit("| "), F.col("r"), F.lit(" | "), line, F.lit(" |")).alias("line"))


def sheet_preview(units: DataFrame, start_row: int = 1, max_rows: int = 100) -> DataFrame:
    """``sheet_page`` as one text per sheet (full_path, sheet_name, page), a line on the page and the column names before it.

    A value holds ``max_rows`` lines. A page behind the last row has its head only.
    """
    first, n = start_row or 1, max_rows or 100
    lines = sheet_page(units, first, n).groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("row_number", "line"))).alias("ls"))
    used = values(units).groupBy(*SHEET).agg(F.max("r").alias("rows"), F.max("c").alias("columns"))
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.col("columns")), lambda c: cells.column_name(c - 1)), " | ")
    head = F.concat(
        F.lit("Preview of '"), F.col("sheet_name"), F.lit("' in "), cells.display_path(F.col("full_path")), F.lit(f" (Rows {first}-"), F.least(F.lit(first + n - 1).cast("long"), F.col("rows")),
        F.lit(" of "), F.col("rows"), F.lit(", "), F.col("columns"), F.lit(" columns):\n\n| Row | "), names, F.lit(" |\n|"), F.repeat(F.lit("---|"), F.col("columns") + 1))
    return used.join(lines, SHEET, "left").select(*SHEET, F.concat_ws("\n", head, F.col("ls.line")).alias("page"))


def word_preview(targets: DataFrame, units: DataFrame) -> DataFrame:
    """All paragraphs (text boxes too) of each target's document, the target flagged: full_path, file_name, target_paragraph,
    row_index, text, is_target, total_paragraphs. ``targets``: full_path, row_index."""
    t = targets.select("full_path", F.col("row_index").alias("target_paragraph")).distinct()
    paras = units.where(F.col("unit_kind").isin("word", "shape") & (F.col("sheet_name") == "Word"))
    shown = stored(paras.join(t, "full_path").select("full_path", "file_name", "target_paragraph", "row_index", "text"), "preview")
    total = shown.groupBy("full_path", "target_paragraph").agg(F.count(F.lit(1)).alias("total_paragraphs"))
    return shown.join(total, ["full_path", "target_paragraph"]).select(
        "full_path", "file_name", "target_paragraph", "row_index", "text", (F.col("row_index") == F.col("target_paragraph")).alias("is_target"), "total_paragraphs")
