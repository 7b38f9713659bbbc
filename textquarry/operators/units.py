"""The long relation that every search runs on: one row per cell, formula, comment, shape or paragraph.

Columns: full_path, file_name, sheet_name, sheet_pos, sheet_hidden, unit_kind (value, formula, comment, shape, word),
row_index and col_index (1-based, 0 for none), text, formula, shape_name, sheets_in_workbook.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = T.StructType([
    T.StructField("full_path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("sheet_name", T.StringType()),
    T.StructField("sheet_pos", T.IntegerType()), T.StructField("sheet_hidden", T.BooleanType()), T.StructField("unit_kind", T.StringType()),
    T.StructField("row_index", T.LongType()), T.StructField("col_index", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("formula", T.StringType()), T.StructField("shape_name", T.StringType()),
    T.StructField("sheets_in_workbook", T.ArrayType(T.StringType()))])

WORD_SHEET = "Word"


def _units(df: DataFrame, **cols: Column) -> DataFrame:
    base = {
        "sheet_name": F.lit(WORD_SHEET), "sheet_pos": F.lit(0), "sheet_hidden": F.lit(False), "col_index": F.lit(0),
        "formula": F.lit(None), "shape_name": F.lit(None)} | cols
    base.setdefault("sheets_in_workbook", F.array(base["sheet_name"]))
    return df.select(*[base[f.name].cast(f.dataType).alias(f.name) for f in UNITS.fields])


#: what (?U)\s stands for
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def paragraphs(text: Column) -> Column:
    """Non-blank paragraphs of a binary word-processor text: CR, LF and FF end one, cell marks become tabs, line breaks in a
    paragraph spaces, other controls go; outer white space off."""
    # translating looks every character up, so only texts that hold a mark are translated; an expression for the outer white space would
    # try each inner run of blanks from all its places
    marked = F.contains(text, F.lit("\x07")) | F.contains(text, F.lit("\x0b"))
    clean = F.when(marked, F.translate(text, "\x07\x0b", "\t ")).otherwise(text)
    clean = F.regexp_replace(clean, r"[\x00-\x08\x0E-\x1F\x7F-\x9F]", "")
    parts = F.transform(F.split(clean, r"[\r\n\f]"), lambda p: F.btrim(p, F.lit(WHITE_SPACE)))
    return F.filter(parts, lambda p: p != "")


def paragraph_units(docs: DataFrame, full_path: Column, file_name: Column, text: Column) -> DataFrame:
    """Word-processor units of one text per row; row_index counts the paragraphs from 1."""
    rows = docs.select(full_path.alias("fp"), file_name.alias("fn"), F.posexplode(paragraphs(text)).alias("at", "para"))
    return _units(rows, full_path=F.col("fp"), file_name=F.col("fn"), unit_kind=F.lit("word"), row_index=F.col("at") + 1, text=F.col("para"))


def sheet_units(df: DataFrame, key: str, name: str, columns: dict[str, Column], hidden: bool = False, header: bool = True) -> DataFrame:
    """A table as a sheet: row ``key`` + 2 (row 1 has the column names if ``header``), one cell per column, blanks left out."""
    sheet = F.lit(name)
    cells = df.select((F.col(key) + 2).alias("r"), F.posexplode(F.array(*[c.cast("string") for c in columns.values()])).alias("c", "v"))
    if header:
        names = F.array(*[F.lit(c) for c in columns])
        top = df.sparkSession.range(1).select(F.lit(1).cast("long").alias("r"), F.posexplode(names).alias("c", "v"))
        cells = top.unionByName(cells.select(F.col("r").cast("long").alias("r"), "c", "v"))
    cells = cells.where(F.col("v").isNotNull() & (F.col("v") != ""))
    return _units(cells, full_path=F.lit(f"tables/{name}.xlsx"), file_name=F.lit(f"{name}.xlsx"), sheet_name=sheet, sheet_hidden=F.lit(hidden),
                  unit_kind=F.lit("value"), row_index=F.col("r"), col_index=F.col("c") + 1, text=F.col("v"))


def comment_units(df: DataFrame, full_path: Column, file_name: Column, sheet: Column, row: Column, text: Column) -> DataFrame:
    return _units(df, full_path=full_path, file_name=file_name, sheet_name=sheet, unit_kind=F.lit("comment"), row_index=row, col_index=F.lit(1), text=text)
