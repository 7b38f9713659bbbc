"""Search over units: scope, predicate and projection as one Catalyst plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import cells, matching
from textquarry.operators.storage import number_rows


class InvalidRequest(ValueError):
    """A search request that can't be run."""


@dataclass(frozen=True)
class SearchRequest:
    """What to look for and where. Defaults are those of the programming interface."""

    keyword: str
    is_regex: bool = False
    match_case: bool = False
    values: bool = True
    formulas: bool = True
    comments: bool = True
    shapes: bool = True
    hidden_sheets: bool = False

    @classmethod
    def for_command_line(cls, keyword: str, **kw) -> SearchRequest:
        return replace(cls(keyword, shapes=False), **kw)

    def validated(self, allow_blank: bool = False) -> SearchRequest:
        if not allow_blank and not self.keyword.strip():
            raise InvalidRequest("keyword is blank")
        if self.is_regex:
            matching.java_pattern(self.keyword, self.match_case)
        return self

    def in_scope(self) -> Column:
        """Paragraphs are always searched; hidden sheets only on request."""
        kinds = ["word"] + [k for k, on in (("value", self.values), ("formula", self.formulas), ("comment", self.comments), ("shape", self.shapes)) if on]
        return F.col("unit_kind").isin(*kinds) & (~F.col("sheet_hidden") | F.lit(self.hidden_sheets))


def hits(units: DataFrame, request: SearchRequest) -> DataFrame:
    """Units in scope that match, with hit_pos and hit_len of the first occurrence. An empty shape or cell can't match."""
    request.validated(allow_blank=True)
    text = F.col("text")
    rows = units.where(request.in_scope()).where((text != "") | (F.col("unit_kind") == "comment"))
    if request.is_regex:
        rows = rows.where(matching.regex_matches(text, request.keyword, request.match_case))
        hit = F.coalesce(matching.regex_hit(text, request.keyword, request.match_case), F.lit(""))  # an empty hit is null there
        pos = matching.regex_position(text, request.keyword, request.match_case)
        return rows.withColumn("hit_pos", F.greatest(pos, F.lit(1))).withColumn("hit_len", F.length(hit))
    pos = matching.literal_position(text, request.keyword, request.match_case)
    found = rows.withColumn("hit_pos", pos).where(F.col("hit_pos") > 0)
    if request.match_case:
        return found.withColumn("hit_len", F.lit(len(request.keyword)))
    spans = found.withColumn("_span", matching.original_span(text, F.col("hit_pos"), F.length(F.lower(F.lit(request.keyword)))))
    return spans.withColumn("hit_pos", F.col("_span.hit_pos")).withColumn("hit_len", F.col("_span.hit_len")).drop("_span")


def match_type() -> Column:
    kind = F.col("unit_kind")
    return (F.when((kind == "value") & F.col("sheet_hidden"), "HiddenSheet").when(kind == "value", "CellValue").when(kind == "formula", "Formula")
            .when(kind == "comment", "Comment").when(kind == "shape", "Shape").otherwise("WordText"))


def address() -> Column:
    return (F.when(F.col("unit_kind") == "word", "-").when((F.col("row_index") == 0) | (F.col("col_index") == 0), "")
            .otherwise(cells.cell_address(F.col("row_index") - 1, F.col("col_index") - 1)))


#: values, comments, formulas, shapes: the order within a sheet
KIND_ORDER = ("value", "comment", "formula", "shape", "word")


def project(found: DataFrame) -> DataFrame:
    """The match columns but the id, and sheet_pos and kind_pos for ordering."""
    kind_pos = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("unit_kind"))
    return found.select(
        "file_name", "full_path", "sheet_name", address().alias("cell_address"), "row_index", "col_index",
        cells.column_name(F.col("col_index") - 1).alias("col_name"),
        match_type().alias("match_type"), "shape_name", "sheet_hidden",
        matching.snippet(F.col("text"), F.col("hit_pos"), F.col("hit_len")).alias("snippet"), F.col("text").alias("full_content"),
        "formula", "sheets_in_workbook", "sheet_pos", kind_pos.alias("kind_pos"))


ORDER = ["full_path", "sheet_pos", "sheet_name", "kind_pos", "row_index", "col_index", "shape_name", "full_content"]


def search(units: DataFrame, request: SearchRequest) -> DataFrame:
    """The matches with ids 1..N in a fixed order: file, sheet, kind, row, column."""
    return number_rows(project(hits(units, request)), ORDER).drop("sheet_pos", "kind_pos")


def refine(matches: DataFrame, query: str) -> DataFrame:
    """Rows with ``query`` (as typed, case ignored) in one of six columns; a blank query keeps all."""
    if not query.strip():
        return matches
    keep = F.lit(False)
    for c in ("file_name", "full_path", "sheet_name", "cell_address", "full_content", "shape_name"):
        keep |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(query)))
    return matches.where(keep)


def sorted_by(matches: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Natural order of a column, digits by value; equal keys by id."""
    key = cells.natural_key(F.coalesce(F.col(column), F.lit("")))
    return matches.orderBy(key.desc() if descending else key.asc(), F.col("id").asc())


def first_with_total(matches: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` matches by id, one row of total and truncated): a limit is this report's feature."""
    top = matches.orderBy("id").limit(limit)
    total = matches.agg(F.count(F.lit(1)).alias("total")).withColumn("truncated", F.col("total") > limit)
    return top, total


def match_texts(matches: DataFrame) -> DataFrame:
    """(id, match_text): each match as a block of lines for a reader or a prompt; formula and shape only where there are any."""
    trim = lambda c: F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"  {name}: "), F.col(c), F.lit("\n"))).otherwise("")
    return matches.select("id", F.concat(
        F.lit("- File: "), F.col("full_path"), F.lit("\n  Sheet: "), F.col("sheet_name"), F.lit("\n  Cell: "), F.col("cell_address"), F.lit(" (Row "), F.col("row_index"), F.lit(", Col "),
        F.col("col_index"), F.lit(")\n  Type: "), F.col("match_type"), F.lit("\n"), line("Shape", "shape_name"), F.lit("  Content: "), trim("full_content"), F.lit("\n  Snippet: "), trim("snippet"),
        F.lit("\n"), line("Formula", "formula")).alias("match_text"))


def result_text(matches: DataFrame, query: str, max_results: int = 100) -> DataFrame:
    """One row (result_text): how many matches there are, and the first ``max_results`` of them; the limit is the feature."""
    shown = match_texts(matches).orderBy("id").limit(max_results)
    one = shown.agg(F.array_sort(F.collect_list(F.struct("id", "match_text"))).alias("m"))
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    head = F.when(F.col("total") == 0, F.lit(f"No matches found for query: '{query}'.")).when(
        F.col("total") > max_results, F.concat(F.lit("Found "), F.col("total"), F.lit(f" matches (truncated to maximum {max_results} results):\n\n"))).otherwise(
        F.concat(F.lit("Found "), F.col("total"), F.lit(" match(es):\n\n")))
    # one row each
    return one.join(F.broadcast(total), F.lit(True)).select(F.concat(head, F.array_join("m.match_text", "\n")).alias("result_text"))
