"""Cell addresses, number rendering and the text rules of exports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMN_PREFIX = "Column "
ROW_PREFIX = "Row "
TARGET_PREFIX = "- Target Cell: "
NO_HEADING = "Document Section"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: the expression doesn't grow with each step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def column_name(index: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA, up to six letters (over 300 million columns); empty below 0."""
    n = index.cast("long")
    out, first = F.lit(None).cast("string"), sum(26 ** k for k in range(1, 7))
    # names of k letters start at 26 + ... + 26^(k-1); within them each letter is a digit
    for k in range(6, 0, -1):
        first -= 26 ** k
        letters = [F.chr(F.lit(65) + F.pmod(F.floor((n - first) / 26 ** d), F.lit(26))) for d in range(k - 1, -1, -1)]
        out = F.when(n < first + 26 ** k, F.concat(*letters)).otherwise(out)
    return F.when(n < 0, F.lit("")).otherwise(out)


def cell_address(row: Column, col: Column) -> Column:
    """A1 style from 0-based indices."""
    return F.concat(column_name(col), (row + 1).cast("string"))


def parse_address(address: Column) -> Column:
    """struct(row, col), 0-based, of an A1-style address; null if letters or digits are missing."""
    up = F.upper(address)
    letters, digits = F.regexp_extract(up, r"^([A-Z]+)[0-9]+$", 1), F.regexp_extract(up, r"^[A-Z]+([0-9]+)$", 1)
    col = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)
    ok = (letters != "") & (digits.try_cast("long") >= 1)
    return F.when(ok, F.struct((digits.try_cast("long") - 1).alias("row"), (col - 1).alias("col")))


def render_number(x: Column) -> Column:
    """Shortest decimal text that reads back as the same double: no exponent, no ``.0``."""
    # where the JVM gives 17 or 18 digits, 16 or 17 of them may say the same double
    digits = lambda s: F.length(F.regexp_replace(F.substring_index(s, "E", 1), "[^0-9]", ""))
    same = lambda form, v: F.format_string(form, v).try_cast("double") == v
    shorter = lambda s, v: F.when(digits(s) < 17, s).when(same("%.15E", v), F.format_string("%.15E", v)).when(
        (digits(s) > 17) & same("%.16E", v), F.format_string("%.16E", v)).otherwise(s)
    return bound(x, lambda v: (
        F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf"))
        .when(v == 0, F.when(v.cast("string").startswith("-"), "-0").otherwise("0"))
        .otherwise(bound(shorter(v.cast("string"), v), _plain))))


def _plain(s: Column) -> Column:
    """The text of a finite double other than 0 without its exponent."""
    sign = F.when(s.startswith("-"), "-").otherwise("")
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), "^-", "")
    exponent = F.when(F.contains(s, F.lit("E")), F.substring_index(s, "E", -1).try_cast("int")).otherwise(0)
    parts = F.struct(sign.alias("sign"), F.substring_index(mantissa, ".", 1).alias("whole"),
                     F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "").alias("part"), exponent.alias("exponent"))

    def placed(t: Column) -> Column:
        digits, point, n = t["digits"], t["point"], F.length(t["digits"])
        return (F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
                .when(point >= n, F.concat(digits, F.repeat(F.lit("0"), point - n)))
                .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n - point))))

    def trimmed(t: Column) -> Column:
        return F.regexp_replace(F.when(F.contains(t, F.lit(".")), F.regexp_replace(t, r"\.?0*$", "")).otherwise(t), r"^0+(?=[0-9])", "")

    # point: digits before the decimal point
    return bound(parts, lambda t: F.concat(t["sign"], bound(
        bound(F.struct(F.concat(t["whole"], t["part"]).alias("digits"), (F.length(t["whole"]) + t["exponent"]).alias("point")), placed), trimmed)))


def trim_unicode(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def csv_field(text: Column) -> Column:
    """Outer white space off, each line break a space."""
    return F.regexp_replace(trim_unicode(text), r"\r\n|\r|\n", " ")


def markdown_cell(text: Column) -> Column:
    out = F.replace(trim_unicode(text), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(out, r"\r\n|\r|\n", "<br>")


def markdown_preview_cell(text: Column) -> Column:
    """Of sheet previews: not trimmed, each CR or LF a space of its own."""
    return F.translate(F.replace(text, F.lit("|"), F.lit("\\|")), "\r\n", "  ")


def display_path(path: Column) -> Column:
    """As shown to a reader: Windows' verbatim prefixes off, all in backslashes or all in slashes; of shares in any case."""
    low = F.lower(path)
    share = low.startswith("\\\\?\\unc\\") | low.startswith("//?/unc/")
    return F.when(share, _share(path)).when(path.startswith("\\\\?\\") | path.startswith("//?/"), _local(path)).otherwise(path)


def export_path(path: Column) -> Column:
    """As written to reports: only the prefixes in backslashes, of shares in capitals, which the system itself gives."""
    return F.when(path.startswith("\\\\?\\UNC\\"), _share(path)).when(path.startswith("\\\\?\\"), _local(path)).otherwise(path)


def _share(path: Column) -> Column:
    return F.concat(F.lit("\\\\"), path.substr(F.lit(9), F.length(path)))


def _local(path: Column) -> Column:
    return path.substr(F.lit(5), F.length(path))


def is_heading(text: Column) -> Column:
    """A ``#`` line; or at most 80 bytes, no full stop at the end, and a numbered or chapter-like start."""
    t = trim_unicode(text)
    first_word = F.regexp_extract(t, r"(?U)^(\S+)", 1)
    numbered = first_word.endswith(".") | t.startswith("第") | t.startswith("Chapter") | t.startswith("Section")
    short = (F.octet_length(t) <= 80) & ~t.endswith("。") & ~t.endswith(".")
    return t.startswith("#") | (short & numbered)


def highlight(text: Column, snippet: Column) -> Column:
    """All occurrences in ``text`` of what stands in the snippet's mark tags, in bold."""
    hit = F.regexp_extract(snippet, r"(?s)<mark[^>]*>(.*?)</mark>", 1)
    return F.when((hit != "") & F.contains(text, hit), F.replace(text, hit, F.concat(F.lit("**"), hit, F.lit("**")))).otherwise(text)


def target_line(sheet: Column, address: Column, column_header: Column, row_key: Column) -> Column:
    name = trim_unicode(sheet)
    return F.concat(
        F.lit(TARGET_PREFIX), F.when(name == "", "").otherwise(F.concat(F.lit("["), name, F.lit("] "))), address,
        F.lit(" (Column: "), column_header, F.lit(", Row: "), row_key, F.lit(")"))


COLLATION = "UNICODE_CI_AI"
_UNACCENTED = {"ł": "l", "đ": "d", "ø": "o", "ħ": "h", "ı": "i", "ŧ": "t"}  # letters that aren't made of a letter and a mark


def natural_key(text: Column) -> Column:
    """Sort key: pieces of text and runs of digits in turn; text by the root collation without case and accents, digits by value
    whatever their number: (text, digits without zeros in front: how many, then themselves)."""
    pieces = F.regexp_extract_all(text, F.lit(r"([^0-9]*)([0-9]*)"), F.lit(0))

    def piece(p: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(p, r"([0-9]*)$", 1), r"^0+(?=[0-9])", "")
        words = F.translate(F.regexp_replace(p, r"[0-9]+$", ""), "".join([*_UNACCENTED, *map(str.upper, _UNACCENTED)]), "".join([*_UNACCENTED.values()] * 2))
        return F.struct(F.collate(words, COLLATION).alias("words"), F.length(digits).alias("size"), digits.alias("digits"))

    return F.transform(pieces, piece)
