"""Localised labels of exports, as expressions; a language without a label falls back to English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: column titles and kind names of exports
HEADERS = {
    "en": ["ID", "File name", "Full path", "Sheet name", "Cell", "Shape name", "Match type", "Matched content", "Formula"],
    "ja": ["ID", "ファイル名", "フルパス", "シート名", "セル位置", "Shape 名", "一致種別", "一致内容", "数式"],
}
KINDS = {
    "en": {"CellValue": "Value", "Formula": "Formula", "Comment": "Comment", "HiddenSheet": "Hidden sheet", "Shape": "Shape", "WordText": "Word"},
    "ja": {"CellValue": "値", "Formula": "数式", "Comment": "コメント", "HiddenSheet": "非表示シート", "Shape": "図形", "WordText": "Word"},
}
EXPORT_SHEET = {"en": "Search Results", "ja": "検索結果"}


def label_of(kind: Column, language: Column) -> Column:
    """The label of a kind in a language, else in English, else the kind itself."""
    def lookup(lang):
        out = F.lit(None).cast("string")
        for k, v in KINDS[lang].items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    own = F.lit(None).cast("string")
    for lang in KINDS:
        own = F.when(language == lang, lookup(lang)).otherwise(own)
    return F.coalesce(own, lookup("en"), kind)


def titles(language: str) -> list[str]:
    return HEADERS.get(language, HEADERS["en"])
