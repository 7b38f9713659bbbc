"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames; ``queries()`` lists the
registered ``opN_<name>`` queries and ``oracle_sql()`` their DuckDB counterparts where SQL can express them.
"""

from __future__ import annotations


def _modules():
    from textquarry.llm import (chat_format, decontaminate, fingerprint, importance, jaccard_join, language_id, mixing, prefix_trie,
                                quality, suffix_dedup, token_counts, token_output, url_filter)

    return (suffix_dedup, token_output, mixing, decontaminate, quality, fingerprint, language_id, token_counts,
            chat_format, jaccard_join, url_filter, prefix_trie, importance)


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
