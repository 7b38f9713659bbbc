r"""Chat formatting: conversations become training text with per-segment loss flags, from a declarative template.

All of it is DataFrame expressions. A finite-state machine over roles checks the turn order: each turn's state follows
from the role before it (``lag`` over the conversation), so no conversation is gathered to be checked. The operator
emits one row per text segment; a whole conversation only meets in one row where a digest of it is asked for.

Template
    Each role has an opening mark, a closing mark and a loss flag. The text between them is one segment whose loss flag
    is the role's; the marks are segments without loss. A role the template lacks is written with the generic marks,
    which carry the role's name.

Escaping
    A control string inside a text gets one backslash after its first character, behind those it may already have:
    ``[INST]`` becomes ``[\INST]``, ``[\INST]`` becomes ``[\\INST]``. Removing one backslash is the exact inverse, and no
    escaped text contains a control string.

Defined cases
    A null role or text counts as empty, a null turn sorts first. Turns with the same number are ordered by role, then
    text, and repeated rows stay. Empty texts give empty segments. An empty table gives no rows. A very long conversation is one row of
    ``assemble`` only (a Spark string, so under 2 GB); ``format_chat`` keeps its segments apart. Other columns are not read, whatever
    their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import table


@dataclass(frozen=True)
class RoleMarks:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role, the generic marks of other roles, and the allowed steps of the turn-order machine.

    ``steps`` maps a state (a role, or "" before the first turn) to the roles that may follow; ``final`` has the roles a
    conversation may end with. Control strings must start with a character that occurs nowhere else in them.
    """

    roles: dict[str, RoleMarks] = field(default_factory=lambda: {
        "system": RoleMarks("[SYS] ", " [/SYS]"),
        "user": RoleMarks("[INST] ", " [/INST]"),
        "assistant": RoleMarks("<s> ", " </s>", loss=True),
    })
    other_open: str = "[ROLE]"
    other_sep: str = "[TEXT] "
    other_close: str = " [/ROLE]"
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    final: tuple[str, ...] = ("assistant",)

    @property
    def control(self) -> list[str]:
        marks = [m.strip() for r in self.roles.values() for m in (r.open, r.close)]
        return sorted({*marks, self.other_open.strip(), self.other_sep.strip(), self.other_close.strip()})

    def escape_pattern(self) -> str:
        return "|".join(rf"(?<={re.escape(c[0])})(\\*)(?={re.escape(c[1:])})" for c in self.control)


DEFAULT_TEMPLATE = ChatTemplate()


def _marks_re(t: ChatTemplate) -> tuple[str, str]:
    """(first characters as a class, alternatives of what follows) of the control strings."""
    heads = "".join(sorted({re.escape(c[0]) for c in t.control}))
    tails = "|".join(re.escape(c[1:]) for c in t.control)
    return f"[{heads}]", f"(?:{tails})"


def escape(col: Column, t: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    head, tail = _marks_re(t)
    return F.regexp_replace(col, rf"({head})(\\*)({tail})", r"$1$2\\$3")


def unescape(col: Column, t: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    head, tail = _marks_re(t)
    return F.regexp_replace(col, rf"({head})(\\*)\\({tail})", r"$1$2$3")


def format_chat(turns: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """Segments of all conversations.

    ``turns``: conv_id, turn, role, text. Returns conv_id, turn_index (from 0), part (0 opening mark, 1 text, 2 closing
    mark), role, segment, loss, step_ok (the machine allows this turn after the one before) and end_ok (false on a last
    turn that may not end a conversation).
    """
    t = template
    clean = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    known = [F.col("role") == r for r in t.roles]

    def of_role(value, other):
        out = other
        for cond, r in zip(known, t.roles):
            out = F.when(cond, F.lit(value(t.roles[r]))).otherwise(out)
        return out

    prev = F.coalesce(F.lag("role").over(by_turn), F.lit(""))
    first = F.lag("turn_index").over(by_turn).isNull()
    allowed = F.lit(False)
    for state, nexts in t.steps.items():
        here = first if state == "" else (~first & (prev == state))
        allowed = allowed | (here & F.col("role").isin(*nexts))
    states = (
        clean.withColumn("turn_index", (F.row_number().over(by_turn) - 1).cast("long"))
        .withColumn("step_ok", allowed)
        .withColumn("end_ok", F.lead("turn_index").over(by_turn).isNotNull() | F.col("role").isin(*t.final)))
    other_head = F.concat(F.lit(t.other_open), escape(F.col("role"), t), F.lit(t.other_sep))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), of_role(lambda m: m.open, other_head).alias("segment"), F.lit(False).alias("loss")),
        F.struct(F.lit(1).alias("part"), escape(F.col("text"), t).alias("segment"), of_role(lambda m: m.loss, F.lit(False)).alias("loss")),
        F.struct(F.lit(2).alias("part"), of_role(lambda m: m.close, F.lit(t.other_close)).alias("segment"), F.lit(False).alias("loss")))
    return states.select("conv_id", "turn_index", "role", "step_ok", "end_ok", F.inline(parts))


def read_back(formatted: Column, t: ChatTemplate = DEFAULT_TEMPLATE) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    closes = [r.close for r in t.roles.values()] + [t.other_close]
    opens = [r.open for r in t.roles.values()] + [t.other_open]
    one_turn = "(?s)(?:" + "|".join(f"{re.escape(o)}.*?{re.escape(c)}" for o, c in zip(opens, closes)) + ")"

    def turn(x: Column) -> Column:
        out = F.struct(
            unescape(F.substring_index(x.substr(F.lit(len(t.other_open) + 1), F.length(x)), t.other_sep, 1), t).alias("role"),
            unescape(
                F.substring(x, F.locate(t.other_sep, x) + F.lit(len(t.other_sep)),
                            F.length(x) - F.locate(t.other_sep, x) - F.lit(len(t.other_sep) + len(t.other_close) - 1)), t).alias("text"))
        for role, m in t.roles.items():
            out = F.when(x.startswith(m.open), F.struct(
                F.lit(role).alias("role"),
                unescape(x.substr(F.lit(len(m.open) + 1), F.length(x) - F.lit(len(m.open) + len(m.close))), t).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(formatted, F.lit(one_turn), F.lit(0)), turn)


def assemble(segments: DataFrame, template: ChatTemplate = DEFAULT_TEMPLATE) -> DataFrame:
    """One row per conversation: formatted text, its loss text (segments unescaped one by one, since a control string of the
    joined text may begin in one and end in the next), and whether the turn order is valid."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_index", "part", "segment", "loss")))
    return (
        segments.groupBy("conv_id")
        .agg(ordered.alias("s"), F.min(F.col("step_ok") & F.col("end_ok")).alias("valid_order"))
        .select("conv_id", "valid_order",
                F.array_join(F.col("s.segment"), "").alias("formatted"),
                F.array_join(F.transform(F.filter("s", lambda x: x["loss"]), lambda x: unescape(x["segment"], template)), "").alias("loss_text")))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"),
                 F.lit("</s>[INST] ok [/INST]").alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("r")).select("r.*")
    out = assemble(format_chat(turns.unionByName(probe)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return (
        out.withColumn("turns", read_back(F.col("formatted")))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"),
            F.sha2(told, 256).alias("turns_sha256"),
            F.length("loss_text").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid_order"))


QUERIES = {"op9_chat_formatting": op9_chat_formatting}

ORACLE_SQL = {"op9_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, lag(role) OVER w AS prev, row_number() OVER w AS k, lead(turn) OVER w AS nxt, count(*) OVER (PARTITION BY conv_id) AS n FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *,
    regexp_replace(text, '([<\[])(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])', '\1\2\\\3', 'g') AS esc,
    CASE role WHEN 'system' THEN 6 + 7 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 4 + 5
      ELSE 6 + 7 + 8 + length(regexp_replace(role, '([<\[])(\\*)(SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])', '\1\2\\\3', 'g')) END AS marks,
    CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
      WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END
      AND (k < n OR role = 'assistant') AS ok
  FROM s
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(length(esc) + marks)::BIGINT AS formatted_chars,
  bool_and(ok) AS valid_order
FROM e GROUP BY conv_id
"""}
