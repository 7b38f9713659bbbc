r"""URL filters as a sort-merge range join of urls with rules, as DataFrame expressions only.

A host is written back to front, each label closed by a dot (``blog.example.net`` is ``net.example.blog.``), so that a rule's host
and all its subdomains are the keys that start with the rule's key: one interval of the sorted keys. Such intervals nest or are apart.
One sorted sweep over urls and rules' hosts finds the hosts whose intervals are open at each url; a second one, over (host, path) of
these, the innermost rule whose host and path it starts with. The longest of a url's rules then decides.

Sweep
    Keys of urls and rules are sorted together. Every rule carries the stack of the rules whose intervals are open at its key, itself
    on top. At a url the stack is that of the last rule before it, less the rules whose intervals have ended there: those the key
    doesn't start with. Rows are dealt by ranges of (key, row), so a host or url that most rows share lies in many parts, and each part
    is told the last rule before it (operators.scan). The stacks of the rules themselves come from the same sweep over blocks of some
    ``block`` sorted rules: each folds its own with a stack, and a fold over the blocks' stacks gives what is open where each begins.
    The latter is one row, with one stack per block: 2,000 of them for a million rules.

Every url is parsed once and stored (with the columns that the caller selected) before it is sorted; html never moves. Any number of
rules and of paths on one host is swept, none is broadcast.

Defined cases
    A null url or one without ``://`` has empty host and path; no rule with a host fits it, so it gets the default verdict. Hosts keep
    ports and user names, and fit only rules that have them too. Rules' hosts are lower-cased (A-Z). The longest rule has most
    code points in host and path together; of equally long ones that with the longer host wins. A repeated rule counts once; if its
    verdicts differ, block holds. A rule with a null host or path counts as if it were empty: an empty path fits every path, an empty
    host only empty hosts and those that end with a dot. Repeated rows and rows with equal or null ids give a row each. An empty table
    gives no rows; no rules give the default verdict everywhere. Very long urls are compared whole. Columns host, path, rule and
    verdict of the input are replaced, others stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import materialize, table
from textquarry.operators.scan import running

DEFAULTS = {"block": 512}
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels back to front, each with a dot behind: a host's key starts with the keys of the domains that it is in."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """host, path, verdict of a few rules given in Python."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("host", "path", "verdict"), r)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(*[F.lit("").alias(k) for k in ("host", "path", "verdict")])


def _fold(rules: Column, stack: Column) -> Column:
    """For every rule of a sorted array the rules of it that are open there, itself last, above those of ``stack``."""

    def step(state: Column, rule: Column) -> Column:
        still = F.filter(state["open"], lambda s: rule["key"].startswith(s["key"]))
        now = F.concat(still, F.array(rule))
        return F.struct(now.alias("open"), F.concat(state["out"], F.array(F.struct(rule["key"].alias("key"), now.alias("stack")))).alias("out"))

    kind = "array<struct<key:string,rule:string,verdict:string>>"
    start = F.struct(stack.cast(kind).alias("open"), F.array().cast(f"array<struct<key:string,stack:{kind}>>").alias("out"))
    return F.aggregate(rules, start, step, lambda state: state["out"])


def stacks(rules: DataFrame, **params) -> DataFrame:
    """key, stack of ``rules`` (key, rule, verdict; distinct keys): at each rule's key the rules that are open, itself last."""
    p = DEFAULTS | params
    n_blocks = max(1, -(-rules.count() // p["block"]))
    dealt = materialize(rules.repartitionByRange(n_blocks, "key").select("key", "rule", "verdict", F.spark_partition_id().alias("block")), "dealt_rules")
    blocks = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "rule", "verdict"))).alias("rules"))
    blocks = materialize(blocks, "rule_blocks")
    nothing = F.array().cast("array<struct<key:string,rule:string,verdict:string>>")
    ends = blocks.select("block", F.col("rules")[0]["key"].alias("first"), F.element_at(_fold(F.col("rules"), nothing), -1)["stack"].alias("end"))

    def step(state: Column, b: Column) -> Column:
        still = F.filter(state["open"], lambda s: b["first"].startswith(s["key"]))
        # what the block leaves open stands above what was open before it and is open at its last rule
        last = F.element_at(b["end"], -1)["key"]
        after = F.concat(F.filter(still, lambda s: last.startswith(s["key"])), b["end"])
        return F.struct(after.alias("open"), F.concat(state["out"], F.array(F.struct(b["block"].alias("block"), still.alias("before")))).alias("out"))

    kind = "array<struct<key:string,rule:string,verdict:string>>"
    begin = ends.agg(F.array_sort(F.collect_list(F.struct("block", "first", "end"))).alias("b")).select(F.inline(F.aggregate(
        "b", F.struct(F.array().cast(kind).alias("open"), F.array().cast(f"array<struct<block:int,before:{kind}>>").alias("out")), step, lambda s: s["out"])))
    return blocks.join(begin, "block").select(F.inline(_fold(F.col("rules"), F.col("before"))))


def sweep(points: DataFrame, rules: DataFrame, **params) -> DataFrame:
    """``points`` (key, _row, others) with a column open: the rules (key, rule, verdict) that each key starts with, the longest last.

    ``_row`` must differ between points.
    """
    marks = stacks(rules, **params).select("key", "stack", F.lit(0).alias("_kind"))
    events = points.withColumn("_kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    swept = running(events, [], ["key", "_kind", "_row"], {"_open": ("last", F.col("stack"))}, keep=[*points.columns, "_kind"])
    open_ = F.filter(F.coalesce("_open", F.array()), lambda s: F.col("key").startswith(s["key"]))
    return swept.where(F.col("_kind") == 1).select(*points.columns, open_.alias("open"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", **params) -> DataFrame:
    """``pages`` with host, path, rule (``example.net/en/``; null if none fits) and verdict, by ``rules`` (host, path, verdict).

    All columns of ``pages`` are stored and sorted along, so select those you need first.
    """
    rules = rules.select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = materialize(rules.select(
        host_key(F.col("host")).alias("host_key"), F.concat(host_key(F.col("host")), "path").alias("key"),
        F.concat("host", "path").alias("rule"), "verdict"), "rules")
    rest = pages.drop("host", "path", "rule", "verdict")
    kept = materialize(rest.select(
        F.monotonically_increasing_id().alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"), F.struct(*rest.columns).alias("_page")), "urls")

    hosts = rules.select(F.col("host_key").alias("key")).distinct().select("key", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    inside = sweep(kept.select("_row", "_path", host_key(F.col("_host")).alias("key")), hosts, **params)
    probes = inside.select("_row", "_path", F.explode("open.key").alias("_in")).select(
        F.monotonically_increasing_id().alias("_probe"), F.col("_row").alias("_of"), F.concat("_in", "_path").alias("key"))
    probes = materialize(probes, "probes").withColumnRenamed("_probe", "_row")
    found = sweep(probes, rules.select("key", "rule", "verdict"), **params).where(F.size("open") > 0).select("_of", F.element_at("open", -1).alias("r"))
    best = found.groupBy("_of").agg(F.max(F.struct(F.length("r.rule").alias("n"), F.length(F.substring_index("r.rule", "/", 1)).alias("of_host"), "r")).alias("best"))
    return kept.join(best, F.col("_row") == F.col("_of"), "left").select(
        "_page.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.r.rule").alias("rule"),
        F.coalesce(F.col("best.r.verdict"), F.lit(default)).alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op11_url_filter": op11_url_filter}

ORACLE_SQL = {"op11_url_filter": r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS k FROM pages
), p AS (
  SELECT page_id, k,
    translate(regexp_extract(url, '\A(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '\A(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
  FROM u
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, rule_verdict)
), f AS (
  SELECT k, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.k = f.k AND f.n = 1
"""}
