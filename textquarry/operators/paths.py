"""Relational operators on paths: pruning of nested roots, permitted folders, many ignore rules, completion, recent entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.patterns import glob_regex


def canonical(path: Column) -> Column:
    """A ``/`` path without ``.``, ``..`` and repeated or trailing slashes; what ``..`` would leave above the top is dropped.

    A stack folded over the components, only for paths that have such parts.
    """
    empty = F.array().cast("array<string>")
    kept = F.aggregate(F.split(path, "/"), empty, lambda stack, part: (
        F.when(part.isin("", "."), stack).when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part)))))
    folded = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)|//|./$"), folded).otherwise(path)


def ancestors(path: Column) -> Column:
    """The proper ancestors of a ``/`` path by component: a/b/c gives a and a/b."""
    parts = F.split(path, "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def prune_nested(roots: DataFrame, column: str = "path") -> DataFrame:
    """Distinct roots, in canonical form, that lie in no other root. Equi-joins on ancestors: no pair of roots is compared by prefix."""
    own = roots.select(canonical(F.col(column)).alias(column)).distinct()
    nested = own.select(column, F.explode(ancestors(F.col(column))).alias("above")).join(
        own.select(F.col(column).alias("above")), "above", "left_semi").select(column).distinct()
    return own.join(nested, column, "left_anti")


def permitted(paths: DataFrame, folders: DataFrame, column: str = "path") -> DataFrame:
    """``paths`` with ``allowed``: whether the path is one of the folders or below one, by component, once ``.`` and ``..`` are
    resolved; no folders: all are.

    An equi-join on ancestors, so that any number of folders will do.
    """
    own = folders.select(canonical(F.col(column)).alias("folder")).distinct()
    if not own.limit(1).count():
        return paths.withColumn("allowed", F.lit(True))
    steps = paths.select(column).distinct().withColumn("_at", canonical(F.col(column)))
    steps = steps.select(column, F.explode(F.concat(ancestors(F.col("_at")), F.array("_at"))).alias("folder"))
    inside = steps.join(own, "folder", "left_semi").select(column).distinct().withColumn("allowed", F.lit(True))
    return paths.join(inside, column, "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def complete(directories: DataFrame, prefix: str, limit: int = 10, column: str = "path") -> DataFrame:
    """The first ``limit`` directories that start with ``prefix``, in order; the limit is the feature."""
    known = directories.select(canonical(F.col(column)).alias(column))
    return known.where(F.col(column).startswith(prefix)).distinct().orderBy(column).limit(limit)


def complete_children(directories: DataFrame, typed: str, limit: int = 10, column: str = "path") -> DataFrame:
    """The first ``limit`` folders directly below what is typed up to its last ``/`` whose names start with the rest, in order.

    Only an absolute path is completed; every ancestor of a known directory is a folder. The limit is the feature.
    """
    parent, _, start = typed.rpartition("/")
    if not typed.startswith("/"):
        return directories.select(column).limit(0)
    directories = directories.select(canonical(F.col(column)).alias(column))
    below = F.substring(F.col(column), F.lit(len(parent) + 2), F.length(column))
    name = F.substring_index(below, "/", 1)
    return directories.where(F.col(column).startswith(parent + "/")).where((name != "") & name.startswith(start)).select(
        F.concat(F.lit(parent + "/"), name).alias(column)).distinct().orderBy(column).limit(limit)


def most_recent(history: DataFrame, value: str, at: str, limit: int = 20) -> DataFrame:
    """Distinct values, the latest used first; equal times by value."""
    return history.where(F.trim(F.col(value)) != "").groupBy(value).agg(F.max(at).alias("last_used")).orderBy(
        F.col("last_used").desc(), F.col(value)).limit(limit)


def _rule(line: str) -> tuple[str, str]:
    """(kind, key) of an ignore rule: what it says of names, whole paths or last extensions can be looked up, other globs are tried."""
    body = line.removeprefix("!")
    body = (body[1:] if body.startswith(("\\!", "\\#")) else body).rstrip("/")
    wild = any(c in body for c in "*?[\\")
    if "/" not in body and not wild:
        return "name", body
    if not wild:
        return "path", body.removeprefix("/")
    if body.startswith("*.") and body.count(".") == 1 and not any(c in body[1:] for c in "*?[\\/"):
        return "extension", body[2:]
    return "glob", glob_regex(line)[0] + "$"


def _decided(entries: DataFrame, lines: list[str], many: int) -> DataFrame:
    """``entries`` (path, is_dir; distinct) with ignored: what the last rule that fits says, if any does."""
    spark = entries.sparkSession
    # twice the place of a rule, one more if it takes paths back in: the greatest is that of the last
    rules = [(*_rule(x), 2 * k + x.startswith("!"), x.endswith("/")) for k, x in enumerate(lines)]
    tried = [F.when(F.col("path").rlike(key) & (F.col("is_dir") if only else F.lit(True)), F.lit(code)) for kind, key, code, only in rules if kind == "glob"]
    last = F.greatest(F.lit(-1), *[F.coalesce(F.array_max(F.array(*tried[k: k + 100])), F.lit(-1)) for k in range(0, len(tried), 100)]) if tried else F.lit(-1)
    own = entries.withColumn("_tried", last)
    named = [r for r in rules if r[0] != "glob"]
    if named:
        table = spark.createDataFrame(named, "kind string, key string, code int, only_dirs boolean").groupBy("kind", "key", "only_dirs").agg(F.max("code").alias("code"))
        table = F.broadcast(table) if len(named) <= many else table
        name = F.substring_index("path", "/", -1)
        keys = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (
            ("name", name), ("path", F.col("path")), ("extension", F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1))))])
        found = entries.select("path", "is_dir", F.inline(keys)).join(table, ["kind", "key"]).where(F.col("is_dir") | ~F.col("only_dirs"))
        found = found.groupBy("path", "is_dir").agg(F.max("code").alias("_found"))
        own = own.join(found, ["path", "is_dir"], "left")
    else:
        own = own.withColumn("_found", F.lit(-1))
    code = F.greatest("_tried", F.coalesce("_found", F.lit(-1)))
    return own.select("path", "is_dir", ((code >= 0) & (code % 2 == 0)).alias("ignored"))


def ignored_by_rules(files: DataFrame, lines: list[str], column: str = "path", many: int = 100_000) -> DataFrame:
    """``files`` with ``ignored``, by any number of gitignore ``lines``: the last that fits decides, an ignored folder takes all below it.

    Each distinct folder and path is decided once. Rules on names, paths and extensions are looked up by equality, however many
    there are; only globs of other forms are tried one by one.
    """
    lines = [x for x in lines if x and not x.startswith("#")]
    if not lines:
        return files.withColumn("ignored", F.lit(False))
    names = files.select(F.col(column).alias("path")).where(F.col(column).isNotNull()).distinct()
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", ""))
    nearest = names.select(parent.alias("path")).where(F.col("path").isNotNull()).distinct()
    above = nearest.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("top"))
    shut = _decided(above.select(F.col("top").alias("path")).distinct().withColumn("is_dir", F.lit(True)), lines, many).where("ignored").select(F.col("path").alias("top"))
    inside = above.join(shut, "top", "left_semi").select(F.col("path").alias("_in")).distinct()
    own = _decided(names.withColumn("is_dir", F.lit(False)), lines, many)
    told = own.withColumn("_in_path", parent).join(inside, F.col("_in_path") == F.col("_in"), "left").select(
        F.col("path").alias("_of"), (F.col("ignored") | F.col("_in").isNotNull()).alias("_ignored"))
    return files.join(told, F.col(column) == F.col("_of"), "left").withColumn("ignored", F.coalesce("_ignored", F.lit(False))).drop("_of", "_ignored")
