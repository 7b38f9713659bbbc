"""File patterns: token lists, gitignore globs as regular expressions, include and ignore predicates over path columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the known extensions
SPREADSHEET_EXTENSIONS = (".xlsx", ".xlsm", ".xlsb", ".xls")
WORD_EXTENSIONS = (".docx", ".docm", ".doc")
ALL_EXTENSIONS = SPREADSHEET_EXTENSIONS + WORD_EXTENSIONS


def split_list(text: str, escapes: bool = True) -> list[str]:
    """Comma-separated tokens; double quotes protect commas, ``""`` and (with ``escapes``) ``\\"`` are a quote inside them only."""
    tokens, cur, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and text[i + 1: i + 2] == '"' and (c == '"' or escapes and c == "\\"):
            cur, i = cur + '"', i + 2
            continue
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            tokens.append(cur.strip())
            cur = ""
        else:
            cur += c
        i += 1
    if quoted:
        raise ValueError("unclosed double quote")
    return [t for t in [*tokens, cur.strip()] if t]


def split_roots(text: str) -> list[str]:
    """The folders and files of a request, as ``split_list`` reads them; none is an error."""
    roots = split_list(text)
    if not roots:
        raise ValueError("no folder or file to search")
    return roots


def join_list(tokens: list[str]) -> str:
    return ", ".join('"' + t.replace('"', '""') + '"' if re.search(r'[,"\s]', t) else t for t in tokens)


def has_known_extension(token: str) -> bool:
    return token.lower().endswith(ALL_EXTENSIONS)


def complement(tokens: list[str], extensions: list[str]) -> list[str]:
    """Tokens without a known extension get each enabled one."""
    out = []
    for t in tokens:
        out += [t] if has_known_extension(t) else [t.rstrip(".") + e for e in extensions]
    return out


def glob_regex(glob: str) -> tuple[str, bool, bool]:
    """(regular expression on a relative path with ``/``, negated, directories only) of one gitignore line."""
    negated = glob.startswith("!")
    body = glob[1:] if negated else glob
    body = body[1:] if body.startswith(("\\!", "\\#")) else body
    only_dirs = body.endswith("/")
    body = body.rstrip("/") if only_dirs else body
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
            continue
        if c == "*":
            while body[i + 1: i + 2] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in body[i + 2:]:
            j = body.index("]", i + 2)
            inner = body[i + 1: j]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "[" + inner.replace("\\", "\\\\").replace("[", "\\[") + "]", j
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 1
        else:
            out += re.escape(c)
        i += 1
    return ("^" if anchored else "^(?:.*/)?") + out, negated, only_dirs


def check_glob(glob: str) -> None:
    """Raises ValueError for a glob that can't be read: a bracket that doesn't end, a range that runs backwards, an escape of nothing."""
    i = 0
    while i < len(glob):
        if glob[i] == "\\":
            if i + 1 == len(glob):
                raise ValueError(f"dangling escape: {glob}")
            i += 1
        elif glob[i] == "[":
            end = glob.find("]", i + (3 if glob[i + 1: i + 2] in ("!", "^") else 2))
            if end < 0:
                raise ValueError(f"unclosed character class: {glob}")
            for a, b in re.findall(r"(.)-(.)", glob[i + 1: end].lstrip("!^")):
                if a > b:
                    raise ValueError(f"invalid range {a}-{b}: {glob}")
            i = end
        i += 1


@dataclass(frozen=True)
class PathFilter:
    """Include and ignore patterns of a search; both lists as typed by the user."""

    include: str = ""
    ignore: str = ""
    extensions: tuple[str, ...] = SPREADSHEET_EXTENSIONS

    def checked(self) -> tuple[PathFilter, list[tuple[str, str]]]:
        """(the filter without lists that can't be read, which then let everything pass; (field, cause) of each of these)."""
        good, issues = self, []
        for field, name in (("file_patterns", "include"), ("ignore_patterns", "ignore")):
            try:
                for token in split_list(getattr(self, name)):
                    check_glob(token)
            except ValueError as e:
                good, issues = replace(good, **{name: ""}), [*issues, (field, str(e))]
        return good, issues

    def include_regexes(self) -> list[str]:
        return [glob_regex(t)[0] + "$" for t in complement(split_list(self.include), list(self.extensions))]

    def allowed_extensions(self) -> tuple[str, ...]:
        """An explicit extension in an include pattern overrides the enabled ones."""
        return ALL_EXTENSIONS if any(map(has_known_extension, split_list(self.include))) else self.extensions

    def ignore_rules(self) -> list[tuple[str, bool, bool]]:
        """(regular expression, negated, directories only), in order; the last that matches decides."""
        out = []
        for line in split_list(self.ignore):
            if not line.startswith("#"):
                rx, negated, only_dirs = glob_regex(line)
                out.append((rx + "$", negated, only_dirs))
        return out

    def accepts(self, relative_path: Column) -> Column:
        """Lock files out, then extension and include, then ignore, as one predicate on a relative path column."""
        lock = F.substring_index(relative_path, "/", -1).startswith("~$")
        return ~lock & self.included(relative_path) & ~self.ignored(relative_path)

    def included(self, relative_path: Column) -> Column:
        """Extension and include patterns alone."""
        name = F.substring_index(relative_path, "/", -1)
        ext = F.lower(F.concat(F.lit("."), F.substring_index(name, ".", -1)))
        ok = ext.isin(*self.allowed_extensions())
        wanted = self.include_regexes()
        if wanted:
            hit = F.lit(False)
            for rx in wanted:
                hit |= relative_path.rlike(rx)
            ok &= hit
        return ok

    def decided(self, path: Column, is_dir: bool) -> Column:
        """What the last ignore rule that fits the path itself says, not looking at the folders above it."""
        out = F.lit(False)
        for rx, negated, only_dirs in self.ignore_rules():
            if is_dir or not only_dirs:
                out = F.when(path.rlike(rx), F.lit(not negated)).otherwise(out)
        return out

    def ignored(self, relative_path: Column) -> Column:
        """An ignored folder takes all below it along, whatever later rules say of files in it."""
        if not self.ignore_rules():
            return F.lit(False)
        parts = F.split(relative_path, "/")
        above = F.when(F.size(parts) > 1, F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))
        return F.exists(above, lambda d: self.decided(d, True)) | self.decided(relative_path, False)
