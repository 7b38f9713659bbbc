"""The registered queries over the driver's tables, with their DuckDB counterparts.

Each table stands for a container of documents: texts are word-processor files, tables are sheets, conversations are
comments, page addresses are paths. All queries read their whole tables.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.functions import cells, labels, matching, patterns
from textquarry.operators import context, paths, report, search, storage, units
from textquarry.operators.search import SearchRequest
from textquarry.sinks import export

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def document_units(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".docx"))
    return units.paragraph_units(docs, F.concat(F.coalesce("source", F.lit("")), F.lit("/"), name), name, F.col("text"))


def part_units(spark: SparkSession, sf: str) -> DataFrame:
    """The parts as a sheet with holes: names and types are missing where the size says so."""
    size = F.col("p_size")
    return units.sheet_units(_table(spark, sf, "part"), "p_partkey", "part", {
        "p_name": F.when(size % 7 != 0, F.col("p_name")), "p_brand": F.when(size % 3 != 0, F.col("p_brand")), "p_type": F.when(size % 5 != 0, F.col("p_type")),
        "p_size": size, "p_retailprice": cells.render_number(F.col("p_retailprice"))})


def conversation_units(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.col("conv_id").cast("string"), F.lit(".xlsx"))
    return units.comment_units(_table(spark, sf, "conversations"), F.concat(F.lit("conversations/"), name), name, F.col("role"), F.col("turn") + 1, F.col("text"))


# ---------------------------------------------------------------- SQL pieces of the counterparts


def _esc(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def _snippet(text: str, pos: str, length: str) -> str:
    first, end = f"greatest(1, {pos} - 30)", f"least({pos} + {length}, length({text}) + 1)"
    last = f"least(length({text}) + 1, {end} + 30)"
    mark = matching.MARK_OPEN.replace("'", "''")
    return (f"(CASE WHEN {first} > 1 THEN '...' ELSE '' END || {_esc(f'substr({text}, {first}, {pos} - {first})')} || '{mark}' || {_esc(f'substr({text}, {pos}, {end} - {pos})')}"
            f" || '</mark>' || {_esc(f'substr({text}, {end}, {last} - {end})')} || CASE WHEN {last} <= length({text}) THEN '...' ELSE '' END)")


_PARAS = r"""d AS (
  SELECT coalesce(source, '') || '/' || doc_id || '.docx' AS full_path, doc_id || '.docx' AS file_name,
    list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\r\n\f]'), lambda x: regexp_replace(
      regexp_replace(translate(x, chr(7) || chr(11), chr(9) || ' '), '[\x00-\x08\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ps
  FROM documents
), u AS (SELECT full_path, file_name, unnest(ps) AS text, generate_subscripts(ps, 1)::BIGINT AS row_index FROM d)"""

_PARTS = """v AS (
  SELECT p_partkey + 2 AS r, 1 AS c, CASE WHEN p_size % 7 <> 0 THEN p_name END AS v, p_size, p_partkey FROM part
  UNION ALL SELECT p_partkey + 2, 2, CASE WHEN p_size % 3 <> 0 THEN p_brand END, p_size, p_partkey FROM part
  UNION ALL SELECT p_partkey + 2, 3, CASE WHEN p_size % 5 <> 0 THEN p_type END, p_size, p_partkey FROM part
  UNION ALL SELECT p_partkey + 2, 4, p_size::VARCHAR, p_size, p_partkey FROM part
  UNION ALL SELECT p_partkey + 2, 5, regexp_replace(p_retailprice::VARCHAR, '\\.0$', ''), p_size, p_partkey FROM part
  UNION ALL SELECT 1, unnest([1, 2, 3, 4, 5]), unnest(['p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']), 0, 0
), cell AS (SELECT r::BIGINT AS r, c::INT AS c, v FROM v WHERE v IS NOT NULL AND v <> '')""".replace("\\\\", "\\")


# ---------------------------------------------------------------- scans and predicates


@_query("paragraphs", f"WITH {_PARAS} SELECT * FROM u")
def paragraphs(spark, sf):
    return document_units(spark, sf).select("full_path", "file_name", "text", "row_index")


@_query("paragraph_search", f"""WITH {_PARAS}, h AS (SELECT *, instr(lower(text), 'thatin') AS p FROM u WHERE contains(lower(text), 'thatin'))
SELECT row_number() OVER (ORDER BY full_path, row_index) AS id, full_path, row_index, 'WordText' AS match_type, {_snippet('text', 'p', '6')} AS snippet FROM h""")
def paragraph_search(spark, sf):
    """The flagship: literal search, case ignored, with snippets and stable ids."""
    return search.search(document_units(spark, sf), SearchRequest("thatin")).select("id", "full_path", "row_index", "match_type", "snippet")


@_query("literal_match_case", f"WITH {_PARAS} SELECT full_path, row_index, instr(text, 'The ') AS hit_pos FROM u WHERE contains(text, 'The ')")
def literal_match_case(spark, sf):
    return search.hits(document_units(spark, sf), SearchRequest("The ", match_case=True)).select("full_path", "row_index", F.col("hit_pos").cast("long").alias("hit_pos"))


@_query("literal_non_ascii", f"WITH {_PARAS} SELECT full_path, row_index, instr(lower(text), 'être') AS hit_pos FROM u WHERE contains(lower(text), 'être')")
def literal_non_ascii(spark, sf):
    return search.hits(document_units(spark, sf), SearchRequest("ÊTRE")).select("full_path", "row_index", F.col("hit_pos").cast("long").alias("hit_pos"))


@_query("regex_first", rf"""WITH {_PARAS}, h AS (SELECT *, regexp_extract(text, '[a-z]+ing (the|and)') AS hit FROM u WHERE regexp_matches(text, '[a-z]+ing (the|and)'))
SELECT full_path, row_index, instr(text, hit) AS hit_pos, length(hit) AS hit_len FROM h""")
def regex_first(spark, sf):
    found = search.hits(document_units(spark, sf), SearchRequest("[a-z]+ing (the|and)", is_regex=True, match_case=True))
    return found.select("full_path", "row_index", F.col("hit_pos").cast("long").alias("hit_pos"), F.col("hit_len").cast("long").alias("hit_len"))


@_query("regex_any_case", f"WITH {_PARAS} SELECT full_path, row_index FROM u WHERE regexp_matches(lower(text), 'ción(ue|os) [a-z]')")
def regex_any_case(spark, sf):
    return search.hits(document_units(spark, sf), SearchRequest("CIÓN(ue|OS) [a-z]", is_regex=True)).select("full_path", "row_index")


@_query("folded_positions", f"""WITH {_PARAS}, t AS (SELECT full_path, row_index, replace(replace(text, 'on ', 'İn '), 'The', 'TİİE') AS text FROM u), h AS (
  SELECT *, instr(lower(replace(text, 'İ', '_')), 'er ') AS p FROM t WHERE contains(lower(replace(text, 'İ', '_')), 'er '))
SELECT full_path, row_index, p AS hit_pos, 3::BIGINT AS hit_len, substr(text, p, 3) AS hit FROM h""")
def folded_positions(spark, sf):
    """Hits behind letters that become two when they are lower-cased lie in the text as it is."""
    u = document_units(spark, sf)
    u = u.withColumn("text", F.replace(F.replace("text", F.lit("on "), F.lit("İn ")), F.lit("The"), F.lit("TİİE")))
    found = search.hits(u, SearchRequest("ER "))
    return found.select("full_path", "row_index", F.col("hit_pos").cast("long").alias("hit_pos"), F.col("hit_len").cast("long").alias("hit_len"),
                        F.substring(F.col("text"), F.col("hit_pos"), F.col("hit_len")).alias("hit"))


_DIALECT = r"(?P<stem>[[:alpha:]]{3,})(?P<end>ing|tion)[[:punct:]][[:space:]]+([[:upper:]]|th)[[:^digit:]]"


@_query("regex_dialect", rf"""WITH {_PARAS}, h AS (SELECT *, regexp_extract(text, '{_DIALECT}') AS hit FROM u WHERE regexp_matches(text, '{_DIALECT}'))
SELECT full_path, row_index, instr(text, hit) AS hit_pos, length(hit) AS hit_len FROM h""")
def regex_dialect(spark, sf):
    """POSIX classes, named groups and alternatives; texts without one of the literals never meet the expression."""
    found = search.hits(document_units(spark, sf), SearchRequest(_DIALECT, is_regex=True, match_case=True))
    return found.select("full_path", "row_index", F.col("hit_pos").cast("long").alias("hit_pos"), F.col("hit_len").cast("long").alias("hit_len"))


@_query("cells_match", f"WITH {_PARTS} SELECT r AS row_index, c AS col_index, chr(64 + c) || r AS cell_address, v AS full_content FROM cell WHERE contains(lower(v), 'ring')")
def cells_match(spark, sf):
    return search.project(search.hits(part_units(spark, sf), SearchRequest("RING"))).select("row_index", "col_index", "cell_address", "full_content")


@_query("scope_union", f"""WITH {_PARAS} SELECT match_type, count(*) AS hits FROM (
  SELECT 'WordText' AS match_type FROM u WHERE contains(lower(text), 'tion')
  UNION ALL SELECT 'Comment' FROM conversations WHERE contains(lower(coalesce(text, '')), 'tion')
  UNION ALL SELECT 'HiddenSheet' FROM nation WHERE contains(lower(n_name), 'tion')) GROUP BY 1""")
def scope_union(spark, sf):
    hidden = units.sheet_units(_table(spark, sf, "nation"), "n_nationkey", "nation", {"n_name": F.col("n_name")}, hidden=True, header=False)
    everything = document_units(spark, sf).unionByName(conversation_units(spark, sf)).unionByName(hidden)
    found = search.project(search.hits(everything, SearchRequest("tion", hidden_sheets=True)))
    return found.groupBy("match_type").agg(F.count(F.lit(1)).alias("hits"))


@_query("single_file", f"WITH {_PARAS} SELECT row_index, text FROM u WHERE full_path IN (SELECT coalesce(source, '') || '/' || doc_id || '.docx' FROM documents WHERE doc_id = 1) AND contains(lower(text), 'th')")
def single_file(spark, sf):
    """Hits in one requested file: the request is a semi-join on the path."""
    wanted = _table(spark, sf, "documents").where("doc_id = 1").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id"), F.lit(".docx")).alias("full_path"))
    return search.hits(document_units(spark, sf), SearchRequest("th")).join(wanted, "full_path", "left_semi").select("row_index", "text")


@_query("refine_filter", f"""WITH {_PARAS} SELECT full_path, row_index FROM u WHERE contains(lower(text), 'thatin') AND (contains(lower(text), 'the ') OR contains(file_name, 'the ') OR contains(lower(full_path), 'the '))""")
def refine_filter(spark, sf):
    found = search.project(search.hits(document_units(spark, sf), SearchRequest("thatin")))
    return search.refine(found, "The ").select("full_path", "row_index")


# ---------------------------------------------------------------- paths


def _url_path(col):
    return F.regexp_replace(F.regexp_replace(col, "^[a-z]+://", ""), "[?#].*$", "")


_URLS = r"p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


@_query("include_patterns", rf"""WITH {_URLS} SELECT page_id, path FROM p WHERE regexp_matches(path, '^(.*/)?[^/]*4[^/]*\.html$') OR regexp_matches(path, '^blog\.[^/]*/(.*/)?[0-9][^/]*$')""")
def include_patterns(spark, sf):
    """Gitignore globs compiled to regular expressions over a path column."""
    p = _table(spark, sf, "pages").select("page_id", _url_path(F.col("url")).alias("path"))
    hit = F.lit(False)
    for glob in ("*4*.html", "/blog.*/**/[0-9]*"):
        hit |= F.col("path").rlike(patterns.glob_regex(glob)[0] + "$")
    return p.where(hit)


@_query("ignore_patterns", rf"""WITH {_URLS} SELECT page_id FROM p WHERE NOT (
  regexp_matches(path, '^(.*/)?spam[^/]*/') OR regexp_matches(path, '(^|/)[^/]*[0-689](/|$)'))""")
def ignore_patterns(spark, sf):
    p = _table(spark, sf, "pages").select("page_id", _url_path(F.col("url")).alias("path"))
    return p.where(~patterns.PathFilter(ignore="spam*/, *[0-9], !*7").ignored(F.col("path"))).select("page_id")


@_query("root_prune", rf"""WITH {_URLS}, q AS (SELECT DISTINCT regexp_replace(path, '/+$', '') AS path FROM (SELECT path FROM p UNION ALL SELECT regexp_extract(path, '^[^/]*/fr') FROM p) WHERE path <> '')
SELECT path FROM q a WHERE NOT EXISTS (SELECT 1 FROM q b WHERE starts_with(a.path, b.path || '/'))""")
def root_prune(spark, sf):
    p = _table(spark, sf, "pages").select(_url_path(F.col("url")).alias("path"))
    roots = p.unionByName(p.select(F.regexp_extract("path", "^[^/]*/fr", 0).alias("path"))).where("path <> ''")
    return paths.prune_nested(roots)


#: ways to name the same or another path with . and .. in it
_DOTTED = r"CASE page_id % 4 WHEN 1 THEN regexp_replace(path, '/', '/./x/../') WHEN 2 THEN path || '/../../other/' || page_id WHEN 3 THEN '../' || path ELSE path END"


@_query("permitted_paths", rf"""WITH {_URLS}, d AS (SELECT page_id, {_DOTTED} AS path FROM p), c AS (SELECT page_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(path, '/'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1: len(a) - 1] ELSE list_concat(a, x) END), '/') AS path FROM d),
f AS (SELECT DISTINCT regexp_extract(path, '^[^/]*/[^/]*') AS folder FROM p WHERE page_id % 40 = 0 AND regexp_matches(path, '^[^/]+/[^/]+'))
SELECT page_id, EXISTS (SELECT 1 FROM f WHERE path = folder OR starts_with(path, folder || '/')) AS allowed FROM c""")
def permitted_paths(spark, sf):
    """Which paths, some with ``.`` and ``..``, lie in permitted folders: the folders of every fortieth page."""
    p = _table(spark, sf, "pages").select("page_id", _url_path(F.col("url")).alias("path"))
    folders = p.where("page_id % 40 = 0").select(F.regexp_extract("path", "^[^/]*/[^/]*", 0).alias("path")).where(F.col("path").rlike("^[^/]+/[^/]+"))
    k, path = F.col("page_id") % 4, F.col("path")
    first = F.concat(F.substring_index(path, "/", 1), F.when(F.instr(path, "/") > 0, F.concat(F.lit("/./x/../"), path.substr(F.instr(path, "/") + 1, F.length(path)))).otherwise(""))
    dotted = F.when(k == 1, first).when(k == 2, F.concat(path, F.lit("/../../other/"), F.col("page_id"))).when(k == 3, F.concat(F.lit("../"), path)).otherwise(path)
    return paths.permitted(p.select("page_id", dotted.alias("path")), folders).select("page_id", "allowed")


def _many_rules() -> list[str]:
    forms = ("{k}.html", "*/fr/{k}", "{k}/", "!*{k}.html", "{k}")
    return [forms[k % 5].format(k=k) for k in range(1000)]


@_query("ignore_many_rules", rf"""WITH {_URLS}, e AS (SELECT DISTINCT path AS entry, false AS is_dir FROM p
  UNION ALL SELECT DISTINCT array_to_string(string_split(path, '/')[1: n], '/'), true FROM (SELECT path, unnest(range(1, len(string_split(path, '/')))) AS n FROM p)),
r AS (SELECT k, k % 5 AS form, k::VARCHAR AS t FROM range(1000) q(k)), m AS (
  SELECT entry, is_dir, max(k) AS k FROM (SELECT *, regexp_extract(entry, '[^/]*$') AS name FROM e) JOIN r ON CASE form WHEN 0 THEN name = t || '.html' WHEN 1 THEN regexp_matches(entry, '^[^/]*/fr/' || t || '$')
    WHEN 2 THEN is_dir AND name = t WHEN 3 THEN ends_with(name, t || '.html') ELSE name = t END GROUP BY 1, 2),
i AS (SELECT entry, is_dir FROM m WHERE k % 5 <> 3)
SELECT page_id, path IN (SELECT entry FROM i WHERE NOT is_dir) OR EXISTS (SELECT 1 FROM i WHERE is_dir AND starts_with(path, entry || '/')) AS ignored FROM p""")
def ignore_many_rules(spark, sf):
    """1,000 ignore rules: names, folders, globs and exceptions."""
    p = _table(spark, sf, "pages").select("page_id", _url_path(F.col("url")).alias("path"))
    return paths.ignored_by_rules(p, _many_rules()).select("page_id", "ignored")


@_query("path_completion", rf"""WITH {_URLS} SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS path FROM p WHERE starts_with(regexp_replace(path, '/[^/]*$', ''), 'blog.') ORDER BY 1 LIMIT 10""")
def path_completion(spark, sf):
    p = _table(spark, sf, "pages").select(F.regexp_replace(_url_path(F.col("url")), "/[^/]*$", "").alias("path"))
    return paths.complete(p, "blog.")


@_query("folder_completion", rf"""WITH {_URLS} SELECT DISTINCT '/' || regexp_extract(path, '^[^/]+/[^/]+') AS path FROM p WHERE starts_with(path, (SELECT min(regexp_extract(path, '^[^/]+/')) FROM p WHERE regexp_matches(path, '^[^/]+/[^/]+/')))
  AND regexp_matches(path, '^[^/]+/[^/]+/') ORDER BY 1 LIMIT 10""")
def folder_completion(spark, sf):
    """Child folders of the first host that has some, as a path field offers them (at most ten: the feature)."""
    p = _table(spark, sf, "pages").select(F.concat(F.lit("/"), _url_path(F.col("url"))).alias("path")).where(F.col("path").rlike("^/[^/]+/[^/]+/"))
    host = p.agg(F.min(F.regexp_extract("path", "^/[^/]+/", 0))).first()[0]
    return paths.complete_children(p, host or "/")


_PREFIXES = ["\\\\?\\UNC\\", "\\\\?\\unc\\", "//?/UNC/", "//?/Unc/", "\\\\?\\C:\\", "//?/D:/", "\\/?\\", ""]


@_query("display_paths", rf"""WITH {_URLS}, r AS (SELECT page_id, CASE page_id % 8 {" ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PREFIXES))} END || path AS raw FROM p)
SELECT page_id, regexp_replace(regexp_replace(raw, '^(?:\\\\\?\\[uU][nN][cC]\\|//\?/[uU][nN][cC]/)', '\\\\'), '^(?:\\\\\?\\|//\?/)', '') AS shown,
  CASE WHEN raw LIKE '\\?\UNC\%' THEN '\\' || substr(raw, 9) WHEN raw LIKE '\\?\%' THEN substr(raw, 5) ELSE raw END AS exported FROM r""")
def display_paths(spark, sf):
    """Paths of pages behind verbatim prefixes of drives and shares, in both slash directions, mixed, and plain."""
    raw = F.concat(F.element_at(F.array(*map(F.lit, _PREFIXES)), (F.col("page_id") % 8 + 1).cast("int")), _url_path(F.col("url")))
    return _table(spark, sf, "pages").select("page_id", cells.display_path(raw).alias("shown"), cells.export_path(raw).alias("exported"))


@_query("recent_entries", "SELECT props AS value, max(ts) AS last_used FROM events WHERE trim(props) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def recent_entries(spark, sf):
    return paths.most_recent(_table(spark, sf, "events").select(F.col("props").alias("value"), "ts"), "value", "ts")


# ---------------------------------------------------------------- rendering


@_query("number_render", r"""SELECT 'part' AS t, p_partkey AS k, regexp_replace(p_retailprice::VARCHAR, '\.0$', '') AS shown FROM part
UNION ALL SELECT 'customer', c_custkey, regexp_replace(c_acctbal::VARCHAR, '\.0$', '') FROM customer""")
def number_render(spark, sf):
    one = _table(spark, sf, "part").select(F.lit("part").alias("t"), F.col("p_partkey").alias("k"), cells.render_number(F.col("p_retailprice")).alias("shown"))
    return one.unionByName(_table(spark, sf, "customer").select(F.lit("customer").alias("t"), F.col("c_custkey").alias("k"), cells.render_number(F.col("c_acctbal")).alias("shown")))


@_query("cell_addresses", """SELECT l_orderkey, l_linenumber, CASE WHEN n >= 702 THEN chr(65 + ((n - 702) // 676)::INT) ELSE '' END || CASE WHEN n >= 26 THEN chr(65 + ((n - 26) // 26 % 26)::INT) ELSE '' END || chr(65 + (n % 26)::INT) || (l_linenumber + 1) AS address,
n AS col, l_linenumber::BIGINT AS "row" FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 7 + l_suppkey) % 16384 AS n FROM lineitem)""")
def cell_addresses(spark, sf):
    """A1 addresses and back, over all columns of a sheet."""
    li = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 16384).alias("n"))
    a = li.withColumn("address", cells.cell_address(F.col("l_linenumber"), F.col("n")))
    return a.withColumn("p", cells.parse_address(F.col("address"))).select("l_orderkey", "l_linenumber", "address", F.col("p.col").alias("col"), F.col("p.row").alias("row"))


@_query("csv_fields", r"SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r\n|\r|\n', ' ', 'g') AS field FROM documents")
def csv_fields(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", cells.csv_field(F.col("text")).alias("field"))


@_query("markdown_cells", r"SELECT doc_id, regexp_replace(replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '|', '\|'), '\r\n|\r|\n', '<br>', 'g') AS cell, replace(replace(replace(text, '|', '\|'), chr(13), ' '), chr(10), ' ') AS preview FROM documents")
def markdown_cells(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", cells.markdown_cell(F.col("text")).alias("cell"), cells.markdown_preview_cell(F.col("text")).alias("preview"))


@_query("natural_order", """WITH n AS (SELECT o_orderkey, o_orderkey % 11 AS k, o_orderkey % 5 AS a, o_orderkey * 37 % 1000 AS b, o_orderkey % 4 AS z FROM orders)
SELECT row_number() OVER (ORDER BY ['annee', 'annee', 'annee', 'file', 'file', 'lodz', 'lodz', 'nguyen', 'nguyen', 'report', 'report'][k + 1], a, CASE z WHEN 3 THEN 1 ELSE 0 END, b, o_orderkey) AS place, o_orderkey FROM n""")
def natural_order(spark, sf):
    """Names such as Année 3-12 and Łódź 20-007: in the order of the numbers, however long and whatever their zeros, letters' case and accents."""
    key = F.col("o_orderkey")
    word = F.get(F.array(*map(F.lit, ("Année", "annee", "ANNÉE", "file", "FILE", "Łódź", "lodz", "Nguyễn", "NGUYEN", "report", "Report"))), (key % 11).cast("int"))
    number = (key * 37 % 1000).cast("string")
    # every fourth number has 30 digits
    number = F.when(key % 4 == 3, F.concat(F.lit("123456789012345678901234567"), F.lpad(number, 3, "0"))).when(key % 3 == 0, F.lpad(number, 26, "0")).otherwise(number)
    name = F.concat(word, F.lit(" "), (key % 5).cast("string"), F.lit("-"), number)
    return storage.number_rows(_table(spark, sf, "orders").select("o_orderkey", cells.natural_key(name).alias("k")), ["k", "o_orderkey"], "place").select("place", "o_orderkey")


@_query("kind_labels", """SELECT event_id, CASE lang WHEN 'ja' THEN CASE kind WHEN 'Formula' THEN '数式' WHEN 'Shape' THEN '図形' ELSE kind END
  ELSE CASE kind WHEN 'HiddenSheet' THEN 'Hidden sheet' ELSE kind END END AS label
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' ELSE 'fr' END AS lang, CASE event_type WHEN 'click' THEN 'Formula' WHEN 'view' THEN 'Shape' ELSE event_type END AS kind FROM events)""")
def kind_labels(spark, sf):
    """Label look-up with fallbacks: own language, English, the kind itself."""
    kind = F.when(F.col("event_type") == "click", "Formula").when(F.col("event_type") == "view", "Shape").otherwise(F.col("event_type"))
    lang = F.when(F.col("event_id") % 3 == 0, "ja").when(F.col("event_id") % 3 == 1, "en").otherwise("fr")
    return _table(spark, sf, "events").select("event_id", labels.label_of(kind, lang).alias("label"))


# ---------------------------------------------------------------- context


_HEADINGS = _PARAS + r""", t AS (SELECT *, regexp_extract(text, '^(\S+)', 1) AS w FROM u), hd AS (
  SELECT *, starts_with(text, '#') OR (octet_length(encode(text)) <= 80 AND right(text, 1) NOT IN ('.', '。')
    AND (right(w, 1) = '.' OR starts_with(text, '第') OR starts_with(text, 'Chapter') OR starts_with(text, 'Section'))) AS is_h FROM t), sec AS (
  SELECT *, coalesce(last_value(CASE WHEN is_h THEN text END IGNORE NULLS) OVER (PARTITION BY full_path ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'Document Section') AS section FROM hd)"""


@_query("heading_before", f"WITH {_HEADINGS} SELECT full_path, row_index, section FROM sec")
def heading_before(spark, sf):
    return context.headings_before(document_units(spark, sf)).select("full_path", "row_index", "section")


@_query("grid_preview", f"""WITH {_PARTS}, h AS (SELECT r, c FROM cell WHERE contains(lower(v), 'ring'))
SELECT h.r AS row_index, h.c AS col_index, cell.r, cell.c, cell.v AS text, CASE WHEN cell.c = 5 AND cell.r > 1 AND cell.r % 4 = 0 THEN 'D' || cell.r || '*2' END AS cell_formula, cell.r = h.r AND cell.c = h.c AS is_target
FROM h JOIN cell ON cell.r BETWEEN h.r - 3 AND h.r + 3 AND cell.c BETWEEN h.c - 2 AND h.c + 2""")
def grid_preview(spark, sf):
    """The cells around each hit, with the formulas that some prices have."""
    u = part_units(spark, sf)
    priced = F.when((F.col("p_partkey") + 2) % 4 == 0, F.concat(F.lit("D"), F.col("p_partkey") + 2, F.lit("*2")))
    formulas = units.sheet_units(_table(spark, sf, "part"), "p_partkey", "part", {"p_retailprice": priced}, header=False).withColumn("unit_kind", F.lit("formula")).withColumn("col_index", F.lit(5))
    found = search.hits(u, SearchRequest("ring")).select(F.struct("row_index", "col_index").alias("id"), "full_path", "sheet_name", "row_index", "col_index")
    return context.grid_preview(found, u.unionByName(formulas)).select("id.row_index", "id.col_index", "r", "c", "text", "cell_formula", "is_target")


@_query("header_context", f"""WITH {_PARTS}, n AS (SELECT r, count(*) AS n FROM cell GROUP BY r), w AS (
  SELECT r, c, v, max(CASE WHEN n >= 2 THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hr FROM cell JOIN n USING (r)
), h AS (SELECT w.r, w.c, CASE WHEN w.r = 1 THEN 1 ELSE w.hr END AS header_row FROM w WHERE contains(lower(w.v), 'brand#1')
), k AS (SELECT r, min(c) AS k FROM cell GROUP BY r)
SELECT h.r, h.c, h.header_row, hc.v AS column_header, CASE WHEN k.k < h.c THEN k.k ELSE 1 END::INT AS key_col, coalesce(kc.v, 'Row ' || h.r) AS row_key
FROM h JOIN cell hc ON hc.r = h.header_row AND hc.c = h.c JOIN k ON k.r = h.r LEFT JOIN cell kc ON kc.r = h.r AND kc.c = CASE WHEN k.k < h.c THEN k.k ELSE 1 END""")
def header_context(spark, sf):
    u = part_units(spark, sf)
    found = search.hits(u, SearchRequest("brand#1")).select((F.col("row_index") * 100 + F.col("col_index")).alias("id"), "full_path", "sheet_name", "row_index", "col_index")
    out = context.header_context(found, u)
    return out.select(F.floor(F.col("id") / 100).alias("r"), (F.col("id") % 100).cast("int").alias("c"), "header_row", "column_header", F.col("key_col").cast("int").alias("key_col"), "row_key")


@_query("window_columns", f"""WITH {_PARTS}, h AS (SELECT DISTINCT c FROM cell WHERE contains(lower(v), 'economy')), s AS (
  SELECT DISTINCT unnest(range(greatest(1, c - 1), least(5, c + 1) + 1))::INT AS c FROM h UNION SELECT 1)
SELECT c, coalesce(c > lag(c) OVER (ORDER BY c) + 1, false) AS gap_before, lead(c) OVER (ORDER BY c) IS NULL AND c < 5 AS gap_after FROM s""")
def window_columns(spark, sf):
    u = part_units(spark, sf)
    found = search.hits(u, SearchRequest("economy"))
    keys = found.select("full_path", "sheet_name").distinct().withColumn("key_col", F.lit(1))
    return context.window_columns(found, keys, u, window=1).select("c", "gap_before", "gap_after")


@_query("word_sections", f"""WITH {_HEADINGS}, h AS (SELECT *, substr(text, instr(lower(text), 'thatin'), 6) AS hit FROM sec WHERE contains(lower(text), 'thatin'))
SELECT full_path, '### ' || any_value(file_name) || chr(10) || chr(10) || string_agg('- Location: Paragraph ' || row_index || chr(10) || '- Section: ' || section || chr(10) || chr(10) || '### ' || section || chr(10) || '> '
  || replace(text, hit, '**' || hit || '**'), chr(10) || chr(10) ORDER BY row_index) AS section_text
FROM h GROUP BY full_path""")
def word_sections(spark, sf):
    """Markdown of each document with hits, every hit under the heading before it."""
    u = document_units(spark, sf)
    return context.word_context(search.project(search.hits(u, SearchRequest("thatin"))), u)


@_query("word_preview", f"""WITH {_PARAS}, h AS (SELECT full_path, min(row_index) AS target_paragraph FROM u WHERE contains(lower(text), 'thanedble') GROUP BY 1)
SELECT full_path, file_name, target_paragraph, row_index, text, row_index = target_paragraph AS is_target, count(*) OVER (PARTITION BY full_path) AS total_paragraphs FROM u JOIN h USING (full_path)""")
def word_preview(spark, sf):
    """The whole document around the first hit in it, that paragraph flagged."""
    u = document_units(spark, sf)
    first = search.hits(u, SearchRequest("thanedble")).groupBy("full_path").agg(F.min("row_index").alias("row_index"))
    return context.word_preview(first, u)


@_query("sheet_sections", f"""WITH {_PARTS}, n AS (SELECT r, count(*) AS n FROM cell GROUP BY r), w AS (
  SELECT r, c, v, max(CASE WHEN n >= 2 THEN r END) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hr FROM cell JOIN n USING (r)
), h AS (SELECT r, v, hr FROM w WHERE contains(lower(v), 'red widget')), t AS (
  SELECT string_agg('- Target Cell: [part] A' || h.r || ' (Column: ' || x.v || ', Row: ' || h.v || ')' || chr(10) || '  - Matched Value: **' || h.v || '**', chr(10) ORDER BY h.r) AS lines, arg_min(h.hr, h.r) AS top
  FROM h JOIN cell x ON x.r = h.hr AND x.c = 1
), b AS (SELECT string_agg('| **' || h.v || '** | ' || coalesce(y.v, '') || ' | ... |', chr(10) ORDER BY h.r) AS body FROM h LEFT JOIN cell y ON y.r = h.r AND y.c = 2)
SELECT 'part' AS sheet_name, '### part.xlsx - part' || chr(10) || lines || chr(10) || chr(10) || '| ' || coalesce((SELECT v FROM cell WHERE r = top AND c = 1), 'Column A') || ' | ' || coalesce((SELECT v FROM cell WHERE r = top AND c = 2), 'Column B')
  || ' | ... |' || chr(10) || '| --- | --- | --- |' || chr(10) || body AS section_text FROM t, b""")
def sheet_sections(spark, sf):
    """Markdown of a sheet with hits, its table in a window of one column beside them."""
    u = part_units(spark, sf)
    return context.sheet_context(search.search(u, SearchRequest("red widget")), u, window=1).select("sheet_name", "section_text")


_LINES = """lines AS (SELECT g.r, '| ' || g.r || ' | ' || string_agg(replace(coalesce(cell.v, ''), '|', '\\|'), ' | ' ORDER BY g.c) || ' |' AS line
  FROM (SELECT r, c FROM range(1, (SELECT max(r) + 1 FROM cell)) t(r), range(1, 6) s(c)) g LEFT JOIN cell USING (r, c) GROUP BY g.r)"""


@_query("sheet_page", f"WITH {_PARTS}, {_LINES} SELECT r AS row_number, line, (SELECT max(r) FROM cell) AS page_rows, 5 AS page_columns FROM lines WHERE r <= 100")
def sheet_page(spark, sf):
    """The first page of a sheet (100 rows: the pager's default) as Markdown lines."""
    return context.sheet_page(part_units(spark, sf)).select("row_number", "line", "page_rows", "page_columns")


@_query("sheet_preview", f"""WITH {_PARTS}, {_LINES} SELECT 'part' AS sheet_name, 'Preview of ''part'' in tables/part.xlsx (Rows 51-' || least(120, (SELECT max(r) FROM cell)) || ' of ' || (SELECT max(r) FROM cell) || ', 5 columns):'
  || chr(10) || chr(10) || '| Row | A | B | C | D | E |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || (SELECT string_agg(line, chr(10) ORDER BY r) FROM lines WHERE r BETWEEN 51 AND 120) AS page
UNION ALL SELECT 'nation', 'Preview of ''nation'' in tables/nation.xlsx (Rows 51-' || (max(n_nationkey) + 2) || ' of ' || (max(n_nationkey) + 2) || ', 1 columns):' || chr(10) || chr(10) || '| Row | A |' || chr(10) || '|---|---|' FROM nation""")
def sheet_preview(spark, sf):
    """Rows 51 to 120 of two sheets as one text each; the shorter one ends before them."""
    short = units.sheet_units(_table(spark, sf, "nation"), "n_nationkey", "nation", {"n_name": F.col("n_name")})
    return context.sheet_preview(part_units(spark, sf).unionByName(short), 51, 70).select("sheet_name", "page")


@_query("sheet_list", """SELECT 'tables/nation.xlsx' AS full_path, 0 AS sheet_pos, 'nation' AS sheet_name, false AS sheet_hidden, count(*) * 2 + 2 AS n_cells FROM nation
UNION ALL SELECT 'tables/region.xlsx', 1, 'region', true, count(*) FROM region""")
def sheet_list(spark, sf):
    a = units.sheet_units(_table(spark, sf, "nation"), "n_nationkey", "nation", {"n_name": F.col("n_name"), "n_regionkey": F.col("n_regionkey")})
    b = units.sheet_units(_table(spark, sf, "region"), "r_regionkey", "region", {"r_name": F.col("r_name")}, hidden=True, header=False).withColumn("sheet_pos", F.lit(1))
    return context.sheet_list(a.unionByName(b))


# ---------------------------------------------------------------- reports and exports


@_query("hits_by_file", f"WITH {_PARAS} SELECT full_path, 'Word' AS sheet_name, count(*) AS hits, min(row_index) AS first_row, max(row_index) AS last_row FROM u WHERE contains(lower(text), 'tion') GROUP BY 1")
def hits_by_file(spark, sf):
    return report.per_file(search.project(search.hits(document_units(spark, sf), SearchRequest("tion"))))


@_query("first_with_total", f"""WITH {_PARAS}, h AS (SELECT *, row_number() OVER (ORDER BY full_path, row_index) AS id, count(*) OVER () AS total FROM u WHERE contains(lower(text), 'ention'))
SELECT id, full_path, row_index, total, total > 100 AS truncated FROM h WHERE id <= 100""")
def first_with_total(spark, sf):
    """The first 100 matches (the report's limit) and how many there are."""
    top, total = search.first_with_total(search.search(document_units(spark, sf), SearchRequest("ention")), 100)
    # one row
    return top.join(F.broadcast(total), F.lit(True)).select("id", "full_path", "row_index", "total", "truncated")


@_query("result_text", f"""WITH {_PARAS}, h AS (SELECT *, instr(lower(text), 'thatin') AS p, row_number() OVER (ORDER BY full_path, row_index) AS id, count(*) OVER () AS total FROM u WHERE contains(lower(text), 'thatin')), i AS (
  SELECT id, total, '- File: ' || full_path || chr(10) || '  Sheet: Word' || chr(10) || '  Cell: - (Row ' || row_index || ', Col 0)' || chr(10) || '  Type: WordText' || chr(10) || '  Content: ' || text
    || chr(10) || '  Snippet: ' || regexp_replace({_snippet('text', 'p', '6')}, '^\\s+|\\s+$', '', 'g') || chr(10) AS t FROM h WHERE id <= 40)
SELECT CASE WHEN any_value(total) > 40 THEN 'Found ' || any_value(total) || ' matches (truncated to maximum 40 results):' ELSE 'Found ' || any_value(total) || ' match(es):' END || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY id) AS result_text FROM i""")
def result_text(spark, sf):
    """The first 40 matches as one text, with a line that says how many there are (the limit is the feature)."""
    return search.result_text(search.search(document_units(spark, sf), SearchRequest("thatin")), "thatin", 40)


@_query("report_counts", f"""WITH {_PARAS}, s AS (SELECT coalesce(source, '') AS src, count(*) AS discovered, count(*) FILTER (n_chars < CASE WHEN source = 'src0' THEN 0 WHEN source = 'src1' THEN 1000000 ELSE 200 END) AS failed FROM documents GROUP BY 1),
m AS (SELECT split_part(full_path, '/', 1) AS src, count(*) AS matches FROM u WHERE contains(lower(text), 'tion') GROUP BY 1)
SELECT src, discovered, discovered - failed AS readable, failed, coalesce(matches, 0)::BIGINT AS matches, CASE WHEN failed = discovered THEN 2 WHEN failed > 0 THEN 1 ELSE 0 END AS status FROM s LEFT JOIN m USING (src)""")
def report_counts(spark, sf):
    """Counters and exit status of each source; short documents stand for files with issues: in one source none, in another all of them."""
    source = F.coalesce("source", F.lit(""))
    docs = _table(spark, sf, "documents").select(source.alias("src"), F.concat(source, F.lit("/"), F.col("doc_id"), F.lit(".docx")).alias("full_path"), "n_chars")
    short = F.col("n_chars") < F.when(F.col("src") == "src0", 0).when(F.col("src") == "src1", 1_000_000).otherwise(200)
    found = search.hits(document_units(spark, sf), SearchRequest("tion")).withColumn("src", F.substring_index("full_path", "/", 1))
    return report.counts(docs, found, docs.where(short), by=["src"])


@_query("observed_counts", f"""WITH {_PARAS} SELECT (SELECT count(*) FROM documents) AS discovered, (SELECT count(*) FROM documents WHERE n_chars >= 200 OR n_chars IS NULL) AS readable, (SELECT count(*) FROM documents WHERE n_chars < 200) AS failed,
(SELECT count(*) FROM u WHERE contains(lower(text), 'thanedble')) AS matches, 1 AS status, (SELECT count(*) FROM u WHERE contains(lower(text), 'thanedble')) AS rows_written""")
def observed_counts(spark, sf):
    """The counters of a search come from the write of its matches, which runs once; the rows it wrote are counted beside them."""
    docs = _table(spark, sf, "documents").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id"), F.lit(".docx")).alias("full_path"), "n_chars")
    found = search.project(search.hits(document_units(spark, sf), SearchRequest("thanedble")))
    files = docs.select("full_path", F.when(F.col("n_chars") < 200, "short").alias("cause"))
    target = f"{storage.stored_dir(spark)}/observed-{uuid.uuid4().hex}"
    counted = report.written(found, files, lambda df: df.write.parquet(target))
    return counted.crossJoin(spark.read.parquet(target).agg(F.count(F.lit(1)).alias("rows_written")))  # one row each


@_query("issue_dedup", """SELECT path, code, ts, event_id FROM (SELECT 'user/' || user_id AS path, event_type AS code, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1""")
def issue_dedup(spark, sf):
    issues = _table(spark, sf, "events").select(F.concat(F.lit("user/"), F.col("user_id")).alias("path"), F.col("event_type").alias("code"), "ts", "event_id")
    return report.distinct_issues(issues, ["path", "code"], "ts")


@_query("export_table", rf"""WITH {_PARAS}, h AS (SELECT *, row_number() OVER (ORDER BY full_path, row_index) AS id FROM u WHERE contains(lower(text), 'thatin'))
SELECT id, file_name, full_path, 'Word' AS sheet_name, '-' AS cell_address, '' AS shape_name, 'Word' AS match_type, regexp_replace(text, '\r\n|\r|\n', ' ', 'g') AS content, '' AS formula FROM h""")
def export_table(spark, sf):
    return export.export_rows(search.search(document_units(spark, sf), SearchRequest("thatin")), "ja")


@_query("json_records", f"""WITH {_PARAS}, h AS (SELECT *, instr(lower(text), 'thanedble') AS p FROM u WHERE contains(lower(text), 'thanedble')), i AS (SELECT *, row_number() OVER (ORDER BY full_path, row_index) AS id, {_snippet('text', 'p', '9')} AS snippet FROM h)
SELECT id, to_json({{'id': id, 'file_name': file_name, 'full_path': full_path, 'sheet_name': 'Word', 'cell_address': '-', 'row_index': row_index, 'col_index': 0, 'match_type': 'WordText', 'full_content': text, 'snippet': snippet}})::VARCHAR AS record FROM i""")
def json_records(spark, sf):
    return export.json_records(search.search(document_units(spark, sf), SearchRequest("thanedble")))


@_query("benchmark_phrases", r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM benchmark), k AS (
  SELECT DISTINCT item_id, array_to_string(w[i: i + 3], ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM b WHERE len(w) > 3)
), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents), g AS (
  SELECT doc_id, i, array_to_string(w[i: i + 3], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) > 3))
SELECT item_id, doc_id, count(DISTINCT phrase) AS phrases, min(i) AS first_word FROM g JOIN k USING (phrase) GROUP BY 1, 2""")
def benchmark_phrases(spark, sf):
    """Many keywords at once: every run of four words of every benchmark item, looked up in all texts by one equi-join on hashes.

    The keywords are distinct first, so a phrase of many items meets a text's run once, and its items are added at the end.
    """
    def runs(df, key):
        w = df.select(key, F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)).alias("w")).where(F.size("w") > 3)
        at = w.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 4)).alias("at"))
        return at.select(key, (F.col("at") + 1).cast("long").alias("first_word"), F.xxhash64(*[F.col("w")[F.col("at") + k] for k in range(4)]).alias("run"))

    keys = runs(_table(spark, sf, "benchmark"), "item_id").select("item_id", "run").distinct()
    found = runs(_table(spark, sf, "documents"), "doc_id").join(keys.select("run").distinct(), "run").groupBy("doc_id", "run").agg(F.min("first_word").alias("first_word"))
    return found.join(keys, "run").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("phrases"), F.min("first_word").alias("first_word"))


@_query("turns_in_order", """SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE contains(lower(coalesce(text, '')), 'th')""")
def turns_in_order(spark, sf):
    at = Window.partitionBy("conv_id").orderBy("turn")
    return _table(spark, sf, "conversations").where(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("th"))).select("conv_id", "turn", "role", F.lag("role").over(at).alias("before"))


assert all(re.fullmatch(r"[a-z_]+", name) for name in QUERIES)
