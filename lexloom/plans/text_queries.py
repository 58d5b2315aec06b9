"""Markdown, compression, validation, classification, commands, JSON, documents and lookups, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, commands, jsonx, lexical, lint, markdown, tokens, validation
from ..functions.spaces import stripped
from ..operators import lookup, state
from . import adapters as A

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


_PAIRS = f"pairs AS (SELECT p_partkey, {A.ORIGINAL} AS a, {A.SHORTER} AS b, {A.PATH} AS path FROM part)"


def _q(text: str) -> str:
    return text.replace("'", "''")


_HEADS = lambda t: f"list_transform(range(1, len(regexp_extract_all({t}, '(?m)^(#{{1,6}})\\s+(.*)', 1)) + 1), lambda i: concat(regexp_extract_all({t}, '(?m)^(#{{1,6}})\\s+(.*)', 1)[i], ' ', {A.STRIP(f"regexp_extract_all({t}, '(?m)^(#{{1,6}})\\s+(.*)', 2)[i]")}))"
_URLS = lambda t: f"list_distinct(regexp_extract_all({t}, 'https?://[^\\s)]+'))"
_W = "\\p{L}\\p{M}\\p{N}\\p{Pc}"  # letters, marks, numbers and connectors of all scripts
_PATHS = lambda t: f"list_distinct(regexp_extract_all({t}, '(?:\\./|\\.\\./|/|[A-Za-z]:\\\\)[{_W}\\-/\\\\\\.]+|[{_W}\\-\\.]+[/\\\\][{_W}\\-/\\\\\\.]+'))"
_BULLETS = lambda t: f"len(regexp_extract_all({t}, '(?m)^\\s*[-*+]\\s+'))::BIGINT"
_CODES = lambda t: f"regexp_extract_all(regexp_replace(regexp_replace({t}, '(?m)^```[\\s\\S]*?^```', '', 'g'), '(?m)^~~~[\\s\\S]*?^~~~', '', 'g'), '`([^`]+)`', 1)"
_LIST = lambda x: f"concat('[', array_to_string(list_sort({x}), ', '), ']')"
_EXCEPT = lambda a, b: f"list_distinct(list_filter({a}, lambda x: NOT list_contains({b}, x)))"


def _set_sql_of(what: str, f) -> str:
    a, b = f("a"), f("b")
    return f"CASE WHEN len({_EXCEPT(a, b)}) > 0 OR len({_EXCEPT(b, a)}) > 0 THEN concat('{what} mismatch: lost=', {_LIST(_EXCEPT(a, b))}, ', added=', {_LIST(_EXCEPT(b, a))}) END"


def _heads(text):
    return F.array_join(F.transform(markdown.headings(text), lambda h: F.concat(h["level"], F.lit(" "), h["title"])), "|")


@query(f"WITH {_PAIRS} SELECT p_partkey, len({_HEADS('a')})::INT AS n, array_to_string({_HEADS('a')}, '|') AS headings FROM pairs")
def headings(spark, d):
    return A.markdown_pairs(spark, d).select("p_partkey", F.size(markdown.headings(F.col("original"))).alias("n"), _heads(F.col("original")).alias("headings"))


@query(f"WITH {_PAIRS} SELECT p_partkey, {_BULLETS('a')} AS bullets FROM pairs")
def bullets(spark, d):
    return A.markdown_pairs(spark, d).select("p_partkey", markdown.bullets(F.col("original")).alias("bullets"))


@query(f"SELECT page_id, len({_URLS('t')})::INT AS n, {_LIST(_URLS('t'))} AS urls FROM (SELECT page_id, concat(url, ' ', html) AS t FROM pages)")
def urls(spark, d):
    found = markdown.urls(F.concat_ws(" ", "url", "html"))
    return A.table(spark, d, "pages").select("page_id", F.size(found).alias("n"), validation._listed(found).alias("urls"))


@query(f"SELECT page_id, {_LIST(_PATHS('t'))} AS paths FROM (SELECT page_id, concat_ws(' ', url, html) AS t FROM pages)")
def paths(spark, d):
    return A.table(spark, d, "pages").select("page_id", validation._listed(markdown.paths(F.concat_ws(" ", "url", "html"))).alias("paths"))


@query(f"SELECT doc_id, len({_HEADS('t')})::INT AS headings, {_BULLETS('t')} AS bullets, len({_URLS('t')})::INT AS urls, len({_PATHS('t')})::INT AS paths, len({_CODES('t')})::INT AS codes, length({A.STRIP('t')})::INT AS solid FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents)")
def document_structure(spark, d):
    """What whole texts of the corpus hold."""
    t = A.table(spark, d, "documents").select("doc_id", markdown.unix_lines(F.col("text")).alias("t"))
    x = F.col("t")
    return t.select("doc_id", F.size(markdown.headings(x)).alias("headings"), markdown.bullets(x).alias("bullets"), F.size(markdown.urls(x)).alias("urls"), F.size(markdown.paths(x)).alias("paths"), F.size(markdown.inline_codes(x)).alias("codes"), F.length(stripped(x)).alias("solid"))


_KEPT = f"regexp_replace(text, '{_q(lexical.pattern(False))}', '\\1', 'g')"


@query(f"SELECT doc_id, {_set_sql_of('URL', _URLS)} AS url_error, {_set_sql_of('Path', _PATHS)} AS path_warning, CASE WHEN len({_HEADS('a')}) <> len({_HEADS('b')}) THEN concat('Heading count mismatch: ', len({_HEADS('a')}), ' vs ', len({_HEADS('b')})) END AS heading_error FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS a, regexp_replace({_KEPT}, '\\r\\n?', chr(10), 'g') AS b FROM documents)")
def document_validation(spark, d):
    """Whole texts of the corpus against their compressed form."""
    pairs = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("original"), lexical.compressed(F.col("text")).alias("compressed"))
    found = validation.facts(pairs, names=("headings", "urls", "paths"))
    x = lambda n: (F.col(f"a_{n}"), F.col(f"b_{n}"))
    return found.select("doc_id", validation.url_error(*x("urls")).alias("url_error"), validation.path_warning(*x("paths")).alias("path_warning"), validation.heading_error(*x("headings")).alias("heading_error"))


@query(f"WITH {_PAIRS} SELECT code, count(*) AS n, count(DISTINCT p_partkey) AS texts FROM (SELECT p_partkey, unnest({_CODES('b')}) AS code FROM pairs) GROUP BY code")
def inline_codes(spark, d):
    codes = A.markdown_pairs(spark, d).select("p_partkey", F.explode(markdown.inline_codes(F.col("compressed"))).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("texts"))


_FENCES = lambda t: f"regexp_extract_all({t}, '(?ms)^```[^`\\n]*\\n.*?\\n```$')"


@query(f"WITH {_PAIRS} SELECT p_partkey, unnest({_FENCES('a')}) AS block FROM pairs")
def code_blocks(spark, d):
    return A.markdown_pairs(spark, d).select("p_partkey", F.explode(markdown.code_blocks(F.col("original"))).alias("block"))


_FM = "(?s)\\A(---\\r?\\n.*?\\r?\\n---\\r?\\n)(.*)"


@query(f"WITH {_PAIRS} SELECT p_partkey, front, CASE WHEN front <> '' THEN substr(a, length(front) + 1) ELSE a END AS body, concat(front, regexp_replace(CASE WHEN front <> '' THEN substr(a, length(front) + 1) ELSE a END, '{_q(lexical.pattern(False))}', '\\1', 'g')) AS rebuilt FROM (SELECT p_partkey, a, regexp_extract(a, '{_FM}', 1) AS front FROM pairs)")
def frontmatter_split(spark, d):
    s = A.markdown_pairs(spark, d).select("p_partkey", markdown.front_matter(F.col("original")).alias("s"))
    return s.select("p_partkey", "s.front", "s.body", F.concat("s.front", lexical.compressed(F.col("s.body"))).alias("rebuilt"))


_WRAP = "CASE WHEN p_partkey % 3 = 0 THEN concat('```markdown', chr(10), p_name, chr(10), '```', chr(10)) WHEN p_partkey % 3 = 1 THEN concat('```', chr(10), p_name, chr(10), '~~~') ELSE p_name END"


_INSIDE = lambda c: f"'(?s)\\A\\s*{c}[^\\n]*\\n(.*)\\n{c}\\s*\\z'"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(w, {_INSIDE('```')}) THEN regexp_extract(w, {_INSIDE('```')}, 1) WHEN regexp_matches(w, {_INSIDE('~~~')}) THEN regexp_extract(w, {_INSIDE('~~~')}, 1) ELSE w END AS text FROM (SELECT p_partkey, {_WRAP} AS w FROM part)")
def unwrap_fence(spark, d):
    return A.table(spark, d, "part").select("p_partkey", markdown.unwrapped(F.expr(_WRAP)).alias("text"))


_DROP_KEY = f"regexp_replace(regexp_extract(a, '{_FM}', 1), '(?m)^tools[ \\t]*:.*(?:\\n[ \\t].*)*\\n?', '')"


@query(f"WITH {_PAIRS} SELECT p_partkey, {_DROP_KEY} AS front, concat_ws(chr(10), 'version: 1', regexp_extract(a, '{_FM}', 1)) AS keyed FROM pairs")
def key_drop(spark, d):
    front = markdown.front_matter(F.col("original"))["front"]
    return A.markdown_pairs(spark, d).select("p_partkey", markdown.without_key(front, "tools").alias("front"), markdown.with_keys(front, {"name": "x", "version": "1"}).alias("keyed"))


_BASE = "CASE p_partkey % 5 WHEN 0 THEN concat(p_name, chr(10), chr(10)) WHEN 1 THEN concat(p_name, chr(10)) WHEN 2 THEN p_name WHEN 3 THEN concat(p_name, chr(10), chr(10), '<!-- b -->', chr(10), 'old', chr(10), '<!-- e -->', chr(10), chr(10), 'after', chr(10)) ELSE concat('<!-- b -->', chr(10), 'only', chr(10), '<!-- e -->', chr(10)) END"
_BLOCK = "concat('<!-- b -->', chr(10), 'rules', chr(10), '<!-- e -->', chr(10))"


@query(f"SELECT p_partkey, CASE WHEN contains(t, '<!-- b -->') AND contains(t, '<!-- e -->') THEN t ELSE concat(t, CASE WHEN t = '' OR regexp_matches(t, '\\n\\n\\z') THEN '' WHEN regexp_matches(t, '\\n\\z') THEN chr(10) ELSE concat(chr(10), chr(10)) END, {_BLOCK}) END AS text FROM (SELECT p_partkey, {_BASE} AS t FROM part)")
def marker_insert(spark, d):
    return A.table(spark, d, "part").select("p_partkey", markdown.with_block(F.expr(_BASE), "<!-- b -->", "<!-- e -->", "rules").alias("text"))


@query(f"SELECT p_partkey, CASE WHEN {A.STRIP('c')} <> '' THEN c END AS text FROM (SELECT p_partkey, CASE WHEN contains(t, '<!-- b -->') THEN CASE WHEN before = '' THEN after WHEN after = '' THEN concat(before, chr(10)) ELSE concat(before, chr(10), chr(10), after) END ELSE t END AS c FROM (SELECT p_partkey, t, rtrim(split_part(t, '<!-- b -->', 1), chr(10)) AS before, ltrim(split_part(t, '<!-- e -->', 2), chr(10)) AS after FROM (SELECT p_partkey, {_BASE} AS t FROM part)))")
def marker_strip(spark, d):
    return A.table(spark, d, "part").select("p_partkey", markdown.without_block(F.expr(_BASE), "<!-- b -->", "<!-- e -->").alias("text"))


@query(f"SELECT p_partkey, CASE WHEN contains(t, '<!-- b -->') AND contains(t, '<!-- e -->') THEN concat(split_part(t, '<!-- b -->', 1), '<!-- b -->', chr(10), p_brand, chr(10), '<!-- e -->', split_part(t, '<!-- e -->', 2)) END AS text FROM (SELECT p_partkey, p_brand, {_BASE} AS t FROM part)")
def marker_replace(spark, d):
    return A.table(spark, d, "part").select("p_partkey", markdown.between(F.expr(_BASE), "<!-- b -->", "<!-- e -->", F.col("p_brand")).alias("text"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'added' WHEN p_partkey % 3 = 0 THEN 'skipped-already-installed' WHEN p_partkey % 5 = 0 THEN 'appended' WHEN p_partkey % 7 = 0 THEN 'overwritten' ELSE 'skipped-exists' END AS status FROM part) GROUP BY status")
def rule_plan(spark, d):
    k = F.col("p_partkey")
    plan = markdown.rule_plan(k % 2 != 0, k % 3 == 0, k % 5 == 0, k % 7 == 0)
    return A.table(spark, d, "part").groupBy(plan.alias("status")).agg(F.count(F.lit(1)).alias("n"))


_LEVELS = "concat('| Level | Text |', chr(10), '|---|---|', chr(10), '| **lite** | ', p_name, ' |', chr(10), '| **full** | ', p_brand, ' |', chr(10), '- lite: a', chr(10), '- full: b', chr(10), 'end')"


@query("SELECT p_partkey, concat('| Level | Text |', chr(10), '|---|---|', chr(10), '| **full** | ', p_brand, ' |', chr(10), '- full: b', chr(10), 'end') AS body FROM part")
def intensity_rows(spark, d):
    return A.table(spark, d, "part").select("p_partkey", markdown.for_level(F.expr(_LEVELS), "full").alias("body"))


_PATTERN = _q(lexical.pattern(False))


@query(f"SELECT doc_id, c AS compressed, length(text)::BIGINT AS before, length(c)::BIGINT AS after FROM (SELECT doc_id, text, regexp_replace(text, '{_PATTERN}', '\\1', 'g') AS c FROM documents)")
def lexical_compress(spark, d):
    return A.table(spark, d, "documents").select("doc_id", lexical.report(F.col("text")).alias("r")).select("doc_id", "r.*")


@query(f"WITH {_PAIRS} SELECT p_partkey, regexp_replace(replace(a, 'in order to', 'to'), '(?i)\\b(?:in addition|however|furthermore|additionally)\\b,?[ \\t]*', '', 'g') AS text FROM pairs")
def phrase_rules(spark, d):
    return A.markdown_pairs(spark, d).select("p_partkey", lexical.rephrased(F.col("original")).alias("text"))


def _pairs(spark, d, fact, **columns):
    found = validation.facts(A.markdown_pairs(spark, d).select("p_partkey", "original", "compressed"), names=(fact,))
    return found.select("p_partkey", *(f(F.col(f"a_{fact}"), F.col(f"b_{fact}")).alias(k) for k, f in columns.items()))


@query(f"WITH {_PAIRS} SELECT p_partkey, CASE WHEN len({_HEADS('a')}) <> len({_HEADS('b')}) THEN concat('Heading count mismatch: ', len({_HEADS('a')}), ' vs ', len({_HEADS('b')})) END AS error, CASE WHEN {_HEADS('a')} <> {_HEADS('b')} THEN 'Heading text/order changed' END AS warning FROM pairs")
def validate_headings(spark, d):
    return _pairs(spark, d, "headings", error=validation.heading_error, warning=validation.heading_warning)


@query(f"WITH {_PAIRS} SELECT p_partkey, {_set_sql_of('URL', _URLS)} AS error FROM pairs")
def validate_urls(spark, d):
    return _pairs(spark, d, "urls", error=validation.url_error)


@query(f"WITH {_PAIRS} SELECT p_partkey, {_set_sql_of('Path', _PATHS)} AS warning FROM pairs")
def validate_paths(spark, d):
    return _pairs(spark, d, "paths", warning=validation.path_warning)


@query(f"WITH {_PAIRS} SELECT p_partkey, CASE WHEN {_BULLETS('a')} <> 0 AND abs({_BULLETS('a')} - {_BULLETS('b')}) / {_BULLETS('a')} > 0.15 THEN concat('Bullet count changed too much: ', {_BULLETS('a')}, ' -> ', {_BULLETS('b')}) END AS warning FROM pairs")
def validate_bullets(spark, d):
    return _pairs(spark, d, "bullets", warning=validation.bullet_warning)


_COUNT = lambda l, c: f"len(list_filter({l}, lambda y: y = {c}))"
_LOST = f"list_concat({_EXCEPT(_CODES('a'), _CODES('b'))}, list_transform(list_filter(list_distinct({_CODES('a')}), lambda c: {_COUNT(_CODES('b'), 'c')} > 0 AND {_COUNT(_CODES('b'), 'c')} < {_COUNT(_CODES('a'), 'c')}), lambda c: concat(c, ' (lost ', {_COUNT(_CODES('a'), 'c')} - {_COUNT(_CODES('b'), 'c')}, ' of ', {_COUNT(_CODES('a'), 'c')}, ' occurrences)')))"


@query(f"WITH {_PAIRS} SELECT p_partkey, CASE WHEN len({_LOST}) > 0 THEN concat('Inline code lost: ', {_LIST(_LOST)}) END AS error, CASE WHEN len({_EXCEPT(_CODES('b'), _CODES('a'))}) > 0 THEN concat('Inline code added: ', {_LIST(_EXCEPT(_CODES('b'), _CODES('a')))}) END AS warning FROM pairs")
def validate_inline(spark, d):
    return _pairs(spark, d, "codes", error=validation.inline_error, warning=validation.inline_warning)


_HEADING_ERROR = f"CASE WHEN len({_HEADS('a')}) <> len({_HEADS('b')}) THEN concat('Heading count mismatch: ', len({_HEADS('a')}), ' vs ', len({_HEADS('b')})) END"
_BLOCK_ERROR = f"CASE WHEN {_FENCES('a')} <> {_FENCES('b')} THEN 'Code blocks not preserved exactly' END"
_CODE_ERROR = f"CASE WHEN len({_LOST}) > 0 THEN concat('Inline code lost: ', {_LIST(_LOST)}) END"
_CODE_WARNING = f"CASE WHEN len({_EXCEPT(_CODES('b'), _CODES('a'))}) > 0 THEN concat('Inline code added: ', {_LIST(_EXCEPT(_CODES('b'), _CODES('a')))}) END"
_BULLET_WARNING = f"CASE WHEN {_BULLETS('a')} <> 0 AND abs({_BULLETS('a')} - {_BULLETS('b')}) / {_BULLETS('a')} > 0.15 THEN concat('Bullet count changed too much: ', {_BULLETS('a')}, ' -> ', {_BULLETS('b')}) END"
_ERRORS = f"concat_ws('; ', {_HEADING_ERROR}, {_BLOCK_ERROR}, {_set_sql_of('URL', _URLS)}, {_CODE_ERROR})"
_WARNINGS = f"concat_ws('; ', CASE WHEN {_HEADS('a')} <> {_HEADS('b')} THEN 'Heading text/order changed' END, {_set_sql_of('Path', _PATHS)}, {_BULLET_WARNING}, {_CODE_WARNING})"


@query(f"WITH {_PAIRS} SELECT p_partkey, errors = '' AS is_valid, errors, warnings FROM (SELECT p_partkey, {_ERRORS} AS errors, {_WARNINGS} AS warnings FROM pairs)")
def validate_all(spark, d):
    out = validation.judged(A.markdown_pairs(spark, d).select("p_partkey", "original", "compressed"))
    return out.select("p_partkey", "is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


@query(f"WITH {_PAIRS}, first AS (SELECT a, {_ERRORS} = '' AS ok FROM pairs), fixed AS (SELECT a, ok, regexp_replace(a, '{_PATTERN}', '\\1', 'g') AS b FROM first), again AS (SELECT ok, {_ERRORS} = '' AS fine FROM fixed) SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN ok THEN 'accepted' WHEN fine THEN 'repaired' ELSE 'restored' END AS outcome FROM again) GROUP BY outcome")
def validate_fix_loop(spark, d):
    from ..operators.repair import repaired

    pairs = A.markdown_pairs(spark, d).select(F.col("p_partkey").alias("id"), "original", "compressed")
    return repaired(pairs).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_EXT = "lower(regexp_extract(split_part(path, '/', -1), '.(\\.[^.]+)$', 1))"
_BY_EXT = f"CASE WHEN {_EXT} IN {_in(classify.PROSE)} THEN 'natural_language' WHEN {_EXT} IN {_in(classify.CONFIG)} THEN 'config' WHEN {_EXT} IN {_in(classify.CODE)} THEN 'code' WHEN {_EXT} <> '' THEN 'unknown' END"


@query(f"WITH {_PAIRS} SELECT p_partkey, {_EXT} AS ext, {_BY_EXT} AS kind FROM pairs")
def classify_ext(spark, d):
    ext = classify.extension(F.col("path"))
    return A.markdown_pairs(spark, d).select("p_partkey", ext.alias("ext"), classify.by_extension(ext).alias("kind"))


@query("SELECT event_id, json_valid(substr(t, 1, 10000)) AS is_json FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat(props, ' x') ELSE CAST(event_id AS VARCHAR) END AS t FROM events)")
def classify_json(spark, d):
    t = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat(props, ' x') ELSE CAST(event_id AS STRING) END")
    return A.table(spark, d, "events").select("event_id", classify.is_json(t).alias("is_json"))


_HEAD = lambda t, n: f"string_split({t}, chr(10))[1:{n}]"
_SHARE = lambda lines, hit: f"CASE WHEN len(list_filter({lines}, lambda x: {A.STRIP('x')} <> '')) > 0 THEN len(list_filter({lines}, lambda x: {hit})) / len(list_filter({lines}, lambda x: {A.STRIP('x')} <> '')) ELSE 0 END"
_YAML = lambda t: f"{_SHARE(_HEAD(t, 30), f'''regexp_matches({A.STRIP('x')}, '{_q(classify.YAML_LINE)}')''')} > 0.6"
_CODE = lambda t: f"{_SHARE(_HEAD(t, 50), f'''regexp_matches(x, '{_q(classify.CODE_LINE)}')''')} > 0.4"
_MIXED = "CASE p_partkey % 4 WHEN 0 THEN concat('key: ', p_name, chr(10), chr(9), chr(10), 'other: 2', chr(10), chr(9), chr(10), '- a: b', chr(10), 'plain') WHEN 1 THEN concat('import os', chr(10), 'def f():', chr(10), '    return ', CAST(p_size AS VARCHAR(20)), chr(10), '}') WHEN 2 THEN concat('{\"a\": ', CAST(p_size AS VARCHAR(20)), '}') ELSE concat('Some prose about ', p_name, '.', chr(10), 'More of it.') END"


@query(f"SELECT p_partkey, {_YAML('t')} AS is_yaml FROM (SELECT p_partkey, {_MIXED} AS t FROM part)")
def classify_yaml(spark, d):
    return A.table(spark, d, "part").select("p_partkey", classify.is_yaml(F.expr(_MIXED)).alias("is_yaml"))


@query(f"SELECT p_partkey, {_CODE('t')} AS is_code FROM (SELECT p_partkey, {_MIXED} AS t FROM part)")
def classify_code(spark, d):
    return A.table(spark, d, "part").select("p_partkey", classify.is_code(F.expr(_MIXED)).alias("is_code"))


_KIND = f"coalesce({_BY_EXT}, CASE WHEN t IS NULL THEN 'unknown' WHEN json_valid(substr(t, 1, 10000)) OR {_YAML('t')} THEN 'config' WHEN {_CODE('t')} THEN 'code' ELSE 'natural_language' END)"
_PLACES = "CASE WHEN p_partkey % 2 = 0 THEN concat('/w/LICENSE', CAST(p_partkey AS VARCHAR(20))) ELSE " + A.PATH + " END"


@query(f"SELECT p_partkey, {_KIND} AS kind FROM (SELECT p_partkey, {_PLACES} AS path, {_MIXED} AS t FROM part)")
def classify_file(spark, d):
    rows = A.table(spark, d, "part").select("p_partkey", F.expr(_PLACES).alias("path"), F.expr(_MIXED).alias("t"))
    return rows.select("p_partkey", classify.kind_of(F.col("path"), F.col("t")).alias("kind"))


_NAME = "split_part(path, '/', -1)"
_SENSITIVE = f"(regexp_matches({_NAME}, '{_q(classify.SENSITIVE_NAME)}') OR list_has_any(string_split(lower(path), '/'), [{', '.join(repr(x) for x in classify.SENSITIVE_PARTS)}]) OR regexp_matches(regexp_replace(lower({_NAME}), '[_\\-\\s.]', '', 'g'), '{'|'.join(classify.SENSITIVE_TOKENS)}'))"


@query(f"WITH {_PAIRS} SELECT p_partkey, path, {_SENSITIVE} AS sensitive FROM pairs")
def sensitive_paths(spark, d):
    return A.markdown_pairs(spark, d).select("p_partkey", "path", classify.is_sensitive(F.col("path")).alias("sensitive"))


_CAND = "CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN concat(' ', chr(9), chr(10)) WHEN 2 THEN NULL ELSE left(text, 100) END"
_DOCPATH = "CASE doc_id % 7 WHEN 0 THEN concat('/w/', CAST(doc_id AS VARCHAR(20)), '.py') WHEN 1 THEN '/w/.ssh/a.md' ELSE concat('/w/', CAST(doc_id AS VARCHAR(20)), '.md') END"
_DOCTEXT = "CASE WHEN doc_id % 11 = 0 THEN concat(chr(10), chr(9)) WHEN doc_id % 97 = 0 THEN repeat('long ', 110000) ELSE text END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN strlen(t) > 500000 THEN 'too large' WHEN {_SENSITIVE} THEN 'sensitive path' WHEN NOT ({_EXT} IN {_in(classify.PROSE)}) THEN 'not natural language' WHEN {A.STRIP('t')} = '' THEN 'empty input' WHEN {A.STRIP("coalesce(c, '')")} = '' THEN 'empty output' WHEN {A.STRIP('c')} = {A.STRIP('t')} THEN 'identical output' END AS reason FROM (SELECT {_DOCPATH} AS path, {_DOCTEXT} AS t, {_CAND} AS c FROM documents)) GROUP BY reason")
def guard_reasons(spark, d):
    rows = A.table(spark, d, "documents").select(F.expr(_DOCPATH).alias("path"), F.expr(_DOCTEXT).alias("t"), F.expr(_CAND).alias("c"))
    return rows.select(classify.refusal(F.col("path"), F.col("t"), F.col("c")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _b(x: str) -> str:
    return f"\\b(?:{x})\\b"


_OFF = f"(regexp_matches(p, '{_b(commands.STOPS)}.*{_b('terse')}') OR regexp_matches(p, '{_b('terse')}.*{_b(commands.STOPS)}') OR regexp_matches(p, '{_b(commands.BACK)}'))"
_ON = f"(regexp_matches(p, '{_b(commands.STARTS)}.*{_b('terse')}') OR regexp_matches(p, '{_b('terse')}.*{_b(commands.STARTED)}'))"
_LEVEL = lambda a, unknown: f"CASE WHEN {a} = '' THEN 'full' WHEN {a} IN ('off', 'stop', 'disable') THEN 'off' WHEN {a} = 'wenyan-full' THEN 'wenyan' WHEN {a} IN ('lite', 'full', 'ultra', 'wenyan-lite', 'wenyan', 'wenyan-ultra') THEN {a} ELSE {unknown} END"
_CMD, _ARG = "regexp_extract(p, '^(\\S*)', 1)", "regexp_extract(p, '^\\S*\\s+(\\S*)', 1)"
_SLASH = lambda ns: f"CASE WHEN p LIKE '/terse%' THEN CASE WHEN {_CMD} = '/terse-commit' THEN 'commit' WHEN {_CMD} = '/terse-review' THEN 'review' WHEN {_CMD} = '/terse-compress' {ns and 'OR ' + _CMD + chr(32) + '= ' + repr('/terse:terse-compress')} THEN 'compress' WHEN {_CMD} = '/terse' {ns and 'OR ' + _CMD + ' = ' + repr('/terse:terse')} THEN {_LEVEL(_ARG, 'NULL')} END END"
_STATS = "regexp_matches(p, '^/terse(?::terse)?-stats(?:\\s+.*)?$')"
_PHRASE = f"CASE WHEN ({_ON} OR regexp_matches(p, '{_b(commands.BRIEF)}')) AND NOT regexp_matches(p, '{_b(commands.STOPS)}') THEN 'full' END"
HOOK_SQL = f"CASE WHEN {_STATS} THEN {_PHRASE} WHEN {_OFF} THEN 'off' ELSE coalesce({_SLASH('x')}, {_PHRASE}) END"
_TEMPLATE = "^activate terse mode:[ \\t]*(\\S*)"
PLUGIN_SQL = f"CASE WHEN p = '' THEN NULL WHEN {_OFF} THEN 'off' WHEN regexp_matches(p, '{_TEMPLATE}') THEN {_LEVEL(f'''regexp_extract(p, '{_TEMPLATE}', 1)''', repr('full'))} WHEN {_ON} THEN 'full' ELSE {_SLASH('')} END"
_MESSAGES = f"messages AS (SELECT user_id::VARCHAR AS session_id, event_id AS seq, CASE WHEN event_id % 41 = 0 THEN 'session.created' WHEN event_id % 37 = 0 THEN 'session.idle' ELSE 'message' END AS event_type, {A.PROMPT} AS prompt FROM events)"


@query(f"WITH {_MESSAGES} SELECT seq, {HOOK_SQL} AS command, {_STATS} AS is_stats, {_STATS} AND p LIKE '%--share%' AS share, CASE WHEN {_STATS} THEN nullif(regexp_extract(p, '--since (\\S+)', 1), '') END AS since FROM (SELECT seq, lower({A.STRIP("coalesce(prompt, '')")}) AS p FROM messages)")
def parse_commands_hook(spark, d):
    stats = commands.stats_command(F.col("prompt"))
    return A.messages(spark, d).select("seq", commands.hook_command(F.col("prompt")).alias("command"), stats["is_stats"].alias("is_stats"), stats["share"].alias("share"), stats["since"].alias("since"))


@query(f"WITH {_MESSAGES} SELECT seq, {PLUGIN_SQL} AS command FROM (SELECT seq, lower(CASE WHEN q LIKE '\"%\"' THEN {A.STRIP('q[2:-2]')} ELSE q END) AS p FROM (SELECT seq, {A.STRIP("coalesce(prompt, '')")} AS q FROM messages))")
def parse_commands_plugin(spark, d):
    return A.messages(spark, d).select("seq", commands.plugin_command(F.col("prompt")).alias("command"))


_STATE = f"WITH {_MESSAGES}, c AS (SELECT session_id, seq, event_type, CASE event_type WHEN 'session.created' THEN 'full' WHEN 'message' THEN {HOOK_SQL} END AS command FROM (SELECT *, lower({A.STRIP("coalesce(prompt, '')")}) AS p FROM messages)), s AS (SELECT *, nullif(last_value(command IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq), 'off') AS m FROM c) SELECT session_id, seq, m AS active_mode, m IS NOT NULL AND m NOT IN ('commit', 'review', 'compress') AND event_type = 'message' AS emits"


@query(f"{_STATE}, CASE WHEN m IS NULL OR m = 'full' THEN '[TERSE]' ELSE concat('[TERSE:', upper(m), ']') END AS badge FROM s")
def mode_state(spark, d):
    from ..functions.formatting import badge

    out = state.modes(A.messages(spark, d))
    return out.select("session_id", "seq", "active_mode", F.coalesce("emits", F.lit(False)).alias("emits"), badge(F.col("active_mode"), "terse").alias("badge"))


@query(f"{_STATE} FROM s")
def mode_state_stream(spark, d):
    import uuid

    from ..sources.shared import shared_dir
    from ..streaming import modes

    base = f"{shared_dir(spark)}/modes-{uuid.uuid4().hex}"
    A.messages(spark, d).write.parquet(f"{base}/in")
    events = spark.readStream.schema("session_id string, seq bigint, event_type string, prompt string").parquet(f"{base}/in")
    return modes.run_available(modes.mode_stream(events), f"{base}/out", f"{base}/state")


#: Lines of a server: no JSON, no list, a list whose descriptions change, one where only nested ones do, several lists.
_NESTED = "'\"inputSchema\":{\"type\":\"object\",\"properties\":{\"x\":{\"description\":\"' || <inner> || '\"}}}'"
_LINE = "CASE p_partkey % 5 WHEN 0 THEN 'not json ' || p_name WHEN 1 THEN '{\"id\":1,\"method\":\"' || p_brand || '\"}' WHEN 2 THEN '{\"jsonrpc\":\"2.0\",\"id\":' || CAST(p_partkey AS VARCHAR(20)) || ',\"result\":{\"tools\":[{\"name\":\"the ' || p_brand || '\",\"description\":\"' || <shown> || '\",' || <second> || '}],\"nextCursor\":\"c\",\"total\":3}}' WHEN 3 THEN '{\"jsonrpc\":\"2.0\",\"id\":null,\"result\":{\"tools\":[{\"name\":\"n\",\"description\":\"Get item\",' || <third> || '}]}}' ELSE '{\"result\":{\"prompts\":[{\"name\":\"a\",\"description\":\"' || <shown> || '\"}],\"resources\":[{\"uri\":\"u\",\"description\":null},{\"description\":\"' || <shown> || '\"}],\"other\":[{\"description\":\"the other\"}]}}' END"
_RAW = "'The ' || p_name || ' is just a part'"
_SHORT = f"regexp_replace({_RAW}, '{_PATTERN}', '\\1', 'g')"


def _line(shown: str, second: str, third: str) -> str:
    """The lines with descriptions as given: at the top, nested below changed ones, nested below unchanged ones."""
    return _LINE.replace("<shown>", shown).replace("<second>", _NESTED.replace("<inner>", second)).replace("<third>", _NESTED.replace("<inner>", third))


_PAYLOAD = _line(_RAW, _RAW, _RAW)


@query(f"SELECT p_partkey, {_line(_SHORT, _RAW, _SHORT)} AS line FROM part")
def payload_rewrite(spark, d):
    return A.table(spark, d, "part").select("p_partkey", jsonx.rewritten(F.expr(_PAYLOAD)).alias("line"))


@query(f"SELECT p_partkey, replace({_line(_SHORT, _SHORT, _SHORT)}, 'the other', 'other') AS line FROM part")
def payload_rewrite_deep(spark, d):
    return A.table(spark, d, "part").select("p_partkey", jsonx.deep_rewriter()(F.expr(_PAYLOAD)).alias("line"))


_COMMENT = _q(jsonx.COMMENT).replace("*+", "*")  # this engine does not backtrack


@query(f"SELECT p_partkey, regexp_replace(regexp_replace({A.JSONC.replace('{{', '{').replace('}}', '}')}, '{_COMMENT}', '\\1', 'g'), ',(\\s*[}}\\]])', '\\1', 'g') AS text, p_name || ' // kept' AS name FROM part")
def jsonc_strip(spark, d):
    text = F.expr(A.JSONC.replace("{{", "{").replace("}}", "}"))
    rows = A.table(spark, d, "part").select("p_partkey", text.alias("raw"))
    return rows.select("p_partkey", jsonx.without_comments(F.col("raw")).alias("text"), F.try_variant_get(jsonx.parsed(F.col("raw")), "$.name", "string").alias("name"))


_HOOKS = "concat('{\"Start\":[{\"matcher\":\"x\",\"own\":1,\"hooks\":[{\"type\":\"command\",\"command\":\"node /h/terse-a.js\",\"async\":true},{\"type\":\"command\",\"command\":\"', CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'echo x' END, '\"}]}],\"Stop\":[{\"hooks\":[{\"type\":\"agent\",\"prompt\":\"', CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END, '\"}]}', CASE WHEN s_suppkey % 5 = 0 THEN ',{\"hooks\":[{\"type\":\"command\",\"command\":\"terse-b\"}]}' ELSE '' END, ']}')"
_TREES = f"trees AS (SELECT s_suppkey, {_HOOKS}::JSON AS j FROM supplier), events AS (SELECT s_suppkey, j, unnest(json_keys(j)) AS event FROM trees), entries AS (SELECT s_suppkey, event, unnest(from_json(json_extract(j, event), '[\"JSON\"]')) AS e FROM events), hooks AS (SELECT s_suppkey, event, unnest(from_json(json_extract(e, 'hooks'), '[\"JSON\"]')) AS h FROM entries), judged AS (SELECT *, coalesce(CASE h->>'type' WHEN 'command' THEN h->>'command' <> '' WHEN 'agent' THEN h->>'prompt' <> '' END, false) AS sound, coalesce(contains(h->>'command', 'terse'), false) AS marked FROM hooks)"


def _hooks(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", F.expr(_HOOKS).alias("text"))


@query(f"WITH {_TREES} SELECT s_suppkey, count(DISTINCT event) FILTER (WHERE sound)::INT AS events, count(*) FILTER (WHERE sound)::INT AS hooks, bool_or(marked) AS marked, count(*) FILTER (WHERE NOT sound) AS dropped FROM judged GROUP BY s_suppkey")
def hook_tree_filter(spark, d):
    trees = _hooks(spark, d).select("s_suppkey", F.from_json("text", jsonx.HOOKS).alias("h"), jsonx.settings_sound()(F.concat(F.lit('{"hooks":'), F.col("text"), F.lit("}"))).alias("s"))
    kept = jsonx.sound_hooks(F.col("h"))
    return trees.select("s_suppkey", F.size(kept).alias("events"), jsonx.hook_count(kept).alias("hooks"), jsonx.has_hook(F.col("h"), "terse").alias("marked"), F.col("s.changed").alias("dropped"))


@query(f"WITH {_TREES} SELECT s_suppkey, count(DISTINCT event) FILTER (WHERE NOT marked)::INT AS events, count(*) FILTER (WHERE NOT marked)::INT AS hooks, count(*) FILTER (WHERE marked) AS removed, (count(*) FILTER (WHERE NOT marked) + 1)::INT AS again, concat('keep', CASE WHEN count(*) FILTER (WHERE NOT marked AND event = 'Start') > 0 THEN ' x 1' ELSE ' - -' END) AS others FROM judged GROUP BY s_suppkey")
def hook_tree_prune(spark, d):
    """Hooks of ours removed, then one added twice; what stands beside the hooks stays."""
    texts = _hooks(spark, d).select("s_suppkey", F.concat(F.lit('{"model":"keep", // a comment\n"hooks":'), F.col("text"), F.lit(",}")).alias("text"))
    left = texts.select("s_suppkey", jsonx.settings_without("terse")(F.col("text")).alias("r"))
    add = jsonx.settings_with("Start", "node terse-b.js", "terse")
    again = left.select("*", add(F.col("r.settings")).alias("one")).select("*", add(F.col("one.settings")).alias("two"))
    tree = lambda c: F.from_json(F.col(f"{c}.settings"), f"model string, hooks {jsonx.HOOKS}")
    out = again.select("s_suppkey", "r", tree("r").alias("a"), tree("two").alias("b"))
    first = F.get(F.try_element_at("a.hooks", F.lit("Start")), 0)["matcher"]
    own = F.get_json_object("r.settings", "$.hooks.Start[0].own")
    others = F.concat_ws(" ", "a.model", F.coalesce(first, F.lit("-")), F.coalesce(own, F.lit("-")))
    return out.select("s_suppkey", F.size("a.hooks").alias("events"), jsonx.hook_count(F.col("a.hooks")).alias("hooks"), F.col("r.changed").alias("removed"), jsonx.hook_count(F.col("b.hooks")).alias("again"), others.alias("others"))


@query("WITH c AS (SELECT s_suppkey, concat('node \"/h/terse-', s_suppkey % 5, '.js\" --flag') AS command FROM supplier), t AS (SELECT s_suppkey, unnest(list_transform(regexp_extract_all(command, '\"[^\"]*\"|\\S+'), lambda x: trim(x, '\"'))) AS script FROM c) SELECT s_suppkey, script FROM t WHERE regexp_matches(script, 'terse-[0-4]\\.js$') AND script NOT IN (SELECT concat('/h/terse-', i, '.js') FROM range(3) r(i))")
def hook_orphans(spark, d):
    rows = A.table(spark, d, "supplier").select("s_suppkey", F.expr("concat('node \"/h/terse-', CAST(s_suppkey % 5 AS STRING), '.js\" --flag')").alias("command"))
    files = spark.range(3).select(F.concat(F.lit("/h/terse-"), F.col("id").cast("string"), F.lit(".js")).alias("path"))
    return lookup.orphans(rows, files, tuple(f"terse-{i}.js" for i in range(5))).select("s_suppkey", "script")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN concat('\"/bin/node\" \"/h/a', n_nationkey % 2, '.js\"') ELSE concat('node /x/b', n_nationkey, '.js') END AS command FROM nation")
def node_commands(spark, d):
    c = F.expr("CASE WHEN n_nationkey % 3 = 0 THEN concat('node /h/a', CAST(n_nationkey % 2 AS STRING), '.js ') ELSE concat('node /x/b', CAST(n_nationkey AS STRING), '.js') END")
    return A.table(spark, d, "nation").select("n_nationkey", lint.absolute_node(c, "/bin/node", ("a0.js", "a1.js")).alias("command"))


@query("SELECT ord, id FROM (SELECT n_nationkey AS ord, n_name AS id, n_nationkey % 5 = 4 AS soft, list_transform(string_split(concat('command:c', n_nationkey % 4, '||dir:~/d', n_nationkey % 6, ' || '), '||'), lambda x: replace(trim(x), 'dir:~/', 'dir:$HOME/')) AS rules FROM nation) WHERE list_has_any(rules, ['command:c0', 'dir:$HOME/d1']) AND NOT soft")
def provider_detect(spark, d):
    spec = "concat('command:c', CAST(n_nationkey % 4 AS STRING), '||dir:~/d', CAST(n_nationkey % 6 AS STRING), ' || ')"
    rows = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("id"), F.expr(spec).alias("detect"), (F.col("n_nationkey") % 5 == 4).alias("soft"))
    facts = spark.createDataFrame([("command", "c0"), ("dir", "$HOME/d1")], "kind string, value string")
    return lookup.detected(rows, facts).select("ord", "id").orderBy("ord")


_CWD = "CASE p_partkey % 3 WHEN 0 THEN '/w/a/b/c/d' WHEN 1 THEN concat('/w/x/', CAST(p_partkey AS VARCHAR(20))) ELSE '/z/y' END"
_MODES = ", ".join(f"'{m}'" for m in commands.MODES)
_VALID = lambda x: f"CASE WHEN strlen({x}) <= 64 AND lower({A.STRIP(x)}) IN ({_MODES}) THEN lower({A.STRIP(x)}) END"


@query(f"WITH files(dir, rank, value) AS (VALUES ('/w/a/b', 2, 'lite'), ('/w/a/b', 1, 'ultra'), ('/w', 2, ' ULTRA ')), p AS (SELECT p_partkey, string_split({_CWD}, '/') AS parts, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 1 THEN 'lite' END AS env FROM part), up AS (SELECT p_partkey, depth, array_to_string(parts[1:len(parts) - depth], '/') AS dir FROM (SELECT *, unnest(range(len(parts))) AS depth FROM p)), hit AS (SELECT p_partkey, arg_min(dir, depth * 10 + rank) AS dir, arg_min(value, depth * 10 + rank) AS value FROM up JOIN files USING (dir) GROUP BY p_partkey) SELECT p_partkey, dir, coalesce({_VALID('env')}, {_VALID('value')}, 'full') AS mode FROM p LEFT JOIN hit USING (p_partkey)")
def nearest_config(spark, d):
    """The nearest folder's file is invalid on purpose for some: then the user's mode counts, not a folder further up."""
    rows = A.table(spark, d, "part").select("p_partkey", F.expr(_CWD).alias("cwd"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'lite' END").alias("env"))
    configs = spark.createDataFrame([("/w/a/b", ".terse.json", "lite"), ("/w/a/b", ".terse/config.json", "ultra"), ("/w", ".terse.json", " ULTRA ")], "dir string, file string, value string")
    found = lookup.nearest(rows, configs)
    first = F.when(F.col("p_partkey") % 3 != 1, F.col("env"))
    return found.select("p_partkey", "dir", lookup.default_mode(first, F.col("value"), F.lit("nonsense")).alias("mode"))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'mismatch' ELSE 'ok' END AS status FROM documents) GROUP BY status")
def manifest_verify(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".md")).alias("name"), F.col("text").alias("content"))
    hashed = F.when(F.col("doc_id") % 10 == 1, F.repeat(F.lit("0"), F.lit(64))).otherwise(F.upper(F.sha2(F.col("content").cast("binary"), 256)))
    good = docs.where("doc_id % 10 <> 0").select(F.concat(hashed, F.lit("  *dir/"), F.col("name")).alias("value"), F.lit(1).alias("line_no"))
    stale = docs.where("doc_id % 10 <> 0").select(F.concat(F.repeat(F.lit("a"), F.lit(64)), F.lit("  "), F.col("name")).alias("value"), F.lit(0).alias("line_no"))
    return lookup.verify(docs, lookup.manifest(good.union(stale))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'only source' ELSE 'differs' END AS status FROM documents WHERE doc_id % 9 = 0 OR doc_id % 11 = 0")
def mirror_check(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "text")
    copy = docs.where("doc_id % 9 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return lookup.mirror_differences(docs, copy, "doc_id", "text")


_TYPES = "^(" + "|".join(lint.TYPES) + ")(\\([^)]+\\))?!?: (.+)$"


@query(f"SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(s, '{_TYPES}') THEN 'type' END, CASE WHEN length(s) > 72 THEN 'over 72' END, CASE WHEN length(s) BETWEEN 51 AND 72 THEN 'over 50' END, CASE WHEN s LIKE '%.' THEN 'period' END, CASE WHEN regexp_matches(regexp_extract(s, '{_TYPES}', 3), '^[A-Za-z]+(ed|ing) ') THEN 'mood' END], lambda x: x IS NOT NULL), ',') AS violations FROM (SELECT o_orderkey, {A.SUBJECT} AS s FROM orders)")
def commit_lint(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", F.array_join(lint.commit_violations(F.expr(A.SUBJECT)), ",").alias("violations"))


@query(f"SELECT severity, count(*) AS n, min(path) AS first_path, max(line) AS last_line FROM (SELECT regexp_extract(l, '{lint.REVIEW}', 4) AS severity, regexp_extract(l, '{lint.REVIEW}', 1) AS path, try_cast(regexp_extract(l, '{lint.REVIEW}', 2) AS INT) AS line FROM (SELECT {A.REVIEW} AS l FROM orders)) WHERE severity <> '' GROUP BY severity")
def review_parse(spark, d):
    rows = A.table(spark, d, "orders").select(lint.review_line(F.expr(A.REVIEW)).alias("r")).select("r.*").where("severity <> ''")
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"), F.max("line").alias("last_line"))


@query(f"SELECT path, symbol, count(*) AS n FROM (SELECT regexp_extract(l, '{lint.LOCATOR}', 1) AS path, regexp_extract(l, '{lint.LOCATOR}', 3) AS symbol FROM (SELECT {A.LOCATOR} AS l FROM orders)) WHERE path <> '' GROUP BY path, symbol")
def locator_parse(spark, d):
    rows = A.table(spark, d, "orders").select(lint.locator_line(F.expr(A.LOCATOR)).alias("r")).select("r.*").where("path <> ''")
    return rows.groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents QUALIFY place <= 5")
def longest_by_language(spark, d):
    rank = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return A.table(spark, d, "documents").select("doc_id", rank.cast("long").alias("place")).where("place <= 5")


@query(f"SELECT path, line, problem, row_number() OVER (PARTITION BY path ORDER BY line, problem, k)::INT AS place FROM (SELECT o_orderkey AS k, regexp_extract(l, '{lint.REVIEW}', 1) AS path, try_cast(regexp_extract(l, '{lint.REVIEW}', 2) AS INT) AS line, regexp_extract(l, '{lint.REVIEW}', 5) AS problem FROM (SELECT o_orderkey, {A.REVIEW} AS l FROM orders)) WHERE path <> ''")
def review_sorted(spark, d):
    """Findings by file and then by line."""
    found = lookup.findings(A.table(spark, d, "orders").select(F.expr(A.REVIEW).alias("value")))
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "problem"))
    return found.select("path", "line", "problem", place.alias("place")).orderBy("path", "line", "place")


@query("SELECT base, dir, place, original_size, compressed_size FROM (SELECT doc_id::VARCHAR AS base, concat('d', doc_id % 7) AS dir, list_position(['d3', 'd1', 'd5'], concat('d', doc_id % 7))::INT AS place, strlen(text) AS original_size, strlen(text) // 2 AS compressed_size FROM documents) WHERE place IS NOT NULL AND original_size > compressed_size")
def folder_pairs(spark, d):
    """Pairs of three folders, one of which is named twice."""
    from ..operators import usage

    docs = A.table(spark, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")).alias("dir"), F.col("doc_id").cast("string").alias("id"), F.octet_length("text").cast("long").alias("n"))
    files = docs.select("dir", F.concat("id", F.lit(".original.md")).alias("name"), F.col("n").alias("size")).union(docs.select("dir", F.concat("id", F.lit(".md")), F.floor(F.col("n") / 2).cast("long")))
    return usage.pairs_of(files, ["d3", "d1", "d3", "d5", "d1"]).select("base", "dir", "place", "original_size", "compressed_size")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1")
def missing_siblings(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id")
    return lookup.missing_siblings(docs, docs.where("doc_id % 4 <> 1"), ["doc_id"])


_ODD_FRONT = "CASE p_partkey % 5 WHEN 0 THEN concat('---', chr(10), 'tools: a', chr(10), '  - b', chr(10), 'name: ', p_name, chr(10), '---  ', chr(10), chr(10), p_brand) WHEN 1 THEN concat('---', chr(13), chr(10), 'a: 1', chr(13), chr(10), '---') WHEN 2 THEN concat('--- ', p_name, ' --- rest') WHEN 3 THEN concat('---', chr(10), 'name: x', chr(10), 'tools:', chr(10), chr(9), '- y', chr(10), '---x', chr(10), 'body') ELSE p_name END"


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(t, '{markdown.LOOSE}') THEN regexp_extract(t, '{markdown.LOOSE}', 1) ELSE '' END AS front, CASE WHEN regexp_matches(t, '{markdown.LOOSE}') THEN regexp_extract(t, '{markdown.LOOSE}', 2) ELSE t END AS body, regexp_replace(t, '{markdown.PLAIN}', '') AS bare, CASE WHEN regexp_matches(t, '{markdown.INNER}') THEN concat('---', chr(10), substr(regexp_replace(concat(chr(10), regexp_extract(t, '{markdown.INNER}', 1)), '\\ntools[ \\t]*:[^\\n]*(?:\\n[ \\t][^\\n]*)*', '', 'g'), 2), regexp_extract(t, '{markdown.INNER}', 2)) ELSE t END AS without_tools FROM (SELECT p_partkey, {_ODD_FRONT} AS t FROM part)")
def front_variants(spark, d):
    """Front matter as other readers see it."""
    t = A.table(spark, d, "part").select("p_partkey", F.expr(_ODD_FRONT).alias("t"))
    x = F.col("t")
    return t.select("p_partkey", markdown.front_matter_loose(x).alias("s"), markdown.body_only(x).alias("bare"), markdown.without_key_inside(x, "tools").alias("without_tools")).select("p_partkey", "s.front", "s.body", "bare", "without_tools")


@query("SELECT n_nationkey, n_nationkey % 3 <> 0 AS shown, n_nationkey % 3 = 1 AS debug, concat(CASE WHEN n_nationkey % 4 = 0 THEN '/x' WHEN n_nationkey % 2 = 1 THEN CASE WHEN n_nationkey % 3 = 0 THEN '/r' ELSE '/h/AppData/Roaming' END ELSE '/h/.config' END, '/terse') AS folder, CASE WHEN n_nationkey % 2 = 0 THEN concat('\"a \\\"', n_name, '\\\\\"') ELSE n_name END AS quoted FROM nation")
def environment(spark, d):
    """Flags, the folder of settings by platform, and arguments quoted."""
    from ..functions import environment as env
    from ..functions.formatting import windows_quoted

    k = F.col("n_nationkey")
    flag = F.when(k % 3 == 0, "0").when(k % 3 == 1, "1")
    folder = env.config_dir("terse", k % 2 == 1, F.lit("/h"), F.when(k % 4 == 0, "/x").otherwise(""), F.when(k % 3 == 0, "/r"))
    raw = F.when(k % 2 == 0, F.concat(F.lit('a "'), F.col("n_name"), F.lit("\\"))).otherwise(F.col("n_name"))
    return A.table(spark, d, "nation").select("n_nationkey", env.switched_on(flag, True).alias("shown"), env.switched_on(flag, False).alias("debug"), folder.alias("folder"), windows_quoted(raw).alias("quoted"))


@query("SELECT item_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS n FROM benchmark")
def token_counts(spark, d):
    """Words, as no tokenizer is named; with a tokenizer's file the same function counts its tokens."""
    return A.table(spark, d, "benchmark").select("item_id", tokens.count(F.col("text")).alias("n"))
