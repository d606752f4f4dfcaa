"""The registered queries, each with the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselens.functions import codepoints, display, lexicon, normalize, predicates, sentences, silver
from proselens.operators import agreement, cache, calibrate, checkers, evaluation, extract, model, ranking, spans, training
from proselens.plans import scan as scanning

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _add(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return put


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")




def _t() -> Column:
    return F.col("text")


# ---------------------------------------------------------------- verdicts

_SIGN = " OR ".join(f"regexp_matches(l, {_q(p)})" for p in predicates.CODE_SIGNS)
_LINES = "list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\v\\f\\r]'))"
_SHARE = f"length(regexp_replace(text, {_q(predicates.PUNCTUATION)}, '', 'g')) / greatest(1, length(text))::DOUBLE"
_LOW = f"(len(regexp_extract_all(text, '[A-Za-z]{{2,}}')) < 3 OR {_SHARE} > 0.04)"
_DIRECTIVE = f"(regexp_matches(ltrim(text, '/*# '), {_q(predicates.DIRECTIVE)}) OR regexp_matches(text, {_q(predicates.DIRECTIVE)}))"
_LICENSE = f"regexp_matches(left(text, 400), {_q(predicates.LICENSE)})"
_CODE = f"(len({_LINES}) > 0 AND len(list_filter({_LINES}, lambda l: NOT ({_SIGN}))) = 0 AND {_LOW})"
_VERDICT = f"CASE WHEN length(text) < 40 OR {_DIRECTIVE} OR {_LICENSE} THEN 'skip' WHEN {_CODE} THEN 'code' ELSE 'prose' END"


@_add(f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM documents GROUP BY 1")
def verdict_counts(spark, d):
    return _docs(spark, d).select(predicates.verdict(_t(), _t()).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@_add(f"SELECT lang, {_VERDICT} AS verdict, count(*) AS n, avg(length(text)) AS mean_chars FROM documents GROUP BY 1, 2")
def verdict_by_lang(spark, d):
    return _docs(spark, d).select("lang", predicates.verdict(_t(), _t()).alias("verdict"), F.length("text").alias("c")).groupBy("lang", "verdict").agg(F.count("*").alias("n"), F.avg("c").alias("mean_chars"))


@_add("SELECT CASE WHEN length(text) < 40 THEN 'skip' ELSE 'prose' END AS verdict, count(*) AS n FROM documents GROUP BY 1")
def markdown_verdicts(spark, d):
    return _docs(spark, d).groupBy(predicates.markdown_verdict(_t()).alias("verdict")).agg(F.count("*").alias("n"))


@_add(f"SELECT doc_id, {_LICENSE} AS in_window, regexp_matches(text, {_q(predicates.LICENSE)}) AS anywhere FROM documents")
def license_window(spark, d):
    return _docs(spark, d).select("doc_id", predicates.is_license(_t()).alias("in_window"), _t().rlike(predicates.LICENSE).alias("anywhere"))


_MARKED = "CASE doc_id % 5 WHEN 0 THEN '/* eslint-disable */ ' WHEN 1 THEN '# noqa: ' WHEN 2 THEN '// prettier-ignore ' WHEN 3 THEN 'type: ignore ' ELSE '' END"


@_add(f"SELECT doc_id, {_DIRECTIVE} AS directive FROM (SELECT doc_id, {_MARKED} || text AS text FROM documents)")
def directive_skip(spark, d):
    marked = _docs(spark, d).select("doc_id", F.concat(F.expr(_MARKED), _t()).alias("text"))
    return marked.select("doc_id", predicates.is_directive(_t(), _t()).alias("directive"))


@_add(f"SELECT doc_id, round({_SHARE}, 6) AS share, {_LOW} AS low FROM documents")
def low_prose_ratio(spark, d):
    return _docs(spark, d).select("doc_id", F.round(predicates.punctuation_share(_t()), 6).alias("share"), predicates.low_prose(_t()).alias("low"))


_CODE_TEXT = "concat('const part', p_partkey, ' = find(', p_size, ');', chr(10), CASE WHEN p_size % 3 = 0 THEN 'and it was kept as the older one' ELSE 'return [part];' END)"


@_add(f"SELECT p_partkey, {_CODE} AS code FROM (SELECT p_partkey, {_CODE_TEXT} AS text FROM part)")
def code_line_share(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.expr(_CODE_TEXT).alias("text")).select("p_partkey", predicates.looks_like_code(_t()).alias("code"))


# ---------------------------------------------------------------- normalisation


@_add("SELECT doc_id, sha256(array_to_string(list_transform(string_split(concat('// ', replace(text, chr(10), concat(chr(13), chr(10), '//  '))).replace(concat(chr(13), chr(10)), chr(10)), chr(10)), lambda l: regexp_replace(l, '^\\s*//+\\s?', '')), chr(10))) AS digest FROM documents")
def norm_line_strip(spark, d):
    raw = F.concat(F.lit("// "), F.replace(_t(), F.lit("\n"), F.lit("\r\n//  ")))
    return _docs(spark, d).select("doc_id", F.sha2(normalize.strip_slashes(raw), 256).alias("digest"))


@_add("""SELECT doc_id, sha256(array_to_string(list_transform(ls, lambda l, i: CASE WHEN i = 1 THEN l ELSE regexp_replace(l, '^\\s*\\*(\\s|$)', '') END), chr(10))) AS digest FROM (
SELECT doc_id, string_split(regexp_replace(regexp_replace(concat('/** ', replace(text, chr(10), concat(chr(10), ' * ')), ' */'), '[ \\t]*\\*/[ \\t]*$', ''), '^/\\*+[ \\t]?', ''), chr(10)) AS ls FROM documents)""")
def norm_block_strip(spark, d):
    raw = F.concat(F.lit("/** "), F.replace(_t(), F.lit("\n"), F.lit("\n * ")), F.lit(" */"))
    return _docs(spark, d).select("doc_id", F.sha2(normalize.strip_block(raw), 256).alias("digest"))


@_add("""SELECT doc_id, length(array_to_string(CASE WHEN tag > 0 THEN ls[1:tag - 1] ELSE ls END, chr(10))) AS n FROM (
SELECT doc_id, ls, coalesce(list_position(list_transform(ls, lambda l: regexp_matches(l, '^\\s*@\\w')), true), 0) AS tag FROM (
SELECT doc_id, string_split(concat(CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), concat(chr(10), '@param ')) ELSE text END, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), ' @return x') ELSE '' END), chr(10)) AS ls FROM documents))""")
def norm_tag_truncate(spark, d):
    tagged = F.concat(F.when(F.col("doc_id") % 3 == 0, F.replace(_t(), F.lit("\n"), F.lit("\n@param "))).otherwise(_t()), F.when(F.col("doc_id") % 2 == 0, F.lit("\n @return x")).otherwise(F.lit("")))
    return _docs(spark, d).select("doc_id", F.length(normalize.truncate_at_tags(tagged)).alias("n"))


_COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@_add(f"SELECT doc_id, length({_COLLAPSED}) AS n, sha256({_COLLAPSED}) AS digest FROM documents")
def ws_collapse(spark, d):
    c = normalize.collapse(_t())
    return _docs(spark, d).select("doc_id", F.length(c).alias("n"), F.sha2(c, 256).alias("digest"))


# ---------------------------------------------------------------- sentences

#: RE2's word boundary knows ASCII alone; a letter in front is excluded by name, and two passes take neighbours.
_SHORT = "'(?i)(^|[^\\p{L}\\p{N}_])([A-Za-z]|etc|vs|mr|mrs|ms|dr|prof|sr|jr|st|vol|fig|no|approx|cf|al)\\.'"


def _protected(text: str) -> str:
    once = f"regexp_replace({text}, {_SHORT}, concat('\\1\\2', chr(1)), 'g')"
    return f"regexp_replace({once}, {_SHORT}, concat('\\1\\2', chr(1)), 'g')"


_PROTECTED = _protected(_COLLAPSED)
_SPLIT = f"list_filter(list_transform(string_split(regexp_replace({_PROTECTED}, '([.!?])[\"'')\\]]?\\s+([A-Z0-9\"''(])', concat('\\1', chr(2), '\\2'), 'g'), chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


@_add(f"SELECT doc_id, unnest(range(0, len(s)))::INTEGER AS i, unnest(s) AS sentence FROM (SELECT doc_id, {_SPLIT} AS s FROM documents)")
def sentence_explode(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(sentences.split_sentences(_t())).alias("i", "sentence"))


@_add(f"SELECT lang, sum(len(s))::BIGINT AS n, max(list_max(list_transform(s, lambda x: length(x)))) AS longest FROM (SELECT lang, {_SPLIT} AS s FROM documents) GROUP BY lang")
def sentence_stats(spark, d):
    s = _docs(spark, d).select("lang", sentences.split_sentences(_t()).alias("s"))
    return s.groupBy("lang").agg(F.sum(F.size("s")).alias("n"), F.max(F.array_max(F.transform("s", lambda x: F.length(x)))).alias("longest"))


_ABBREVIATED = "concat('Mr. A. Smith vs. Dr. b. etc. e.g. this. ', text)"


@_add(f"SELECT doc_id, replace({_protected(_ABBREVIATED)}, chr(1), '|') AS view FROM documents")
def abbrev_protect(spark, d):
    return _docs(spark, d).select("doc_id", F.replace(sentences.protect(F.expr(_ABBREVIATED)), F.lit(sentences.PLACEHOLDER), F.lit("|")).alias("view"))


@_add("SELECT doc_id, len(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), '\\n\\s*\\n', chr(1), 'g'), chr(1)))::INTEGER AS n FROM documents")
def checker_sentence_split(spark, d):
    return _docs(spark, d).select("doc_id", F.size(sentences.split_for_checkers(_t())).alias("n"))


# ---------------------------------------------------------------- code points

_DASHED = "concat(replace(text, ', ', ' — '), CASE WHEN doc_id % 3 = 0 THEN ' ☃ 😀 “' ELSE '' END)"
_POINTS = "list_distinct(list_filter(list_transform(string_split(text, ''), lambda c: unicode(c)), lambda x: x > 255))"


@_add(f"SELECT doc_id, array_to_string(list_sort({_POINTS}), ',') AS points FROM (SELECT doc_id, {_DASHED} AS text FROM documents)")
def codepoints_distinct(spark, d):
    rows = _docs(spark, d).select("doc_id", F.expr(_DASHED).alias("text"))
    return rows.select("doc_id", F.array_join(F.array_sort(codepoints.disallowed(_t())).cast("array<string>"), ",").alias("points"))


@_add(f"SELECT doc_id, len(list_filter({_POINTS}, lambda x: NOT (x BETWEEN 8208 AND 8213) AND NOT (x BETWEEN 128512 AND 128591)))::INTEGER AS n FROM (SELECT doc_id, {_DASHED} AS text FROM documents)")
def codepoints_whitelist(spark, d):
    rows = _docs(spark, d).select("doc_id", F.expr(_DASHED).alias("text"))
    allowed = [codepoints.parse_entry("U+2010-U+2015"), codepoints.parse_entry("U+1F600-U+1F64F")]
    return rows.select("doc_id", F.size(codepoints.disallowed(_t(), allowed)).alias("n"))


@_add(f"SELECT format('U+{{:04X}}', p) AS point, count(*) AS n FROM (SELECT unnest({_POINTS}) AS p FROM (SELECT doc_id, {_DASHED} AS text FROM documents)) GROUP BY 1")
def codepoint_hex(spark, d):
    rows = _docs(spark, d).select(F.expr(_DASHED).alias("text")).select(F.explode(codepoints.disallowed(_t())).alias("p"))
    return rows.groupBy(codepoints.hexadecimal(F.col("p")).alias("point")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- checkers (K1-K5)

_PREMISE = "concat('The ', p_name, ' is ', lower(p_type), ', and it is ', CASE WHEN p_size % 4 = 0 THEN 'clear that it holds' ELSE 'kept in a box' END, ', so the part stays.')"
_CHAIN = r",\s+and\s+([^,:;.]{8,120}),\s+so\b"


@_add(f"SELECT p_partkey, len(m)::INTEGER AS n, m[1] AS middle FROM (SELECT p_partkey, regexp_extract_all({_PREMISE}, {_q(_CHAIN)}, 1) AS m FROM part)")
def p14_candidates(spark, d):
    m = F.regexp_extract_all(F.expr(_PREMISE), F.lit(_CHAIN), F.lit(1))
    return _table(spark, d, "part").select("p_partkey", F.size(m).alias("n"), F.get(m, F.lit(0)).alias("middle"))


@_add(f"SELECT p_partkey, regexp_matches(regexp_extract({_PREMISE}, {_q(_CHAIN)}, 1), {_q('(?i)' + lexicon.EXPLETIVE.pattern)}) AS expletive FROM part")
def p14_expletive(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.regexp_extract(F.expr(_PREMISE), _CHAIN, 1).rlike("(?i)" + lexicon.EXPLETIVE.pattern).alias("expletive"))


@_add(f"SELECT doc_id, length(c[len(c)]) AS n, len(c)::INTEGER AS clauses FROM (SELECT doc_id, string_split(regexp_replace(text, {_q(lexicon.CLAUSE_CUT.pattern)}, chr(1), 'g'), chr(1)) AS c FROM documents)")
def p14_clause_cut(spark, d):
    parts = F.split(_t(), lexicon.CLAUSE_CUT.pattern, -1)
    return _docs(spark, d).select("doc_id", F.length(F.element_at(parts, -1)).alias("n"), F.size(parts).alias("clauses"))


_FENCE = lexicon.COMMA_FENCE.pattern.replace("?P<subject>", "").replace("?P<fenced>", "").replace("?P<after>", "")


@_add(f"SELECT doc_id, len(regexp_extract_all(text, {_q(_FENCE)}))::INTEGER AS n FROM documents")
def p13_candidates(spark, d):
    return _docs(spark, d).select("doc_id", F.regexp_count(_t(), F.lit(_FENCE)).alias("n"))


@_add(f"SELECT doc_id, f, len(regexp_extract_all(f, '[A-Za-z][A-Za-z''_.-]*'))::INTEGER AS words FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_q(_FENCE)}, 2)) AS f FROM documents) WHERE words >= 4")
def p13_min_words(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all(_t(), F.lit(_FENCE), F.lit(2))).alias("f"))
    return rows.withColumn("words", F.regexp_count("f", F.lit(lexicon.WORD.pattern))).filter(f"words >= {lexicon.LEAST_FENCED_WORDS}")


def _spans(df: DataFrame, rule: str, key: str) -> DataFrame:
    fired = df.filter(checkers.prefilter(_t(), (rule,))).select(key, F.explode(checkers.spans_of(rule)(_t())).alias("s"))
    return fired.select(key, "s.*")


@_add()
def p14_spans(spark, d):
    return _spans(_table(spark, d, "part").select("p_partkey", F.expr(_PREMISE).alias("text")), "P14", "p_partkey")


@_add()
def p13_spans(spark, d):
    return _spans(_docs(spark, d).select("doc_id", _t()), "P13", "doc_id")


@_add()
def p15_spans(spark, d):
    return _spans(_docs(spark, d).select("doc_id", F.replace(_t(), F.lit(", "), F.lit(" — ")).alias("text")), "P15", "doc_id")


@_add()
def first_checker(spark, d):
    rows = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace(_t(), F.lit(", "), F.lit(" — "))).otherwise(_t()).alias("text"))
    return checkers.check(rows).select("doc_id", "rule", "score", "source", F.size("spans").alias("n_spans"), "clauses")


@_add()
def structure_tokens(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(checkers.structure_column()(_t())).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


#: Comments with a known finding: rule (none: nothing fires), text, and the clause that is found.
_PLANTED = (
    ("P14", "The socket is a shared handle, and it stays open for the run, so callers reuse it.", ", and it stays open for the run, so", "it"),
    (None, "The loader opens the file, and it stays open for the run, so callers reuse it.", "", ""),
    ("P13", "The parser, or whatever module replaces it later, returns a tree.", ", or whatever module replaces it later,", ""),
    (None, "The parser, or a lexer, returns a tree of all the nodes.", "", ""),
    ("P15", "The queue — a bounded list of jobs — drains first.", "— a bounded list of jobs —", ""),
    (None, "Rows 3 – 5 and 7 – 9 are kept as they have been all along.", "", ""),
    ("C2", "total = add(a, b); rest = total - 2 * a; emit(rest, total);", "", ""),
    ("C13", "The first list points to the second one → and back to it.", "U+2192", ""),
    ("P13", "A file that is not an image, including one with no name, gets skipped.", ", including one with no name,", ""),
    ("P14", "The workers are forked early, and they never run alone, so no deadlock can form.", ", and they never run alone, so", "they"),
    (None, "Plain prose says one thing at a time and stops there.", "", ""),
)
_LEAD = "CASE WHEN o_orderkey % 11 = 6 THEN concat('count = ', o_orderkey, '; ') ELSE concat('Order ', o_orderkey, ' is kept by clerk ', o_custkey, '. ') END"
_PLANTED_TEXT = "concat(" + _LEAD + ", CASE o_orderkey % 11 " + " ".join(f"WHEN {i} THEN {_q(x[1])}" for i, x in enumerate(_PLANTED)) + " END)"
_PLANTED_SQL = (
    "planted AS (SELECT *, strpos(text, clause) - 1 AS a FROM (SELECT o_orderkey, o_orderpriority AS path, "
    + _PLANTED_TEXT
    + " AS text, "
    + ", ".join(f"CASE o_orderkey % 11 {' '.join(f'WHEN {i} THEN {_q(x[k]) if x[k] is not None else chr(78) + chr(85) + chr(76) + chr(76)}' for i, x in enumerate(_PLANTED))} END AS {name}" for k, name in ((0, "rule"), (2, "clause"), (3, "pronoun")))
    + " FROM orders))"
)


def _planted(spark, d) -> DataFrame:
    return _table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("path"), F.expr(_PLANTED_TEXT).alias("text"))


def _planted_spans(rule: str) -> None:
    def query(spark, d):
        return _spans(_planted(spark, d), rule, "o_orderkey")

    query.__name__ = f"{rule.lower()}_planted"
    _add(f'WITH {_PLANTED_SQL} SELECT o_orderkey, clause, pronoun, a::INTEGER AS start, (a + length(clause))::INTEGER AS "end" FROM planted WHERE rule = {_q(rule)}')(query)


for _rule in ("P13", "P14", "P15"):
    _planted_spans(_rule)


@_add(f"WITH {_PLANTED_SQL} SELECT o_orderkey, rule, 1.0::DOUBLE AS score, 'heuristic' AS source, 1 AS n_spans, [clause] AS clauses FROM planted WHERE rule LIKE 'P%'")
def first_checker_planted(spark, d):
    return checkers.check(_planted(spark, d)).select("o_orderkey", "rule", "score", "source", F.size("spans").alias("n_spans"), "clauses")


@_add(f"WITH {_PLANTED_SQL} SELECT o_orderkey, path, CASE WHEN dash IS NULL THEN rule ELSE 'C13' END AS rule, CASE WHEN dash IS NOT NULL THEN [dash] WHEN rule = 'C2' THEN [] ELSE [clause] END AS clauses FROM (SELECT *, CASE WHEN contains(text, '—') THEN 'U+2014' WHEN contains(text, '–') THEN 'U+2013' END AS dash FROM planted) WHERE rule IS NOT NULL OR dash IS NOT NULL")
def scan_planted(spark, d):
    # the dashes of a fence are code points that the scan does not allow, and these claim a comment first
    return scanning.claimed(_planted(spark, d).withColumn("verdict", predicates.verdict(_t(), _t()))).select("o_orderkey", "path", "rule", "clauses")


# ---------------------------------------------------------------- extraction (E*)


@_add("""WITH s AS (SELECT o_custkey % 50 AS path, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS n FROM orders),
c AS (SELECT path, n + n // 5 AS line, 1 + (n // 10) % 2 AS col, CASE WHEN o_orderkey % 7 = 0 THEN 'trailing' ELSE 'line' END AS kind, concat('// ', o_orderpriority) AS raw FROM s),
f AS (SELECT *, CASE WHEN kind = 'line' AND lag(kind) OVER w = 'line' AND lag(col) OVER w = col AND lag(line) OVER w + 1 = line THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY path ORDER BY line, col)),
r AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY line, col ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT path, min(line) AS line, min(col) AS col, min(kind) AS kind, string_agg(raw, chr(10) ORDER BY line) AS raw, max(line) AS end_line FROM r GROUP BY path, run""")
def run_merge(spark, d):
    n = F.row_number().over(Window.partitionBy("path").orderBy("o_orderkey"))
    rows = _table(spark, d, "orders").withColumn("path", F.col("o_custkey") % 50).withColumn("n", n)
    lines = rows.select("path", F.expr("n + n div 5").alias("line"), F.expr("1 + (n div 10) % 2").alias("col"), F.when(F.col("o_orderkey") % 7 == 0, "trailing").otherwise("line").alias("kind"), F.concat(F.lit("// "), "o_orderpriority").alias("raw"))
    merged = extract.merge_runs(lines.withColumns({"end_line": F.col("line"), "end_col": F.col("col")}), ["path"])
    return merged.select("path", "line", "col", "kind", "raw", "end_line")


@_add()
def extract_cstyle(spark, d):
    source = F.concat(F.lit("const a = 1; // "), F.expr("substring_index(text, '\n', 1)"), F.lit("\n/** "), F.replace(_t(), F.lit("\n"), F.lit("\n * ")), F.lit(" */\n// one\n// two\nlet r = /[/]x/g, q = a / 2;\nlet t = `${f({b: `// no`}) /* yes */} // no`;\n"))
    files = _docs(spark, d).select(F.concat(F.lit("f"), "doc_id", F.lit(".ts")).alias("path"), source.alias("text"))
    return extract.extract(files)[0].select("path", "line", "col", "kind", "end_line", F.length("text").alias("n"))


@_add()
def extract_markdown(spark, d):
    source = F.concat(F.lit("---\nlang: x\n---\n# Title\n\n"), F.replace(_t(), F.lit("\n"), F.lit("\n\n")), F.lit("\n\n```\ncode\n```\n"))
    files = _docs(spark, d).select(F.concat(F.lit("f"), "doc_id", F.lit(".md")).alias("path"), source.alias("text"))
    return extract.extract(files)[0].select("path", "line", "kind", "end_line", F.length("text").alias("n"))


#: A source with comments at known places, {} is a number.
_SOURCE = {
    "ts": "const a = 1; // trailing {}\n// one {}\n// two\nlet r = /[/]x/g, t = `// no ${f(1 /* in {} */)}`;\n/* block\n   {} */\nlet s = '// no';\n",
    "py": "import os  # first {}\n# one {}\n# two\ns = '# no'\n\ndef f():\n    return s  # last {}\n",
    "md": "---\nkey: {}\n---\n# Title {}\n\nA paragraph with the number {}\nand a second line.\n\n```\ncode {}\n```\n\n- item {}\n",
}
#: What it holds: line, column, last line, kind, text.
_HELD = {
    "ts": ((1, 14, 1, "trailing", "trailing {}"), (2, 1, 3, "line", "one {}\ntwo"), (4, 35, 4, "block", "in {}"), (5, 1, 6, "block", "block\n{}")),
    "py": ((1, 12, 1, "trailing", "first {}"), (2, 1, 3, "line", "one {}\ntwo"), (7, 15, 7, "trailing", "last {}")),
    "md": ((4, 1, 4, "prose", "Title {}"), (6, 1, 7, "prose", "A paragraph with the number {} and a second line."), (13, 1, 13, "prose", "item {}")),
}


def _planted_sources(kind: str) -> None:
    def query(spark, d):
        orders = _table(spark, d, "orders").select(F.concat(F.lit("f"), "o_orderkey", F.lit(f".{kind}")).alias("path"), F.replace(F.lit(_SOURCE[kind]), F.lit("{}"), F.col("o_orderkey").cast("string")).alias("text"))
        return extract.extract(orders)[0].select("path", "line", "col", "end_line", "kind", "text")

    query.__name__ = f"extract_planted_{kind}"
    rows = ", ".join(f"({a}, {b}, {c}, {_q(k)}, {_q(x)})" for a, b, c, k, x in _HELD[kind])
    _add(f"SELECT concat('f', o_orderkey, '.{kind}') AS path, line, col, end_line, kind, replace(body, '{{}}', o_orderkey::VARCHAR) AS text FROM orders, (VALUES {rows}) v(line, col, end_line, kind, body)")(query)


for _kind in _SOURCE:
    _planted_sources(_kind)


_LINE_ROWS = "SELECT doc_id, unnest(range(0, len(ls)))::INTEGER AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
_TOGGLED = f"""l AS ({_LINE_ROWS}), m AS (SELECT doc_id, pos, pos % 7 = 3 AS off, pos % 11 = 5 AS ok FROM l),
a AS (SELECT *, last_value(CASE WHEN ok THEN false WHEN off THEN true END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS after FROM m),
t AS (SELECT doc_id, pos, off OR coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY pos), false) AS disabled FROM a)"""


def _line_rows(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split(_t(), "\n")).alias("pos", "line"))


def _toggled(spark, d) -> DataFrame:
    marks = _line_rows(spark, d).select("doc_id", "pos", (F.col("pos") % 7 == 3).alias("off"), (F.col("pos") % 11 == 5).alias("on"))
    return spans.disabled_lines(marks, "doc_id")


@_add(f"WITH {_TOGGLED} SELECT doc_id, sum(CASE WHEN disabled THEN 1 ELSE 0 END)::BIGINT AS n FROM t GROUP BY doc_id")
def toggle_ranges(spark, d):
    return _toggled(spark, d).groupBy("doc_id").agg(F.count_if("disabled").alias("n"))


@_add(f"WITH {_TOGGLED}, b AS (SELECT doc_id, (pos // 2) * 2 AS start, max(pos) + 1 AS stop FROM t GROUP BY doc_id, pos // 2) SELECT doc_id, start::INTEGER AS start, stop::INTEGER AS stop FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND disabled AND pos >= start AND pos < stop)")
def block_range_anti(spark, d):
    lines = _toggled(spark, d)
    blocks = lines.groupBy("doc_id", F.expr("pos div 2").alias("b")).agg(F.max("pos").alias("p")).select("doc_id", (F.col("b") * 2).cast("int").alias("start"), (F.col("p") + 1).alias("end"))
    return spans.live_blocks(blocks, lines, "doc_id").select("doc_id", "start", F.col("end").alias("stop"))


@_add("""WITH l AS (SELECT doc_id, unnest(range(0, len(ls)))::INTEGER AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(concat(CASE WHEN doc_id % 2 = 0 THEN concat('---', chr(10), 'lang: ', lang, chr(10), '...', chr(10)) ELSE '' END, text), chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, bool_or(pos = 0 AND line = '---') AS opened, min(CASE WHEN pos > 0 AND line IN ('---', '...') THEN pos END) AS close FROM l GROUP BY doc_id)
SELECT doc_id, sum(CASE WHEN opened AND pos <= close THEN 0 ELSE length(line) END)::BIGINT AS chars FROM l JOIN c USING (doc_id) GROUP BY doc_id""")
def front_matter_blank(spark, d):
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\nlang: "), "lang", F.lit("\n...\n"))).otherwise(F.lit("")), _t())
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    doc = Window.partitionBy("doc_id")
    close = F.min(F.when((F.col("pos") > 0) & F.col("line").isin("---", "..."), F.col("pos"))).over(doc)
    opened = F.max((F.col("pos") == 0) & (F.col("line") == "---")).over(doc)
    blank = lines.withColumn("blank", F.coalesce(opened & (F.col("pos") <= close), F.lit(False)))
    return blank.groupBy("doc_id").agg(F.sum(F.when(F.col("blank"), 0).otherwise(F.length("line"))).alias("chars"))


@_add("SELECT page_id, unnest(regexp_extract_all(html, '<!--\\s*(.*?)\\s*-->', 1)) AS comment FROM pages")
def html_comment_extract(spark, d):
    return _table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"<!--\s*(.*?)\s*-->"), F.lit(1))).alias("comment"))


# ---------------------------------------------------------------- spans and sentences

_SENTENCE_ROWS = "s AS (SELECT doc_id, i, i * 100 AS s, i * 100 + 90 AS e FROM (SELECT doc_id, unnest(range(0, n_chars // 100 + 1)) AS i FROM documents))"
_SPAN_ROWS = "p AS (SELECT doc_id, CASE (doc_id + k) % 3 WHEN 0 THEN 'P13' WHEN 1 THEN 'P14' ELSE 'P15' END AS rule, (doc_id * 37 + k * 53) % n_chars AS start, (doc_id * 37 + k * 53) % n_chars + doc_id % 150 + 20 AS stop FROM (SELECT doc_id, n_chars, unnest(range(0, 4)) AS k FROM documents))"
_PLACED = "o AS (SELECT doc_id, rule, start, stop, min(i) AS lo, max(i) AS hi FROM (SELECT DISTINCT * FROM p) JOIN s USING (doc_id) WHERE s < stop AND start < e GROUP BY ALL)"
_UNITS = """n AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM o),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS unit, CASE rule WHEN 'P14' THEN 1 WHEN 'P13' THEN 2 ELSE 3 END AS rank FROM n),
g AS (SELECT doc_id, unit, min(lo) AS first_sentence, max(hi) AS last_sentence, min(rank) AS best, list(rank) AS ranks FROM u GROUP BY doc_id, unit)"""


def _sentence_rows(spark, d) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.explode(F.expr("sequence(0L, n_chars div 100)")).alias("i")).select("doc_id", "i", (F.col("i") * 100).alias("s"), (F.col("i") * 100 + 90).alias("e"))


def _span_rows(spark, d) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    start = F.expr("(doc_id * 37 + k * 53) % nullif(n_chars, 0)")  # null for an empty text, as in SQL: it has no spans
    return rows.select("doc_id", F.expr("CASE (doc_id + k) % 3 WHEN 0 THEN 'P13' WHEN 1 THEN 'P14' ELSE 'P15' END").alias("rule"), start.alias("start"), (start + F.col("doc_id") % 150 + 20).alias("end")).distinct()


def _units(spark, d) -> DataFrame:
    return spans.name_units(spans.overlaps(_sentence_rows(spark, d), _span_rows(spark, d), "doc_id"), "doc_id")


@_add(f"WITH {_SENTENCE_ROWS}, {_SPAN_ROWS}, {_PLACED} SELECT doc_id, rule, start, stop, lo, hi FROM o")
def span_sentence_overlap(spark, d):
    return spans.overlaps(_sentence_rows(spark, d), _span_rows(spark, d), "doc_id").withColumnRenamed("end", "stop")


@_add(f"WITH {_SENTENCE_ROWS}, {_SPAN_ROWS}, {_PLACED}, {_UNITS} SELECT doc_id, count(*) AS units, sum(last_sentence - first_sentence + 1)::BIGINT AS sentences FROM g GROUP BY doc_id")
def interval_merge(spark, d):
    return _units(spark, d).groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.col("last_sentence") - F.col("first_sentence") + 1).alias("sentences"))


@_add(f"WITH {_SENTENCE_ROWS}, {_SPAN_ROWS}, {_PLACED}, {_UNITS} SELECT doc_id, unit::BIGINT AS unit, first_sentence, last_sentence, CASE best WHEN 1 THEN 'P14' WHEN 2 THEN 'P13' ELSE 'P15' END AS rule, len(list_filter(ranks, lambda r: r = best))::BIGINT AS n_spans FROM g")
def unit_naming(spark, d):
    return _units(spark, d)


@_add(f"WITH {_SENTENCE_ROWS}, {_SPAN_ROWS}, {_PLACED}, {_UNITS} SELECT doc_id, count(*) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = s.doc_id AND i BETWEEN first_sentence AND last_sentence) GROUP BY doc_id")
def unclaimed_sentences(spark, d):
    return spans.unclaimed(_sentence_rows(spark, d), _units(spark, d), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- cache

_FILE = "concat('d/', doc_id, '.ts') AS path"
_STAMP = "concat(strlen(text), ':', sha256(text))"
_CACHED = f"c AS (SELECT {_FILE}, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE {_STAMP} END AS stamp, doc_id % 4 AS n_comments FROM documents WHERE doc_id % 3 <> 0)"


def _cache_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    files = cache.stamped(_docs(spark, d).select(F.concat(F.lit("d/"), "doc_id", F.lit(".ts")).alias("path"), "doc_id", _t().cast("binary").alias("content")), "v1").drop("content")
    stored = files.filter("doc_id % 3 <> 0").select("path", "run_key", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("stamp")).alias("stamp"), (F.col("doc_id") % 4).alias("n_comments"))
    return files, stored


@_add(f"WITH f AS (SELECT {_FILE}, {_STAMP} AS stamp FROM documents), {_CACHED} SELECT path, n_comments FROM f JOIN c USING (path, stamp)")
def cache_hits(spark, d):
    return cache.hits(*_cache_sides(spark, d)).select("path", "n_comments")


@_add(f"WITH f AS (SELECT {_FILE}, {_STAMP} AS stamp FROM documents), {_CACHED} SELECT path FROM f ANTI JOIN c USING (path, stamp)")
def cache_misses(spark, d):
    return cache.misses(*_cache_sides(spark, d)).select("path")


@_add(f"WITH {_CACHED} SELECT path, n_comments FROM c SEMI JOIN (SELECT {_FILE} FROM documents WHERE doc_id % 2 = 0) USING (path)")
def cache_prune(spark, d):
    files, stored = _cache_sides(spark, d)
    return cache.pruned(stored, files.filter("doc_id % 2 = 0")).select("path", "n_comments")


# ---------------------------------------------------------------- paths

_PATH = "concat(regexp_replace(url, '[?#].*$', ''), CASE page_id % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.PY' WHEN 2 THEN '.md' WHEN 3 THEN '.mjs' WHEN 4 THEN '.rs' ELSE '' END)"


@_add(f"""SELECT CASE WHEN e IN ('.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs') THEN 'c-style' WHEN e IN ('.py', '.pyi') THEN 'python-style' WHEN e IN ('.md', '.markdown') THEN 'markdown' WHEN e = '.rs' THEN 'c-style' END AS family, count(*) AS n
FROM (SELECT lower(regexp_extract({_PATH}, '(\\.[^./\\\\]+)$', 1)) AS e FROM pages) GROUP BY 1""")
def ext_family(spark, d):
    return _table(spark, d, "pages").select(extract.family_of(F.expr(_PATH), {".rs": "c-style"}).alias("family")).groupBy("family").agg(F.count("*").alias("n"))


@_add("SELECT norm_path, root_no, path FROM (SELECT *, row_number() OVER (PARTITION BY norm_path ORDER BY root_no, path) AS n FROM (SELECT concat(page_id, ':', url) AS path, page_id % 3 AS root_no, lower(regexp_replace(url, '[?#].*$', '')) AS norm_path FROM pages)) WHERE n = 1")
def path_dedup(spark, d):
    rows = _table(spark, d, "pages").select(F.concat_ws(":", "page_id", "url").alias("path"), (F.col("page_id") % 3).alias("root_no"), F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("norm_path"))
    return ranking.first_per_path(rows).select("norm_path", "root_no", "path")


#: Patterns of an ignore file: the last that matches decides.
_IGNORES = [(1, "/en/", True), (2, "/en/7", False), (3, "example\\.org", True), (4, "blog", False)]
_IGNORE_ROWS = ", ".join(f"({n}, {_q(p)}, {str(x).lower()})" for n, p, x in _IGNORES)


@_add(f"SELECT page_id, coalesce(max_by(ignored, seq), false) AS ignored FROM pages LEFT JOIN (VALUES {_IGNORE_ROWS}) t(seq, pattern, ignored) ON regexp_matches(url, pattern) GROUP BY page_id")
def ignore_last_match(spark, d):
    rules = F.broadcast(spark.createDataFrame(_IGNORES, "seq int, pattern string, ignored boolean"))
    joined = _table(spark, d, "pages").join(rules, F.expr("url rlike pattern"), "left")
    return joined.groupBy("page_id").agg(F.coalesce(F.max_by("ignored", "seq"), F.lit(False)).alias("ignored"))


# ---------------------------------------------------------------- rules, ranking, summaries (J3, T*, A1-A8)

_RULES = ["C2", "C12", "C13", "P1", "P3", "P10", "P13", "P14"]
_RULE_OF = "CASE WHEN doc_id % 9 = 0 THEN 'C2' WHEN doc_id % 7 = 0 THEN 'P14' WHEN doc_id % 5 = 0 THEN 'P10' ELSE 'P3' END"
_FOUND = f"f AS (SELECT doc_id, source AS path, n_chars % 97 AS line, doc_id % 13 AS col, {_RULE_OF} AS rule, CASE WHEN doc_id % 9 = 0 OR doc_id % 7 = 0 THEN 'heuristic' ELSE 'model' END AS origin, round((n_chars * 37 % 1000) / 1000.0, 4)::DOUBLE AS score, doc_id AS seq FROM documents)"


def _findings(spark, d) -> DataFrame:
    return _docs(spark, d).select(
        "doc_id", F.col("source").alias("path"), (F.col("n_chars") % 97).alias("line"), (F.col("doc_id") % 13).alias("col"), F.expr(_RULE_OF).alias("rule"),
        F.when((F.col("doc_id") % 9 == 0) | (F.col("doc_id") % 7 == 0), "heuristic").otherwise("model").alias("source"), display.rounded(F.expr("(n_chars * 37 % 1000) / 1000D")).alias("score"), F.col("doc_id").alias("seq"),
    )


@_add(f"WITH {_FOUND} SELECT f.rule, coalesce(t.name, '') AS name, count(*) AS n FROM f LEFT JOIN (VALUES ('C2', 'no-commented-out-code'), ('P3', 'no-metaphorical-equations'), ('P14', 'bracket-supporting-premise')) t(rule, name) USING (rule) GROUP BY ALL")
def rule_dim_join(spark, d):
    rules = F.broadcast(spark.createDataFrame([("C2", "no-commented-out-code"), ("P3", "no-metaphorical-equations"), ("P14", "bracket-supporting-premise")], "rule string, name string"))
    return _findings(spark, d).join(rules, "rule", "left").groupBy("rule", F.coalesce("name", F.lit("")).alias("name")).agg(F.count("*").alias("n"))


@_add(f"WITH {_FOUND} SELECT rule, row_number() OVER (ORDER BY rule[1], rule[2:]::INTEGER)::INTEGER AS place FROM (SELECT DISTINCT rule FROM f)")
def taxonomy_order(spark, d):
    letter, number = display.taxonomy_order(F.col("rule"))
    return _findings(spark, d).select("rule").distinct().select("rule", F.row_number().over(Window.orderBy(letter, number)).alias("place"))


_BAND = "CASE WHEN rule = 'C2' THEN 2 WHEN origin = 'heuristic' THEN 1 ELSE 0 END"
_TOP = f"SELECT doc_id, rule, {_BAND} AS band, row_number() OVER (ORDER BY {_BAND}, CASE WHEN {_BAND} = 0 THEN -score END, path, line, seq)::INTEGER AS place FROM f"


@_add(f"WITH {_FOUND} SELECT * FROM ({_TOP}) WHERE place <= 50")
def rank_three_band(spark, d):
    top = ranking.limited(ranking.report_order(_findings(spark, d), show_code=True), 50)
    order = Window.orderBy("band", F.when(F.col("band") == 0, -F.col("score")), "path", "line", "seq")  # over 50 rows
    return top.withColumn("place", F.row_number().over(order)).select("doc_id", "rule", "band", "place")


_PROBS = "[(n_chars * 37 % 1000) / 1000.0, (n_chars * 91 % 1000) / 1000.0, (doc_id * 17 % 1000) / 1000.0, 0.5]"
_LABELS = ["C7", "P3", "P6", "P10"]


def _probs() -> Column:
    return F.array(F.expr("(n_chars * 37 % 1000) / 1000D"), F.expr("(n_chars * 91 % 1000) / 1000D"), F.expr("(doc_id * 17 % 1000) / 1000D"), F.lit(0.5))


@_add(f"SELECT doc_id, string_agg(rule, ',' ORDER BY p DESC, i) AS ranked FROM (SELECT doc_id, i, rule, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, i) AS n FROM (SELECT doc_id, unnest([1, 2, 3, 4]) AS i, unnest(['C7', 'P3', 'P6', 'P10']) AS rule, unnest({_PROBS}) AS p FROM documents) WHERE rule <> 'P10') WHERE n <= 2 GROUP BY doc_id")
def topk_rules(spark, d):
    best = ranking.top_rules(_LABELS, F.col("probs"), 2, ("P10",))
    return _docs(spark, d).withColumn("probs", _probs()).select("doc_id", F.array_join(F.transform(best, lambda r: r["rule"]), ",").alias("ranked"))


@_add(f"WITH {_FOUND} SELECT count(*) AS shown, (SELECT count(*) FROM f WHERE rule <> 'C2') - count(*) AS hidden FROM (SELECT * FROM f WHERE rule <> 'C2' LIMIT 25)")
def limit_hidden(spark, d):
    found = _findings(spark, d)
    shown = ranking.limited(ranking.report_order(found), 25).agg(F.count("*").alias("shown"))
    total = found.filter("rule <> 'C2'").agg(F.count("*").alias("total"))
    return shown.crossJoin(total).select("shown", (F.col("total") - F.col("shown")).alias("hidden"))


@_add(f"WITH {_FOUND} SELECT count(*) AS findings, count(DISTINCT path) AS files_with_findings, count(DISTINCT CASE WHEN rule = 'C2' THEN path END) AS files_with_code, (SELECT count(*) FROM documents) AS comments, (SELECT count(DISTINCT source) FROM documents) AS files FROM f WHERE score >= 0.71 OR origin = 'heuristic'")
def summary_agg(spark, d):
    found = _findings(spark, d).filter("score >= 0.71 OR source = 'heuristic'")
    return ranking.summary(found, _docs(spark, d).select(F.col("source").alias("path")))


@_add(f"WITH {_FOUND} SELECT path, count(*)::INTEGER AS n, string_agg(rule, ',' ORDER BY line, col, seq) AS rules FROM f GROUP BY path")
def group_by_path(spark, d):
    grouped = ranking.by_path(_findings(spark, d))
    return grouped.select("path", F.size("findings").alias("n"), F.array_join(F.transform("findings", lambda f: f["rule"]), ",").alias("rules"))


_LABELLED = "list_filter([CASE WHEN quality = 0 THEN 'P3' END, CASE WHEN toxic = 1 THEN 'P6' END, CASE WHEN doc_id % 4 = 0 THEN 'P9' END], lambda x: x IS NOT NULL)"


def _labelled(spark, d) -> DataFrame:
    each = F.array(F.when(F.col("quality") == 0, "P3"), F.when(F.col("toxic") == 1, "P6"), F.when(F.col("doc_id") % 4 == 0, "P9"))
    return _table(spark, d, "labels").select("doc_id", "quality", "toxic", F.array_compact(each).alias("labels"))


@_add(f"SELECT r.rule, count(x.label) AS n FROM (VALUES ('P3'), ('P6'), ('P9'), ('P12')) r(rule) LEFT JOIN (SELECT unnest({_LABELLED}) AS label FROM labels) x ON x.label = r.rule GROUP BY r.rule")
def rule_support(spark, d):
    every = spark.createDataFrame([("P3",), ("P6",), ("P9",), ("P12",)], "rule string")
    counts = _labelled(spark, d).select(F.explode("labels").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    return every.join(counts, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


@_add(f"SELECT label AS rule, count(*) AS n FROM (SELECT unnest({_LABELLED}) AS label FROM labels) GROUP BY 1 HAVING count(*) >= 55")
def having_support(spark, d):
    return _labelled(spark, d).select(F.explode("labels").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).filter("n >= 55")


# ---------------------------------------------------------------- two labelers

_TWO = "x AS (SELECT doc_id, list_filter([CASE WHEN quality = 0 THEN 'P3' END, CASE WHEN doc_id % 4 = 0 THEN 'P6' END], lambda v: v IS NOT NULL) AS a, list_filter([CASE WHEN toxic = 1 THEN 'P3' END, CASE WHEN doc_id % 3 = 0 THEN 'P6' END], lambda v: v IS NOT NULL) AS b FROM labels)"
_AGREE = "CASE WHEN list_sort(a) = list_sort(b) THEN 'full' WHEN list_has_any(a, b) THEN 'partial' ELSE 'conflict' END"


def _two(spark, d) -> DataFrame:
    rows = _table(spark, d, "labels")
    one = rows.select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 0, "P3"), F.when(F.col("doc_id") % 4 == 0, "P6"))).alias("labels"))
    two = rows.select("doc_id", F.array_compact(F.array(F.when(F.col("toxic") == 1, "P3"), F.when(F.col("doc_id") % 3 == 0, "P6"))).alias("labels"))
    return agreement.consensus(one, two, ["doc_id"])


@_add(f"WITH {_TWO} SELECT {_AGREE} AS agreement, count(*) AS n FROM x GROUP BY 1")
def labeler_agreement(spark, d):
    return _two(spark, d).groupBy("agreement").agg(F.count("*").alias("n"))


@_add(f"WITH {_TWO} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS united, array_to_string(list_sort(list_intersect(a, b)), ',') AS agreed FROM x")
def labels_union_intersect(spark, d):
    return _two(spark, d).select("doc_id", F.array_join("labels", ",").alias("united"), F.array_join("labels_agreed", ",").alias("agreed"))


@_add(f"WITH {_TWO} SELECT d.doc_id, array_to_string(CASE WHEN a IS NULL THEN ['P1'] ELSE list_sort(list_distinct(list_concat(a, b))) END, ',') AS labels, coalesce({_AGREE.replace('ELSE', 'WHEN a IS NOT NULL THEN')}, 'full') AS agreement FROM documents d LEFT JOIN x USING (doc_id)")
def labels_with_fallback(spark, d):
    pairs = _docs(spark, d).select("doc_id", F.array(F.lit("P1")).alias("labels"))
    return agreement.with_labels(pairs, _two(spark, d), ["doc_id"]).select("doc_id", F.array_join("labels", ",").alias("labels"), "agreement")


# ---------------------------------------------------------------- silver labels

_BEFORE = "concat(CASE doc_id % 5 WHEN 0 THEN 'It cannot be that this is not the **case**, as a list, in one. ' WHEN 1 THEN 'The place anywhere: otherwise `a/b.md` is the end. ' WHEN 2 THEN 'Note this: ' ELSE '' END, text)"
_AFTER = "concat(CASE doc_id % 3 WHEN 0 THEN 'The parser returns (at most) one. ' WHEN 1 THEN 'That runs: else it stops. ' ELSE '' END, text)"


_WHOLE = "trim({}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"


def _sql_labels() -> str:
    b, a = (lambda p: f"regexp_matches(b, {_q(p)})"), (lambda p: f"regexp_matches(a, {_q(p)})")
    gone = lambda p: f"({b(p)} AND NOT {a(p)})"
    tests = {
        "P10": gone(silver.EMPHASIS), "P11": gone(silver.HEAD_NOUN), "P12": f"({b(silver.DOC_PATH)} OR {b(silver.DOC_SECTION)})",
        "P13": f"({b(silver.FENCED)} AND contains(a, '(') AND NOT contains(b, '('))", "P3": f"({b(silver.EQUATION)} AND {a(silver.ACTION)})",
        "P4": f"(({b(silver.COLON_FRAGMENT)} OR {b('[^ \\t\\n\\f\\r][ \\t\\n\\f\\r][–—][ \\t\\n\\f\\r][A-Za-z0-9_]')}) AND NOT {a(silver.COLON_FRAGMENT)})", "P5": f"({b(silver.CANNOT_NOT)} OR {b(silver.NEVER_NOT)})",
        "P6": f"(regexp_matches({_WHOLE.format('b')}, {_q(silver.DANGLING)}) AND NOT regexp_matches({_WHOLE.format('a')}, {_q(silver.DANGLING)}))",
        "P7": f"({b(silver.ELSE)} AND contains(b, ':') AND NOT ({a(silver.ELSE)} AND contains(a, ':')))", "P9": gone(silver.NONASSERTIVE),
    }
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for r, t in tests.items()) + "], lambda x: x IS NOT NULL)"


_PAIRS = f"r AS (SELECT doc_id, {_BEFORE} AS b, {_AFTER} AS a FROM documents), m AS (SELECT doc_id, a, b, {_sql_labels()} AS labels FROM r)"


def _mined(spark, d) -> DataFrame:
    pairs = _docs(spark, d).select("doc_id", F.expr(_BEFORE).alias("before"), F.expr(_AFTER).alias("after"))
    return pairs.withColumn("labels", silver.silver_labels(F.col("before"), F.col("after")))


@_add(f"WITH {_PAIRS} SELECT doc_id, array_to_string(labels, ',') AS labels FROM m")
def silver_labels(spark, d):
    return _mined(spark, d).select("doc_id", F.array_join("labels", ",").alias("labels"))


@_add(f"WITH {_PAIRS} SELECT count(*) AS pairs, sum(CASE WHEN len(labels) > 0 THEN 1 ELSE 0 END)::BIGINT AS labelled FROM m")
def silver_label_counts(spark, d):
    return _mined(spark, d).agg(F.count("*").alias("pairs"), F.count_if(F.size("labels") > 0).alias("labelled"))


_OUTCOME = "CASE WHEN contains(a, '(') AND NOT contains(b, '(') THEN 'parens' WHEN contains(b, ',') AND contains(a, ',') THEN 'kept' ELSE 'rewritten' END"


@_add(f"WITH {_PAIRS} SELECT {_OUTCOME} AS outcome, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4)::DOUBLE AS percent FROM m GROUP BY 1")
def revision_histogram(spark, d):
    rows = _mined(spark, d).withColumnsRenamed({"before": "b", "after": "a"}).groupBy(F.expr(_OUTCOME).alias("outcome")).agg(F.count("*").alias("n"))
    return rows.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


# ---------------------------------------------------------------- calibration and metrics

_SCORED = "z AS (SELECT doc_id, (n_chars * 37 % 1000) / 1000.0::DOUBLE AS p, toxic AS y, CASE doc_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'clean' END AS kind, CASE WHEN doc_id % 2 = 0 THEN 'P3' ELSE 'P6' END AS rule, n_chars FROM documents JOIN labels USING (doc_id))"
_BIASED = _SCORED.replace("(n_chars * 37 % 1000) / 1000.0::DOUBLE", "(CASE WHEN toxic = 1 THEN 400 + n_chars * 37 % 600 ELSE n_chars * 37 % 700 END) / 1000.0::DOUBLE")


def _scored(spark, d, biased: bool = True) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", "n_chars").join(_table(spark, d, "labels"), "doc_id")
    p = "CASE WHEN toxic = 1 THEN 400 + n_chars * 37 % 600 ELSE n_chars * 37 % 700 END" if biased else "n_chars * 37 % 1000"
    return rows.select("doc_id", F.expr(f"({p}) / 1000D").alias("p"), F.col("toxic").alias("y"), F.expr("CASE doc_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'clean' END").alias("kind"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'P3' ELSE 'P6' END").alias("rule"), "n_chars")


@_add(f"WITH {_BIASED} SELECT round(quantile_cont(p, 0.97), 6) AS scan_cut FROM z WHERE y = 0 AND (y = 1 OR kind <> 'after')")
def scan_cut_quantile(spark, d):
    return calibrate.scan_cut(calibrate.realistic(_scored(spark, d))).select(F.round("scan_cut", 6).alias("scan_cut"))


_GRID = "g AS (SELECT unnest(range(5, 96)) / 100.0::DOUBLE AS t)"


@_add(f"WITH {_BIASED}, {_GRID}, c AS (SELECT t, sum(CASE WHEN p > t THEN 1 ELSE 0 END) AS fired, sum(CASE WHEN p > t THEN y ELSE 0 END) AS hit, sum(y) AS pos FROM z, g GROUP BY t), k AS (SELECT t, hit / pos AS recall FROM c WHERE fired > 0 AND hit / fired >= 0.75) SELECT coalesce((SELECT t FROM k ORDER BY recall DESC, t LIMIT 1), 0.95)::DOUBLE AS gate_cut")
def gate_cut_grid(spark, d):
    return calibrate.gate_cut(_scored(spark, d))


@_add(f"WITH {_BIASED}, {_GRID}, c AS (SELECT rule, t, sum(CASE WHEN p > t THEN 1 ELSE 0 END) AS fired, sum(CASE WHEN p > t THEN y ELSE 0 END) AS hit, sum(y) AS pos FROM z, g GROUP BY rule, t), k AS (SELECT rule, t, hit / pos AS recall FROM c WHERE fired > 0 AND hit / fired >= 0.5), b AS (SELECT rule, t FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY recall DESC, t DESC) AS n FROM k) WHERE n = 1) SELECT r.rule, coalesce(t, 1.01)::DOUBLE AS rule_cut FROM (SELECT DISTINCT rule FROM z) r LEFT JOIN b USING (rule)")
def rule_cut_grid(spark, d):
    return calibrate.rule_cuts(_scored(spark, d))


@_add(f"WITH {_BIASED}, r AS (SELECT y, avg(n) OVER (PARTITION BY p) AS rank FROM (SELECT y, p, row_number() OVER (ORDER BY p) AS n FROM z)) SELECT round((sum(CASE WHEN y = 1 THEN rank END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6)::DOUBLE AS auc FROM r")
def auc_rank(spark, d):
    return calibrate.auc(_scored(spark, d)).select(F.round("auc", 6).alias("auc"))


@_add(f"WITH {_BIASED} SELECT rule, round(CASE WHEN sum(y) = 0 THEN 1.0 ELSE least(sum(1 - y) / greatest(sum(y), 1), 20.0) END, 6)::DOUBLE AS weight FROM z GROUP BY rule")
def pos_weights(spark, d):
    return calibrate.pos_weights(_scored(spark, d)).select("rule", F.round("weight", 6).alias("weight"))


@_add(f"WITH {_SCORED} SELECT kind, count(*) AS n, sum(y)::BIGINT AS pos FROM z WHERE y = 1 OR kind <> 'after' GROUP BY kind")
def realistic_mask(spark, d):
    return calibrate.realistic(_scored(spark, d, False)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))


@_add(f"WITH {_BIASED} SELECT y, round(avg(CASE WHEN p > 0.71 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS share, count(*) AS n FROM z GROUP BY y")
def heldout_flag_rates(spark, d):
    return calibrate.flag_rates(_scored(spark, d), 0.71).select("y", F.round("share", 6).alias("share"), "n")


_PREDICATES = {"long_text": "n_chars > 1000", "sure": "p > 0.6", "both": "p > 0.5 AND n_chars > 500", "never": "p > 2"}


@_add(f"WITH {_BIASED} " + " UNION ALL ".join(f"SELECT '{k}' AS predicate, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6)::DOUBLE AS precision, round(tp / nullif(tp + fn, 0), 6)::DOUBLE AS recall FROM (SELECT sum(CASE WHEN {s} AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN {s} AND y = 0 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN NOT ({s}) AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS fn FROM z)" for k, s in _PREDICATES.items()))
def confusion_by_predicate(spark, d):
    out = calibrate.confusion(_scored(spark, d), {k: F.expr(s) for k, s in _PREDICATES.items()})
    return out.select("predicate", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@_add(f"""WITH e AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS i, unnest(['C7', 'P3', 'P6', 'P10']) AS rule, unnest({_PROBS}) AS p FROM documents),
r AS (SELECT doc_id, rule, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, i) AS n FROM e),
h AS (SELECT l.doc_id, min(CASE WHEN list_contains({_LABELLED}, rule) THEN n END) AS best FROM labels l JOIN r USING (doc_id) WHERE len({_LABELLED}) > 0 GROUP BY l.doc_id)
SELECT {', '.join(f'round(avg(CASE WHEN best <= {k} THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS top_{k}' for k in (1, 2, 3))} FROM h""")
def topk_hit_rate(spark, d):
    rows = _docs(spark, d).join(_labelled(spark, d), "doc_id").filter("size(labels) > 0").select(_probs().alias("probs"), F.col("labels").alias("true"))
    rates = calibrate.hit_rates(rows, _LABELS)
    return rates.select(*[F.round(c, 6).alias(c) for c in rates.columns])


@_add(f"WITH {_BIASED}, c AS (SELECT rule, sum(CASE WHEN y = 1 AND p > 0.5 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND p > 0.5 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p <= 0.5 THEN 1 ELSE 0 END) AS fn FROM z GROUP BY rule) SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6)::DOUBLE AS f1_micro, round(avg(2 * tp / (2 * tp + fp + fn)), 6)::DOUBLE AS f1_macro FROM c")
def f1_scores(spark, d):
    out = calibrate.f1(_scored(spark, d).withColumn("z", (F.col("p") > 0.5).cast("int")))
    return out.select(F.round("f1_micro", 6).alias("f1_micro"), F.round("f1_macro", 6).alias("f1_macro"))


# ---------------------------------------------------------------- data sets and features


@_add("SELECT CASE WHEN doc_id * 7919 % 100 < 70 THEN 'train' WHEN doc_id * 7919 % 100 < 85 THEN 'calibration' ELSE 'test' END AS split, count(*) AS n, sum(toxic)::BIGINT AS pos FROM labels GROUP BY 1")
def split_three_way(spark, d):
    bucket = F.col("doc_id") * 7919 % 100
    return _table(spark, d, "labels").groupBy(F.when(bucket < 70, "train").when(bucket < 85, "calibration").otherwise("test").alias("split")).agg(F.count("*").alias("n"), F.sum("toxic").alias("pos"))


@_add("SELECT doc_id FROM labels WHERE toxic = 0 ORDER BY doc_id * 7919 % 10007, doc_id LIMIT 100")
def downsample_clean(spark, d):
    return _table(spark, d, "labels").filter("toxic = 0").orderBy(F.expr("doc_id * 7919 % 10007"), "doc_id").limit(100).select("doc_id")


_TERMS = "SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))) AS term FROM documents"


@_add(f"SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1, 6)::DOUBLE AS idf FROM ({_TERMS}) GROUP BY term HAVING count(*) >= 2")
def tfidf_word_stats(spark, d):
    docs = _docs(spark, d)
    n = docs.agg(F.count("*").alias("n"))
    terms = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0)))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")
    return counts.crossJoin(F.broadcast(n)).select("term", "df", F.round(F.log((1 + F.col("n")) / (1.0 + F.col("df"))) + 1, 6).alias("idf"))  # one row


@_add("SELECT pair, count(*) AS n FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]{2,}') AS ws FROM documents))) WHERE pair IS NOT NULL GROUP BY pair HAVING count(*) >= 3")
def ngram_counts(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))
    rows = _docs(spark, d).select(words.alias("w")).filter("size(w) > 1")
    pairs = rows.select(F.explode(F.expr("transform(slice(w, 1, size(w) - 1), (x, i) -> concat(x, ' ', w[i + 1]))")).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).filter("n >= 3")


@_add("SELECT gram, count(*) AS n FROM (SELECT w, substring(w, i::INTEGER, 3) AS gram FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT ' ' || unnest(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) || ' ' AS w FROM documents))) GROUP BY gram")
def char_wb_counts(spark, d):
    words = _docs(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]{2,}"), F.lit(0))).alias("w"))
    padded = words.select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    return padded.select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@_add()
def gate_train_score(spark, d):
    rows = _docs(spark, d).join(_labelled(spark, d), "doc_id").select("doc_id", "text", F.when(F.col("toxic") == 1, F.array(F.lit("P3"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    fitted = model.fit(rows, ["P3", "P6"])
    return fitted.score(rows).select("doc_id", F.round("gate", 6).alias("gate"), ranking.top_rules(["P3", "P6"], F.col("probs"), 1).alias("ranked"))


# ---------------------------------------------------------------- training rows and evaluation

#: Revisions of comments with their labels, made of orders: what changed goes round by o_orderkey.
_REVISED = (
    ("The queue — a bounded list of jobs — drains first.", "The queue (a bounded list of jobs) drains first."),
    ("The queue - a bounded list of jobs - drains first.", "The queue (a bounded list of jobs) drains first."),
    ("The queue, bounded as a list, drains first.", "The queue (bounded as a list) drains first."),
    ("The queue, bounded as a list, drains first.", "The queue is bounded and drains first."),
    ("The queue drains first.", "The queue is drained first."),
    ("The queue — a bounded list of jobs — drains first.", "The queue — a bounded list of jobs — drains later."),
    ("The queue — a bounded list of jobs — drains first.", "The queue drains first."),
)
_SHAPES = ("dash -> parentheses", "spaced hyphens -> parentheses", "comma -> parentheses", "comma -> commas dropped", "something else", "something else", "something else")
_OUTCOMES = ("parens", None, None, None, None, "kept", "rewritten")
_CASE = lambda values: "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else _q(v)}" for i, v in enumerate(values)) + " END"


def _revised(spark, d) -> DataFrame:
    rows = _table(spark, d, "orders").select("o_orderkey", F.expr(_CASE([b for b, _ in _REVISED])).alias("before"), F.expr(_CASE([a for _, a in _REVISED])).alias("after"))
    dashes = checkers.spans_of("P15")
    return rows.withColumns({"dashes": F.size(dashes("before")), "left": F.size(dashes("after"))})


@_add(f"SELECT {_CASE(_SHAPES)} AS shape, count(*) AS n FROM orders GROUP BY 1")
def edit_shape_histogram(spark, d):
    return _revised(spark, d).groupBy(evaluation.edit_shape(F.col("before"), F.col("after"), F.col("dashes")).alias("shape")).agg(F.count("*").alias("n"))


@_add(f"SELECT outcome, count(*) AS n FROM (SELECT {_CASE(_OUTCOMES)} AS outcome FROM orders) WHERE outcome IS NOT NULL GROUP BY 1")
def dash_outcomes(spark, d):
    outcome = evaluation.dash_outcome(F.col("before"), F.col("after"), F.col("dashes"), F.col("left")).alias("outcome")
    return _revised(spark, d).select(outcome).filter("outcome IS NOT NULL").groupBy("outcome").agg(F.count("*").alias("n"))


@_add(f"WITH {_PLANTED_SQL} SELECT count(*) AS comments, count(*)::BIGINT AS spans FROM planted WHERE rule = 'P13'")
def firing_counts(spark, d):
    return evaluation.firing(_planted(spark, d).withColumn("spans", checkers.spans_of("P13")(_t())))


@_add(f"WITH {_FOUND} SELECT list_sort(list_distinct(list(rule))) AS rules FROM f")
def violated_rules(spark, d):
    return evaluation.violated(_findings(spark, d))


@_add(f"WITH {_FOUND} SELECT rule, count(*) AS n FROM f GROUP BY rule")
def rule_totals(spark, d):
    return evaluation.totals(_findings(spark, d))


@_add(f"WITH {_FOUND} SELECT (r - 1)::INTEGER AS place, rule, coalesce(n, 0) AS n, coalesce(n, 0) >= 10 AS kept FROM (SELECT unnest(range(1, {len(_RULES) + 1})) AS r, unnest([{', '.join(map(_q, _RULES))}]) AS rule) LEFT JOIN (SELECT rule, count(*) AS n FROM f GROUP BY rule) USING (rule)")
def support_dropped(spark, d):
    return evaluation.supported(_findings(spark, d), _RULES)


_SCORED_SQL = "s AS (SELECT o_orderkey AS id, concat('P', o_orderkey % 5) AS rule, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 5 > 0 THEN 1 ELSE 0 END AS y, CASE WHEN o_custkey % 3 = 0 AND o_orderkey % 7 > 0 OR o_custkey % 11 = 0 THEN 1 ELSE 0 END AS z FROM orders)"


def _scored_orders(spark, d) -> DataFrame:
    z = (F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 7 > 0) | (F.col("o_custkey") % 11 == 0)
    y = (F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 5 > 0)
    return _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("P"), F.col("o_orderkey") % 5).alias("rule"), y.cast("int").alias("y"), z.cast("int").alias("z"))


@_add(f"WITH {_SCORED_SQL} SELECT round(sum(y * z) / sum(z), 6)::DOUBLE AS precision, round(sum(y * z) / sum(y), 6)::DOUBLE AS recall, count(DISTINCT CASE WHEN y = 1 THEN rule END) AS live FROM s")
def f1_micro_parts(spark, d):
    return evaluation.micro(_scored_orders(spark, d)).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "live")


@_add(f"WITH {_SCORED_SQL}, e AS (SELECT r, avg(y) AS p FROM (SELECT *, unnest(range(0, 200)) AS r FROM s WHERE z = 1) WHERE (id * 31 + r * 17) // 7 % 2 = 0 GROUP BY r) SELECT round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.05), 6) AS low, round(quantile_cont(p, 0.95), 6) AS high FROM e")
def split_half_precision(spark, d):
    found = evaluation.split_half(_scored_orders(spark, d), F.expr("(id * 31 + r * 17) div 7 % 2 = 0"))
    return found.select(*[F.round(c, 6).alias(c) for c in ("median", "low", "high")])


@_add(f"WITH {_TWO} SELECT round(sum(len(list_sort(list_distinct(list_concat(a, b))))) / (count(*) * 20.0), 6)::DOUBLE AS baseline FROM x")
def random_baseline(spark, d):
    return evaluation.random_baseline(_two(spark, d), 20).select(F.round("baseline", 6).alias("baseline"))


_KNOWN = ["P1", "P3", "P10"]
_KNOWN_SQL = "list_filter([" + ", ".join(map(_q, _KNOWN)) + "], lambda k: list_contains({}, k))"


@_add(f"""WITH {_TWO}, p AS (SELECT doc_id, {_KNOWN_SQL.format('list_concat(a, b)')} AS own, {_KNOWN_SQL.format('list_filter(a, lambda v: list_contains(b, v))')} AS agreed, {_AGREE} AS agreement FROM x),
r AS (SELECT doc_id, 'before' AS kind, own AS labels, agreed AS labels_eval, agreement <> 'conflict' AND len(agreed) > 0 AS eval_ok FROM p WHERE len(own) > 0
  UNION ALL SELECT doc_id, 'after', [], [], true FROM p WHERE len(own) > 0 UNION ALL SELECT doc_id, 'clean', [], [], true FROM documents)
SELECT doc_id, kind, array_to_string(CASE WHEN eval_ok AND doc_id * 7919 % 100 < 30 THEN labels_eval ELSE labels END, ',') AS labels, eval_ok,
  CASE WHEN NOT eval_ok OR doc_id * 7919 % 100 >= 30 THEN 'train' WHEN doc_id * 7919 % 100 < 15 THEN 'calib' ELSE 'test' END AS split FROM r""")
def example_assembly(spark, d):
    docs = _docs(spark, d)
    pairs = _two(spark, d).join(docs.select("doc_id", F.col("text").alias("before"), F.upper("text").alias("after")), "doc_id")
    rows = training.examples(pairs, docs.select("doc_id", "text"), _KNOWN, "doc_id", most_clean=1 << 30)
    return training.three_way(rows, F.col("doc_id") * 7919 % 100).select("doc_id", "kind", F.array_join("labels", ",").alias("labels"), "eval_ok", "split")


@_add("SELECT o_orderkey, i::INTEGER AS i, (CASE i WHEN 0 THEN 0 WHEN 1 THEN 18 + l ELSE 33 + l END)::INTEGER AS start, (CASE i WHEN 0 THEN 16 + l WHEN 1 THEN 32 + l ELSE 49 + 2 * l END)::INTEGER AS \"end\" FROM (SELECT o_orderkey, length(o_orderkey::VARCHAR) AS l, unnest([0, 1, 2]) AS i FROM orders)")
def sentence_places(spark, d):
    text = F.concat(F.lit("Order  "), "o_orderkey", F.lit(" is kept. \nIt waits here. Order  "), "o_orderkey", F.lit(" is kept."))
    rows = _table(spark, d, "orders").select("o_orderkey", F.posexplode(sentences.located_sentences(text)).alias("i", "s"))
    return rows.select("o_orderkey", "i", "s.start", "s.end")


# ---------------------------------------------------------------- report fields


@_add(f"WITH {_FOUND} SELECT doc_id, CASE WHEN rule = 'C2' THEN 'code' WHEN origin = 'heuristic' THEN 'flag' ELSE printf('%.2f', score) END AS tag, concat(line, ':', col, CASE WHEN line % 2 = 0 THEN '' ELSE concat('-', line + 1, ':', col) END) AS place FROM f")
def report_fields(spark, d):
    found = _findings(spark, d)
    end = F.col("line") + F.col("line") % 2
    return found.select("doc_id", display.tag(F.col("rule"), F.col("source"), F.col("score")).alias("tag"), display.place(F.col("line"), F.col("col"), end, F.col("col")).alias("place"))


@_add("SELECT doc_id, left(string_split(text, chr(10))[1], 64) AS head, concat(left(left(text, 60), 5), '[>', substring(left(text, 60), 6, 10), '<]', substring(left(text, 60), 16)) AS marked FROM documents")
def highlight_headline(spark, d):
    short = F.left("text", F.lit(60))
    return _docs(spark, d).select("doc_id", display.headline(_t()).alias("head"), display.highlighted(short, F.lit(5), F.lit(15)).alias("marked"))


# ---------------------------------------------------------------- extension: streams


@_add("SELECT epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    from proselens.streaming.windows import tumbling

    out = tumbling(_table(spark, d, "events"), "1 hour")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@_add("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id""")
def events_session(spark, d):
    from proselens.streaming.windows import sessions

    return sessions(_table(spark, d, "events"), "30 minutes").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


# ---------------------------------------------------------------- the whole scan


def _ranked(rows: DataFrame) -> DataFrame:
    found = scanning.claimed(rows.withColumn("verdict", predicates.verdict(_t(), _t()))).select("doc_id", "path", "rule", "score", "source", "clauses")
    return ranking.report_order(found.withColumns({"line": F.lit(1), "seq": F.col("doc_id")}), show_code=True).drop("line", "seq")


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as comments: verdicts, code points and checkers in one pass, ranked worst first."""
    return _ranked(_docs(spark, sf_dir).select("doc_id", F.col("source").alias("path"), _t()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over documents and the comments with known findings."""
    planted = _planted(spark, sf_dir).withColumnRenamed("o_orderkey", "doc_id")
    return _ranked(_docs(spark, sf_dir).select("doc_id", F.col("source").alias("path"), _t()).unionByName(planted))


_QUERIES["scan_documents"] = scan_documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
