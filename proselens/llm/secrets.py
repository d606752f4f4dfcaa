"""Secret scans with a trigram inverted index, in DataFrame operations only.

For each rule's regular expression a Boolean query over trigrams is derived that every match must
satisfy (a conjunction over what follows, a disjunction over alternatives). The index holds postings
(trigram, doc_id) of the trigrams that some rule's query names, over lower-cased text, found in one pass
over each text. Postings are intersected by document; a document that satisfies a rule's query is its
candidate and is verified by the expression itself over the whole text. A rule without mandatory
trigrams scans every text. Candidates go to the texts where their counted number allows that, so that
texts need no shuffle; beyond it both sides are shuffled by doc_id.

Spans are code points, end exclusive, leftmost and without overlap in each rule; a match that a rule's
length test drops still consumes its text. Positions cost time in proportion to text and matches.

Defined results: a null text is empty and has no secrets; rows that repeat a doc_id are verified each on
its own text; a null doc_id is scanned in full; an empty table gives an empty result; columns of docs
stay, whatever their names, but one that has the name asked for the result (`found`) is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.shared import written

_parse = re._parser.parse


@dataclass(frozen=True)
class Rule:
    """least: the characters that group `value` (0: the whole match) must have. narrow: an expression with the same matches less those that are too short."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    base: bool = False
    narrow: str = ""


#: Fixed values. The first three are the base rules.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]+", 0, 32, True, r"[0-9a-f]{32,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)

#: Candidates up to which they are sent to all texts: 64 bytes each, so 32 MB at most.
MOST_SENT = 500_000

#: Matches that a step of the walk over positions takes together.
CHUNK = 1024

#: The most strings that a part of an expression may stand for before its trigrams are taken.
MOST_STRINGS = 64

#: A query: True (no condition), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple


def _both(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and (not parts or any(p is True for p in parts)):
        return True
    own: set[Query] = set()
    for p in parts:  # a part of the same kind is as good as its own parts
        own |= set(p[1]) if isinstance(p, tuple) and p[0] == kind else set() if p is True else {p}
    if kind == "or":  # an alternative that asks for more than another adds nothing
        terms = {p: set(p[1]) if isinstance(p, tuple) and p[0] == "and" else {p} for p in own}
        own = {p for p in own if not any(terms[q] < terms[p] for q in own)}
    listed = sorted(own, key=str)
    return True if not listed else listed[0] if len(listed) == 1 else (kind, tuple(listed))


def _strings(found: set[str]) -> Query:
    """What a text satisfies that holds one of these strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in found])


def _members(items: list) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            out.add(chr(value).lower())
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The strings that a sequence stands for, where few; else None and what its matches satisfy."""
    exact: set[str] | None = {""}
    query: list[Query] = []
    whole = True
    for op, value in nodes:
        name, own, condition = str(op), None, True
        if name == "LITERAL":
            own = {chr(value).lower()}
        elif name == "IN":
            own = _members(value)
        elif name == "SUBPATTERN":
            own, condition = _walk(value[3])
        elif name == "BRANCH":
            each = [_walk(x) for x in value[1]]
            if all(s is not None for s, _ in each):
                own = set().union(*(s for s, _ in each))
            else:
                condition = _both("or", [q if s is None else _strings(s) for s, q in each])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = value
            strings, q = _walk(inner)
            if strings is not None and low == high and low <= 8:
                own = reduce(lambda a, _: {x + y for x in a for y in strings}, range(low), {""})
            elif strings is not None and (low, high) == (0, 1):
                own = strings | {""}
            elif low:
                condition = q if strings is None else _strings(strings)
        if own is not None and len(exact) * len(own) <= MOST_STRINGS:
            exact = {x + y for x in exact for y in own}
            continue
        query.append(_strings(exact))
        query.append(condition)
        exact, whole = (own or {""}) if own is not None else {""}, False
    if whole:
        return exact, _strings(exact)
    return None, _both("and", [*query, _strings(exact)])


def trigram_query(pattern: str) -> Query:
    """What the trigrams of a lower-cased text satisfy wherever the pattern matches the text."""
    return _walk(_parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1]))


def _holds(query: Query, have: Column) -> Column:
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(have, query)
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), (_holds(q, have) for q in query[1]))


def _any_of(wanted: list[str]) -> str:
    """An expression that finds every occurrence of these trigrams, overlapping ones too, as group 1."""
    quoted = lambda s: "".join(c if c.isalnum() else f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\x{{{ord(c):x}}}" for c in s)
    first = {c: [quoted(t[1:]) for t in wanted if t[0] == c] for c in sorted({t[0] for t in wanted})}
    return f"(?=({'|'.join(f'{quoted(c)}(?:{"|".join(rest)})' for c, rest in first.items())}))"


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index: (trigram, doc_id) for every trigram that a rule's query names."""
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    low = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.lower("text").alias("low"))
    held = F.regexp_extract_all("low", F.lit(_any_of(wanted)), F.lit(1)) if wanted else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(F.array_distinct(held)).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document that satisfies some rule's query: doc_id, kinds. Rules without a query are not listed."""
    queries = [(r.kind, q) for r in rules if (q := trigram_query(r.pattern)) is not True]
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("have")), F.lit(k)) for k, q in queries]))
    return have.select("doc_id", kinds.alias("kinds")).filter("size(kinds) > 0")


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, as lambdas compute what they name anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _positions(text: Column, rule: Rule, no: int) -> Column:
    """array<struct<start, kind (its number), end>> of the rule's matches that pass its length test. What lies between
    matches comes from split, so one walk over both gives every position. The walk writes positions as text: a
    step would copy an array whole, and does copy a text, so the matches are walked in chunks."""
    pattern = rule.narrow or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.value)) if rule.value else found
    gap = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    each = F.arrays_zip(gap.alias("gap"), F.transform(found, lambda m: F.length(m)).alias("size"), F.transform(values, lambda v: F.length(v)).alias("worth"))
    state = lambda at, done, out: F.struct(at.alias("at"), done.alias("done"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["size"]
        return state(end, acc["done"], F.when(x["worth"] >= rule.least, F.concat(acc["out"], at, F.lit(":"), end, F.lit(","))).otherwise(acc["out"]))

    def walked(x: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))
        none = F.lit("")
        whole = F.aggregate(chunks, state(F.lit(0), none, none), lambda acc, chunk: F.aggregate(chunk, state(acc["at"], acc["done"], none), step, lambda s: state(s["at"], F.concat(s["done"], s["out"]), none)))
        spans = F.filter(F.split(whole["done"], ","), lambda s: s != "")
        return F.transform(spans, lambda s: F.struct(F.substring_index(s, ":", 1).cast("int").alias("start"), F.lit(no).alias("kind"), F.substring_index(s, ":", -1).cast("int").alias("end")))

    return _let(F.filter(each, lambda x: x["size"].isNotNull()), walked)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "found") -> DataFrame:
    """docs with a column `into`: array<struct<start, kind, end>> by start, then rule (kind: the rule's number)."""
    index = written(postings(docs, rules), "trigram-postings")
    some = written(candidates(index, rules).select(F.col("doc_id").alias("__id"), F.col("kinds").alias("__kinds")), "trigram-candidates")
    some = F.broadcast(some) if some.count() <= MOST_SENT else some
    joined = docs.join(some, F.col("doc_id") == F.col("__id"), "left")
    text = F.col("text")
    each = []
    for no, rule in enumerate(rules):
        maybe = text.rlike(rule.narrow or rule.pattern)  # a cheap test before the walk
        if trigram_query(rule.pattern) is not True:
            maybe = (F.col("doc_id").isNull() | F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))) & maybe
        each.append(F.when(maybe, _positions(text, rule, no)).otherwise(_none()))
    columns = [F.col(c) for c in docs.columns if c.lower() != into.lower()]
    return joined.select(*columns, F.sort_array(F.concat(*each)).alias(into))


def _joined(found: Column) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = [F.expr(f"size(filter(found, x -> x.kind = {i}))").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(RULES) if r.base]
    base = F.filter("found", lambda x: x["kind"] < sum(r.base for r in RULES))
    return found.select("doc_id", *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _oracle() -> str:
    """The same by full scans with DuckDB's own engine."""
    ctes, unions = [], []
    for no, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        ctes.append(
            f"r{no} AS (SELECT doc_id, n, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.value}) AS v, regexp_split_to_array(text, '{p}') AS g FROM d)"
        )
        unions.append(
            f"SELECT doc_id, n, {no} AS kind, '{r.kind}' AS name, i, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS b, length(m[i]) AS size, length(v[i]) AS worth FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM r{no}) WHERE length(v[i]) >= {r.least}"
        )
    line = "name || ':' || b::BIGINT || ':' || (b + size)::BIGINT, ',' ORDER BY b, kind"
    counts = ", ".join(f"sum(CASE WHEN kind = {no} THEN 1 ELSE 0 END) AS n_{r.kind}" for no, r in enumerate(RULES) if r.base)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents), {', '.join(ctes)},
s AS ({' UNION ALL '.join(unions)}),
a AS (SELECT n, {counts}, coalesce(string_agg({line}) FILTER (kind < {sum(r.base for r in RULES)}), '') AS base, coalesce(string_agg({line}), '') AS spans FROM s GROUP BY n)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}' for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)"""


ORACLE = _oracle()
