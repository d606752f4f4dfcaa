"""Deterministic span checkers P14, P13, P15.

One Arrow function runs all three on the rows that pass a native pre-filter, and returns the first rule
that fires with its spans, as a CASE over three functions would run each of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proselens.functions import lexicon as lex

ORDER = ("P14", "P13", "P15")
SPAN = "array<struct<clause:string,pronoun:string,start:int,end:int>>"

#: A row without these cannot fire; the Arrow function does not see it.
PREFILTER = {
    "P14": r",\s+and\s[^,:;.]{8,120},\s+so\b",
    "P13": r",\s+(?:as well as|rather than|particularly|especially|including|such as|but not|unlike|plus|like|and|nor|not|or)\s[^,.;:()—–`]{2,90},\s+[A-Za-z]",
    "P15": r"(?s)[—–].+[—–]",
}

#: A masked text without these has no sentence in which the rule's pattern stands.
_IN_VIEW = {"P14": lex.CHAIN, "P13": re.compile(PREFILTER["P13"]), "P15": re.compile(PREFILTER["P15"])}

Found = tuple[str, str, int, int]


def lower_words(text: str) -> list[str]:
    return [w.lower() for w in lex.WORD.findall(text)]


def mask(text: str) -> str:
    """Code and quotations as x, abbreviation periods as NUL; of the same length."""

    def hide(match) -> str:
        found = match.group()
        stray = "\n" in found and lex.SENTENCE_END.search(found)
        return found if stray else found[0] + "x" * (len(found) - 2) + found[-1]

    for pattern in (lex.CODE_SPAN, lex.QUOTED):
        text = pattern.sub(hide, text)
    return lex.ABBREVIATION.sub(lambda m: m.group().replace(".", "\0"), text)


def located(view: str) -> Iterator[tuple[str, int]]:
    """Sentences of a masked text, with where each begins."""
    begin = 0
    for gap in lex.SENTENCE.finditer(view):
        yield view[begin : gap.start()], begin
        begin = gap.end()
    yield view[begin:], begin


# --- P14


def copular_subject(clause: str) -> list[str]:
    """The words in front of the clause's copula, up to a preposition; none if the clause has another kind of verb."""
    words = lex.WORD.findall(clause)
    low = [w.lower() for w in words]
    verb = next((i for i, w in enumerate(low[:9]) if w in lex.VERBS), None)
    if not verb or low[verb] not in lex.COPULAS:
        return []
    complement = next((w for w in low[verb + 1 :] if w not in ("not", "still", "also", "now")), "")
    if complement in lex.PREPOSITIONS:
        return []
    stop = next((i for i in range(1, verb) if low[i] in lex.PREPOSITIONS), verb)
    return words[:stop]


def is_plural(subject: list[str]) -> bool:
    """K1c"""
    low = [w.lower() for w in subject]
    if "and" in low[1:-1]:
        return True
    head = next((w for w in reversed(low) if w not in lex.STOPWORDS), low[-1]).strip("`'\"*_")
    return head.endswith("s") and not head.endswith("ss")


def bare_pronoun(words: list[str]) -> bool:
    """K1d: a verb, or an adverb and a verb, right after the pronoun (given in lower case)."""
    rest = words[2:] if len(words) > 1 and words[1] in lex.ADVERBS else words[1:]
    if not rest:
        return False
    if words[0] in lex.DETERMINER_LIKE:
        return rest[0] in lex.AUXILIARIES
    return rest[0] in lex.VERBS or bool(lex.REGULAR_VERB.match(rest[0]))


def continued_pronoun(first: str, middle: str) -> str | None:
    """The pronoun that opens the middle clause, if it goes on with the subject of the first."""
    words = lower_words(middle)
    if "`" in middle or lex.DASH.search(middle) or not words or words[0] not in lex.PRONOUNS or not bare_pronoun(words):
        return None
    pronoun = words[0]
    if pronoun == "it" and lex.EXPLETIVE.match(middle.strip()):
        return None
    clause = lex.LEADING_SUBORDINATE.sub("", lex.CLAUSE_CUT.split(first)[-1].strip(" ,"))
    subject = [] if pronoun in lower_words(clause) else copular_subject(clause)
    if not subject or subject[0].lower() in lex.NO_ANTECEDENT:
        return None
    return pronoun if is_plural(subject) == (pronoun in lex.PLURAL) else None


def supporting_premises(text: str, view: str | None = None) -> list[Found]:
    """K1 (P14)"""
    found = []
    for sentence, base in located(mask(text) if view is None else view):
        for m in lex.CHAIN.finditer(sentence):
            if pronoun := continued_pronoun(sentence[: m.start()], m["middle"]):
                a, b = base + m.start(), base + m.end()
                found.append((text[a:b], pronoun, a, b))
    return found


# --- P13


def is_finite(word: str) -> bool:
    """F13"""
    low = word.lower()
    if low in lex.FINITE_AUXILIARIES:
        return True
    regular = len(low) >= 4 and lex.REGULAR_VERB.match(low) and low not in lex.NOT_VERBS and not lex.NOT_VERB_SUFFIX.search(low)
    return bool(regular) and not word[0].isupper()


def is_noun_phrase(subject: str) -> bool:
    """no more verbs than relativizers after its first word; a word after a determiner is no verb."""
    words = lex.WORD.findall(subject)
    if not words or words[0].lower() in lex.ADVERBIAL_STARTS or words[0].lower().endswith("ly") or is_finite(words[0]):
        return False
    verbs = sum(is_finite(w) for before, w in pairwise(words) if before.lower() not in lex.DETERMINERS)
    return verbs <= sum(w.lower() in lex.RELATIVIZERS for w in words[1:])


def comma_fences(text: str, view: str | None = None) -> list[Found]:
    """K2 (P13): the span takes in both commas."""
    found = []
    for sentence, base in located(mask(text) if view is None else view):
        for m in lex.COMMA_FENCE.finditer(sentence):
            if len(lex.WORD.findall(m["fenced"])) >= lex.LEAST_FENCED_WORDS and is_finite(m["after"]) and is_noun_phrase(m["subject"]):
                a, b = base + m.start("fenced") - 2, base + m.end("fenced") + 1
                found.append((text[a:b], "", a, b))
    return found


# --- P15


def is_gloss(inside: str, line_before: str) -> bool:
    """Two lines of a term and its gloss: a short term, and few words on the line of the closing dash."""
    return "\n" in inside and len(lex.WORD.findall(line_before)) <= 2 and len(lex.WORD.findall(inside.rpartition("\n")[2])) <= lex.GLOSS_LINE_WORDS


def dash_fences(text: str, view: str | None = None) -> list[Found]:
    """K3 (P15)"""
    view = mask(text) if view is None else view
    found = []
    for sentence, base in located(view):
        for m in lex.DASH_FENCE.finditer(sentence):
            a, b = base + m.start(), base + m.end()
            if is_gloss(m["inside"], view[view.rfind("\n", 0, a) + 1 : a]):
                continue
            inner, after = lower_words(m["inside"])[:1], lower_words(sentence[m.end() :])[:1]
            if inner and inner == after:  # a sequence
                continue
            a, b = a + m["open"][0].isspace(), b - m["close"][-1].isspace()
            found.append((text[a:b], "", a, b))
    return found


CHECKERS = {"P14": supporting_premises, "P13": comma_fences, "P15": dash_fences}


def first_of(rules: tuple[str, ...], text: str) -> tuple[str | None, list[Found]]:
    """The first rule that fires and its spans: the text is masked once, and a rule whose pattern the masked text lacks is passed over."""
    view = mask(text) if text else text
    return next(((r, s) for r in rules if _IN_VIEW[r].search(view) and (s := CHECKERS[r](text, view))), (None, []))


# --- structural tokens

_MARKER = lex.re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in lex.CONNECTIVES.items()))


def content_words(text: str) -> set[str]:
    """N27"""
    return {w for w in lower_words(text) if len(w) > 2 and w not in lex.STRUCTURE_STOPWORDS}


def structure_tokens(text: str) -> list[str]:
    """Runs of connectives, and what stands in front of each `, so`."""
    out: list[str] = []
    for sentence in lex.SENTENCE.split(text or ""):
        marks = list(_MARKER.finditer(sentence))
        kinds = [m.lastgroup for m in marks]
        for n in (2, 3):
            out += [f"c{n}:{'>'.join(kinds[i : i + n])}" for i in range(len(kinds) - n + 1)]
        for i, (kind, follower) in enumerate(pairwise(kinds)):
            if follower != "SO" or kind not in ("AND", "WHICH", "RPAREN", "DASH"):
                continue
            head = i - 1 if kind == "RPAREN" and i and kinds[i - 1] == "LPAREN" else i
            before = sentence[marks[head - 1].end() if head else 0 : marks[head].start()]
            middle = sentence[marks[head].end() : marks[i + 1].start()]
            words = lower_words(middle)
            facts = [f"bref:{min(2, len(content_words(before) & content_words(middle)))}"]
            facts += ["bsubj:pron"] * bool(words and words[0] in lex.STRUCTURE_PRONOUNS)
            facts += ["bshort"] * bool(words and len(words) < len(lex.WORD.findall(before)))
            out += [f"{kind}:{f}" for f in facts] + [f"premise:{kind}"]
    return out


# --- Spark


def prefilter(text: Column, rules: tuple[str, ...] = ORDER) -> Column:
    return text.rlike("|".join(f"(?:{PREFILTER[r]})" for r in rules))


def spans_of(rule: str):
    """A checker as a function of a text column."""
    check = CHECKERS[rule]

    @F.pandas_udf(SPAN)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("clause", "pronoun", "start", "end"), s, strict=True)) for s in check(t or "")])

    return run


def first_firing(rules: tuple[str, ...] = ORDER):
    """K4: the first rule that fires, and its spans, in one call."""

    @F.pandas_udf(f"rule string, spans {SPAN}")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            rule, spans = first_of(rules, text or "")
            rows.append((rule, [dict(zip(("clause", "pronoun", "start", "end"), s, strict=True)) for s in spans]))
        return pd.DataFrame(rows, columns=["rule", "spans"])

    return run


def clauses_of(spans: Column) -> Column:
    """K5: the clauses of spans, single-spaced."""
    return F.transform(spans, lambda s: F.trim(F.regexp_replace(s["clause"], r"(?U)\s+", " ")))


def check(df: DataFrame, text: str = "text", rules: tuple[str, ...] = ORDER) -> DataFrame:
    """K4, K5: rows on which a rule fires, with rule, score 1.0, source, spans and single-spaced clauses."""
    # not deterministic to Catalyst, which would push the filter below, and the function with it, to run twice
    fired = df.filter(prefilter(F.col(text), rules)).withColumn("fired", first_firing(rules).asNondeterministic()(F.col(text))).filter("fired.rule IS NOT NULL")
    return fired.select("*", F.col("fired.rule").alias("rule"), F.lit(1.0).alias("score"), F.lit("heuristic").alias("source"), F.col("fired.spans").alias("spans"), clauses_of(F.col("fired.spans")).alias("clauses")).drop("fired")


def structure_column():
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(structure_tokens)

    return run
