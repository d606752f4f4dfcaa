"""Sentence boundaries (N8-N10). Reports and checkers split differently, so both are kept."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from proselens.functions.normalize import collapse

#: Stands in for a period that ends no sentence; of the same length, so offsets stay.
PLACEHOLDER = "\u0001"

# Fixed values.
ABBREVIATION = r"(?iU)\b([A-Za-z]|etc|vs|mr|mrs|ms|dr|prof|sr|jr|st|vol|fig|no|approx|cf|al)\."
BOUNDARY = r"(?<=[.!?])[\"')\]]?\s+(?=[A-Z0-9\"'(])"
CHECKER_BOUNDARY = r"(?<=[.!?])\s+|\n\s*\n"


def protect(text: Column) -> Column:
    """Abbreviation periods as placeholders."""
    return F.regexp_replace(text, ABBREVIATION, f"$1{PLACEHOLDER}")


def split_sentences(text: Column) -> Column:
    """Sentences in reading order, single-spaced, without empty ones."""
    parts = F.split(protect(collapse(text)), BOUNDARY, -1)
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit(PLACEHOLDER), F.lit(".")))), lambda s: s != "")


def _places(text: str | None, sentences) -> list[dict]:
    out, at = [], 0
    for sentence in sentences if sentences is not None else ():
        words = [re.escape(w) for w in sentence.split()]
        m = re.compile(r"\s+".join(words)).search(text, at) if words else None
        at = m.end() if m else at
        out.append({"start": m.start() if m else -1, "end": m.end() if m else -1})
    return out


def located_sentences(text: Column) -> Column:
    """array<struct<sentence, start, end>>: each sentence with its place in the text, searched from the end of the one before with any
    whitespace between its words; -1 where it is not found."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def placed(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_places(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    sentences = split_sentences(text)
    return F.zip_with(sentences, placed(text, sentences), lambda s, p: F.struct(s.alias("sentence"), p["start"].alias("start"), p["end"].alias("end")))


def split_for_checkers(text: Column) -> Column:
    """Also at whitespace before lower case, and at blank lines."""
    return F.split(text, CHECKER_BOUNDARY, -1)
