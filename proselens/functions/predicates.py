"""What a comment is: directive, license, code or prose (F1-F7), as one CASE chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_LENGTH = 40
LICENSE_WINDOW = 400
PUNCTUATION_SHARE = 0.04

# Fixed values.
DIRECTIVE = (
    r"(?i)^\s*(?:eslint-|tslint:|prettier-ignore|@ts-|c8 |v8 |istanbul |jshint |globals?\s|"
    r"type:\s*ignore|noqa|pragma:|pylint:|mypy:|fmt:\s*(?:on|off)|isort:|!|-\*-|coding[:=]|#!)"
)
LICENSE = r"(?i)copyright|licen[cs]e|SPDX|Permission is hereby granted|All rights reserved|Licensed under|WITHOUT WARRANTIES"
CODE_SIGNS = (
    r"[;{}]\s*$",
    r"^\s*(?:const|let|var|function|class|import|export|return|if|for|while|def|elif)\b.*[:;{(]",
    r"\w+\s*\([^)]*\)\s*[;{]",
    r"=>\s*[{(]",
    r"^\s*[\w.\[\]]+\s*[-+*/|&]?=[^=]",
    r"^\s*</?\w+[^>]*>",
    r"^\s*[}\])]",
)
PUNCTUATION = r"[^{}\[\]();=<>|&]"


def is_directive(text: Column, raw: Column) -> Column:
    """F2"""
    return F.ltrim(raw, F.lit("/*# ")).rlike(DIRECTIVE) | text.rlike(DIRECTIVE)


def is_license(text: Column) -> Column:
    """a license phrase in the first 400 characters."""
    return F.substring(text, 1, LICENSE_WINDOW).rlike(LICENSE)


def punctuation_share(text: Column) -> Column:
    return F.length(F.regexp_replace(text, PUNCTUATION, "")) / F.greatest(F.lit(1), F.length(text))


def low_prose(text: Column) -> Column:
    """few words, or dense in punctuation."""
    return (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) < 3) | (punctuation_share(text) > PUNCTUATION_SHARE)


def looks_like_code(text: Column) -> Column:
    """every line that is not blank has a sign of code, and there is little prose."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    sign = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p in CODE_SIGNS])
    return (F.size(lines) > 0) & F.forall(lines, sign) & low_prose(text)


def verdict(text: Column, raw: Column) -> Column:
    """skip, code or prose, in a fixed order."""
    skip = (F.length(text) < MIN_LENGTH) | is_directive(text, raw) | is_license(text)
    return F.when(skip, "skip").when(looks_like_code(text), "code").otherwise("prose")


def markdown_verdict(text: Column) -> Column:
    """by length alone."""
    return F.when(F.length(text) < MIN_LENGTH, "skip").otherwise("prose")
