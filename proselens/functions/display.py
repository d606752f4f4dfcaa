"""Report fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(score: Column) -> Column:
    """N17"""
    return F.round(score, 4)


def taxonomy_order(rule: Column) -> tuple[Column, Column]:
    """By letter, then number."""
    return F.substring(rule, 1, 1), F.substring(rule, 2, 9).cast("int")


def place(line: Column, col: Column, end_line: Column, end_col: Column) -> Column:
    """L:c, with the end where it differs."""
    start = F.concat_ws(":", line, col)
    return F.when((line == end_line) & (col == end_col), start).otherwise(F.concat(start, F.lit("-"), F.concat_ws(":", end_line, end_col)))


def hundredths(score: Column) -> Column:
    """The score's exact binary value to two places, ties to even, as the surveyed tool writes it; format_string alone rounds
    the shortest decimal, ties up. The products of both halves of the score are exact."""
    high = F.floor(score * (1 << 26)) / F.lit(float(1 << 26))
    near = F.rint(score * 100)
    beyond = lambda half: (high * 100 - near - half) + (score - high) * 100
    odd = near % 2 != 0
    up = (beyond(0.5) > 0) | ((beyond(0.5) == 0) & odd)
    down = (beyond(-0.5) < 0) | ((beyond(-0.5) == 0) & odd)
    return F.format_string("%.2f", (near + F.when(up, 1).when(down, -1).otherwise(0)) / 100)


def tag(rule: Column, source: Column, score: Column) -> Column:
    """Code, flag, or the score."""
    return F.when(rule == "C2", "code").when(source == "heuristic", "flag").otherwise(hundredths(score))


def headline(text: Column, width: int = 64) -> Column:
    """The first line, cut."""
    return F.left(F.substring_index(text, "\n", 1), F.lit(width))


def highlighted(text: Column, start: Column, end: Column) -> Column:
    """[> and <] around code points start to end."""
    return F.concat(F.left(text, start), F.lit("[>"), F.substr(text, start + 1, end - start), F.lit("<]"), F.substr(text, end + 1))
