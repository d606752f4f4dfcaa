"""Text shapes: comment markers, tags, whitespace (operators N1-N7), all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode-aware outer whitespace of one line, as Python's strip() takes it.
_OUTER = r"(?U)^\s+|\s+$"


def newlines(text: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def each_line(text: Column, change) -> Column:
    """A change of every line, which may use the line's number."""
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


def strip_hash(text: Column) -> Column:
    """Leading # of each line."""
    return each_line(newlines(text), lambda line: F.regexp_replace(line, r"^\s*#+\s?", ""))


def strip_slashes(text: Column) -> Column:
    """Leading // of each line."""
    return each_line(newlines(text), lambda line: F.regexp_replace(line, r"^\s*//+\s?", ""))


def strip_block(text: Column) -> Column:
    """The closer (with one star), then the opener and a blank, then the stars of later lines."""
    inner = F.regexp_replace(F.regexp_replace(newlines(text), r"[ \t]*\*/[ \t]*\z", ""), r"^/\*+[ \t]?", "")
    return each_line(inner, lambda line, i: F.when(i == 0, line).otherwise(F.regexp_replace(line, r"^\s*\*(?!/)\s?", "")))


def strip_lines(text: Column) -> Column:
    """Outer whitespace of each line."""
    return each_line(text, lambda line: F.regexp_replace(line, _OUTER, ""))


def truncate_at_tags(text: Column) -> Column:
    """The lines before the first that opens with an @tag."""
    lines = F.split(text, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"^\s*@\w")), True)
    return F.when(at > 0, F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n")).otherwise(text)


def collapse(text: Column) -> Column:
    """Runs of whitespace as one space, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markers(raw: Column, kind: Column) -> Column:
    text = newlines(raw)
    return (
        F.when(kind == "python", strip_hash(raw))
        .when(kind == "docstring", text)
        .when(text.startswith("//"), strip_slashes(raw))
        .when(text.startswith("/*"), strip_block(raw))
        .otherwise(text)
    )


def normalize(raw: Column, kind: Column) -> Column:
    """A raw comment to the prose shape that classifiers and checkers read."""
    return F.regexp_replace(truncate_at_tags(strip_lines(strip_markers(raw, kind))), _OUTER, "")
