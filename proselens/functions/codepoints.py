"""Code points beyond Latin-1 and their whitelist."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN1_MAX = 0xFF
HIGHEST = 0x10FFFF


class WhitelistError(ValueError):
    pass


def parse_entry(entry: str | int) -> tuple[int, int]:
    """U+XXXX, U+XXXX-U+YYYY or a number to an inclusive range."""
    if isinstance(entry, bool) or not isinstance(entry, (int, str)):
        raise WhitelistError(f"not a code point: {entry!r}")
    if isinstance(entry, int):
        low = high = entry
    else:
        ends = entry.strip().split("-")
        if len(ends) > 2 or not all(re.fullmatch("[uU]\\+[0-9A-Fa-f]{4,6}", e.strip()) for e in ends):
            raise WhitelistError(f"not a code point: {entry!r}")
        low, high = int(ends[0].strip()[2:], 16), int(ends[-1].strip()[2:], 16)
    if not 0 <= low <= high <= HIGHEST:
        raise WhitelistError(f"out of range: {entry!r}")
    return low, high


def disallowed(text: Column, ranges: list[tuple[int, int]] | None = None) -> Column:
    """Distinct code points above Latin-1 outside the ranges, in order of first sight."""
    rest = F.regexp_replace(text, r"[\x00-\xFF]+", "")  # most texts end here
    points = F.array_distinct(F.transform(F.split(rest, ""), lambda c: F.ascii(c)))

    def kept(x: Column) -> Column:
        outside = x > LATIN1_MAX
        for low, high in ranges or []:
            outside &= ~x.between(low, high)
        return outside

    return F.filter(points, kept)


def hexadecimal(point: Column) -> Column:
    """N16"""
    return F.format_string("U+%04X", point)
