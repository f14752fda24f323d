"""Null-safe predicate builders for detection rules.

A rule must read a missing field as "no match" for a positive test and as "match" for ``not_in``.
SQL's three-valued logic gives NULL instead, so every builder closes over ``coalesce``.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_NEEDLE = 200
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")


def fld(path: str | Column) -> Column:
    """A dotted path as a column; a path of missing parents reads as null."""
    return F.col(path) if isinstance(path, str) else path


def closed(pred: Column) -> Column:
    """``pred`` with an unknown outcome read as false."""
    return F.coalesce(pred, F.lit(False))


def eq(path: str | Column, value) -> Column:
    return closed(fld(path) == F.lit(value))


def cmp(path: str | Column, op: str, number: float) -> Column:
    """gt / gte / lt / lte / ne; a missing or non-numeric value never matches, not even for ``ne``."""
    ops = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le, "ne": operator.ne}
    if isinstance(number, bool) or not isinstance(number, (int, float)):
        return F.lit(False)
    return closed(ops[op](fld(path).try_cast("double"), F.lit(float(number))))


def isin_(path: str | Column, values: Iterable) -> Column:
    return closed(fld(path).isin(list(values)))


def contains(path: str | Column, needle: str) -> Column:
    if not 1 <= len(needle) <= MAX_NEEDLE:
        return F.lit(False)
    return closed(fld(path).contains(needle))


def glob_to_regex(pattern: str) -> str:
    """Shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored Java regex."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1:end]
            negate = body.startswith("!")
            body = body[1:] if negate else body
            safe = "".join("\\" + c if c in "\\[]^&" else c for c in body)
            out.append("[" + ("^" if negate else "") + safe + "]")
            i = end
        else:
            out.append("\\" + ch if not ch.isalnum() and ch != "_" and ch.isascii() else ch)
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def glob(path: str | Column, pattern: str) -> Column:
    if not 1 <= len(pattern) <= MAX_NEEDLE:
        return F.lit(False)
    return closed(fld(path).rlike(glob_to_regex(pattern)))


def exists(path: str | Column, wanted: bool = True) -> Column:
    return fld(path).isNotNull() if wanted else fld(path).isNull()


def not_in(path: str | Column, entries: Iterable[str], cidrs: Iterable[str] = ()) -> Column:
    """True unless the value is on the list; a missing value is on no list, so it matches.

    ``entries`` are exact strings, ``cidrs`` IPv4 networks. Both come from small rule files; long
    lists belong in a table and go through ``operators.joins.not_listed``.
    """
    value = fld(path)
    listed = value.isin(list(entries)) if entries else F.lit(False)
    for net in cidrs:
        listed = listed | in_cidr(value, net)
    return ~closed(listed)


def ipv4_number(value: Column) -> Column:
    """Dotted IPv4 text as BIGINT, null when it is not one."""
    octets = F.split(F.when(is_ipv4(value), value), "\\.")
    return reduce(lambda acc, i: acc * 256 + octets[i].cast("bigint"), range(4), F.lit(0).cast("bigint"))


def is_ipv4(value: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return closed(value.rlike(rf"\A{octet}(\.{octet}){{3}}\z"))


def in_cidr(value: Column, net: str) -> Column:
    """IPv4 containment by integer arithmetic (no UDF, stays in generated code)."""
    base, _, length = net.partition("/")
    bits = int(length or 32)
    number = reduce(lambda acc, part: acc * 256 + int(part), base.split("."), 0)
    shift = 32 - bits
    return closed(F.shiftright(ipv4_number(value), shift) == F.lit(number >> shift).cast("bigint"))


def outside_hours(ms: str | Column, start: str = "08:00", end: str = "18:00",
                  days: Iterable[str] = WEEKDAYS[:5], tz_offset_minutes: int = 0) -> Column:
    """Whether an epoch-ms time lies outside a weekly working window (never, for an empty window).

    Minutes come from floor division, so times before 1970 work; the epoch fell on a Thursday. A
    window whose end is before its start wraps midnight.
    """
    def minutes(hhmm: str) -> int:
        hour, _, minute = hhmm.partition(":")
        return int(hour) * 60 + int(minute)

    lo, hi = minutes(start), minutes(end)
    if lo == hi:
        return F.lit(False)
    total = F.floor(fld(ms) / F.lit(60000)) + F.lit(tz_offset_minutes)
    of_day = F.pmod(total, F.lit(1440))
    weekday = F.pmod(F.floor(total / F.lit(1440)) + F.lit(3), F.lit(7))
    in_day = weekday.isin([WEEKDAYS.index(d) for d in days])
    in_time = (of_day >= lo) & (of_day < hi) if lo < hi else (of_day >= lo) | (of_day < hi)
    return closed(~(in_day & in_time))


def all_of(*preds: Column) -> Column:
    return reduce(operator.and_, preds, F.lit(True))


def any_of(*preds: Column) -> Column:
    return reduce(operator.or_, preds, F.lit(False))
