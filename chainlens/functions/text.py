"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = r"(?!)"


def delta_text(old: Column, new: Column) -> Column:
    """`new (delta: +d)` of two counters; a missing side is 0."""
    zero = F.lit(0).cast("decimal(20,0)")
    old, new = F.coalesce(old, zero), F.coalesce(new, zero)
    change = (new - old).cast("decimal(21,0)")
    sign = F.when(change < 0, "").otherwise("+")
    return F.concat(new.cast("string"), F.lit(" (delta: "), sign, change.cast("string"), F.lit(")"))


def quoted(text: Column) -> Column:
    """text in double quotes, with backslash, quote, tab and line ends escaped."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), text, F.lit('"'))


def glob_to_regex(pattern: str) -> str:
    """The regular expression (for whole strings) of a shell pattern, whose * and ? stop at /; a malformed one never matches."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == len(pattern):
                return NEVER
            out += _literal(pattern[i])
            i += 1
        elif c == "[":
            found = _brackets(pattern, i)
            if found is None:
                return NEVER
            part, i = found
            out += part
        else:
            out += _literal(c)
    return f"^{out}$"


def _brackets(pattern: str, i: int) -> tuple[str, int] | None:
    """The character class that begins at i, and where it ends; None if it is malformed (empty, unclosed, a bare - or ])."""

    def one(i: int) -> tuple[str, int] | None:
        if i < len(pattern) and pattern[i] == "\\":
            i += 1
        elif pattern[i : i + 1] in ("-", "]"):
            return None
        return (_literal(pattern[i]), i + 1) if i < len(pattern) else None

    negated = pattern[i : i + 1] == "^"
    i, inside = i + negated, ""
    while not (inside and pattern[i : i + 1] == "]"):
        low = one(i)
        if low is None:
            return None
        inside, i = inside + low[0], low[1]
        if pattern[i : i + 1] == "-":
            high = one(i + 1)
            if high is None:
                return None
            inside, i = f"{inside}-{high[0]}", high[1]
    return f"[{'^' if negated else ''}{inside}]", i + 1


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_ /@:,%" or ord(c) > 127 else "\\" + c


def matches_any(name: Column, patterns: list[str]) -> Column:
    """Whether name matches one of a few shell patterns."""
    out = F.lit(False)
    for p in patterns:
        out = out | name.rlike(glob_to_regex(p))
    return out


def unescape_mount(text: Column) -> Column:
    """The octal escapes of mount tables as characters."""
    for raw, plain in (("\\040", " "), ("\\011", "\t"), ("\\012", "\n"), ("\\134", "\\")):
        text = F.replace(text, F.lit(raw), F.lit(plain))
    return text


def collapsed(text: Column) -> Column:
    """Runs of spaces and tabs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).when(severity == "low", 3).otherwise(4)


def counter(text: Column) -> Column:
    """An unsigned number; anything else is 0."""
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))


def joined(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ","), F.lit(""))


def day_start(date: str, zone: str) -> Column:
    """The instant at which a calendar day begins in a zone."""
    return F.to_utc_timestamp(F.to_timestamp(F.lit(date), "yyyy-MM-dd"), zone)


def in_days(ts: Column, since: str | None, until: str | None, zone: str) -> Column:
    """Whether ts lies in the days since to until, both included, of a zone: up to the midnight after, not just its last second."""
    out = F.lit(True)
    if since:
        out = out & (ts >= day_start(since, zone))
    if until:
        after = F.date_format(F.date_add(F.to_date(F.lit(until)), 1), "yyyy-MM-dd")
        out = out & (ts < F.to_utc_timestamp(F.to_timestamp(after, "yyyy-MM-dd"), zone))
    return out


def nanoseconds(timestamp: Column, read: Callable[[Column], Column] = F.to_timestamp) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text in UTC, whose trimmed zeros make its own order wrong."""
    fraction = F.rpad(F.regexp_extract(timestamp, r"\.(\d+)", 1), 9, "0").cast("bigint")
    return F.unix_seconds(read(F.regexp_replace(timestamp, r"\.\d+", ""))) * 1_000_000_000 + fraction


def timer_schedule(on_calendar: Column, on_boot: Column, on_active: Column) -> Column:
    return F.coalesce(F.nullif(on_calendar, F.lit("")), F.concat(F.coalesce(on_boot, F.lit("")), F.lit("+"), F.coalesce(on_active, F.lit(""))))


def timer_unit(unit: Column, unit_file: Column) -> Column:
    return F.coalesce(F.nullif(unit, F.lit("")), F.regexp_replace(F.substring_index(unit_file, "/", -1), r"\.timer$", ".service"))


def snapshot_id(ts: Column, raw: Column) -> Column:
    """An id of a document that a retry gives again: its time and the start of its hash."""
    return F.concat(F.lit("snap-"), F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 6))
