"""Expressions over server-log lines: timestamps, time zones, durations, cost tuples, indentation. JVM-side only."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of log lines.
LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?: (?:[A-Z]{2,5}|[+-]\d{2}(?::?\d{2})?))?)(.*)"
LINE_START = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}"
DURATION = r"duration: ([\d.]+) ms\s+plan:\s*$"
COST = r"\(cost=([\d.]+)\.\.([\d.]+)\s+rows=(\d+)\s+width=(\d+)\)"
ACTUAL = r"\(actual(?:\s+time=([\d.]+)\.\.([\d.]+))?\s+rows=([\d.]+)\s+loops=(\d+)\)"
# Offsets of time-zone abbreviations from UTC, in half hours.
ZONES = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "ZULU": 0, "WET": 0,
    "HST": -20, "AKST": -18, "PST": -16, "AKDT": -16, "PDT": -14, "MST": -14, "MDT": -12, "CST": -12, "CDT": -10, "EST": -10, "EDT": -8, "AST": -8, "CLT": -8, "NST": -7,
    "BRT": -6, "ART": -6,
    "CET": 2, "BST": 2, "WEST": 2, "WAT": 2, "CEST": 4, "EET": 4, "SAST": 4, "CAT": 4, "EEST": 6, "MSK": 6, "EAT": 6,
    "PKT": 10, "IST": 11, "ICT": 14, "WIB": 14, "HKT": 16, "SGT": 16, "AWST": 16, "JST": 18, "KST": 18, "ACST": 19, "AEST": 20, "AEDT": 22, "NZST": 24, "NZDT": 26,
}


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_line_start(line: Column | str) -> Column:
    return _c(line).rlike(LINE_START)


def timestamp_text(line: Column | str) -> Column:
    """The timestamp with its zone that a line begins with; null for a continuation line."""
    return F.nullif(F.regexp_extract(line, LINE, 1), F.lit(""))


def message(line: Column | str) -> Column:
    """What follows the timestamp; null for a continuation line."""
    return F.when(timestamp_text(line).isNotNull(), F.regexp_extract(line, LINE, 2))


def numeric_offset(token: Column | str) -> Column:
    """Seconds of +HH, +HHMM, +HH:MM (and with minus); null if hours exceed 15 or minutes 59."""
    token = _c(token)
    shape = r"^([+-])([0-9]{2})(?::?([0-9]{2}))?$"
    hours = F.regexp_extract(token, shape, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(token, shape, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(token, shape, 1) == "-", -1).otherwise(1)
    return F.when((hours <= 15) & (minutes <= 59), sign * (hours * 3600 + minutes * 60))


def zone_offset(token: Column | str, overrides: dict[str, int] | None = None, fixed: int | None = None) -> Column:
    """Seconds east of UTC of a zone token: numeric offset, else override, else a fixed offset, else the table; unknown ones count as UTC."""
    token = _c(token)
    table = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v * 1800)])
    steps = [numeric_offset(token)]
    if overrides:
        steps.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv]), token))
    if fixed is not None:
        steps.append(F.lit(fixed))
    return F.coalesce(*steps, F.try_element_at(table, token), F.lit(0))


def utc_timestamp(text: Column | str, overrides: dict[str, int] | None = None, fixed: int | None = None) -> Column:
    """UTC time (timestamp_ntz) of a timestamp with or without zone; null if it can't be read."""
    text = F.trim(_c(text))
    core = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1)
    token = F.nullif(F.trim(F.substring(text, F.length(core) + 1, F.lit(100))), F.lit(""))
    wall = core.try_cast("timestamp_ntz")
    return F.when(token.isNull(), wall).otherwise(wall - F.make_dt_interval(secs=zone_offset(token, overrides, fixed)))


def duration_ms(line: Column | str) -> Column:
    return F.regexp_extract(line, DURATION, 1).try_cast("double")


def indent(line: Column | str) -> Column:
    """Leading white space in characters."""
    return F.length(F.regexp_extract(line, r"^[\s\p{Z}]*", 0))


def plan_level(line: Column | str) -> Column:
    """Level of a plan line: leading spaces halved."""
    return F.floor(F.length(F.regexp_extract(line, r"^ *", 0)) / 2).cast("int")


def plan_text_of(indents: Column | str, contents: Column | str) -> Column:
    """The text of a plan from arrays of its lines' indents in characters and contents."""
    return F.array_join(F.zip_with(indents, contents, lambda n, c: F.concat(F.repeat(F.lit(" "), n), c)), "\n")


def cost_tuple(line: Column | str) -> Column:
    """struct of startup and total cost, rows and width; null if the line has no cost."""
    part = lambda i, kind: F.regexp_extract(line, COST, i).try_cast(kind)
    return F.when(_c(line).rlike(COST), F.struct(part(1, "double").alias("startup_cost"), part(2, "double").alias("total_cost"), part(3, "bigint").alias("est_rows"), part(4, "int").alias("width")))


def actuals(line: Column | str) -> Column:
    """struct of actual time, rows (rounded) and loops; null if the line has none."""
    part = lambda i, kind: F.regexp_extract(line, ACTUAL, i).try_cast(kind)
    return F.when(_c(line).rlike(ACTUAL), F.struct(part(2, "double").alias("actual_time_ms"), F.round(part(3, "double")).cast("bigint").alias("actual_rows"), part(4, "int").alias("actual_loops")))


def looks_like_json(text: Column | str) -> Column:
    return F.ltrim(_c(text)).rlike(r"^[\[{]")


def plan_format(text: Column | str) -> Column:
    """json if the text is valid JSON that begins an object or array, else text."""
    return F.when(looks_like_json(text) & F.try_parse_json(_c(text)).isNotNull(), "json").otherwise("text")


def parse_since(text: str, now: datetime | None = None) -> datetime:
    """An absolute time, a date, or an age such as 2h, 3d, 1w before now; naive UTC."""
    for shape in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d"):
        try:
            return datetime.strptime(text, shape)
        except ValueError:
            pass
    m = re.fullmatch(r"(\d+)([smhdw])", text)
    if not m:
        raise ValueError(f"no date or age: {text!r}")
    unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[m[2]]
    try:
        return (now or datetime.now(UTC).replace(tzinfo=None)) - timedelta(**{unit: int(m[1])})
    except OverflowError as e:
        raise ValueError(f"out of range: {text!r}") from e


def parse_interval(text: str) -> float:
    """Seconds of 500ms, 30s, 5m or 2h; finite and not negative."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h)\s*", text)
    if not m:
        raise ValueError(f"no interval: {text!r}")
    return float(m[1]) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[m[2]]
