"""log_line_prefix as a regular expression that finds the database of a line, and checks of it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "%m [%p] "
# The escapes of the setting, with the text each stands for.
_SHAPES = {
    "a": r".*?", "u": r".*?", "d": r".*?", "r": r".*?", "h": r".*?", "b": r".*?", "p": r"\d*", "P": r"\d*", "t": r".*?", "m": r".*?", "n": r"[\d.]*", "i": r".*?", "e": r"[0-9A-Z]*",
    "c": r"[0-9a-f.]*", "l": r"\d*", "s": r".*?", "v": r"[\d/]*", "x": r"\d*", "Q": r"-?\d*", "L": r".*?",
}


@dataclass(frozen=True)
class Prefix:
    text: str
    pattern: str
    has_database: bool

    def database(self, message: Column | str) -> Column:
        """Database of a message (what follows the timestamp); null if unknown."""
        if not self.has_database:
            return F.lit(None).cast("string")
        found = F.nullif(F.trim(F.regexp_extract(message, self.pattern, 1)), F.lit(""))
        return F.nullif(found, F.lit("[unknown]"))


def parse_prefix(text: str = DEFAULT) -> Prefix:
    """Compiles a prefix; it must begin with %m or %t, and unknown escapes are an error."""
    parts, at = [], 0
    for m in re.finditer(r"%(-?\d+)?(.)?", text, re.S):
        parts += [("text", text[at : m.start()])] if m.start() > at else []
        code = m[2]
        if code is None:
            raise ValueError("the prefix ends within an escape")
        if code == "%":
            parts.append(("text", "%"))
        elif code == "q":
            parts.append(("optional", ""))
        elif code in _SHAPES:
            parts.append((code, m[1] or ""))
        else:
            raise ValueError(f"unknown escape %{code}")
        at = m.end()
    parts += [("text", text[at:])] if at < len(text) else []
    if not parts or parts[0][0] not in ("m", "t"):
        raise ValueError("the prefix must begin with %m or %t")
    out, optional, seen = "^", 0, False
    for kind, value in parts[1:]:
        if kind == "text":
            out += re.escape(value)
        elif kind == "optional":
            out += "(?:"
            optional += 1
        elif kind == "d" and not seen:
            out += f"\\s*({_SHAPES[kind]})\\s*" if value else f"({_SHAPES[kind]})"
            seen = True
        else:
            out += f"\\s*{_SHAPES[kind]}\\s*" if value else _SHAPES[kind]
    return Prefix(text, out + ")?" * optional + r"[A-Z]+:  ", seen)


def check_prefix(text: str) -> list[tuple[str, str, str]]:
    """(severity, code, message) of what is wrong with a prefix."""
    try:
        found = parse_prefix(text)
    except ValueError as e:
        return [("error", "prefix_invalid", str(e))]
    return [] if found.has_database else [("warning", "prefix_no_database", "without %d, groups can't tell databases apart")]


def check_auto_explain(settings: dict[str, str]) -> list[tuple[str, str, str]]:
    """Findings on the settings that fill the log."""
    out = []
    if settings.get("log_min_duration", "-1") == "-1":
        out.append(("warning", "plans_disabled", "log_min_duration is -1: no plans are logged"))
    if settings.get("log_analyze", "off") == "off":
        out.append(("warning", "no_actuals", "log_analyze is off: plans have estimates only"))
    if settings.get("log_format", "text") != "text":
        out.append(("warning", "format_not_text", f"log_format is {settings['log_format']}"))
    return out


def highest(findings: list[tuple[str, str, str]]) -> str | None:
    rank = {"info": 0, "warning": 1, "error": 2}
    return max((f[0] for f in findings), key=rank.__getitem__, default=None)
