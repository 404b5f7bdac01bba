"""Two small query languages, parsed on the driver to Column expressions.

filter_column: `field op value [AND field op value ...]` over a whitelist of fields.
boolean_column: `field:value` terms with AND, OR, NOT and parentheses; AND is implied.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = re.compile(r"\s*(\w+)\s*(>=|<=|!=|>|<|=|(?i:like)\b)\s*('(?:[^']|'')*'|\"[^\"]*\"|[^\s].*?)\s*$")


def filter_column(text: str, fields: dict[str, str]) -> Column:
    """fields: from name or alias to column. Values compare as numbers if they look like numbers; LIKE ignores case."""
    out = []
    for part in re.split(r"(?i)\s+and\s+", text.strip()) if text.strip() else []:
        m = TERM.match(part)
        if not m or m[1].lower() not in fields:
            raise ValueError(f"not a condition: {part!r}")
        column, op, raw = F.col(fields[m[1].lower()]), m[2].lower(), m[3]
        quoted = raw[0] in "'\""
        raw = raw[1:-1].replace("''", "'") if quoted else raw
        value = F.lit(float(raw)) if not quoted and re.fullmatch(r"-?\d+(\.\d+)?", raw) else F.lit(raw)
        if op == "like":
            pattern = raw if "%" in raw or "_" in raw else f"%{raw}%"
            out.append(column.ilike(pattern))
        else:
            out.append({">=": column >= value, "<=": column <= value, "!=": column != value, ">": column > value, "<": column < value, "=": column == value}[op])
    return reduce(lambda a, b: a & b, out, F.lit(True))


def tokenize(text: str) -> list[str]:
    """Parentheses, and words that may hold quoted parts with spaces."""
    return re.findall(r"[()]|(?:\"[^\"]*\"|[^\s()\"])+", text)


def normalize(text: str) -> str:
    """Canonical text: one space between tokens, operators in capitals, implied ANDs written out."""
    out: list[str] = []
    for t in tokenize(text):
        word = t.upper() if t.upper() in ("AND", "OR", "NOT") else t
        if out and word not in ("AND", "OR", ")") and out[-1] not in ("AND", "OR", "NOT", "("):
            out.append("AND")
        out.append(word)
    return " ".join(out).replace("( ", "(").replace(" )", ")")


def boolean_column(text: str, fields: dict[str, str]) -> Column:
    """NOT binds closest, then AND, then OR. A term is equality without regard to case; a bare word stands in any field."""
    tokens = tokenize(normalize(text).replace("(", "( ").replace(")", " )"))
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def term() -> Column:
        t = take() if peek() else ""
        if t == "NOT":
            return ~F.coalesce(term(), F.lit(False))
        if t == "(":
            inner = either()
            if not peek():
                raise ValueError("a parenthesis is not closed")
            take()
            return inner
        if t in ("", ")", "AND", "OR"):
            raise ValueError(f"a term is missing in {text!r}")
        name, colon, value = t.partition(":")
        value = (value if colon else name).strip('"')
        if colon:
            if name.lower() not in fields:
                raise ValueError(f"unknown field: {name!r}")
            return F.lower(F.col(fields[name.lower()]).cast("string")) == value.lower()
        return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(value.lower())), F.lit(False)) for c in dict.fromkeys(fields.values())))

    def both() -> Column:
        out = term()
        while peek() == "AND":
            take()
            out = out & term()
        return out

    def either() -> Column:
        out = both()
        while peek() == "OR":
            take()
            out = out | both()
        return out

    if not tokens:
        return F.lit(True)
    out = either()
    if peek():
        raise ValueError(f"unexpected {peek()!r}")
    return out
