"""Scalar expressions: paths, code words, money, hashes, decay."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "pyw": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "go": "go", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby", "sh": "shell", "bash": "shell", "zsh": "shell",
    "sql": "sql", "md": "markdown", "markdown": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "html": "html", "css": "css",
}
#: Multipliers and currencies by word.
MULTIPLIERS = {"thousand": 1e3, "mil": 1e3, "million": 1e6, "millions": 1e6, "milhão": 1e6, "milhões": 1e6, "billion": 1e9, "billions": 1e9, "bilhão": 1e9, "bilhões": 1e9, "k": 1e3, "m": 1e6, "b": 1e9, "bn": 1e9}
CURRENCIES = {"R$": "BRL", "US$": "USD", "$": "USD", "€": "EUR", "£": "GBP", "BRL": "BRL", "USD": "USD", "EUR": "EUR", "GBP": "GBP", "reais": "BRL", "dollars": "USD", "euros": "EUR"}


def language(path: str | Column) -> Column:
    """The language by what follows the last point (all of it without a point); null if unknown."""
    p = F.col(path) if isinstance(path, str) else path
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.element_at(F.split(p, "[.]"), -1))


def glob_regex(pattern: str) -> str:
    """A glob over paths as a regular expression: ** crosses folders, * and ? do not."""
    out, i = "^", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return out + "$"


def code_words(text: str | Column) -> Column:
    """Lower-case words of an identifier or path: parted at signs, after a small letter or digit before a capital, and before the last capital of an acronym of two or more."""
    t = F.col(text) if isinstance(text, str) else text
    humps = F.regexp_replace(t, "([\\p{Ll}0-9])(?=\\p{Lu})", "$1 ")
    parted = F.regexp_replace(humps, "(?<![\\p{IsAlphabetic}\\p{N}])(\\p{Lu}{2,}|[\\p{Lu}&&[^A-Z]])(?=\\p{Lu}\\p{Ll})", "$1 ")
    return F.filter(F.split(F.lower(parted), "[^\\p{IsAlphabetic}\\p{N}]+"), lambda w: F.length(w) > 0)


def half_life(age: Column, half: float) -> Column:
    return F.pow(F.lit(0.5), age / half)


def heat(edits: Column, age: Column, half: float, blast: Column) -> Column:
    """edits * 0.5^(age / half) * (1 + blast)."""
    return edits * half_life(age, half) * (1 + blast)


def weekly_decay(weeks: Column) -> Column:
    return 1 / (1 + F.greatest(F.lit(0.01), weeks))


NUMBER = r"\d{1,3}(?:[.,]\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d+)?"
MONEY = re.compile(rf"(?P<sign>R\$|US\$|\$|€|£)\s?(?P<a>{NUMBER})(?:\s?(?P<ma>thousand|millions?|billions?|milhão|milhões|bilhão|bilhões|mil|bn|[kKmMbB])\b)?|(?<![\w.,])(?P<b>{NUMBER})\s?(?:(?P<mb>thousand|millions?|billions?|milhão|milhões|bilhão|bilhões|mil)\s)?(?:de\s)?(?P<word>BRL|USD|EUR|GBP|reais|dollars|euros)\b")


def plain_number(text: str) -> float:
    """A number with points and commas: the last sign of two kinds, or one with other than three digits after it, is decimal."""
    dot, comma = text.rfind("."), text.rfind(",")
    if dot >= 0 and comma >= 0:
        decimal = "." if dot > comma else ","
    else:
        sign = "." if dot >= 0 else ","
        at = max(dot, comma)
        decimal = sign if at >= 0 and text.count(sign) == 1 and len(text) - at - 1 != 3 else ""
    other = text.replace("." if decimal != "." else ",", "")
    return float(other.replace(decimal, ".") if decimal else other)


def money_of(text: str) -> list[dict]:
    """Amounts with currency, by start; percentages are no amounts. start counts UTF-8 bytes."""
    out = []
    for m in MONEY.finditer(text or ""):
        number = m["a"] or m["b"]
        if text[m.end() : m.end() + 2].lstrip().startswith("%"):
            continue
        times = MULTIPLIERS.get((m["ma"] or m["mb"] or "").lower(), 1.0)
        currency = CURRENCIES[m["sign"] or m["word"]]
        confidence = 0.95 if m["sign"] else 0.85
        out.append({"amount": plain_number(number) * times, "currency": currency, "confidence": confidence, "start": len(text[: m.start()].encode()), "raw": m[0]})
    return out


def money(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each amount: id, amount, currency, confidence, start, raw."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{id_col: i, **x} for i, t in zip(b[id_col], b[text]) for x in money_of(t)]
            yield pd.DataFrame(rows, columns=[id_col, "amount", "currency", "confidence", "start", "raw"])

    # most texts have no sign of money: the scan's rows are thinned before they leave the JVM
    likely = df.select(id_col, text).where(F.col(text).rlike("[$€£]|BRL|USD|EUR|GBP|reais|dollars|euros"))
    return likely.mapInPandas(run, f"{id_col} {kind}, amount double, currency string, confidence double, start long, raw string")
