"""Source code and logs as text: symbols, imports, calls and complexity of Python sources, chunks, diffs, keywords, intents.

Python sources are parsed by the standard library's ast; other languages by patterns for definitions.
All are row functions, applied in Arrow batches by `each()`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.Assert, ast.comprehension, ast.match_case)
DEFINITION = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+|export\s+|public\s+|private\s+|static\s+|async\s+|default\s+)*(fn|func|function|class|struct|enum|trait|interface|def|type|impl)\s+([A-Za-z_]\w*)", re.M)
HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
#: What a word must contain to speak for an intent, intents in the order that ties prefer.
INTENTS = {
    "understand": ["how", "why", "what", "explain", "describe", "understand", "works"],
    "debug": ["fix", "bug", "error", "fail", "broken", "panic", "exception", "issue", "wrong"],
    "implement": ["add", "create", "build", "make", "implement", "new", "write", "code"],
    "refactor": ["rename", "extract", "inline", "refactor", "move", "change", "simplify", "cleanup", "restructure"],
    "document": ["document", "describe", "annotate", "comment", "explain", "spec"],
}
#: How far an intent raises the score of a chunk that matches by meaning.
BOOSTS = {"debug": 1.5, "understand": 1.2, "implement": 1.0, "refactor": 0.8, "document": 0.8, "explore": 0.5}


def each(df: DataFrame, id_col: str, text: str, f: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """One row for each tuple that f gives for a row's text; null is empty."""
    kind = dict(df.dtypes)[id_col]
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *x) for i, t in zip(b[id_col], b[text]) for x in f(t or "")], columns=names)

    return df.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, {columns}")


def parsed(source: str) -> ast.Module | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def symbols(source: str) -> list[tuple[str, str, int]]:
    """(kind, name, line) of definitions; by patterns where the source is not Python."""
    tree = parsed(source)
    if tree is None or not tree.body:
        return [(m[1], m[2], source.count("\n", 0, m.start(2)) + 1) for m in DEFINITION.finditer(source)]
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return sorted(((kinds[type(n)], n.name, n.lineno) for n in ast.walk(tree) if type(n) in kinds), key=lambda x: (x[2], x[1]))


def imports(source: str) -> list[tuple[str, int]]:
    """(module, line)."""
    tree = parsed(source)
    out = []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Import):
            out += [(a.name, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out.append(("." * n.level + (n.module or ""), n.lineno))
    return sorted(out, key=lambda x: (x[1], x[0]))


def calls(source: str) -> list[tuple[str, str, int]]:
    """(function, callee, line): calls by the definition that they stand in, `` at the top."""
    out: list[tuple[str, str, int]] = []

    def visit(node: ast.AST, inside: str) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.Call):
                f = n.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
                if name:
                    out.append((inside, name, n.lineno))
            visit(n, n.name if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) else inside)

    if tree := parsed(source):
        visit(tree, "")
    return sorted(out, key=lambda x: (x[2], x[0], x[1]))


def complexity(source: str) -> list[tuple[str, int, int]]:
    """(function, line, cyclomatic complexity): 1, and 1 for each branch and each further operand of and / or."""
    tree = parsed(source)
    out = []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            score = 1 + sum(isinstance(x, BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(n))
            out.append((n.name, n.lineno, score))
    return sorted(out, key=lambda x: (x[1], x[0]))


def diff_ranges(diff: str) -> list[tuple[str, int, int]]:
    """(path, first, last) line ranges of the new files of a unified diff; a deletion has no lines."""
    out, path = [], ""
    for line in diff.split("\n"):
        if line.startswith("+++ "):
            path = re.sub(r"^b/", "", line[4:].split("\t")[0])
        elif m := HUNK.match(line):
            n = int(m[4]) if m[4] is not None else 1
            if n:
                out.append((path, int(m[3]), int(m[3]) + n - 1))
    return out


def chunks(text: str, most: int = 2000) -> list[tuple[int, int, int, str]]:
    """(chunk, first line, last line, text): lines packed up to most characters, broken where no brace is open if possible."""
    out: list[tuple[int, int, int, str]] = []
    lines = text.split("\n")
    first, size, depth, safe = 0, 0, 0, 0
    i = 0
    while i < len(lines):
        n = len(lines[i]) + 1
        if size + n > most and i > first:
            end = safe if safe > first else i
            out.append((len(out), first + 1, end, "\n".join(lines[first:end])))
            first = i = end
            size = depth = 0
            continue
        size += n
        depth = max(0, depth + lines[i].count("{") - lines[i].count("}"))
        i += 1
        if depth == 0:
            safe = i
    if text and first < len(lines):
        out.append((len(out), first + 1, len(lines), "\n".join(lines[first:])))
    return out


def is_binary(data: bytes) -> bool:
    """A NUL byte, or over 30 % control bytes other than white space."""
    odd = sum(b < 32 and b not in b"\t\n\r\x0c\x0b" for b in data)
    return b"\x00" in data or (len(data) > 0 and odd > 0.3 * len(data))


def keyword_matches(words: list[str]) -> Callable[[str], list[tuple[str, int]]]:
    """A function to (keyword, start) of all occurrences, overlapping ones too, without regard to case."""
    built: list = []

    def find(text: str) -> list[tuple[str, int]]:
        if not built:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in dict.fromkeys(x.lower() for x in words if x):
                a.add_word(w, w)
            a.make_automaton()
            built.append(a)
        return sorted(((w, end - len(w) + 1) for end, w in built[0].iter(text.lower())), key=lambda x: (x[1], x[0])) if len(built[0]) else []

    return find


def intent(text: Column) -> Column:
    """(intent, confidence, n): the intent that most words speak for, ties as listed.

    explore counts one less than all others together, so it wins where words speak for several
    intents evenly, and where none speaks. Confidence is the winner's share of all counts, at least 0.3; 1 where none speaks.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")
    speaks = lambda parts: lambda w: w.rlike("|".join(parts))
    n = {k: F.size(F.filter(words, speaks(parts))) for k, parts in INTENTS.items()}
    total = reduce(Column.__add__, n.values())
    scores = F.array(*(F.struct(F.lit(-i).alias("last"), c.alias("n"), F.lit(k).alias("intent")) for i, (k, c) in enumerate(n.items())))
    best = F.array_max(F.transform(scores, lambda s: F.struct(s["n"].alias("n"), s["last"].alias("last"), s["intent"].alias("intent"))))
    explore = (total == 0) | (total - 1 > best["n"])
    share = F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), F.when(explore, total - 1).otherwise(best["n"]) / (2 * total - 1)))
    return F.struct(F.when(explore, F.lit("explore")).otherwise(best["intent"]).alias("intent"), share.alias("confidence"), best["n"].cast("long").alias("n"))


def semantic_weight(score: Column, intent: Column, matches: Column, boost: float = 0.2) -> Column:
    """A score raised by its query's intent where the chunk matches by meaning."""
    table = F.create_map(*[F.lit(x) for pair in BOOSTS.items() for x in pair])
    return F.when(matches, score * (1 + boost * F.try_element_at(table, intent))).otherwise(score)
