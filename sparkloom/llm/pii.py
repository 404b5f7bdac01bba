"""PII: fixed patterns, and contextual extraction bootstrapped from what they find.

Base spans follow the four fixed patterns below. Seeds are the base entities. Every other
token with digits or an at-sign is a candidate instance, and neighbouring tokens of digits are one
candidate together. Each mention, of a seed or a candidate, induces lexical patterns from the words
beside it: the two to the left, the one to the left with the one to the right, and the one to the
left with the sign it ends with. Spark counts the distinct edges between patterns and instances and
scores both sides in turn: a pattern's confidence for a kind is the number of instances believed to
be of that kind over the number that it meets and SMOOTH; patterns with at least SUPPORT believed
instances and CONFIDENCE reach out to unseen instances, and an instance that all its sure patterns
agree on is believed from then on and supports patterns itself. Rounds end when no instance is new.
Mentions of unseen identifiers beside sure patterns of one kind become spans of that kind; base
spans always stay, and added spans never overlap them.

Defined results: a null text is empty; emails need an at-sign and thus very long texts take
linear time; words and instances of more than LONG characters stand in patterns by a hash of the
whole; numbers of any length are compared as digits; repeated rows each get a row; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, stage

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, SMOOTH, LONG = 5, 0.9, 0.5, 64
#: Sure patterns that may be sent to the tasks.
MAX_PATTERNS = 100_000
LEFT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[0-9@]")
#: A token of a number that is written in groups.
DIGITS = re.compile(r"[(+]?[0-9][0-9()./-]*[.,;:!?]?")
FOLLOWS = re.compile(r"""[.,;:!?"')\]}>]*\s*(\S+)""")
TRIM = ".,;:!?\"'()[]{}<>"
SCHEMA = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:string,start:int,end:int>>, mentions array<struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>>"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at-sign: its local part is the run of characters before it."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each dotted run of digits, parts at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans by start, then kind in the order of KINDS."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    found += [(a, 1, b) for a, b in addresses(text)]
    found += [(a, 2, b) for a, b in cards(text)]
    if "+" in text:
        found += [(a, 3, b) for a, b in phones(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def bare(word: str) -> str:
    """A word as patterns have it: small letters, numbers alike, no signs around it; a long one by its hash."""
    plain = re.sub("[0-9]+", "0", word.lower().strip(TRIM)) or word
    return plain if len(plain) <= LONG else "#" + xxhash.xxh128_hexdigest(plain.encode())


def word_before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before a place, opening signs aside, and its start; empty where there is none."""
    end = at
    while end > 0 and (text[end - 1].isspace() or text[end - 1] in "\"'([{<"):
        end -= 1
    start = end
    while start > 0 and not text[start - 1].isspace():
        start -= 1
    return text[start:end], start


def word_after(text: str, at: int) -> str:
    """The word that begins behind a place, closing signs aside."""
    m = FOLLOWS.match(text, at)
    return m[1] if m else ""


def candidate_places(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens with digits or an at-sign that no base span touches, trimmed; runs of digit tokens as one."""
    out: list[list[int]] = []
    by_start = sorted(base, key=lambda x: x[1])
    i = top = 0
    joins = False
    for m in TOKEN.finditer(text) if MARKED.search(text) else ():
        word = m[0]
        if not MARKED.search(word):
            joins = False
            continue
        a = m.start() + len(word) - len(word.lstrip(TRIM))
        b = m.end() - (len(word) - len(word.rstrip(TRIM)))
        while i < len(by_start) and by_start[i][1] < b:
            top = max(top, by_start[i][2])
            i += 1
        if a >= b or top > a:
            joins = False
            continue
        digits = bool(DIGITS.fullmatch(word))
        if digits and word[0] == "(" and ")" in word:
            a = m.start()
        if joins and digits and text[m.start() - 1] == " " and out[-1][2] == m.start() - 1:
            out[-1][1:] = [b, m.end()]
        else:
            out.append([a, b, m.end()])
        joins = digits
    return [(a, b) for a, b, _ in out]


def mentions_of(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and candidates with the lexical patterns beside them."""
    out = []
    for kind, a, b in [*base, *((None, a, b) for a, b in candidate_places(text, base))]:
        one, at = word_before(text, a)
        two, _ = word_before(text, at)
        follow = word_after(text, b)
        patterns = []
        if two:
            patterns.append(f"{bare(two)} {bare(one)} _")
        if one and follow:
            patterns.append(f"{bare(one)} _ {bare(follow)}")
        if one and not one[-1].isalnum():
            patterns.append(f"{bare(one)}{one[-1]} _")
        instance = text[a:b]
        if kind or patterns:
            out.append({"kind": kind, "start": a, "end": b, "instance": instance if b - a <= LONG else "#" + xxhash.xxh128_hexdigest(instance.encode()), "patterns": sorted(set(patterns))})
    return out


def extracted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: counts, base spans and mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            out = []
            for row, doc, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                out.append({"row": row, "doc_id": doc, **{f"n_{k}": kinds.count(k) for k in KINDS}, "base": [{"kind": k, "start": x, "end": y} for k, x, y in base], "mentions": mentions_of(text, base)})
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.list_(pa.struct(span))), ("mentions", pa.list_(pa.struct([*span, ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])))])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def sure_patterns(mentions: DataFrame) -> DataFrame:
    """(pattern, kind) of the patterns that the rounds accept; mentions: kind, instance, patterns."""
    edges = stage(mentions.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("instance", "pattern").agg(F.max("kind").alias("kind")), "edges")
    total = stage(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")), "totals")
    believed = stage(edges.where("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("as_kind")), "believed")
    while True:
        by_kind = edges.select("instance", "pattern").join(believed, "instance").groupBy("pattern", "as_kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
        accepted = stage(by_kind.join(total, "pattern").where(F.col("n") >= CONFIDENCE * (F.col("total") + SMOOTH)).select("pattern", F.col("as_kind").alias("kind")), "patterns")
        reached = edges.select("instance", "pattern").join(accepted, "pattern").groupBy("instance").agg(F.min("kind").alias("as_kind"), F.max("kind").alias("other")).where("as_kind = other").select("instance", "as_kind")
        new = stage(reached.join(believed.select("instance"), "instance", "left_anti"), "reached")
        if new.isEmpty():
            return accepted
        believed = stage(believed.unionByName(new), "believed")


def joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(spans: F.Column) -> F.Column:
    """Spans by start, then kind as listed, then end."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("nth"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts, base and spans (arrays of kind, start, end)."""
    found = stage(extracted(docs, id_col, text_col), "pii")
    mentions = found.select("row", F.inline("mentions"))
    accepted = sure_patterns(mentions)
    new = mentions.where("kind IS NULL").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    added = new.join(accepted, "pattern").groupBy("row", "start", "end").agg(F.min("kind").alias("kind"), F.max("kind").alias("other")).where("kind = other")
    by_row = added.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # as many as the text has
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    spans = in_order(F.concat("base", F.coalesce("added", none)))
    return found.drop("mentions").join(by_row, "row", "left").select("doc_id", *(f"n_{k}" for k in KINDS), "base", spans.alias("spans"))


def pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts, base_sha256 and spans as text."""
    return find_pii(docs).select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans, one mark for what they cover together."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced, n_chars counted anew where there is one; other columns as they were.

    The sure patterns are counted: up to MAX_PATTERNS go to the tasks, which find and mask spans row
    by row; with more of them, spans are found by joins and meet their rows by a staged row key.
    """
    found = stage(extracted(docs, "doc_id", "text").select("mentions"), "mentions")
    accepted = sure_patterns(found.select(F.inline("mentions")))
    return masked_rows(docs, accepted) if accepted.count() <= MAX_PATTERNS else masked_by_join(docs)


def all_spans(text: str, kinds: dict[str, set[str]]) -> list[tuple[str, int, int]]:
    """Base spans and those that sure patterns add: mentions all of whose sure patterns agree on a kind."""
    base = base_spans(text)
    added = []
    for m in mentions_of(text, base) if kinds else ():
        agreed = set().union(*(kinds.get(p, ()) for p in m["patterns"])) if m["kind"] is None else ()
        if len(agreed) == 1:
            added.append((next(iter(agreed)), m["start"], m["end"]))
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def with_text(docs: DataFrame, text: F.Column) -> DataFrame:
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def masked_rows(docs: DataFrame, accepted: DataFrame) -> DataFrame:
    kinds: dict[str, set[str]] = {}
    for r in accepted.collect():
        kinds.setdefault(r["pattern"], set()).add(r["kind"])

    @F.pandas_udf("string")
    def replaced(text: pd.Series) -> pd.Series:
        return pd.Series([masked(t, all_spans(t, kinds)) for t in text], dtype=object)

    marked = F.col("text").rlike("[0-9@]")  # no span is without one
    return with_text(docs, F.when(marked, replaced(F.when(marked, F.col("text")).otherwise(""))).otherwise(F.col("text")))


def masked_by_join(docs: DataFrame) -> DataFrame:
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "unmasked")  # the columns keep their names apart
    spans = find_pii(keyed.select("row", F.col("doc.text").alias("text")), id_col="row").where(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")

    @F.pandas_udf("string")
    def replaced(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else masked(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(text, found)], dtype=object)

    hit = keyed.join(spans, "row", "left").select(F.col("doc").withField("text", replaced("doc.text", "spans")).alias("doc"))
    return with_text(hit.select("doc.*"), F.col("text"))
