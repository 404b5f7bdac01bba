"""Toxicity: a support vector machine over a subsequence string kernel with Nystrom landmarks.

A sentence is scored by its units: words without the punctuation around them, runs of single
characters that spaces set apart, and overlapping windows of over-long words. The kernel counts
the 3-character subsequences that two units share, each weighted by DECAY to the power of its
span, so gaps and inserted characters cost little; it is normalised by the units' own kernels.
Nystrom landmarks give the feature map, and a squared-hinge SVM is fit on it. As the kernel is
an inner product over explicit subsequences, the fitted function is one table of weights by
subsequence, and scoring a unit is a sum over its triples: exactly the kernel expansion.

Training: labels belong to documents. The labelled rows of the training folds, at most
MAX_LABELLED of them, are counted: documents with each unit, by label. Units that mark toxic
documents by log-likelihood ratio are candidates, whole or as a stem of STEM characters; a greedy
cover of at most MAX_TOXIC toxic documents picks those that explain them, so that words which
merely stand in copies of a toxic document are left out. Negatives are units of clean documents: a bounded draw by hash and, in ROUNDS, those the last model liked most.
A logistic curve over at most about MAX_CURVE training documents turns a document's highest
unit into its score.

Defined results: a null or empty text, or one without units, has the lowest unit value; null
labels and null ids are not trained on, a null id is not held out; without rows of
both labels, or without a unit that marks toxic ones, no document is predicted toxic; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, let_go, stage

DECAY = 0.7
SIZES = (8, 12, 16, 26)
LONGEST = SIZES[-1] - 2
CODES = 64
HELD_OUT_FOLD, FOLDS = 2, 4
THRESHOLD = 0.3
#: Bounds of what training gathers: candidates, documents to cover, negatives, documents of the curve.
MAX_CANDIDATES, MAX_TOXIC, MAX_NEGATIVES, MAX_CURVE = 3000, 6000, 3000, 8000
#: Labelled rows that are trained on, at most, the lowest ids by hash: a bounded table, which may be broadcast.
MAX_LABELLED = 100_000
#: Positives that are also shown with gaps, and inflected forms taken from stems.
MAX_GAPPED, MAX_INFLECTED = 60, 300
LANDMARKS = 256
ROUNDS = 2
FLOOR = -3.0
STEM = 5
CACHE_UNITS = 400_000
SINGLES = re.compile(r"(?:(?<=\s)|^)\S(?:\s\S){2,}(?=[.,;:!?]*(?:\s|$))")
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"


@cache
def code_of(char: str) -> int:
    """1 to 26 for a to z, then digits, accented letters and all else by residues; 0 and 63 mark the ends."""
    if "a" <= char <= "z":
        return ord(char) - 96
    if "0" <= char <= "9":
        return ord(char) - 48 + 27
    return 37 + ord(char) % 20 if char.isalpha() else 57 + ord(char) % 6


def units_of(text: str) -> list[str]:
    """The distinct units of a text, short and long."""
    low = text.lower()
    found = {w.strip(EDGES) for w in set(low.split())}
    found.update("".join(m[0].split()) for m in SINGLES.finditer(low))
    found.discard("")
    out = []
    for w in found:
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)]
    return out


def with_stems(text: str) -> set[str]:
    """The units, and the stems of the longer ones with a mark that no unit ends with."""
    units = set(units_of(text))
    return units | {u[:STEM] + "~" for u in units if len(u) > STEM}


def padded(units: list[str], n: int) -> np.ndarray:
    codes = np.full((len(units), n), -1, np.int32)
    for i, u in enumerate(units):
        codes[i, : len(u) + 2] = [0, *map(code_of, u), CODES - 1]
    return codes


@cache
def triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    i, j, k = (np.array(x) for x in zip(*((i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n))))
    return i, j, k, DECAY ** (k - i + 1.0)


def own_kernel(codes: np.ndarray) -> np.ndarray:
    """The kernel of each row with itself, by dynamic programming over all rows at once."""
    rows, n = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]) & (codes >= 0)[:, :, None]
    same = np.ascontiguousarray(np.moveaxis(same, 0, -1)).astype(np.float64) * DECAY**2
    last = np.ones((n + 1, n + 1, rows))
    for _ in range(2):
        now = np.zeros((n + 1, n + 1, rows))
        for i in range(1, n + 1):
            run = np.zeros(rows)
            for j in range(1, n + 1):
                run = DECAY * run + same[i - 1, j - 1] * last[i - 1, j - 1]
                now[i, j] = DECAY * now[i - 1, j] + run
        last = now
    return (same * last[:-1, :-1]).sum(axis=(0, 1))


def triple_sums(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each row, the sum over its subsequences of their weight in the table times their decay."""
    out = np.zeros(len(codes))
    i, j, k, decay = triples(codes.shape[1])
    for lo in range(0, len(codes), 512):
        c = codes[lo : lo + 512]
        at = (c[:, i] * CODES + c[:, j]) * CODES + c[:, k]
        at[c[:, k] < 0] = CODES**3  # padding stands last, so the third is padding if any is
        out[lo : lo + 512] = table[at] @ decay
    return out


def by_size(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, codes) of the units, padded to one of SIZES."""
    length = np.array([len(u) + 2 for u in units])
    low = 0
    for n in SIZES:
        at = np.flatnonzero((length > low) & (length <= n))
        low = n
        for lo in range(0, len(at), 2048):
            part = at[lo : lo + 2048]
            yield part, padded([units[x] for x in part], n)


def kernel_column(units: list[str], table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units))
    for at, codes in by_size(units):
        out[at] = triple_sums(codes, table) / np.sqrt(np.maximum(own_kernel(codes), 1e-12))
    return out


def subsequences(unit: str) -> np.ndarray:
    """A unit's normalised feature vector as a table over subsequences (and a last entry for padding)."""
    table = np.zeros(CODES**3 + 1)
    codes = padded([unit], len(unit) + 2)
    if len(unit) >= 1:
        i, j, k, decay = triples(codes.shape[1])
        c = codes[0]
        np.add.at(table, (c[i] * CODES + c[j]) * CODES + c[k], decay)
    return table / max(np.sqrt((table**2).sum()), 1e-12)


class Prepared:
    """Units with the places of their triples and their lengths, for kernels with many landmarks."""

    def __init__(self, units: list[str]):
        self.n, self.parts = len(units), []
        for at, codes in by_size(units):
            i, j, k, decay = triples(codes.shape[1])
            places = ((codes[:, i] * CODES + codes[:, j]) * CODES + codes[:, k]).astype(np.int32)
            places[codes[:, k] < 0] = CODES**3
            self.parts.append((at, places, decay, np.sqrt(np.maximum(own_kernel(codes), 1e-12))))

    def column(self, landmark: str) -> np.ndarray:
        table, out = subsequences(landmark), np.zeros(self.n)
        for at, places, decay, length in self.parts:
            out[at] = table[places] @ decay / length
        return out


def gapped(unit: str) -> list[str]:
    """The unit as it is written to slip past filters: separated, and with a character put in."""
    middle = len(unit) // 2
    out = [unit[:middle] + c + unit[middle:] for c in "*x."]
    if 2 * len(unit) - 1 <= LONGEST:
        out += [".".join(unit), "-".join(unit)]
    return [x for x in out if len(x) <= LONGEST]


@dataclass
class Model:
    """weights: by subsequence; curve: slope and offset from a document's highest unit to its log odds."""

    weights: np.ndarray
    bias: float
    curve: tuple[float, float] = (1.0, 0.0)
    known: dict = field(default_factory=dict)

    def units(self, units: list[str]) -> np.ndarray:
        return kernel_column(units, self.weights) + self.bias

    def highest(self, texts: list[str]) -> np.ndarray:
        """The highest unit of each text."""
        lists = [units_of(t) for t in texts]
        new = sorted(set().union(*lists).difference(self.known))
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
            new = sorted(set().union(*lists))
        self.known.update(zip(new, self.units(new).tolist()))
        get = self.known.__getitem__
        return np.array([max(map(get, x), default=FLOOR) for x in lists])

    def score(self, texts: list[str]) -> np.ndarray:
        a, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * self.highest(texts) + c, -30, 30)))


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights and bias (last) of a squared-hinge SVM by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        short = 1 - y * (x @ w)
        on = short > 0
        gradient = penalty @ w - x[on].T @ (weight[on] * y[on] * short[on])
        step = np.linalg.solve(penalty + (x[on] * weight[on, None]).T @ x[on], gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_units(positive: list[str], negative: list[str]) -> Model:
    """Fit on Nystrom landmarks: of each side the first, which explain or mislead most, then those farthest from the ones before; both sides weigh alike."""
    spread = sorted({g for p in positive[:MAX_GAPPED] for g in gapped(p)} - set(positive) - set(negative))
    units = [*positive, *spread, *negative]
    rows = Prepared(units)
    landmarks: list[str] = []
    columns: list[np.ndarray] = []
    for pool, lo in ((positive, 0), (negative, len(units) - len(negative))):
        near = np.zeros(len(pool))
        for i in range(min(LANDMARKS // 2, len(pool))):
            at = i if i < LANDMARKS // 4 else int(np.argmin(near))
            if near[at] > 0.95:
                continue
            landmarks.append(pool[at])
            columns.append(rows.column(pool[at]))
            near = np.maximum(near, columns[-1][lo : lo + len(pool)])
    kernel = np.stack(columns, axis=1)
    of = {u: i for i, u in enumerate(units)}
    among = kernel[[of[u] for u in landmarks]]
    among = (among + among.T) / 2
    value, vector = np.linalg.eigh(among)
    root = vector @ np.diag(np.where(value > 1e-8, 1 / np.sqrt(np.maximum(value, 1e-8)), 0)) @ vector.T
    x = kernel @ root
    y = np.array([1.0] * (len(positive) + len(spread)) + [-1.0] * len(negative))
    even = max(1.0, len(negative) / (len(positive) + 0.5 * len(spread)))
    share = np.array([even] * len(positive) + [even / 2] * len(spread) + [1.0] * len(negative))
    w = fit_svm(x, y, share)
    beta = root @ w[:-1]
    return Model(sum(b * subsequences(u) for b, u in zip(beta, landmarks)), float(w[-1]))


def cover(documents: list[frozenset[int]], order: list[int]) -> list[int]:
    """Candidates that explain the documents: again and again the one in most unexplained ones, ties as in order."""
    rank = {c: i for i, c in enumerate(order)}
    left = [d for d in documents if d]
    out = []
    while left:
        n = Counter(c for d in left for c in d)
        best = min(n, key=lambda c: (-n[c], rank[c]))
        if n[best] < 2:
            break
        out.append(best)
        left = [d for d in left if best not in d]
    return out


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    w = np.zeros(2)
    z = np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def nothing_learned(n_pos: int, n_neg: int) -> Model:
    """One score for all: the share of toxic training rows, but never enough to reject a document."""
    p = min(max(n_pos / max(1, n_pos + n_neg), 1e-6), THRESHOLD / 2)
    return Model(np.zeros(CODES**3 + 1), FLOOR, (0.0, float(np.log(p / (1 - p)))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id and text; labels: doc_id and toxic."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & (fold != HELD_OUT_FOLD)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))
    rows = stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked, "doc_id"), "labelled")
    total = dict(rows.groupBy("toxic").count().collect())
    n_pos, n_neg = total.get(1, 0), total.get(0, 0)
    if not n_pos or not n_neg:
        return nothing_learned(n_pos, n_neg)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in arrow_rows(batches):
            pos, neg = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                (pos if toxic else neg).update(with_stems(text))
            found = sorted(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([pos[u] for u in found], pa.int64()), pa.array([neg[u] for u in found], pa.int64())], names=["unit", "pos", "neg"])

    counts = stage(rows.select("text", "toxic").mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "units")
    share = F.lit(n_pos / (n_pos + n_neg))
    n = F.col("pos") + F.col("neg")
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    surprise = 2 * (term(F.col("pos"), n * share) + term(F.col("neg"), n * (1 - share)))
    ratio = ((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1))
    found = counts.where((F.col("pos") >= 2) & (ratio >= 4)).select("unit", surprise.alias("g2")).where("g2 > 10.83").orderBy(F.desc("g2"), "unit").limit(MAX_CANDIDATES).collect()
    candidates = [r["unit"] for r in found]
    index = {u: i for i, u in enumerate(candidates)}

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(index[u] for u in with_stems(t) if u in index) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["has"])

    part = lambda most, n: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / n))
    toxic = rows.where("toxic = 1").where(part(MAX_TOXIC, n_pos)).select("text").distinct()
    chosen = cover([frozenset(r["has"]) for r in toxic.mapInArrow(explain, "has array<int>").collect()], list(range(len(candidates))))
    picked = [candidates[i] for i in chosen]
    stems = [u[:-1] for u in picked if u.endswith("~")]
    positive = [u for u in picked if not u.endswith("~")]
    inflected = counts.where(F.substring("unit", 1, STEM).isin(stems) & (ratio >= 4) & ~F.col("unit").endswith("~"))
    seen = set(positive)
    positive += [r["unit"] for r in inflected.orderBy(F.desc("pos"), "unit").limit(MAX_INFLECTED).collect() if r["unit"] not in seen]
    if not positive:
        return nothing_learned(n_pos, n_neg)
    clean = counts.where((F.col("neg") > 0) & ~F.col("unit").isin(positive) & ~F.col("unit").endswith("~")).where(ratio < 4)
    negative = [r["unit"] for r in clean.orderBy(F.xxhash64("unit"), "unit").limit(MAX_NEGATIVES).select("unit").collect()]
    model = fit_units(positive, negative)
    for _ in range(ROUNDS):
        now = model

        def like(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("unit"), pa.array(now.units(b.column("unit").to_pylist()))], names=["unit", "value"])

        hard = [r["unit"] for r in clean.select("unit").mapInArrow(like, "unit string, value double").where("value > -0.9").orderBy(F.desc("value"), "unit").limit(MAX_NEGATIVES // 4).collect()]
        new = sorted(set(hard).difference(negative))
        if not new:
            break
        negative = new + negative
        model = fit_units(positive, negative)
    sample = score(rows.where(part(MAX_CURVE, n_pos + n_neg)), model, ["toxic"]).select("highest", "toxic").collect()
    model.curve = fit_curve(np.array([r["highest"] for r in sample]), np.array([r["toxic"] for r in sample], float))
    model.known = {}
    return model


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns (of type long or int) with highest and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        own = Model(model.weights, model.bias, model.curve)
        a, c = own.curve
        for b in arrow_rows(batches):
            top = own.highest([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(top), pa.array(1 / (1 + np.exp(-np.clip(a * top + c, -30, 30))))], names=[*keep, "highest", "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "highest double", "score double"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score(d, train(d, labels), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with their columns; decided row by row, without a join."""
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)

    @F.arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        own = Model(model.weights, model.bias, model.curve)
        for texts in batches:
            parts = arrow_rows([pa.RecordBatch.from_arrays([texts], names=["text"])])
            scores = [own.score(b.column("text").to_pylist()) for b in parts]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return docs.where(value(F.coalesce("text", F.lit(""))) < THRESHOLD)
