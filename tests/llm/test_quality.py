import math
import random
import re
from collections import Counter

import pytest
import xxhash

from sparkloom.llm import quality as Q


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def plain_grams(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(x) for x in w]
    m = (1 << 64) - 1
    out = list(h)
    for a, b in zip(h, h[1:]):
        p = (a * 0x9E3779B97F4A7C15 + b) & m
        p ^= p >> 31
        out.append(p * 0xBF58476D1CE4E5B9 & m)
    return [x >> 49 for x in out]


def made(rnd):
    bits = ["a", "bb", "é", "#x", "|", "日本", "Z%", "\n", "\t", "\n\n", "  ", "\xa0y", "\x1c"]
    return " ".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))


def test_against_brute_force(spark, docs):
    rnd = random.Random(1)
    texts = [None, "", " \n ", "x" * 50_000, "one two three four five six seven eight " * 4] + [made(rnd) for _ in range(120)]
    texts += texts[5:15]
    labels = [(i, i % 2) for i in range(0, 60)] + [(70, None), (None, 1)]
    got = {r["doc_id"]: r for r in Q.quality(docs(texts), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(plain_grams(t))
        if i < 60 and i % 2:
            good.update(plain_grams(t))
    n_raw, n_good = raw.total() + Q.SMOOTH * Q.BUCKETS, good.total() + Q.SMOOTH * Q.BUCKETS
    for i, t in enumerate(texts):
        r, g = got[i], plain_grams(t)
        want = sum(math.log((good[x] + Q.SMOOTH) / n_good) - math.log((raw[x] + Q.SMOOTH) / n_raw) for x in g) / len(g) if g else 0.0
        assert tuple(r[c] for c in (*Q.FIVE, "base_failed")) == plain_base(t), t
        assert r["llr"] == pytest.approx(want, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= Q.THRESHOLD)


def test_no_trusted_and_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["kept"] for r in Q.quality(docs([" ".join(map(str, range(30)))]), none).collect()] == [True]
    assert Q.quality(docs([]), none).count() == 0


def test_all_trusted_rows_count(spark, docs, monkeypatch):
    """More trusted ids than are broadcast at once: the target is counted over all of them."""
    rnd = random.Random(4)
    texts = [made(rnd) for _ in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(90)] + [(1, 1)], "doc_id long, quality int")
    rows = lambda: {r["doc_id"]: r["llr"] for r in Q.quality(docs(texts), labels).collect()}
    want = rows()
    monkeypatch.setattr(Q, "MAX_TRUSTED", 7)
    assert rows() == want
    good = Q.counts(Q.id_and_bytes(docs(texts)), Q.trusted_of(labels))
    assert good[1].sum() == sum(len(plain_grams(t)) for i, t in enumerate(texts) if i % 3) and good[0].sum() == sum(len(plain_grams(t)) for t in texts)
