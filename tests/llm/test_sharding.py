import hashlib
import random
import zlib
from collections import Counter

import xxhash

from sparkloom.llm.common import buckets_for, stage
from sparkloom.llm.sharding import SETTLED, propagate, shard_documents


def test_rows_law_and_links(docs):
    rnd = random.Random(1)
    texts = [None, "", "", "x" * 30_000] + ["hot"] * 300
    for i in range(150):
        texts += [f"text {i} é"] * rnd.choice((1, 1, 1, 2, 3, 5))
    texts += [f"alone {i}" for i in range(500)]
    got = {r["doc_id"]: r for r in shard_documents(docs(texts)).collect()}
    assert len(got) == len(texts)
    by_shard, by_text = {}, {}
    for i, t in enumerate(texts):
        r = got[i]
        raw = (t or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_text.setdefault(t or "", []).append(r["shard"])
    counts = [len(by_shard.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    groups = [Counter(x) for t, x in by_text.items() if len(x) > 1 and t != "hot"]
    whole = sum(len(g) == 1 for g in groups)
    assert whole >= 0.9 * len(groups)
    assert len(Counter(by_text["hot"])) <= -(-300 // min(counts)) + 2


def test_small_tables(docs):
    assert shard_documents(docs([])).count() == 0
    got = shard_documents(docs(["a", "a", None])).collect()
    assert len(got) == 3 and len({r["shard"] for r in got}) == 3


def test_same_result_twice(docs):
    d = docs(["a"] * 20 + [str(i) for i in range(30)])
    once, again = (sorted(map(tuple, shard_documents(d).collect()), key=str) for _ in range(2))
    assert once == again


def plain_rounds(state, quotas):
    """The rounds over a dict of counts by (group, shard)."""
    members, buckets = Counter(), buckets_for(sum(quotas))
    for (g, _), n in state.items():
        members[g] += n
    turn = {g: ((m.bit_length() - 1) * buckets + xxhash.xxh64_intdigest(g, 42) % buckets, g) for g, m in members.items()}
    while True:
        free = [q - sum(n for (_, s), n in state.items() if s == k) for k, q in enumerate(quotas)]
        best = {}
        for (g, s), n in state.items():
            if free[s] > 0:
                best[g] = max(best.get(g, (0, -99)), (n, -s))
        moves, ahead = [], Counter()
        for (g, s), n in sorted(state.items(), key=lambda x: (*turn[x[0][0]], x[0][1])):
            most, to = best.get(g, (0, 0))
            if most > n or most == n and -to < s:
                moves.append((g, s, -to, min(n, free[-to] - ahead[-to])))
                ahead[-to] += n
        moves = [m for m in moves if m[3] > 0]
        for g, s, to, n in moves:
            state[g, s] -= n
            state[g, to] += n
        state = Counter({k: n for k, n in state.items() if n})
        if sum(m[3] for m in moves) * SETTLED <= sum(members.values()):
            return state


def test_rounds_against_counts(spark):
    """Groups of all sizes, one of them over ten shards' quotas, until hardly any can move."""
    rnd = random.Random(5)
    start = Counter()
    for i in range(60):
        g = hashlib.sha256(str(i).encode()).digest()
        for _ in range(1400 if i == 0 else rnd.choice((2, 2, 3, 5, 40))):
            start[g, rnd.randrange(16)] += 1
    total = sum(start.values())
    quotas = [total // 16 + 400] * 16
    size = Counter()
    for (g, _), n in start.items():
        size[g] += n
    rows = [(bytearray(g), size[g], s, n) for (g, s), n in start.items()]
    got = propagate(stage(spark.createDataFrame(rows, "grp binary, members long, shard int, n long"), "start"), quotas)
    assert {(bytes(r["grp"]), r["shard"]): r["n"] for r in got.collect()} == plain_rounds(start, quotas)
