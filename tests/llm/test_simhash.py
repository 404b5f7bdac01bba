import random

import numpy as np
import xxhash

from sparkloom.llm import simhash
from sparkloom.llm.simhash import near_duplicates


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_golay_is_perfect():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 23, 500)
    for e in (0, 1, 1 << 5, 1 << 22):
        one, two = simhash.golay_keys(x), simhash.golay_keys(x ^ e)
        for i in range(0, 500, 25):
            assert set(one[1][one[0] == i]) & set(two[1][two[0] == i])


def test_every_pair_within_two_bits_shares_a_key():
    rnd = random.Random(2)
    for _ in range(3000):
        x = rnd.getrandbits(64)
        y = x
        for b in rnd.sample(range(64), rnd.choice((1, 2))):
            y ^= 1 << b
        row, key = simhash.keys(np.array([x, y], np.uint64).view(np.int64))
        assert set(key[row == 0]) & set(key[row == 1])


def test_against_brute_force(spark, docs):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = [None, "", "  \n", "One", "one", "one two", "é É x", "z" * 20000]
    for _ in range(40):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(base))
    got = {r["doc_id"]: r for r in near_duplicates(docs(texts)).collect()}
    fps = [plain(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == plain_groups(fps)


def test_close_points_chain(spark):
    """A family of fingerprints one bit apart each is one component."""
    rnd = random.Random(4)
    xs = [rnd.getrandbits(63)]
    for _ in range(200):
        xs.append(xs[-1] ^ (1 << rnd.randrange(63)))
    xs = sorted(set(xs))
    points = spark.createDataFrame([(x,) for x in xs], "fp long")
    from sparkloom.llm.components import components

    got = components(simhash.links(simhash.candidates(points))).collect()
    assert {r["root"] for r in got} == {xs[0]} and len(got) == len(xs) - 1


def test_empty_table(docs):
    assert near_duplicates(docs([])).count() == 0
