import random

from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import common, simhash, words
from sparkloom.llm import near_copies as N


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain_groups(texts):
    sets, root = list(map(plain_set, texts)), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or x and y and len(x & y) >= 0.8 * len(x | y):
                pairs += x != y
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(sets))], pairs


def planted():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(3, 8)))
    texts = [None, "", "One", "one", "one two", " \n"]
    for i in range(40):
        base = [word() for _ in range(rnd.randint(60, 300))]
        texts.append(" ".join(base))
        for _ in range(3):  # some copies stay above the similarity, some fall below
            base = base.copy()
            for _ in range(rnd.randint(1, max(1, len(base) // 60))):
                base[rnd.randrange(len(base))] = word()
            texts.append(" ".join(base))
    base = [word() for _ in range(200)]
    for _ in range(60):  # a large group
        one = base.copy()
        for _ in range(4):
            one[rnd.randrange(200)] = word()
        texts.append(" ".join(one))
    return texts


def test_stage_drops_planted_near_copies(spark, docs):
    """Fingerprints at most 2 bits apart join hardly any of these."""
    texts = planted()
    want, pairs = plain_groups(texts)
    assert pairs > 100
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(texts), "").collect()}
    assert left == {i for i, g in enumerate(want) if g == i}
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs(texts)).collect()} == dict(enumerate(want))


def test_fuzzy_hash_names_candidates(monkeypatch, docs):
    """Where no two sets share a MinHash key, those that op7 groups are compared still."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(6))
    texts = []
    for _ in range(30):
        base = [word() for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], word()])]
    phrase = [word() for _ in range(11)]
    texts += [" ".join(phrase * 60 + [word() for _ in range(30)]) for _ in range(2)]  # close fingerprints, other sets
    prints = [simhash.fingerprint(t.encode()) & (2**64 - 1) for t in texts]
    close = [bin(prints[i] ^ prints[i + 1]).count("1") <= 2 for i in range(0, 62, 2)]
    assert sum(close[:30]) > 10 and close[30]
    want = {i: i - i % 2 if i < 60 and close[i // 2] else i for i in range(62)}
    marked = N.marked
    monkeypatch.setattr(N, "marked", lambda d: marked(d).withColumn("keys", F.array("fp")))
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(docs(texts)).collect()} == want


def test_other_operators_caches_are_let_go():
    """A worker that encoded texts gives its encoder up in a task of this operator."""
    import public_tokenizers

    words.encoder(public_tokenizers.path("word_bpe_49k.json")).encode(["some words"])
    assert words._ENCODERS
    common.let_go()
    assert not words._ENCODERS


def test_empty_table(docs):
    assert N.near_copies(docs([])).count() == 0
