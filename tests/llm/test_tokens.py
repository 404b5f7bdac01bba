import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from sparkloom.llm.packing import LENGTH, pack, places, shortest_pack_first
from sparkloom.llm.token_files import pack as code
from sparkloom.llm.token_files import token_ids, unpack

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def texts():
    rnd = random.Random(7)
    words = ["The", "cat", "über", "naïve", "it's", "\n", "x1,", "日本", "a"]
    return [None, "", "  ", "same text", "same text", "y" * 9000] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4000))) for _ in range(40)]


def test_coding_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        x = rnd.choice([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1], n).astype(np.uint32)
        control, data = code(x)
        assert unpack(control, data, n).tolist() == x.tolist()
        assert len(control) == -(-n // 4)


def test_token_files(docs):
    t, tok = texts(), Tokenizer.from_file(BYTES)
    got = {r["doc_id"]: r for r in token_ids(docs(t), BYTES).collect()}
    start = 0
    for i, x in enumerate(t):
        ids = tok.encode(x or "", add_special_tokens=False).ids + [0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)
    assert len(got) == len(t)


def test_packing(docs):
    t, tok = texts(), Tokenizer.from_file(WORDS)
    rows = pack(docs(t), WORDS).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, x in enumerate(t):
        ids, at = tok.encode(x or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4"))
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= LENGTH
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_histogram_is_used_up():
    rnd = random.Random(2)
    for limit in (7, 64, 500):
        h = {rnd.randint(1, limit - 1): rnd.randint(1, 1000) for _ in range(60)}
        patterns = shortest_pack_first(h, limit)
        used = {}
        for n, p in patterns:
            assert n > 0 and sum(x * k for x, k in p) <= limit
            for x, k in p:
                used[x] = used.get(x, 0) + n * k
        assert used == h
        table, n = places(patterns)
        assert n == sum(c for c, _ in patterns)
        least = -(-sum(k * v for k, v in h.items()) // limit)
        assert n >= least


def test_empty_tables(docs):
    assert pack(docs([]), WORDS).count() == 0
    assert token_ids(docs([]), BYTES).count() == 0
