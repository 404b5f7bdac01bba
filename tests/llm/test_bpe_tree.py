import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.bpe_tree import encode_decode, encode_text
from sparkloom.llm.words import ChunkEncoder

PATH = P.path("byte_bpe_50k.json")
BITS = ["a", "B", "é", " ", "  ", "\n", "\t", " \n", "'s", "'", "'l", "l", "1", "23", ".", "!!", "\xa0", "<|endoftext|>", "日本", "\x1f", "İ", "ß", "\r\n", "word", "🙂", "the"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def made(rnd, n):
    return "".join(rnd.choice(BITS) for _ in range(n))


def test_tree_equals_whole(tok):
    rnd = random.Random(3)
    texts = [made(rnd, rnd.randint(0, 700)) for _ in range(150)] + ["a" * 3000, "ab" * 2000, " " * 999, "''s" * 400, "日本語" * 500, "lorem" * 900]
    for t in texts:
        assert encode_text(tok, t, 50) == tok.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_equal_library(name):
    rnd = random.Random(4)
    texts = [made(rnd, rnd.randint(0, 14)) for _ in range(3000)]
    e, t = ChunkEncoder(P.path(name)), Tokenizer.from_file(P.path(name))
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want


def test_frame(spark, docs, tok):
    rnd = random.Random(5)
    texts = [None, "", "x", made(rnd, 40), made(rnd, 2000), "q" * 5000, "same", "same"]
    got = {r["doc_id"]: r for r in encode_decode(docs(texts), PATH, block=100).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table(docs):
    assert encode_decode(docs([]), PATH).count() == 0
