"""Exact dedup against plain grouping, with ids that a float cannot hold."""

import random
import re

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from sparkloom.llm.exact_dedup import build, exact_dedup, find
from sparkloom.llm.packing import pack
from sparkloom.llm.token_files import token_ids

BIG = 1 << 53
SCHEMA = "doc_id long, text string"


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {k: (min((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


def test_slots_are_minimal_and_found():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 3000):
        block = rng.integers(0, 256, (n, 32), np.uint8)
        seeds, slots = build(block)
        assert sorted(slots.tolist()) == list(range(n))
        assert find(seeds, n, block).tolist() == slots.tolist()


def test_against_plain_grouping(spark):
    rnd = random.Random(2)
    ids = [None, None, BIG + 1, BIG + 3, -BIG - 1, 7, 7, *range(100, 160)]
    rows = [(i, rnd.choice([None, "", "a b", "a\tb", "a  b", "c", f"own {i}"])) for i in ids]
    want = plain(rows)
    got = exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"] is None, r["keep_id"] or 0, r["group_size"]) for r in got)) == sorted((i is None, i or 0, want[k][0] is None, want[k][0] or 0, want[k][1]) for i, t in rows for k in [re.sub(r"[\x20\x09-\x0D]+", " ", t or "")])
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len(want)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


ROWS = [(None, "aaaa one two three"), (BIG + 1, "bbbb four five six"), (BIG + 3, "cccc seven eight nine"), (1, "dddd ten eleven twelve"), (-1, "eeee alpha beta gamma"), (5, "ffff delta epsilon zeta")]


def test_stages_keep_ids_that_floats_lose(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(repr, function(spark, docs, str(tmp_path)).collect())) == sorted(map(repr, docs.collect())), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in ROWS}


def test_rows_that_share_an_id(spark):
    rows = [(1, "same"), (1, "same"), (2, "same"), (None, "x y z"), (None, "x y z"), (None, "other"), (3, "q"), (3, "r")]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.exact_dedup(spark, docs, "").collect()
    assert sorted(map(repr, left)) == sorted(map(repr, spark.createDataFrame([(1, "same"), (None, "x y z"), (None, "other"), (3, "q"), (3, "r")], SCHEMA).collect()))
    near = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(map(repr, near)) == sorted(map(repr, left))


def test_packing_and_token_files_keep_ids(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    assert sorted(repr(r["doc_id"]) for r in pack(docs, P.path("word_bpe_49k.json")).collect()) == sorted(repr(i) for i, _ in ROWS)
    got = {r["doc_id"]: r["start"] for r in token_ids(docs, P.path("byte_bpe_50k.json")).collect()}
    assert set(got) == {i for i, _ in ROWS} and got[None] == 0
    assert sorted((i for i in got if i is not None), key=got.get) == [-1, 1, 5, BIG + 1, BIG + 3]
