"""Every operator on nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names, and empty tables."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from sparkloom.llm.bpe_tree import encode_decode
from sparkloom.llm.exact_dedup import exact_dedup
from sparkloom.llm.packing import pack
from sparkloom.llm.pii import pii
from sparkloom.llm.quality import quality
from sparkloom.llm.secrets import find_secrets
from sparkloom.llm.sharding import shard_documents
from sparkloom.llm.simhash import near_duplicates
from sparkloom.llm.token_files import token_ids
from sparkloom.llm.toxicity import toxicity

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
CLASH = ["row", "grp", "fp", "key", "digest", "unit", "bucket", "part", "label", "_b", "_r", "n", "rank", "shard", "score", "kept", "_gone", "good", "_row", "_spans", "spans", "doc", "_many", "_id", "_name", "r", "id", "name"]


@pytest.fixture(scope="module")
def frame(spark):
    texts = [None, "", " \t\n", "same words here", "same words here", "x" * 120_000, "the fool " * 20_000, "mail me@x.org", "é́ 🙂"]
    rows = [(i, t, *["c"] * len(CLASH)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, "same words here", *[None] * len(CLASH)), (None, None, *[None] * len(CLASH))]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int")


PER_ROW = {
    "quality": lambda d, x: quality(d, x),
    "sharding": lambda d, x: shard_documents(d),
    "toxicity": lambda d, x: toxicity(d, x),
    "pii": lambda d, x: pii(d),
    "token_ids": lambda d, x: token_ids(d, BYTES),
    "simhash": lambda d, x: near_duplicates(d),
    "exact_dedup": lambda d, x: exact_dedup(d),
    "bpe": lambda d, x: encode_decode(d, BYTES),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(frame, labels, name):
    out = PER_ROW[name](frame, labels).collect()
    assert len(out) == frame.count()
    assert PER_ROW[name](frame.limit(0), labels.limit(0)).count() == 0


def test_ties_and_repeats(frame):
    found = [r for r in exact_dedup(frame).collect() if r["keep_id"] == 3]
    assert len(found) == 4 and {r["group_size"] for r in found} == {4} and sum(r["kept"] for r in found) == 1
    zero = [r for r in near_duplicates(frame).collect() if r["fingerprint"] == "0" * 16]
    assert {r["component_id"] for r in zero} == {0} and len(zero) == 4


def test_pieces(frame):
    out = pack(frame, WORDS).collect()
    assert sum(r["length"] for r in out if r["start"] == 0 and r["doc_id"] in (0, 1, 2)) == 3
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert pack(frame.limit(0), WORDS).count() == 0


def test_findings(frame):
    assert {r["doc_id"] for r in find_secrets(frame).collect() if r["is_secret"]} <= {5}  # the run of 120,000 letters is a candidate
    assert find_secrets(frame.limit(0)).count() == 0


def test_stages_keep_columns(spark, frame, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = frame
    for name, function in corpus_pipeline.STAGES[:-1]:
        now = function(spark, now, str(tmp_path))
        assert now.columns == frame.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= 1
