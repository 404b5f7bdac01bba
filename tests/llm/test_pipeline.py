import random
import re

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm.pii import base_spans, masked
from sparkloom.llm.simhash import fingerprint


def test_stages_against_plain_versions(spark, docs, tmp_path):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(rnd.randint(2, 8)))
    texts = []
    for i in range(200):
        words = [word() for _ in range(rnd.randint(5, 80))]
        if i % 5 == 0:
            words.insert(3, "nincompoop")
        if i % 7 == 0:
            words.append("call +1 (555) 555-0199 or me@mail.com")
        texts.append(" ".join(words))
    texts += [texts[1], texts[2].replace(" ", "\n", 1), None, "", texts[3].upper()]
    frame = docs(texts)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = frame, dict(enumerate(texts))
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, now, str(tmp_path))
        if name == "toxicity":
            kept = {i: t for i, t in kept.items() if "nincompoop" not in (t or "")}
        elif name == "exact_dedup":
            seen, left = set(), {}
            for i, t in sorted(kept.items()):
                key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
                if key not in seen:
                    seen.add(key)
                    left[i] = t
            kept = left
        elif name == "near_dedup":
            ids = sorted(kept)
            root = {i: i for i in ids}
            fps = {i: fingerprint((kept[i] or "").encode()) & (2**64 - 1) for i in ids}

            def top(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a in ids:
                for b in ids:
                    if b < a and bin(fps[a] ^ fps[b]).count("1") <= 2:
                        x, y = top(a), top(b)
                        root[max(x, y)] = min(x, y)
            kept = {i: t for i, t in kept.items() if root[i] == i}
        elif name == "pii":
            kept = {i: None if t is None else masked(t, base_spans(t)) for i, t in kept.items()}
        else:
            tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            assert {r["doc_id"]: r["doc_tokens"] for r in out.collect()} == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in kept.items()}
            continue
        assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"]: r["text"] for r in now.collect()} == kept, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == set(kept)
