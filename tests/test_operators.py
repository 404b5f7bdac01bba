import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import graphs as G
from sparkloom.operators import relational as R
from sparkloom.operators import sequences as S
from sparkloom.operators import stats as ST
from sparkloom.operators import text as X
from sparkloom.operators import vectors as V
from sparkloom.sources import events as E
from sparkloom.sources import files as FS
from sparkloom.streaming import projections as P


def reachable(edges, start):
    seen, todo = {start: 0}, [start]
    for n in todo:
        for a, b in edges:
            if a == n and b not in seen:
                seen[b] = seen[n] + 1
                todo.append(b)
    return seen


@pytest.fixture(scope="module")
def digraph(spark):
    rnd = random.Random(5)
    edges = sorted({(rnd.randrange(14), rnd.randrange(14)) for _ in range(24)})
    return edges, spark.createDataFrame(edges, "src long, dst long")


def test_reach(spark, digraph):
    edges, df = digraph
    got = {r["node"]: r["distance"] for r in G.reach(df, spark.createDataFrame([(edges[0][0],)], "node long")).collect()}
    assert got == reachable(edges, edges[0][0])


def test_strong_components(digraph):
    edges, df = digraph
    nodes = {x for e in edges for x in e}
    back = {n: set(reachable(edges, n)) for n in nodes}
    want = {}
    for n in nodes:
        c = {m for m in back[n] if n in back[m]}
        if len(c) > 1:
            want[n] = min(c)
    assert {r["node"]: r["component"] for r in G.strong_components(df).collect()} == want


def test_graph_edge_cases(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert G.strong_components(none).count() == 0 and G.layers(none).count() == 0
    loop = spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long")
    assert {r["node"]: r["layer"] for r in G.layers(loop).collect()} == {}  # 1 is on a cycle, 2 behind it
    parts = spark.createDataFrame([(a, b, 1.0) for c in (0, 5) for a in range(c, c + 4) for b in range(a + 1, c + 4)] + [(0, 5, 1.0)], "a long, b long, w double")
    found = {r["node"]: r["community"] for r in G.communities(parts).collect()}
    assert len(set(found.values())) <= 3 and len({found[i] for i in (1, 2, 3)}) == 1 and found[1] != found[6]
    q = G.modularity(parts, spark.createDataFrame([(n, int(n >= 5)) for n in found], "node long, community int")).first()["q"]
    assert q == pytest.approx(12 / 13 - 2 * 0.25)


def test_rounds_and_one_task_agree(spark, digraph, monkeypatch):
    _, df = digraph
    chain = spark.range(30).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    start = spark.createDataFrame([(0,), (3,)], "node long")
    rows = lambda d: sorted(map(tuple, d.collect()))
    runs = [lambda: rows(G.reach(df, start)), lambda: rows(G.reach(df, start, 2)), lambda: rows(G.layers(df)), lambda: rows(G.strong_components(df)), lambda: rows(G.layers(chain.limit(4))), lambda: rows(G.longest_path(chain.limit(3)))]
    local = [f() for f in runs]
    monkeypatch.setattr(G, "LOCAL_EDGES", 0)
    assert local == [f() for f in runs]
    monkeypatch.undo()
    long = spark.range(1999).select((F.col("id") + 1).alias("src"), F.col("id").alias("dst"))
    assert G.blast_radius(long, spark.createDataFrame([(0,)], "node long")).count() == 1999


def test_collection(spark):
    from sparkloom.sources.collections import Collection

    c = Collection.create(spark, "v", 2, "euclidean", "tag string")
    assert c.search([0.0, 0.0], 3).count() == 0
    c.upsert(spark.createDataFrame([(1, [0.0, 1.0], "a"), (2, [3.0, 4.0], "b"), (3, [0.0, 1.0], "b")], "id long, vector array<double>, tag string"))
    c.upsert(spark.createDataFrame([(1, [6.0, 8.0], "c")], "id long, vector array<double>, tag string"))
    assert [(r["id"], r["score"], r["tag"]) for r in c.search([0.0, 0.0], 9).collect()] == [(3, 1.0, "b"), (2, 5.0, "b"), (1, 10.0, "c")]
    assert [r["id"] for r in c.search([0.0, 0.0], 9, where=F.col("tag") == "b", least=4.0).collect()] == [3]
    c.delete(spark.createDataFrame([(3,), (9,)], "id long"))
    assert c.count() == 2
    with pytest.raises(Exception, match="components"):
        c.upsert(spark.createDataFrame([(4, [1.0], "x")], "id long, vector array<double>, tag string"))
    with pytest.raises(ValueError):
        c.search([1.0], 1)


def test_registered_functions(spark):
    from sparkloom.functions.registry import register

    register(spark)
    r = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)) c, cosine_similarity(array(0D), array(1D)) z, irr(array(-100D, 110D)) i, fnv1a('a') f, edit_distance('Abc', 'abd') e, jaccard_similarity(array(), array()) j, euclidean_distance(array(0D, 0D), array(3D, 4D)) d").first()
    assert r["c"] == pytest.approx(0.5**0.5) and r["z"] == 0 and r["i"] == pytest.approx(0.1) and r["f"] & (2**64 - 1) == X.fnv1a(b"a") and (r["e"], r["j"], r["d"]) == (1, 1.0, 5.0)


def test_vectors(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    q = x[3].tolist()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(unit @ unit[3]), kind="stable")[:5].tolist()
    assert [r["id"] for r in V.top_k(df, "id", "v", q, 5).collect()] == want
    assert V.top_k(df, "id", "v", q, 0).count() == 0
    assert [r["id"] for r in V.top_k(df, "id", "v", q, 3, "euclidean").collect()] == np.argsort(np.linalg.norm(x - x[3], axis=1), kind="stable")[:3].tolist()
    got = V.top_k_batch(df.where("id < 7").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), df, "id", "v", 4, block=3).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in got] == np.argsort(-(unit[:7] @ unit.T), axis=1, kind="stable")[:, :4].reshape(-1).tolist()
    cents = V.ivf_centroids(df, "id", "v", 4)
    near = [r["id"] for r in V.ivf_top_k(df, "id", "v", q, 5, cents, probes=4).collect()]
    assert near == want
    back = V.quantized(df, "v").withColumn("w", V.dequantized(df)).collect()
    assert all(max(abs(a - b) for a, b in zip(r["v"], r["w"])) <= r["scale"] / 2 + 1e-9 for r in back)


def test_text(spark):
    assert X.fnv1a(b"") == 0xCBF29CE484222325 and X.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    d = spark.createDataFrame([(1, "The cat sat"), (2, "concatenate a"), (3, ""), (4, None)], "id long, text string")
    half = X.bm25(spark.createDataFrame([(1, "dog cat, sat")], "id long, text string"), "id", "text", "cat", average=3.0).first()["score"]
    assert half == pytest.approx(0.5 * 2.2 / (0.5 + 1.2))  # "cat," holds the term, but is another word
    got = {r["id"]: r["score"] for r in X.bm25(d, "id", "text", "cat", average=2.0).collect()}
    assert got[1] == pytest.approx(2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / 2))) and got[2] == pytest.approx(0.5 * 2.2 / (0.5 + 1.2 * (0.25 + 0.75 * 2 / 2))) and set(got) == {1, 2}
    w = X.tfidf(X.postings(d, "id", "text"), "id", 4)
    e = X.hashed_embedding(w, "id", "tfidf").collect()
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1) for r in e)


def test_sequences(spark):
    rows = [(0, i, float(v)) for i, v in enumerate([10] * 15 + [60] * 15)]
    d = spark.createDataFrame(rows, "k int, t int, x double")
    step, start, columns = S.cusum_step("x")
    got = S.fold(d, "k", ["t"], step, start, columns).orderBy("t").collect()
    assert any(r["alarm"] == "up" for r in got[15:18]) and not any(r["alarm"] for r in got[:15])
    step, start, columns = S.ema_step("x", 0.5, 0.0)
    assert [r["q"] for r in S.fold(d.where("t < 2"), "k", ["t"], step, start, columns).orderBy("t").collect()] == [5.0, 7.5]
    runs = S.run_lengths(d, "k", ["t"], "x").orderBy("run").collect()
    assert [(r["value"], r["n"]) for r in runs] == [(10.0, 15), (60.0, 15)]


def test_irr():
    assert ST.irr([-100, 110]) == pytest.approx(0.1) and ST.irr([1, 2]) is None and ST.irr([]) is None
    assert ST.ks_critical(10, 10, 0.05) == pytest.approx(1.3581015 * (20 / 100) ** 0.5)


def test_contains(spark):
    texts = [(1, "a bb ccc dd e"), (2, "xbb ccc ddy"), (3, "bb ccc"), (4, "foobar baz"), (5, ""), (6, None), (7, "FOO")]
    patterns = ["bb ccc dd", "bar ba", "foo", "c", "", None, "absent", "bb ccc dd"]
    docs = spark.createDataFrame(texts, "id int, text string")
    p = spark.createDataFrame([(x,) for x in patterns], "p string")
    for fold in (False, True):
        low = (lambda x: x.lower()) if fold else (lambda x: x)
        want = sorted((i, x) for i, t in texts if t is not None for x in {q for q in patterns if q is not None} if low(x) in low(t))
        assert sorted((r["id"], r["pattern"]) for r in R.contains_any(docs, "id", "text", p, "p", fold).collect()) == want
    size, R.PATTERN_BYTES = R.PATTERN_BYTES, 100  # several passes
    assert sorted((r["id"], r["pattern"]) for r in R.contains_any(docs, "id", "text", p, "p", True).collect()) == want
    R.PATTERN_BYTES = size


def test_duplicate_lines(spark):
    block = "".join(f"step {i};\n" for i in range(6))
    texts = [block + "middle\n" + block, block.replace("step", " step  ") + block, "same line\n" * 8, "same line\n" * 12, "}\n\n" * 20, "one line", "", None, "a\nb\nc\n" * 4]
    got = {r["id"]: (r["lines"], r["duplicated"], r["blocks"]) for r in X.duplicate_lines(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()}
    assert got == {0: (13, 12, 1), 1: (12, 12, 1), 2: (8, 0, 0), 3: (12, 12, 1), 4: (0, 0, 0), 5: (1, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0), 8: (12, 12, 1)}


def test_conformal(spark):
    df = spark.createDataFrame([(i / 1000,) for i in range(50)], "s double")
    assert tuple(ST.conformal_threshold(df, "s", 0.01).first()) == (50, 1.0, 0.5)  # the rank exceeds n
    assert tuple(ST.conformal_threshold(df, "s", 0.1).first()) == pytest.approx((50, 0.045, 0.955))
    assert ST.conformal_threshold(df.limit(5), "s", 0.5).first()["tau"] == 0.7
    assert tuple(ST.conformal_threshold(df.limit(0), "s", 0.5).first()) == (0, None, 0.7)


def test_code_words_and_languages(spark):
    from sparkloom.functions.scalars import code_words, language

    words = {"computeFinancialModel": ["compute", "financial", "model"], "ABc": ["abc"], "HTTPServer": ["http", "server"], "file_knowledge_db": ["file", "knowledge", "db"], "v2Api": ["v2", "api"], "größeÜber": ["größe", "über"], "": []}
    df = spark.createDataFrame([(k,) for k in words], "x string").select("x", code_words("x").alias("w"), language(F.concat("x", F.lit(".zsh"))).alias("l"))
    assert {r["x"]: r["w"] for r in df.collect()} == words and {r["l"] for r in df.collect()} == {"shell"}


def test_fingerprints_count_repeats(spark):
    one, two = (spark.createDataFrame([("k", v) for v in vs], "k string, v int") for vs in ([1], [1, 2, 2]))
    assert P.changed(P.fingerprints(one, "k", ["v"]), P.fingerprints(two, "k", ["v"]), "k").count() == 1


def test_event_log(spark, tmp_path):
    folder = str(tmp_path / "log")
    raw = spark.createDataFrame([(f"2024-01-0{i % 9 + 1}", "me", "edit", f"f{i}", None) for i in range(20)], "ts string, actor string, action string, entity string, payload string")
    E.append(raw, folder)
    E.append(raw.limit(3), folder, after=20)
    log = E.replay(spark, folder)
    assert sorted(r["seq"] for r in log.collect()) == list(range(1, 24))
    assert E.first_error(log).count() == 0 and E.verify(log).where("ok").count() == 23
    assert E.first_error(log.withColumn("entity", F.when(F.col("seq") == 5, "x").otherwise(F.col("entity")))).first()["seq"] == 5
    assert [r["seq"] for r in E.read_since(log, 18, "edit", 3).collect()] == [19, 20, 21]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.rs").write_text("fn")
    (tmp_path / "y.py").write_text("def")
    assert FS.hashed(FS.walk(spark, str(tmp_path), ["rs", "py"])).count() == 2
    old = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, hash string")
    new = spark.createDataFrame([("p", "1"), ("s", "2"), ("u", "1"), ("n", "9")], "path string, hash string")
    got = {(r["kind"], r["old_path"], r["new_path"]) for r in FS.moves(old, new).collect()}
    assert got == {("moved", "q", "s"), ("duplicate", "p", "u"), ("new", None, "n"), ("gone", "r", None)}


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("f1", "edit", 1), ("f1", "edit", 2), ("f2", "read", 3)], "entity string, action string, seq int").write.parquet(src)
    stream = spark.readStream.schema("entity string, action string, seq int").parquet(src)
    q = P.entity_counts(stream).writeStream.outputMode("complete").format("memory").queryName("projected").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["entity"], r["action"], r["n"]) for r in spark.sql("SELECT * FROM projected").collect()} == {("f1", "edit", 2), ("f2", "read", 1)}
    out = str(tmp_path / "out")
    q = P.micro_batches(stream, P.upsert_postings(out, ["entity"]), str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert P.current_postings(spark.read.parquet(out), ["entity"]).count() == 2
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    two = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "k string, v int")
    assert {r["k"] for r in P.changed(P.fingerprints(one, "k", ["v"]), P.fingerprints(two, "k", ["v"]), "k").collect()} == {"b", "c"}
