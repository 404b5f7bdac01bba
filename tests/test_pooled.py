"""Pooled vectors against plain sums, by both ways the vectors go."""

import random

import pytest

from sparkloom.operators import vectors as V


def plain(edges, vectors):
    out = {}
    for s, d, w in edges:
        for i, v in vectors:
            if i == d and v is not None:
                out.setdefault(s, []).append((w, v))
    return {s: [mean(near, k) for k in range(max(len(v) for _, v in near))] for s, near in out.items()}


def mean(near, k):
    have = [w * v[k] for w, v in near if w is not None and k < len(v) and v[k] is not None]
    return sum(have) / sum(w for w, _ in near if w is not None) if have else None


@pytest.mark.parametrize("most", [1 << 23, 0])
def test_pooled_against_plain_sums(spark, monkeypatch, most):
    """Nulls, ragged vectors, repeated ids and a source with edges in many batches."""
    monkeypatch.setattr(V, "MAX_VALUES", most)
    monkeypatch.setattr(V, "EDGES_A_TASK", 5000)
    rnd = random.Random(3)
    vectors = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(30)] + [(3, [1.0, None, 2.0, 0.5]), (30, [1.0, 2.0]), (31, [None] * 4), (32, None), (33, [])]
    edges = [(rnd.choice([*range(200), None]), rnd.choice([*range(36), None]), rnd.choice([None, 1.0, 2.0, 5.0])) for _ in range(3000)]
    edges += [(7, rnd.randrange(30), 1.0) for _ in range(25_000)] + [(900, 31, 1.0), (901, 1, None), (902, 32, 1.0), (903, 33, 1.0), (904, 30, 2.0)]
    got = V.pooled(spark.createDataFrame(edges, "src long, dst long, w double"), "src", "dst", "w", spark.createDataFrame(vectors, "id long, v array<double>"), "id", "v")
    got = got.collect()
    want = plain(edges, vectors)
    assert len(got) == len(want) and {r["src"] for r in got} == set(want)
    for r in got:
        assert [None if x is None else pytest.approx(x, abs=1e-9) for x in want[r["src"]]] == r["pooled"], r["src"]


def test_no_edges_and_no_vectors(spark):
    e = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(2, [1.0])], "id long, v array<double>")
    assert V.pooled(e.where("src > 1"), "src", "dst", "w", v, "id", "v").count() == 0
    assert V.pooled(e, "src", "dst", "w", v.where("id > 2"), "id", "v").count() == 0
    assert [tuple(r) for r in V.pooled(e, "src", "dst", "w", v, "id", "v").collect()] == [(1, [1.0])]


def test_places_are_no_rows(spark, monkeypatch, capsys):
    """The edges are shuffled once, not once for each place."""
    monkeypatch.setattr(V, "EDGES_A_TASK", 1)
    e = spark.createDataFrame([(1, 2, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    v = spark.createDataFrame([(2, [1.0])], "id long, v array<double>")
    V.pooled(e, "src", "dst", "w", v, "id", "v").explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
