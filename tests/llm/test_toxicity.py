import random

import numpy as np
import pytest

from sparkloom.llm import toxicity as T


def plain_kernel(s, t):
    """Sum over all pairs of equal 3-character subsequences of DECAY to their spans."""
    from itertools import combinations

    a = [0, *map(T.code_of, s), 63]
    b = [0, *map(T.code_of, t), 63]
    return sum(T.DECAY ** (x[2] - x[0] + 1 + y[2] - y[0] + 1) for x in combinations(range(len(a)), 3) for y in combinations(range(len(b)), 3) if [a[i] for i in x] == [b[i] for i in y])


@pytest.mark.parametrize("pair", [("idiot", "id-iot"), ("moron", "moron"), ("clown", "crown"), ("a", "abc")])
def test_kernel_equals_brute_force(pair):
    s, t = pair
    want = plain_kernel(s, t) / (plain_kernel(s, s) * plain_kernel(t, t)) ** 0.5
    assert T.kernel_column([s], T.subsequences(t))[0] == pytest.approx(want)


def test_units():
    assert set(T.units_of("You, i d i o t!  go")) >= {"you", "idiot", "go"}
    assert T.units_of("") == []
    assert max(map(len, T.units_of("x" * 5000))) <= T.LONGEST


def made(rnd, insult):
    words = ["".join(rnd.choice("aeioumnrstl") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.randint(8, 30))]
    if insult:
        words.insert(rnd.randrange(len(words)), insult)
    return " ".join(words)


def test_held_out(spark):
    rnd = random.Random(1)
    insults = ["dumbhead", "scoundrel", "b.u.f.f.o.o.n", "buffoon", "scoun*drel"]
    rows, labels = [], []
    for i in range(600):
        bad = rnd.random() < 0.3
        rows.append((i, made(rnd, rnd.choice(insults) if bad else None)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "you dumb-head"), (1003, "buf_foon"), (None, "x"), (1003, "buf_foon")]
    got = T.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    wrong = [i for i, y in labels if by[i]["held_out"] and by[i]["predicted"] != y]
    assert len(wrong) <= 3
    assert by[1000]["score"] == by[1001]["score"] and by[1000]["predicted"] == 0
    assert by[1002]["predicted"] == 1 and by[1003]["predicted"] == 1


def test_no_toxic_rows(spark, docs):
    got = T.toxicity(docs(["a b", None]), spark.createDataFrame([(0, 0)], "doc_id long, toxic int")).collect()
    assert [r["predicted"] for r in got] == [0, 0]
    assert T.toxicity(docs([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_curve_orders():
    a, c = T.fit_curve(np.array([-1.0, -0.5, 0.5, 1.0]), np.array([0.0, 0, 1, 1]))
    assert a > 0
