import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import code as C
from sparkloom.operators import learning as L
from sparkloom.operators import sequences as S

SOURCE = '''import os
from a.b import c

class K:
    def f(self, x):
        if x and os.path.exists(x) or c(x):
            return [y for y in x if y]
        return g(x)
'''


def test_python_sources():
    assert C.symbols(SOURCE) == [("class", "K", 4), ("function", "f", 5)]
    assert C.imports(SOURCE) == [("os", 1), ("a.b", 2)]
    assert ("f", "exists", 6) in C.calls(SOURCE) and ("f", "g", 8) in C.calls(SOURCE)
    assert C.complexity(SOURCE) == [("f", 5, 5)]
    assert C.symbols("pub fn go() {}\nstruct S;") == [("fn", "go", 1), ("struct", "S", 2)]
    assert C.imports("not python (") == [] and C.symbols("") == []


def test_diff():
    d = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a\n+b\n c\n@@ -9 +10 @@\n-q\n+r\n@@ -20,2 +21,0 @@\n-z\n-z\n"
    assert C.diff_ranges(d) == [("x.py", 1, 3), ("x.py", 10, 10)]


@pytest.mark.parametrize("text", ["", "a\n" * 50, "fn x() {\n  y\n}\n" * 20, "z" * 500 + "\nq"])
def test_chunks_cover(text):
    got = C.chunks(text, 60)
    assert "\n".join(x[3] for x in got) == text
    assert all(len(x[3]) <= 60 or x[1] == x[2] for x in got)


def test_matches():
    f = C.keyword_matches(["he", "she", "hers"])
    assert f("uSHErs") == [("she", 1), ("he", 2), ("hers", 2)] and C.keyword_matches([])("x") == []


def test_intent(spark):
    """One intent; none; two evenly (explore counts both less one); ties; words that only contain a keyword; null."""
    want = {"fix the bug please": ("debug", 2), "hm": ("explore", 0), "fix bug add new": ("explore", 2), "describe": ("understand", 1), "renamed prefixes": ("debug", 1), None: ("explore", 0)}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", C.intent(F.col("t")).alias("i")).collect()
    assert {r["t"]: (r["i"]["intent"], r["i"]["n"]) for r in got} == want
    assert {r["t"]: round(r["i"]["confidence"], 6) for r in got}["hm"] == 1.0

    assert C.is_binary(b"a\x00") and not C.is_binary(b"") and not C.is_binary("é\n".encode())


def test_each(spark):
    d = spark.createDataFrame([(1, SOURCE), (2, None)], "id long, src string")
    got = C.each(d, "id", "src", C.symbols, "kind string, name string, line long").collect()
    assert [(r["id"], r["name"]) for r in got] == [(1, "K"), (1, "f")]


def test_learners(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        x = rng.normal(size=2)
        rows.append((0, i, [float(x[0]), float(x[1]), 1.0], float(x[0] > 0), "a" if i % 2 else "b", float(i % 2)))
    d = spark.createDataFrame(rows, "k int, t int, x array<double>, y double, arm string, r double")
    got = S.fold(d, "k", ["t"], *L.ftrl_step("x", "y", alpha=0.5)).orderBy("t").collect()
    assert np.mean([(r["p"] > 0.5) == r["y"] for r in got[150:]]) > 0.9
    q = S.fold(d, "k", ["t"], *L.double_q_step("r", "arm", ["a", "b"])).orderBy("t").collect()
    assert q[-1]["q"] > q[-2]["q"] and max(r["q"] for r in q) <= 10
    c = S.fold(d, "k", ["t"], *L.linucb_step("x", ["a", "b"], "arm", "r", 0.1)).orderBy("t").collect()
    assert c[0]["chosen"] == "a" and np.mean([r["chosen"] == "a" for r in c[200:]]) > 0.6


def test_shares_and_plans(spark):
    d = spark.createDataFrame([("a", 3.0), ("b", None), ("c", -1.0)], "t string, q double")
    assert {r["t"]: r["budget"] for r in L.budget_shares(d, "q", 100, 2).collect()} == {"a": 85, "b": 14, "c": 2}
    tasks = spark.createDataFrame([("a", "done"), ("b", "pending"), ("c", "pending")], "task string, status string")
    deps = spark.createDataFrame([("b", "a"), ("c", "b")], "task string, needs string")
    assert {r["task"]: r["ready"] for r in L.plan_status(tasks, deps).collect()} == {"a": False, "b": True, "c": False}
    p = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "y"), (1, 4, "x")], "k int, t int, n string")
    assert [(r["a"], r["b"], r["strength"]) for r in L.reinforced(p, "k", ["t"], "n").collect()] == [("x", "y", 2.0)]
    assert L.importance_sample(p, "t", 2).count() == 2
    assert L.evaporated(spark.createDataFrame([(1.0, 10.0), (0.001, 10.0)], "s double, age double"), "s", "age", 10.0).collect()[0]["s"] == 0.5
