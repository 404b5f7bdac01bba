"""Log tables, kept results, geometries, listings, clusters."""

import numpy as np
import pytest

from sparkloom.functions import geometry as G
from sparkloom.operators import learning as L
from sparkloom.sources import files as FS
from sparkloom.sources import tables as T
from sparkloom.sources.results import Results

WKT = ["POINT (1 2.5)", "LINESTRING (0 0, 1 1, 2 -3)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"]


@pytest.mark.parametrize("wkt", WKT)
def test_geometry_round_trip(wkt):
    assert G.decode(G.encode(wkt, 4326)) == (4326, wkt) and G.decode(G.encode(wkt)) == (None, wkt)


def test_what_is_no_geometry(spark):
    assert G.decode(b"") is None and G.decode(None) is None and G.decode(b"\x01\xff\x00\x00\x00") is None and G.encode("CIRCLE (1 2)") is None and G.encode(None) is None
    big = bytes.fromhex("0020000001000010e63ff00000000000004000000000000000")
    assert G.decode(big) == (4326, "POINT (1 2)")
    df = spark.createDataFrame([(big,), (None,), (b"x",)], "g binary")
    assert [(r["r"]["srid"], r["r"]["wkt"]) for r in df.select(G.from_ewkb(df["g"]).alias("r")).collect()] == [(4326, "POINT (1 2)"), (None, None), (None, None)]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "f", "x")], "id int, file_path string, extra string")
    T.record(old, "file_access_log", str(tmp_path))
    T.record(spark.createDataFrame([(2, "g", "s")], "id long, file_path string, session_id string"), "file_access_log", str(tmp_path))
    got = T.load(spark, "file_access_log", str(tmp_path))
    assert got.schema == T.ensure(spark, "file_access_log").schema
    assert sorted((r["id"], r["file_path"], r["session_id"]) for r in got.collect()) == [(1, "f", None), (2, "g", "s")]
    assert all(T.ensure(spark, n).count() == 0 for n in T.TABLES)


def test_results(spark):
    kept, runs = Results(), []

    def make():
        runs.append(1)
        return spark.range(3)

    assert kept.get("q", ["a/b.rs"], make).count() == kept.get("q", ["a/b.rs"], make).count() == 3 and len(runs) == 1
    assert kept.invalidate("zzz") == 0 and kept.invalidate("b.rs") == 1
    assert kept.get("q", [], make).count() == 3 and len(runs) == 2 and (kept.hits, kept.misses) == (1, 2)


def test_files_and_documents(spark, tmp_path):
    paths = spark.createDataFrame([("a/b/x",), ("a/bc/y",), ("a/b",)], "path string")
    assert [r["path"] for r in FS.list_dir(paths, "a/b").collect()] == ["a/b/x"]
    (tmp_path / "1.json").write_text('{"n": 1}')
    (tmp_path / "2.json").write_text("no")
    assert sorted(str(r["value"] and r["value"]["n"]) for r in FS.load_all(spark, str(tmp_path), "n int").collect()) == ["1", "None"]
    s = spark.createDataFrame([("f", "b", "fn", 2), ("f", "a", "fn", 1)], "file string, name string, kind string, line int")
    assert FS.symbol_documents(s, "file", "name", "kind", "line").first()["document"] == '[{"line":1,"name":"a","kind":"fn"},{"line":2,"name":"b","kind":"fn"}]'


def test_clusters(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 2, [0.0, 1.0]), (0, 3, [0.9, 0.1]), (0, 4, [-1.0, 0.0]), (0, 5, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, id long, v array<double>")
    assert {r["id"]: r["cluster"] for r in L.leader_clusters(df, "k", "id", "v", 0.8, 2).collect()} == {1: 0, 2: 1, 3: 0}
    assert L.merged_patterns([("a", {"x", "y"}), ("b", {"x"}), ("c", {"z"}), ("d", {"y", "x"})], 0.5) == [(["a", "b", "d"], {"x", "y"}), (["c"], {"z"})]
    inv, b = L.transferred((np.eye(2), np.zeros(2)), (3 * np.eye(2), np.ones(2)), 2.0)
    assert np.allclose(inv, 2 * np.eye(2)) and np.allclose(b, 0.5)
