"""The registered queries of the grid operators against their SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_queries_equal_their_sql(spark):
    from concurrent.futures import ThreadPoolExecutor

    import duckdb

    from terrascape.plans import catalog

    con = duckdb.connect()
    for name in ("lineitem", "embeddings", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    plain = lambda v: round(float(v), 5) if isinstance(v, float) else v

    def found(name):
        got = catalog.QUERIES[name](spark, SF)
        return sorted(got.columns), sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=repr)

    # the queries are many small jobs, of which several run at a time
    with ThreadPoolExecutor(3) as pool:
        running = {name: pool.submit(found, name) for name in catalog.oracle_sql()}
        for name, sql in catalog.oracle_sql().items():
            want = con.sql(sql)
            columns, a = running[name].result()
            assert columns == sorted(want.columns), name
            at = [want.columns.index(c) for c in columns]
            b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
            assert a == b, name


def test_entry_imports_without_the_training_data_operators(monkeypatch):
    import builtins
    import importlib

    real = builtins.__import__

    def missing(name, *rest):
        if name.startswith(("corpus_pipeline", "terrascape.llm")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *rest)

    monkeypatch.setattr(builtins, "__import__", missing)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert not [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]

    def broken(name, *rest):
        if name == "terrascape.llm":
            raise ModuleNotFoundError("xxhash", name="xxhash")
        return real(name, *rest)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):  # what the operators lack themselves isn't passed over
        entry.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_whole_queries_take_all_sources(spark):
    from terrascape.plans import catalog
    from terrascape.plans.fixtures import g32

    cells = g32(spark, SF).toPandas()
    valid = set(map(tuple, cells.loc[cells.cond.notna(), ["row", "col"]].to_numpy().tolist()))
    protected = valid & set(map(tuple, cells.loc[cells.pa > 0, ["row", "col"]].to_numpy().tolist()))
    for name in ("d7_connectedness_all", "d7_connectedness_square_all", "d7_connectedness_geographic_all", "b12_habitat_option3_all", "parc_connectedness_all", "parc_pa_to_pa_all"):
        got = {(r["row"], r["col"]) for r in catalog.QUERIES[name](spark, SF).where("value IS NOT NULL").collect()}
        assert got == (protected if name.startswith("parc") else valid), name
    for name in ("e2_circular_window_all", "e3_e7_square_window_all", "e2_geographic_window_all"):
        assert catalog.QUERIES[name](spark, SF).select("src").distinct().count() == len(valid), name
    alone = {(i, j) for i, j in valid if not any((i + a, j + b) in valid for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)}
    assert catalog.QUERIES["i3_isolated_all"](spark, SF).count() == len(alone)
    assert catalog.QUERIES["c3_c4_edges_all"](spark, SF).where("u = src").select("src").distinct().count() == len(valid) - len(alone)
    assert catalog.QUERIES["i6_i7_paths_all"](spark, SF).select("src").distinct().count() == len(valid)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_queries_take_all_vectors(spark, tmp_path):
    import numpy as np

    from terrascape.plans import catalog

    n, rows = 700, 35
    v = np.random.default_rng(2).random((n, 6)).round(3)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    os.symlink(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    got = {r.vec_id: r.sim for r in catalog.QUERIES["b18_similarity"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(n)) and np.allclose([got[i] for i in range(n)], np.exp(-np.abs(v - v[(np.arange(n) + 37) % n]).sum(axis=1)))
    got = {(r.level, r.gi, r.gj): [r[f"b{i + 1}"] for i in range(6)] for r in catalog.QUERIES["d5_band_overview"](spark, str(tmp_path)).collect()}
    cells = v.reshape(rows, 20, 6)
    assert len(got) == rows * 20 + 18 * 10 + 9 * 5
    assert np.allclose(got[(1, 34, 19)], cells[34, 19]) and np.allclose(got[(2, 17, 0)], cells[34:, :2].mean(axis=(0, 1)), atol=1e-6)
    out = {(r["row"], r["col"]): r["value"] for r in catalog.QUERIES["d8_beri_all"](spark, str(tmp_path)).collect()}
    cond = {(r["row"], r["col"]) for r in catalog.QUERIES["fixture_g32"](spark, str(tmp_path)).where("cond IS NOT NULL").collect()}
    assert {k for k, x in out.items() if x is not None} == {(i, j) for i in range(rows) for j in range(32) if (i % 32, j) in cond}
    assert all(out[i, j] > 0 for i in range(32, rows) for j in range(20) if (i % 32, j) in cond)
