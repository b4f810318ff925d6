"""Whitening against plain numpy over all rows."""

from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

from tallyframe.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, most=8):
    """n, deviations, |whitened|, explained, by the definition."""
    x = [[int(np.floor(np.float64(c) * 1024)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(row, sums, strict=True)] for row in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    with np.errstate(all="ignore"):
        return n, deviation, np.abs(y @ u / np.sqrt(e)), e / np.trace(y.T @ y / n)


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.01"])
def test_every_row_equals_plain_numpy(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    n, deviation, whitened, explained = plain([r["embedding"] for r in rows])
    found = {(r["vec_id"], r["component"]): r for r in queries.QUERIES["op13_embedding_whitening"](spark, folder).collect()}
    assert len(found) == 8 * len(rows)
    for i, r in enumerate(rows):
        for k in range(8):
            f = found[r["vec_id"], k + 1]
            assert (f["n"], f["deviation"]) == (n, deviation[i])
            assert abs(f["whitened"]) == pytest.approx(whitened[i, k], abs=1e-7)
            assert f["explained"] == pytest.approx(explained[k], rel=1e-9)
            assert f["identity_error"] < 1e-9
    for k in range(1, 9):  # one sign for all rows
        z = np.array([found[r["vec_id"], k]["whitened"] for r in rows])
        assert abs(abs(z @ whitened_signed(rows, k - 1)) / len(rows) - 1) < 1e-6


def whitened_signed(rows, k):
    x = np.floor(np.array([r["embedding"] for r in rows], float) * 1024)
    y = x - x.mean(axis=0)
    e, u = np.linalg.eigh(y.T @ y / len(y))
    return y @ u[:, -1 - k] / np.sqrt(e[-1 - k])


def test_copies_weigh_by_count_and_each_row_has_its_result(spark):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in np.float32(rng.normal(size=5))] for _ in range(40)]
    copied = vectors + [vectors[0]] * 30 + [vectors[1]] * 7
    data = spark.createDataFrame([(i, v, 0) for i, v in enumerate(copied)], SCHEMA).repartition(5)
    out = {r["vec_id"]: r["whitening"] for r in whitening.whiten(data).collect()}
    n, deviation, whitened, explained = plain(copied)
    assert len(out) == n == 77
    for i, w in out.items():
        assert w["n"] == n and int(w["deviation"]) == deviation[i]
        assert np.abs(w["whitened"]) == pytest.approx(whitened[i], abs=1e-8)
        assert w["explained"] == pytest.approx(explained)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (2, [1.5, 2.0], 0), (2, [1.5, 2.0], 0), (3, None, 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [], 0), (8, [1.0, 2.0, 3.0], 0), (None, [-1.0, 2.0], 0), (9, [3e38, 1.0], 0)]
    data = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as whitening", "2 as x", "3 as key", "4 as n", "5 as row", "6 as weight")
    out = whitening.whiten(data).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in out) == [(False, 1), (False, 2), (False, 2), (True, 0)]
    assert {(r["x"], r["key"], r["n"], r["row"], r["weight"]) for r in out} == {(2, 3, 4, 5, 6)}
    # the second dimension is constant, so there is one component with variance
    assert all(r["whitening"]["whitened"][1] is None and r["whitening"]["whitened"][0] is not None for r in out)
    assert all(r["whitening"]["identity_error"] < 1e-12 for r in out)
    assert whitening.whiten(data.where("vec_id = 3")).collect() == []
    alone = whitening.whiten(data.where("vec_id = 1")).first()["whitening"]
    assert (alone["n"], int(alone["deviation"]), alone["whitened"], alone["explained"]) == (1, 0, [None, None], [None, None])


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [float(c) for c in (1e12 * (i - 2), -1e12 * i, 7.0)], 0) for i in range(4)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    n, deviation, whitened, _ = plain([r["embedding"] for r in vectors.collect()])
    out = {r["vec_id"]: r["whitening"] for r in whitening.whiten(vectors).collect()}
    assert max(deviation) > 1 << 63
    assert [int(out[i]["deviation"]) for i in range(4)] == deviation


def test_an_empty_table(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_cluster_needs_a_folder_that_is_shared():
    from types import SimpleNamespace

    from tallyframe.llm.shared import shared_dir

    def session(**conf):
        return SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.rsplit(".", 2)[1], d)))

    assert shared_dir(session(checkpoint="hdfs://h/c", warehouse="file:/w")) == "hdfs://h/c"
    assert shared_dir(session(warehouse="s3a://b/w")) == "s3a://b/w/tallyframe-scratch"
    for local in ("file:/w", "file:///w", "/w"):
        with pytest.raises(ValueError, match="share"):
            shared_dir(session(warehouse=local))
