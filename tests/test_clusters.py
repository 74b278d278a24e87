"""Two-means: one process against rounds by aggregation."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import edges  # noqa: F401
from tracelight.operators import weights


def test_labels_agree(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(0, 1, (500, 3)), r.normal(1.5, 1, (400, 3))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "edge_id long, w_time double, w_amount double, w_struct double")
    label = weights.two_means(x, np.arange(len(x)))
    got = {k: v for k, v in weights.two_means_of(df.repartition(7)).select("edge_id", "_k").collect()}
    assert [got[i] for i in range(len(x))] == label.tolist() and 0 < label.sum() < len(x)
    mean = [x[label == k].mean(axis=0) for k in range(2)]  # standing labels: each row lies nearest to its own mean
    assert (np.stack([((x - m) ** 2).sum(axis=1) for m in mean]).argmin(axis=0) == label).all()
    assert not weights.two_means(np.ones((5, 3)), np.arange(5)).any()


def test_blocks_tell_what_rows_tell():
    """A round by blocks counts, sums and labels as one row by row does, and looks at few rows: it takes a fraction of the time."""
    r = np.random.default_rng(8)
    x = np.where(r.random((65_536, 3)) < 0.2, 0.5, r.beta(0.5, 2, (65_536, 3)))
    order, first = weights.blocks_of(x)
    assert sorted(order) == list(range(len(x))) and np.diff(np.append(first, len(x))).max() <= weights.BLOCK
    x, ids = x[order], order
    centres = {t: x[r.integers(0, len(x), 2)] for t in range(20)} | {20: np.array([[0.5, 0.5, 0.5], [0.5, 0.5, 0.0]])}
    box = weights._boxes(x, ids, first)
    timed = []
    for run in (lambda: weights._round(x, ids, centres), lambda: weights._block_round(x, ids, first, *box, centres)):
        began = time.process_time()
        timed.append((run(), time.process_time() - began))
    (want, slow), (got, fast) = timed
    for t in centres:
        assert got[t][0].tolist() == want[t][0].tolist() and got[t][3] == want[t][3]
        assert np.allclose(got[t][1], want[t][1], rtol=1e-12) and np.isclose(got[t][2], want[t][2], rtol=1e-12)
    assert fast < slow / 2


def test_score_of_all_edges(edges):
    """nonoutlier: edges into nodes with one in-edge are not clustered, but projected and rescaled like the others."""
    out = weights.cluster_all(edges, 430, 3.0, ["F:0"], only_busy=True)
    x = weights.normalised(weights.raw_features(edges, 430, 3.0, ["F:0"]))
    x = x.withColumn("w_struct", F.when(F.col("dst") == "F:0", 1.0).otherwise(F.col("w_struct"))).toPandas()
    busy = x["dst"].map(x["dst"].value_counts()) > 1
    c = x.loc[busy, list(weights.FEATURES)].to_numpy()
    label = weights.two_means(c, x.loc[busy, "edge_id"].to_numpy())
    parts = [c[label == k] for k in range(2)]
    mean = tuple(p.mean(axis=0) for p in parts)
    within = sum((p - m).T @ (p - m) for p, m in zip(parts, mean))
    seeded = tuple(bool((x.loc[busy, "src"].to_numpy()[label == k] == "F:0").any()) for k in range(2))
    score = weights.rescale(x[list(weights.FEATURES)].to_numpy() @ weights.projection((len(parts[0]), len(parts[1])), mean, within, seeded))
    x["want"] = score / x.assign(s=score).groupby("src")["s"].transform("sum") * 0.99
    got = {r.edge_id: r.weight for r in out.collect()}
    assert (~busy).sum() >= 0 and all(abs(got[i] - w) < 1e-9 for i, w in zip(x["edge_id"], x["want"]))


@pytest.mark.parametrize("busy", [False, True])
def test_degrees_are_taken_once(edges, monkeypatch, busy):  # noqa: F811
    """What tells busy targets comes with the features: no second shuffle of all edges by their targets."""
    calls, degrees = [], weights.degrees
    monkeypatch.setattr(weights, "degrees", lambda e: calls.append(1) or degrees(e))
    out = weights.cluster_all(edges, 430, 3.0, ["F:0"], only_busy=busy)
    assert len(calls) == 1 and "_busy" not in out.columns and out.count() == edges.count()


def test_sums_meet_by_hash_tables_where_they_are_small(spark, edges):  # noqa: F811
    limit, values = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {"_n": F.col("size")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # nothing is small enough for every task
    try:
        by = [weights.with_sums(edges, values, n) for n in (1000, 10**12, None)]
        plans = [b._jdf.queryExecution().executedPlan().toString() for b in by]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert ["ShuffledHashJoin" in p for p in plans] == [True, False, False]
    assert len({tuple(sorted(b.select("edge_id", "_n").collect())) for b in by}) == 1


@pytest.mark.parametrize("mode", ["clusterall", "nonoutlier", "localtime"])
def test_few_edges(edges, mode):  # noqa: F811
    """One edge, or edges that are all alike, have no two groups: the rescaled heuristic."""
    one = edges.limit(1)
    assert [r.weight for r in weights.weighted(one, mode, 430, 3.0, []).collect()] == [1.0 if mode == "localtime" else 0.99]
    assert weights.weighted(edges.limit(0), mode, 430, 3.0, []).count() == 0


def test_many_sources_at_once():
    """Thousands of sources are clustered together, with the weights that each has by itself."""
    r = np.random.default_rng(3)
    src = np.sort(np.concatenate([r.integers(0, 4000, 16_000), r.integers(0, 3, 600)]))
    x = r.random((len(src), 3))
    x = np.where(r.random(x.shape) < 0.3, np.round(x, 1), x)
    pdf = pd.DataFrame({"edge_id": r.permutation(len(src)) * 7919 + 1, "src": [f"P:{s:04d}" for s in src], "size": r.integers(0, 3, len(src)), "w_time": x[:, 0], "w_amount": x[:, 1], "w_struct": x[:, 2]})
    held = frozenset(["P:0001", "P:0003"])
    began = time.process_time()
    got = weights.local_weights(pdf, held, 20)
    assert time.process_time() - began < 6
    some = pdf[pdf["src"] < "P:0300"]
    want = pd.concat([weights.local_kernel(g, held, 20) for _, g in some.groupby("src")])
    both = want.merge(got, on="edge_id")
    assert len(both) == len(some) and np.allclose(both["weight_x"], both["weight_y"], atol=1e-9)
