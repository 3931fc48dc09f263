"""The learning autoencoder against numerical gradients and plain numpy replays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewave.operators import autoencoder as ae

SMALL = ae.Shape((6, 5, 4, 2))


def data(n: int, width: int = 6, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, 2)) @ rng.normal(0, 1, (2, width)) + rng.normal(0, 0.05, (n, width))


def table(spark, x: np.ndarray, parts: int = 3):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(parts)


def test_gradient_is_numerical():
    x, rng = data(9), np.random.default_rng(1)
    flat = SMALL.fresh() + rng.normal(0, 0.1, SMALL.size)
    got, loss = ae.gradient(SMALL, flat, x)
    assert np.isclose(loss, ae.errors(SMALL, flat, x).sum())
    for k in rng.choice(SMALL.size, 60, replace=False):
        d = np.zeros(SMALL.size)
        d[k] = 1e-6
        slope = (ae.errors(SMALL, flat + d, x).sum() - ae.errors(SMALL, flat - d, x).sum()) / 2e-6
        assert np.isclose(got[k], slope, rtol=1e-4, atol=1e-6)


def test_shapes():
    assert ae.Shape().widths == (12, 32, 16, 4, 16, 32, 12)
    assert ae.Shape().size == 12 * 32 + 32 * 16 + 16 * 4 + 4 * 16 + 16 * 32 + 32 * 12 + 3 * (32 + 16 + 16 + 32) + 4 + 12
    assert [ae.Shape().bent(k) for k in range(6)] == [True, True, False, True, True, False]


def test_training_equals_plain_steps(spark):
    x = data(500)
    start = ae.Learner.fresh(SMALL, rate=5e-3)
    got, losses = ae.train(table(spark, x), start, 12)
    want = start
    for _ in range(12):
        g, _ = ae.gradient(SMALL, want.flat, x)
        want = want.moved(g / len(x))
    assert got.version == 12 and np.allclose(got.flat, want.flat, atol=1e-9) and losses[-1] < losses[0]


def test_scores_tell_what_was_not_learnt(spark):
    x = data(400)
    learner = ae.Learner.fresh(SMALL, rate=5e-3)
    for _ in range(1500):
        g, _ = ae.gradient(SMALL, learner.flat, x)
        learner = learner.moved(g / len(x))
    odd = np.random.default_rng(2).normal(0, 2, (100, 6))
    known, other = (np.array([r["anomaly_score"] for r in ae.scored(table(spark, v), learner).collect()]) for v in (data(400, seed=0), odd))
    assert np.median(known) < 0.4 < np.median(other)
    rows = [(1, None), (2, [1.0]), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (4, [float("nan")] * 6), (5, [0.0] * 6)]
    got = {r["id"]: r["anomaly_score"] for r in ae.scored(spark.createDataFrame(rows, "id long, x array<double>"), learner).collect()}
    assert [k for k, v in got.items() if v is None] == [1, 2, 3, 4] and 0 < got[5] < 1
    assert ae.mean_gradient(spark.createDataFrame(rows[:4], "id long, x array<double>"), learner)[2] == 0


def replay(batches: list[np.ndarray], start: ae.Learner, interval: int, normal: float, center: float, slope: float):
    """The same in numpy: (version, rows, normal rows at hand) of each batch, all scores, and the last network."""
    waiting, now, out, scores = np.zeros((0, start.shape.inner[0])), start, [], []
    for x in batches:
        s = 1 / (1 + np.exp(-slope * (ae.errors(now.shape, now.flat, x) - center)))
        scores += [(now.version, v) for v in s]
        low = np.concatenate([waiting, x[s < normal]])
        waiting, n = low, len(low)
        if n >= interval:
            now = now.moved(ae.gradient(now.shape, now.flat, low)[0] / n)
            waiting = low[:0]
        out.append((now.version, len(x), n))
    return out, scores, now


def test_a_stream_learns_as_a_replay_does(spark, tmp_path):
    """Micro-batches with steps and without; a batch that fails after its step is run again and leaves the same."""
    x = data(400, seed=3)
    batches = [x[:120], x[120:150], x[150:170], x[170:300], x[300:]]
    start = ae.Learner.fresh(SMALL, rate=2e-3)
    options = {"interval": 60, "normal": 0.9, "center": 1.0, "slope": 1.0}
    for k, b in enumerate(batches):
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(b)], "id long, x array<double>").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
    schema = "id long, x array<double>"
    rows = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    online = ae.Online(f"file:{tmp_path}/state", start, **options)
    whole, failed = online.learn, []

    def once_lost(batch, number):
        whole(batch, number)
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    online.learn = once_lost
    with pytest.raises(Exception, match="lost"):
        online.stream(rows(), str(tmp_path / "c")).awaitTermination()
    online.stream(rows(), str(tmp_path / "c")).awaitTermination()
    want, scores, last = replay(batches, start, **options)
    got = [(r["version"], r["rows"], r["low"]) for r in online.versions(spark).orderBy("batch").collect()]
    assert got == want and failed and 1 < last.version < 5
    assert np.allclose(online.version(spark, 4).flat, last.flat, atol=1e-9)
    mine = sorted((r["version"], r["anomaly_score"]) for r in online.scores(spark).collect())
    assert [v for v, _ in mine] == sorted(v for v, _ in scores) and np.allclose([s for _, s in mine], [s for _, s in sorted(scores)], atol=1e-9)
    assert online.version(spark, -1) is start


def test_shares_of_the_rows(spark):
    x = data(300)
    got, losses = ae.train(table(spark, x).withColumn("more", F.lit(1)), ae.Learner.fresh(SMALL), 6, parts=3)
    assert got.version == 6 and len(losses) == 6
    empty, none = ae.train(table(spark, x).where("id < 0"), ae.Learner.fresh(SMALL), 2)
    assert empty.version == 0 and none == []


def test_queries_against_plain_replays(spark):
    """The registered queries over their whole tables."""
    from ridgewave.plans import learning as plans

    from .conftest import SF

    rows = plans.detection_vectors(spark, SF).withColumns({"part": F.pmod(F.xxhash64("id"), F.lit(8)), "share": F.pmod(F.xxhash64("id"), F.lit(4))}).orderBy("id").collect()
    x, part, share = np.array([r["x"] for r in rows]), np.array([r["part"] for r in rows]), np.array([r["share"] for r in rows])
    learner = ae.Learner.fresh(rate=1e-2)
    for k in range(16):
        own = x[share == k % 4]
        learner = learner.moved(ae.gradient(learner.shape, learner.flat, own)[0] / len(own))
    want = 1 / (1 + np.exp(-2.0 * (ae.errors(learner.shape, learner.flat, x) - 1.0)))
    got = sorted((r["id"], r["anomaly_score"]) for r in plans.autoencoded(spark, SF).collect())  # ids repeat
    assert np.allclose([s for _, s in got], [s for _, s in sorted((r["id"], s) for r, s in zip(rows, want))], atol=1e-5)
    out, _, _ = replay([x[part == k] for k in range(8)], ae.Learner.fresh(rate=1e-2), 100, 0.5, 1.0, 2.0)
    got = plans.learnt_online(spark, SF).orderBy("batch").collect()
    assert [(r["version"], r["rows"], r["low"]) for r in got] == out and sum(r["rows"] for r in got) == len(x)
    frames = plans.iq_frames(spark, SF).select(F.col("frame_id").alias("id"), F.concat("i", "q").alias("x")).orderBy("id").collect()
    x = np.array([r["x"] for r in frames])
    learner = ae.Learner.fresh(ae.Shape((64, 32, 16, 8)), 1e-2)
    for _ in range(12):
        learner = learner.moved(ae.gradient(learner.shape, learner.flat, x)[0] / len(x))
    got = {r["id"]: r["anomaly_score"] for r in plans.iq_autoencoded(spark, SF).collect()}
    assert np.allclose([got[r["id"]] for r in frames], 1 / (1 + np.exp(-20 * (ae.errors(learner.shape, learner.flat, x) - 0.05))), atol=1e-5)
