from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from driftloom.catalog.fixtures import CFG, signals
from driftloom.config import DIMENSIONS, WEIGHTS, DriftConfig
from driftloom.functions import signals as S
from driftloom.operators.adaptive import SEED, adaptive_scores, fold_scores
from driftloom.operators.evidence import evidence_stats, own_rows, qualified
from driftloom.operators.ewma import calibrated_baseline, moving_baseline
from driftloom.plans import drift
from driftloom.plans.drift import KEYS, NARROW

NORMAL = (-1.5, 0.3, 2.0, 0.0, -2.5)
SHIFTED = (-3.5, 1.5, 4.5, 5 / 64, -5.5)


def stream(spark, blocks, step_us=1000):
    """Signals of one key: blocks of (count, five dimensions)."""
    df, start = None, 0
    for n, dims in blocks:
        part = spark.range(start, start + n).select(
            F.format_string("r%06d", "id").alias("request_id"),
            (F.col("id") * step_us + 1_700_000_000_000_000).alias("ts_us"),
            F.lit("adapter-v1").alias("model_version"), F.lit("t").alias("tenant_id"),
            *[F.lit(float(v)).alias(d) for d, v in zip(DIMENSIONS, dims)],
        )
        df = part if df is None else df.unionByName(part)
        start += n
    return df


def test_golden_shift(spark):
    s = stream(spark, [(1000, NORMAL), (500, SHIFTED)])
    scored = adaptive_scores(s).collect()
    assert len(scored) == 500
    assert all(r.composite == pytest.approx(108.838542, abs=1e-6) for r in scored)
    first = scored[0].asDict()
    want = {"mean_logprob": -133.3333, "logprob_variance": 120.0, "logprob_entropy_mean": 125.0,
            "uncertainty_spike_freq": 7.8125, "min_logprob": -120.0}
    for d, z in want.items():
        assert first["z_" + d] == pytest.approx(z, abs=1e-3)
    leveled = drift.with_alert_level(adaptive_scores(s))
    assert leveled.filter("alert_level = 'EMERGENCY'").count() == 500
    events = sorted(drift.drift_events(leveled).collect(), key=lambda r: r.detected_at)
    assert len(events) == 471
    assert {e.drift_type for e in events} == {"CATASTROPHIC"}
    assert events[0].affected_request_fraction == pytest.approx(0.06)
    assert events[-1].affected_request_fraction == 1.0
    assert len(events[0].evidence_request_ids) == 30
    assert len(events[-1].evidence_request_ids) == 50
    assert events[-1].evidence_request_ids[-1] == "r001499"


def test_constant_signal_never_alerts(spark):
    assert drift.detect_drift(stream(spark, [(5000, NORMAL)])).count() == 0


def test_calibration_boundary(spark):
    assert adaptive_scores(stream(spark, [(1000, NORMAL)])).count() == 0
    assert adaptive_scores(stream(spark, [(1001, NORMAL)])).count() == 1
    b = calibrated_baseline(stream(spark, [(999, NORMAL)]), KEYS).first()
    assert b.is_calibrating and b.event_count == 999


def test_baseline_freezes_during_drift(spark):
    from driftloom.operators.adaptive import adaptive_baselines

    b = adaptive_baselines(stream(spark, [(1000, NORMAL), (500, SHIFTED)])).first()
    assert b.event_count == 1000
    assert b.mean_mean_logprob == pytest.approx(-1.5)


@pytest.mark.parametrize("fold_rows", [97, 400])
def test_chunked_fold_equals_whole_fold(spark, fold_rows):
    s = signals(spark, "/root/testdata/sf0.001").select(*NARROW)
    cfg = replace(CFG, calibration_events=30)
    whole = adaptive_scores(s, ["model_version"], cfg)
    parts = adaptive_scores(s, ["model_version"], replace(cfg, fold_rows=fold_rows))
    cols = ["request_id", "composite", *["z_" + d for d in DIMENSIONS]]
    assert whole.count() == parts.count() > 0
    assert whole.select(*cols).exceptAll(parts.select(*cols)).count() == 0


def test_tree_fold_equals_step_by_step(spark):
    s = signals(spark, "/root/testdata/sf0.001").select(*NARROW)
    got = {(r.dim): r for r in moving_baseline(
        s.withColumn("k", F.lit(1)), ["k"], cfg=CFG).collect()}
    rows = [tuple(r) for r in s.orderBy("ts_us", "request_id").select(*DIMENSIONS).collect()]
    _, end = fold_scores(rows, dict(SEED), replace(CFG, calibration_events=10**9))
    for d in DIMENSIONS:
        assert got[d].mean == pytest.approx(end["mean_" + d], rel=1e-9)
        assert got[d].var == pytest.approx(end["var_" + d], rel=1e-9)
        assert got[d].n_events == len(rows)


def scored_rows(spark, composites, gap_us=300_000):
    rows = [(f"r{i:06d}", i * gap_us, "m", "t", float(c)) for i, c in enumerate(composites)]
    return spark.createDataFrame(
        rows, "request_id string, ts_us long, model_version string, tenant_id string, "
        "composite double")


def verdict(spark, composites):
    stats = own_rows(evidence_stats(scored_rows(spark, composites)))
    return stats.orderBy(F.desc("ts_us")).select(qualified().alias("q")).first().q


def test_incoherent_evidence_is_rejected(spark):
    import random

    rnd = random.Random(7)
    mixed = [rnd.uniform(2.0, 2.5) for _ in range(75)] + [rnd.uniform(7, 10) for _ in range(75)]
    rnd.shuffle(mixed)
    assert not verdict(spark, mixed)


def test_coherent_evidence_is_accepted(spark):
    import random

    rnd = random.Random(8)
    assert verdict(spark, [rnd.gauss(5.5, 0.05) for _ in range(150)])
    assert not verdict(spark, [5.5] * 29)
    assert verdict(spark, [5.5] * 30)


@pytest.mark.parametrize("block", [37, 1000])
def test_evidence_blocks_match_brute_force(spark, block):
    import random

    import numpy as np

    rnd = random.Random(9)
    comps = [rnd.choice([0.5, 2.5, 4.0, 9.0]) for _ in range(300)]
    cfg = replace(DriftConfig(), buffer_rows=20, block_rows=block)
    got = {r.request_id: r for r in own_rows(
        evidence_stats(scored_rows(spark, comps, 7_000_000), cfg)).collect()}
    assert len(got) == 300
    for i in range(300):
        lo = max(0, i - 19)
        c = np.array(comps[lo:i + 1])
        t = np.arange(lo, i + 1) * 7.0
        r = got[f"r{i:06d}"]
        hit = c >= 2
        assert r.buffer_len == len(c) and r.n_anomalous == hit.sum()
        if hit.any():
            assert r.mean_anomalous == pytest.approx(c[hit].mean())
            assert r.std_anomalous == pytest.approx(c[hit].std(), abs=1e-6)
        for w in (60, 300, 600):
            in_w = hit & (t >= t[-1] - w)
            assert r[f"n_{w}s"] == in_w.sum()
            if in_w.any():
                assert r[f"avg_{w}s"] == pytest.approx(c[in_w].mean())


def z_frame(spark, **z):
    vals = [float(z.get(d, 0.0)) for d in DIMENSIONS]
    return spark.createDataFrame([tuple(vals)], ", ".join(f"z_{d} double" for d in DIMENSIONS))


@pytest.mark.parametrize(
    "z,kind",
    [
        (dict(min_logprob=-6, uncertainty_spike_freq=5), "CATASTROPHIC"),
        (dict(logprob_entropy_mean=4, logprob_variance=1), "INPUT_DISTRIBUTION"),
        (dict(mean_logprob=-3, logprob_entropy_mean=1), "CONCEPT"),
        (dict(mean_logprob=-1, logprob_entropy_mean=2.5), "GRADUAL"),
        (dict(min_logprob=-5, uncertainty_spike_freq=4, logprob_entropy_mean=9), "CATASTROPHIC"),
    ],
)
def test_drift_types(spark, z, kind):
    assert z_frame(spark, **z).select(S.drift_type().alias("k")).first().k == kind


def test_zero_std_weights_and_ties(spark):
    one = spark.range(1)
    z = one.select(S.z_score(F.lit(5.0), F.lit(1.0), F.lit(0.0)).alias("z")).first().z
    assert z == 0.0
    assert sum(WEIGHTS.values()) == pytest.approx(1.0)
    tie = z_frame(spark, logprob_variance=3, mean_logprob=-3)
    assert tie.select(S.dominant_dimension().alias("d")).first().d == "mean_logprob"


def test_thresholds_can_change(spark):
    s = scored_rows(spark, [2.5] * 50)
    base = drift.with_alert_level(s).select("alert_level").distinct().collect()
    assert [r.alert_level for r in base] == ["INFO"]
    out = drift.with_thresholds(s, [("CRITICAL", 2.0, 25 * 300_000)])
    counts = {r.alert_level: r["count"] for r in out.groupBy("alert_level").count().collect()}
    assert counts == {"INFO": 25, "CRITICAL": 25}
    with pytest.raises(ValueError):
        drift.with_thresholds(s, [("CRITICAL", 0.0, 0)])


def test_non_finite_signals_are_kept_apart(spark):
    s = stream(spark, [(3, NORMAL)]).withColumn(
        "min_logprob", F.when(F.col("request_id") == "r000001", float("nan"))
        .when(F.col("request_id") == "r000002", float("-inf")).otherwise(F.col("min_logprob")))
    good, bad = S.split_finite(s)
    assert good.count() == 1 and bad.count() == 2


def test_snapshot_round_trip(spark, tmp_path):
    from driftloom.sources.tables import load_baselines, save_baselines

    s = signals(spark, "/root/testdata/sf0.001")
    b = calibrated_baseline(s, KEYS, cfg=replace(CFG, calibration_events=50))
    save_baselines(b, f"{tmp_path}/b")
    back = load_baselines(spark, f"{tmp_path}/b", 50)
    assert back.select(*b.columns).exceptAll(b).count() == 0
    assert drift.score_frozen(s, back, CFG).count() == s.count()


def test_plans_stay_distributed(spark):
    s = signals(spark, "/root/testdata/sf0.001")
    for df in (
        drift.score_frozen(s, None, CFG),
        drift.with_alert_level(drift.score_frozen(s, None, CFG), CFG),
        own_rows(evidence_stats(drift.score_frozen(s, None, CFG), CFG)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
        assert "NestedLoop" not in plan
        assert "SinglePartition" not in plan


def test_first_events_are_limited_before_the_exchange(spark):
    s = signals(spark, "/root/testdata/sf0.001")
    plan = calibrated_baseline(s, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_small_snapshots_are_broadcast(spark, monkeypatch):
    s = signals(spark, "/root/testdata/sf0.001")
    def plan():
        return drift.score_frozen(s, None, CFG)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(drift, "BROADCAST_BASELINES", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
