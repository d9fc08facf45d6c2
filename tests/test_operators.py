import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftloom.config import AlertBudgetConfig, LoopConfig
from driftloom.functions import text as X
from driftloom.operators import greedy
from driftloom.operators.lifting import reached
from driftloom.operators.distributions import (
    bucket_quantile,
    cumulative_histogram,
    ks_p_asymptotic,
    ks_p_exact,
)
from driftloom.operators.neighbors import nearest
from driftloom.operators.timeline import ranked
from driftloom.plans import accounting, audit, datasets, evaluation, lineage, synthesis
from driftloom.sources import datasets as sets
from driftloom.sources import tables

HOUR = 3_600_000_000


def alert_rows(spark, levels_times):
    rows = [(i, level, t) for i, (level, t) in enumerate(levels_times)]
    return spark.createDataFrame(rows, "alert_id long, level string, ts_us long")


def sent(df):
    return {r.level: r.n for r in df.filter("dispatched").groupBy("level").agg(
        F.count("*").alias("n")).collect()}


def test_alert_budget_goldens(spark):
    rows = (
        [("WARNING", i) for i in range(12)] + [("CRITICAL", i) for i in range(10)]
        + [("EMERGENCY", i) for i in range(20)] + [("INFO", 0)]
    )
    assert sent(greedy.alert_budget(alert_rows(spark, rows))) == {
        "WARNING": 10, "CRITICAL": 5, "EMERGENCY": 20}


def test_alert_budget_window_end(spark):
    rows = [("CRITICAL", 0)] * 5 + [("CRITICAL", HOUR - 1), ("CRITICAL", HOUR), ("CRITICAL", HOUR)]
    out = greedy.alert_budget(alert_rows(spark, rows)).orderBy("alert_id").collect()
    assert [r.dispatched for r in out] == [True] * 5 + [False, True, True]


def fold_budget(times, limit, window):
    kept, out = [], []
    for t in times:
        kept = [s for s in kept if s > t - window]
        ok = len(kept) < limit
        if ok:
            kept.append(t)
        out.append(ok)
    return out


@pytest.mark.parametrize("rate,fold_rows", [(60, 1000), (60, 50), (3, 40)])
def test_alert_budget_in_chunks(spark, rate, fold_rows):
    rnd = random.Random(rate)
    times, t = [], 0
    for _ in range(400):
        t += int(rnd.expovariate(rate) * HOUR)
        times.append(t)
    cfg = AlertBudgetConfig(fold_rows=fold_rows)
    df = alert_rows(spark, [("CRITICAL", t) for t in times])
    got = [r.dispatched for r in greedy.alert_budget(df, cfg).orderBy("alert_id").collect()]
    assert got == fold_budget(times, 5, HOUR)


def test_schedule_never_fires_unrecorded(spark):
    day = 24 * HOUR
    rows = [(i, "a", i * day, False) for i in range(40)]
    rows += [(100 + i, "b", i * day, i == 3) for i in range(40)]
    df = spark.createDataFrame(rows, "tick_id long, schedule string, ts_us long, recorded boolean")
    out = greedy.schedule_fires(df, "schedule").filter("fired").collect()
    assert sorted(r.tick_id - 100 for r in out) == [10, 17, 24, 31, 38]


@pytest.mark.parametrize("fold_rows", [500_000, 20])
def test_cycle_admission(spark, fold_rows):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(150):
        t += rnd.randint(1, 6) * HOUR
        rows.append((i, "c", t, t + rnd.randint(1, 10) * HOUR))
    df = spark.createDataFrame(
        rows, "request_id long, cluster_id string, ts_us long, completed_us long")
    got = greedy.cycle_admission(df, "cluster_id", LoopConfig(fold_rows=fold_rows))
    busy, want = None, []
    for _, _, t, done in rows:
        if busy is not None and t < busy:
            want.append("running")
        elif busy is not None and t - busy < 12 * HOUR:
            want.append("rate_limited")
        else:
            want.append("ok")
            busy = done
    assert [r.reason for r in got.orderBy("request_id").collect()] == want


@pytest.mark.parametrize("fold_rows", [500_000, 30])
def test_schedule_on_large_keys(spark, fold_rows):
    rnd = random.Random(11)
    rows, want = [], []
    for key in ("a", None):
        t, last = 0, None
        for i in range(400):
            t += rnd.randint(0, 30) * HOUR
            recorded = rnd.random() < 0.03
            fires = not recorded and last is not None and t >= last + 168 * HOUR
            if recorded or fires:
                last = t
            rows.append((len(rows), key, t, recorded))
            want.append(fires)
    df = spark.createDataFrame(rows, "tick_id long, schedule string, ts_us long, recorded boolean")
    out = greedy.schedule_fires(df, "schedule", LoopConfig(fold_rows=fold_rows))
    assert out.columns == [*df.columns, "fired"]
    assert [r.fired for r in out.orderBy("tick_id").collect()] == want
    assert sum(want) > 20


@pytest.mark.parametrize("fold_rows", [500_000, 30])
def test_admission_with_odd_completions(spark, fold_rows):
    """Never completed, completed before the start, at equal times, null key."""
    rnd = random.Random(12)
    rows, want = [], []
    for key in ("a", None, "b"):
        t, busy, started = 0, None, False
        for i in range(120):
            t += rnd.choice([0, 0, 1, 5]) * HOUR
            done = None if key == "b" and i == 60 else t + rnd.randint(-20, 9) * HOUR
            rows.append((len(rows), key, t, done))
            if started and (busy is None or t < busy):
                want.append("running")
            elif started and t < busy + 12 * HOUR:
                want.append("rate_limited")
            else:
                want.append("ok")
                started, busy = True, done
    df = spark.createDataFrame(rows, "request_id long, cluster_id string, ts_us long, completed_us long")
    got = greedy.cycle_admission(df, "cluster_id", LoopConfig(fold_rows=fold_rows)).orderBy("request_id").collect()
    assert [r.reason for r in got] == want
    assert [r.admitted for r in got] == [w == "ok" for w in want]


def test_rounds_grow_with_the_log_of_the_path(spark):
    """One key whose path has a thousand rows, as 50 chunks of 20."""
    steps = spark.range(1000).selectExpr("struct('k' as k) as _key", "id as _rn", "nullif(id + 1, 1000) as _next")
    seen, rounds = reached(steps, steps.filter("_rn = 0"))
    assert (seen.count(), rounds) == (1000, 11)


def test_cycle_that_never_ends_blocks_all(spark):
    rows = [(0, "c", 0, None), (1, "c", 100 * HOUR, None)]
    df = spark.createDataFrame(
        rows, "request_id long, cluster_id string, ts_us long, completed_us long")
    out = greedy.cycle_admission(df, "cluster_id").orderBy("request_id").collect()
    assert [r.reason for r in out] == ["ok", "running"]


def test_ranked_is_a_global_row_number(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("request_id"), F.lit("k").alias("k"),
        (F.col("id") * 7919 % 1009 * 10**7).alias("ts_us"))
    out = ranked(df, ["k"], ["ts_us", "request_id"], bucket_us=10**8).orderBy("rn").collect()
    assert [r.rn for r in out] == list(range(1000))
    assert [r.ts_us for r in out] == sorted(r.ts_us for r in out)


def test_null_keys_are_kept(spark):
    df = alert_rows(spark, [(None if i % 3 else "CRITICAL", i) for i in range(60)])
    assert ranked(df, ["level"], ["ts_us", "alert_id"]).count() == 60
    whole = greedy.alert_budget(df)
    parts = greedy.alert_budget(df, AlertBudgetConfig(fold_rows=7))
    assert sent(whole) == sent(parts) == {"CRITICAL": 5, None: 40}
    assert whole.exceptAll(parts).count() == 0


@pytest.mark.parametrize("block", [4096, 13])
def test_nearest_matches_brute_force(spark, block):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 6))
    v[10] = v[3]  # a tie
    df = spark.createDataFrame(
        pd.DataFrame({"id": np.arange(60), "vec": [x.tolist() for x in v]}),
        "id long, vec array<double>")
    q = df.select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    got = nearest(df, q, 4, normalise_vectors=True, block_rows=block).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    for r in got:
        order = sorted(range(60), key=lambda i: (-round(s[r.query_id, i], 12), i))
        assert order[r["rank"] - 1] == r.id or abs(
            s[r.query_id, r.id] - s[r.query_id, order[r["rank"] - 1]]) < 1e-12
    assert len(got) == 240
    assert nearest(df.limit(2), q, 5).count() == 120


def test_latency_buckets(spark):
    ns = [300, 800, 1500, 3000, 7000, 20000, 80000, 200000]
    bounds = [500, 1000, 2000, 5000, 10_000, 50_000, 100_000]
    df = spark.createDataFrame([(float(x),) for x in ns], "ns double")
    h = cumulative_histogram(df, "ns", bounds).collect()
    assert sorted(r.cumulative for r in h) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert bucket_quantile(df, "ns", bounds, 0.99).first().quantile is None
    assert bucket_quantile(df, "ns", bounds, 0.5).first().quantile == 5000
    assert bucket_quantile(df.filter("ns < 0"), "ns", bounds, 0.99).first().quantile == 0.0


def brute_ks(n, m, d):
    """Share of all orderings whose distance is at least d."""
    from itertools import combinations

    hits = total = 0
    for pos in combinations(range(n + m), n):
        taken, i, worst = set(pos), 0, 0.0
        for k in range(n + m):
            i += k in taken
            worst = max(worst, abs(i / n - (k + 1 - i) / m))
        hits += worst >= d - 1e-9
        total += 1
    return hits / total


@pytest.mark.parametrize("n,m,d", [(4, 4, 0.5), (5, 3, 0.6), (6, 5, 0.8), (7, 4, 1.0)])
def test_ks_p_value_by_counting(n, m, d):
    assert ks_p_exact(n, m, d) == pytest.approx(brute_ks(n, m, d), abs=1e-9)


def test_ks_p_value_limits(spark):
    assert ks_p_exact(20, 20, 0.0) == 1.0
    p = spark.range(1).select(
        ks_p_asymptotic(F.lit(3000), F.lit(2500), F.lit(0.04)).alias("p")).first().p
    assert p == pytest.approx(ks_p_exact(3000, 2500, 0.04), rel=0.05)


def test_answer_rules(spark):
    cases = [
        ("a\n\n# note\n b \nc", "3_items", True), ("a\nb", "3_items", False),
        ("the zebra", "Z_prefix", True), ("none", "Z_prefix", False),
        ("It is BLUE.", "Blue", True), ("red", "Blue", False),
        (" a \nb\nc\n\t", "3_items", True),
    ]
    df = spark.createDataFrame(cases, "r string, e string, want boolean")
    out = df.select("want", X.answer_is_correct(F.col("r"), F.col("e")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_arithmetic_judge(spark):
    cases = [
        ("What is 2+3?", "It is 5.", "It is 6.", "A"), ("2+3", "4", "so 5", "B"),
        ("2+3", "5", "5", "TIE"), ("2+3", "none", "5", None), ("color?", "5", "5", None),
    ]
    df = spark.createDataFrame(cases, "p string, a string, b string, want string")
    out = df.select(
        "want", X.arithmetic_verdict(F.col("p"), F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in out)


def test_json_list_strictness(spark):
    df = spark.createDataFrame([('["a [x]", "b"]',)], "raw string")
    strict = df.select(X.json_list(F.col("raw")).alias("v")).first().v
    loose = df.select(X.json_list(F.col("raw"), strict=False).alias("v")).first().v
    assert strict == [] and loose == ["a [x]", "b"]


def test_training_sets_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(f"Q{i}", f"good {i}", f"bad {i}", i % 2 == 0) for i in range(20)],
        "prompt string, chosen string, rejected string, passed_gate boolean")
    for _ in range(2):
        sft, dpo = sets.write_training_sets(pairs, str(tmp_path), "job")
        assert sets.load_sft(spark, sft).count() == 10
        assert sets.load_dpo(spark, dpo).count() == 10
    sft, dpo = sets.write_training_sets(pairs.filter("false"), str(tmp_path), "empty")
    assert sets.load_sft(spark, sft).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"prompt": "a", "response": "b"}\n\n{"prompt": "only"}\n')
    with pytest.raises(ValueError):
        sets.load_sft(spark, str(bad))
    assert sets.load_sft(spark, str(bad), strict=False).count() == 1


def test_prepare_training_set(spark, tmp_path):
    lines = tmp_path / "sft.jsonl"
    lines.write_text("".join(
        f'{{"prompt": "question {i}", "response": "answer {i}"}}\n' for i in range(300)))
    train, held, stats = datasets.prepare_training_set(spark, str(lines))
    assert train.count() + held.count() == 300 and 10 <= held.count() <= 60
    assert stats["total_records"] == 300 and stats["empty_records"] == 0
    ids = spark.range(100).withColumn("text", F.lit("x"))
    train, held = datasets.split_exact(ids, "id", 0.2)
    assert (train.count(), held.count()) == (80, 20)
    with pytest.raises(ValueError):
        datasets.validate_dataset(ids.filter("false"))


def test_checkpoint_folders(spark, tmp_path):
    import json

    for step in (100, 200, 300, 400, 500):
        d = tmp_path / f"ckpt-c1-step{step}"
        d.mkdir()
        (d / "metadata.json").write_text(json.dumps({
            "cycle_id": "c1", "step": step, "phase": "sft", "train_loss": 1.0,
            "eval_loss": 1.1, "timestamp": "t"}))
    rows = tables.read_checkpoints(spark, str(tmp_path), "c1")
    assert [r.step for r in rows.collect()] == [100, 200, 300, 400, 500]
    assert accounting.latest_checkpoint(rows).first().step == 500
    kept = accounting.checkpoint_retention(rows).filter("keep").collect()
    assert sorted(r.step for r in kept) == [300, 400, 500]


def test_costs_and_budget(spark, tmp_path):
    rows = [("c1", "sft_gpu", 8.5), ("c1", "synthesis_api", 4.25), ("c1", "dpo_gpu", 5.0),
            ("c2", "sft_gpu", 1.0)]
    df = spark.createDataFrame(rows, "cycle_id string, component string, amount_usd double")
    totals = {r.cycle_id: r.total_usd for r in accounting.total_per_cycle(df).collect()}
    assert totals == {"c1": 17.75, "c2": 1.0}
    t = accounting.total_per_cycle(df).filter("cycle_id = 'c1'")
    assert accounting.budget_guard(t.withColumn("total_usd", F.lit(18.0)), 3.0, 20.0).first().exceeds
    assert not accounting.budget_guard(t, 2.25, 20.0).first().exceeds
    with pytest.raises(ValueError):
        tables.append_costs(df.withColumn("amount_usd", F.lit(-1.0)), f"{tmp_path}/c")


def test_projected_cost_stops_small_budgets(spark):
    cycles = spark.createDataFrame(
        [("a", "dir/a", 5.0), ("b", "dir/b", None)],
        "cycle_id string, cycle_dir string, budget_usd double")
    runs = spark.createDataFrame(
        [(c, p, 3600.0, 3.21, f"{p}/{c}") for c in "ab" for p in ("sft", "dpo")],
        "cycle_id string, phase string, duration_s double, hourly_usd double, path string")
    none = spark.createDataFrame([], "cycle_id string, amount_usd double")
    out = {r.cycle_id: r for r in accounting.cycle_accounting(cycles, runs, none).collect()}
    assert out["a"].status == "COST_EXCEEDED" and out["a"].candidate_path == "dir/a"
    assert out["b"].status == "COMPLETED" and out["b"].cost_usd == pytest.approx(6.42)
    assert out["b"].gpu_hours == 2.0 and out["b"].candidate_path == "dpo/b"


def nodes(spark, rows):
    full = [(a, p, "2024-01-01", "CANDIDATE", s) for a, p, s in rows]
    return spark.createDataFrame(
        full, "adapter_id string, parent_adapter_id string, created_at string, status string, "
        "evaluation_scores string")


def chain(df, adapter, depth=10):
    rows = lineage.ancestor_chains(df, depth).filter(F.col("adapter_id") == adapter)
    return [r.ancestor_id for r in rows.orderBy("position").collect()]


def test_ancestors(spark):
    df = nodes(spark, [("v1", None, "{}"), ("v2", "v1", "{}"), ("v3", "v2", "{}"),
                       ("x", "gone", "{}"), ("p", "q", "{}"), ("q", "p", "{}"), ("s", "s", "{}")])
    assert chain(df, "v3") == ["v1", "v2", "v3"]
    assert chain(df, "x") == ["x"]
    assert chain(df, "p") == ["q", "p"]
    assert chain(df, "s") == ["s"]
    long = nodes(spark, [(f"n{i}", f"n{i - 1}" if i else None, "{}") for i in range(30)])
    assert chain(long, "n29") == [f"n{i}" for i in range(19, 30)]
    assert chain(long, "n5", 3) == ["n2", "n3", "n4", "n5"]


def test_compare_adapters(spark):
    df = nodes(spark, [("a", None, '{"x": 0.5, "y": 0.25}'), ("b", "a", '{"y": 0.5, "z": 1.0}')])
    got = {r.benchmark: r.delta for r in lineage.compare_adapters(df, "a", "b").collect()}
    assert got == {"x": -0.5, "y": 0.25, "z": 1.0}
    with pytest.raises(KeyError):
        lineage.compare_adapters(df, "a", "missing")


def test_happy_path_history(spark):
    path = ["IDLE", "EVIDENCE_QUALIFYING", "SYNTHESIZING", "TRAINING_SFT", "TRAINING_DPO",
            "EVALUATING", "DEPLOYING_CANARY", "PROMOTING_FULL", "IDLE"]
    moves = [("IDLE", "IDLE")] + list(zip(path, path[1:]))
    rows = [("e1", i, i * 1_000_000, a, b) for i, (a, b) in enumerate(moves)]
    rows += [("e2", 0, 0, "IDLE", "IDLE"), ("e2", 1, 5, "IDLE", "TRAINING_SFT")]
    log = spark.createDataFrame(
        rows, "execution_id string, seq long, ts_us long, from_state string, to_state string")
    s = {r.execution_id: r for r in audit.execution_summaries(log).collect()}
    assert s["e1"].history_rows == 9 and s["e1"].duration_s == 8.0
    assert s["e1"].current_state == "IDLE" and s["e2"].archived_us is None
    bad = audit.illegal_transitions(log.filter("seq > 0")).collect()
    assert [(r.execution_id, r.to_state) for r in bad] == [("e2", "TRAINING_SFT")]


def gate(spark, right, safe=True):
    """One adapter that solves `right` of 20 sums; production solves half of them."""
    rows = [
        ("a", 0, f"What is {i}+{i}?", f"The answer is {2 * i + (i >= right)}.",
         f"The answer is {2 * i + (i % 2)}.", str(2 * i), "arithmetic") for i in range(20)
    ]
    pairs = spark.createDataFrame(
        rows, "adapter_id string, cluster_id int, prompt string, candidate string, "
        "production string, expected string, suite string")
    safety = spark.createDataFrame(
        [("a", f"p{i}", "I cannot help." if safe else "Sure!") for i in range(5)],
        "adapter_id string, prompt string, response string")
    return evaluation.evaluate_adapters(pairs, pairs, pairs, safety).first()


def test_gate_verdicts(spark):
    good = gate(spark, 20)
    assert good.overall_passed and good.failure_reason is None
    worse = gate(spark, 2)
    assert not worse.tier1_passed
    assert worse.failure_reason.startswith("Tier 1 regression: arithmetic: delta=-")
    unsafe = gate(spark, 20, safe=False)
    assert unsafe.failure_reason == (
        "Tier 4 safety: 5 harmful prompt(s) not refused (refusal_rate=0.00, need >= 0.95)")
    assert evaluation.improvement_results(
        spark.createDataFrame([("a", 1, "1+1", "2", "2")],
                              "adapter_id string, cluster_id int, prompt string, "
                              "candidate string, production string")).first().passed is False


def test_descriptions_fall_back(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "cluster_id long, member_count long")
    samples = spark.createDataFrame(
        [(0, 1, "compute the product of primes"), (0, 2, "product of primes again"),
         (1, 1, "the of an")], "cluster_id long, rank int, prompt string")
    got = {r.cluster_id: r.archetype_description
           for r in synthesis.descriptions(sizes, samples).collect()}
    assert got[0] == "Cluster of 5 failures involving: product, primes, compute"
    assert got[1] == "Cluster of 6 failures (cluster_id=1)"
    assert got[2] == "Cluster of 7 failures (no representative samples)"


def test_synthesis_job_end_to_end(spark, tmp_path):
    rows = [(f"m{i}", f"multiply numbers by {i % 3} times table", "bad", -2.0) for i in range(20)]
    rows += [(f"s{i}", f"bubble sort list python code {i % 3}", "worse", -3.0) for i in range(20)]
    f = spark.createDataFrame(
        rows, "request_id string, prompt string, response string, mean_logprob double")
    pairs, totals = synthesis.synthesize(f, "job-x", str(tmp_path))
    t = totals.first()
    assert t.clusters_processed >= 2 and t.pairs_synthesized == 20 * t.clusters_processed
    assert t.pairs_passing == t.pairs_synthesized
    assert t.overall_factor == pytest.approx(t.pairs_passing / 40)
    assert sets.load_sft(spark, f"{tmp_path}/job-x/sft_data.jsonl").count() == t.pairs_passing
    assert sets.load_dpo(spark, f"{tmp_path}/job-x/dpo_data.jsonl").count() == t.pairs_passing
    _, none = synthesis.synthesize(f.limit(3), "job-y")
    assert none.first().pairs_synthesized == 0 and none.first().overall_factor == 0.0


def test_model_hooks(spark):
    from driftloom.functions import hooks

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("abc",), ("de",)], "text string")
    rows = df.select(hooks.model_embedding(load)(F.col("text")).alias("v")).collect()
    assert all(sum(x * x for x in r.v) == pytest.approx(1.0, rel=1e-5) for r in rows)
    judge = hooks.model_judge(lambda: lambda prompts: [
        '{"preference_clarity": 0.9, "prompt_validity": 0.9, "response_quality": 0.9, '
        '"amplification_fidelity": 0.6}' for _ in prompts])
    s = df.select(X.judge_scores(judge(F.col("text"))).alias("s")).first().s
    assert s.amplification_fidelity == 0.6 and not s.parse_error


def test_broken_channel_stops_no_other(spark):
    from driftloom.plans.alerts import dispatch_alerts

    seen = []

    def broken(df):
        raise RuntimeError("down")

    out = dispatch_alerts(
        alert_rows(spark, [("CRITICAL", i) for i in range(7)]),
        [broken, lambda df: seen.append(df.count())])
    assert seen == [5] and out.count() == 5


def test_preference_sets_are_validated(spark, tmp_path):
    from driftloom.plans.datasets import prepare_preference_set

    def written(name, rows):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame([(r,) for r in rows], "value string").write.text(path)
        return path

    good = ['{"prompt": "p%d", "chosen": "cc", "rejected": "r"}' % i for i in range(50)]
    train, held, stats = prepare_preference_set(spark, written("good", [*good, "", "  "]), 0.3)
    assert train.count() + held.count() == 50 and held.count() > 3
    assert train.join(held, ["prompt"]).count() == 0
    assert stats["chosen"]["total_records"] == 50 and stats["chosen"]["avg_text_length"] == 2.0
    for name, rows in {
        "empty": ["", ""], "blank": [*good, '{"prompt": "p", "chosen": "", "rejected": "r"}'],
        "lacking": [*good, '{"prompt": "p", "chosen": "c"}'],
    }.items():
        with pytest.raises(ValueError):
            prepare_preference_set(spark, written(name, rows))


def test_nearest_sends_no_more_often_for_more_rows(spark, monkeypatch):
    """Blocks grow with the table, tiles do not; copies beyond a tile keep the smaller ids."""
    from driftloom.operators import neighbors

    assert neighbors.block_count(spark.range(1000).selectExpr("array(id, 1) as vec"), "vec", 10) == neighbors.FEW_BLOCKS
    monkeypatch.setattr(neighbors, "TILE", 16)
    rng = np.random.default_rng(4)
    b = np.round(rng.normal(size=(100, 3)))
    b = np.vstack([b, b[:50], [[np.nan] * 3]])
    row, col, score = neighbors.best_of(b[:40], b, 5, (np.arange(40), np.arange(len(b)) // 2))
    for i in range(40):
        s = np.nan_to_num(b @ b[i], nan=-np.inf)
        s[2 * i:2 * i + 2] = -np.inf
        want = np.argsort(-s, kind="stable")[:5]
        assert col[row == i].tolist() == want.tolist() and np.allclose(score[row == i], s[want])


def test_doubling_keeps_only_rows_that_are_led_to(spark, monkeypatch):
    """Many rows that lead to a few: after the first round the others are not carried on."""
    from driftloom.operators import lifting

    sizes = []
    real = lifting.cut

    def counted(df):
        out = real(df)
        if "_next" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(lifting, "cut", counted)
    rows = spark.range(1000).select(F.struct(F.lit("a").alias("k")).alias("_key"), F.col("id").alias("_rn"))
    steps = rows.withColumn("_next", (F.floor(F.col("_rn") / 100) + 1).cast("long") * 100).filter("_next < 1000")
    seen, _ = lifting.reached(steps, rows.filter("_rn = 7"))
    assert sorted(r["_rn"] for r in seen.collect()) == [7, *range(100, 1000, 100)]
    assert sizes[0] == 900 and max(sizes[1:]) <= 10
