"""Moving mean and variance baselines (ungated).

One step maps the state (m, v) to

    m' = alpha_m * x + (1 - alpha_m) * m
    v' = alpha_v * (x - m')^2 + (1 - alpha_v) * v

so any run of rows maps m affinely and v to `av*v + P - Q*m + R*m^2`. Such maps compose, and a
key of any length folds as a tree: blocks of rows first, then blocks of maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.config import DIMENSIONS, DriftConfig
from driftloom.operators.timeline import ranked, whole_part

CFG = DriftConfig()
FAN_IN = 1000
FIELDS = ("a", "b", "av", "p", "q", "r")


def _map(**kw) -> Column:
    return F.struct(*[kw[f].alias(f) for f in FIELDS])


def _identity() -> Column:
    one, zero = F.lit(1.0), F.lit(0.0)
    return _map(a=one, b=zero, av=one, p=zero, q=zero, r=zero)


def _step(s: Column, x: Column, first: Column, cfg: DriftConfig) -> Column:
    am, av = cfg.alpha_mean, cfg.alpha_var
    a = s["a"] * (1.0 - am)
    b = s["b"] * (1.0 - am) + x * am
    d = x - b
    zero = F.lit(0.0)
    grown = _map(
        a=a,
        b=b,
        av=s["av"] * (1.0 - av),
        p=s["p"] * (1.0 - av) + d * d * av,
        q=s["q"] * (1.0 - av) + a * d * (2.0 * av),
        r=s["r"] * (1.0 - av) + a * a * av,
    )
    seeded = _map(a=zero, b=x, av=zero, p=zero, q=zero, r=zero)
    return F.when(first, seeded).otherwise(grown)


def _then(s: Column, t: Column) -> Column:
    """Map of the rows behind `s` followed by the rows behind `t`."""
    return _map(
        a=t["a"] * s["a"],
        b=t["a"] * s["b"] + t["b"],
        av=t["av"] * s["av"],
        p=t["av"] * s["p"] + t["p"] - t["q"] * s["b"] + t["r"] * s["b"] * s["b"],
        q=t["av"] * s["q"] + t["q"] * s["a"] - t["r"] * s["a"] * s["b"] * 2.0,
        r=t["av"] * s["r"] + t["r"] * s["a"] * s["a"],
    )


def moving_baseline(
    df: DataFrame,
    keys: list[str],
    dims: tuple = DIMENSIONS,
    cfg: DriftConfig = CFG,
    ts: str = "ts_us",
    tie: str = "request_id",
    levels: int = 3,
) -> DataFrame:
    """Mean and variance per key and dimension after all rows: keys, dim, n_events, mean, var.

    `levels` tree levels of 1000 hold 10^(3*(levels+1)) rows per key.
    """
    rows = ranked(df.select(*keys, ts, tie, *dims), keys, [ts, tie], ts)
    in_order = F.array_sort(F.collect_list(F.struct("rn", *[F.col(d) for d in dims])))

    def series(d: str) -> Column:
        return F.transform("_rows", lambda r: F.struct(r["rn"].alias("rn"), r[d].alias("x")))

    blocks = (
        rows.withColumn("_node", whole_part(F.col("rn"), FAN_IN))
        .groupBy(*keys, "_node")
        .agg(in_order.alias("_rows"))
        .select(
            *keys,
            "_node",
            F.size("_rows").cast("long").alias("n_events"),
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(d).alias("dim"), series(d).alias("xs"))
                        for d in dims
                    ]
                )
            ).alias("_d"),
        )
        .select(
            *keys,
            "_node",
            "n_events",
            F.col("_d.dim").alias("dim"),
            F.aggregate(
                "_d.xs", _identity(), lambda s, r: _step(s, r["x"], r["rn"] == 0, cfg)
            ).alias("_f"),
        )
    )
    for _ in range(levels):
        blocks = (
            blocks.withColumn("_up", whole_part(F.col("_node"), FAN_IN))
            .groupBy(*keys, "dim", "_up")
            .agg(
                F.sum("n_events").alias("n_events"),
                F.array_sort(F.collect_list(F.struct("_node", "_f"))).alias("_fs"),
            )
            .select(
                *keys,
                "dim",
                F.col("_up").alias("_node"),
                "n_events",
                F.aggregate("_fs", _identity(), lambda s, r: _then(s, r["_f"])).alias("_f"),
            )
        )
    return blocks.select(
        *keys, "dim", "n_events", F.col("_f.b").alias("mean"), F.col("_f.p").alias("var")
    )


def first_events(
    df: DataFrame, keys: list[str], n: int, ts: str = "ts_us", tie: str = "request_id"
) -> DataFrame:
    """First n rows per key; the rank filter is applied before the exchange as well."""
    w = W.partitionBy(*keys).orderBy(ts, tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def calibrated_baseline(
    df: DataFrame,
    keys: list[str],
    dims: tuple = DIMENSIONS,
    cfg: DriftConfig = CFG,
    ts: str = "ts_us",
    tie: str = "request_id",
) -> DataFrame:
    """Flat snapshot after each key's first `calibration_events` rows.

    Columns: keys, event_count, is_calibrating, mean_<dim>, var_<dim>.
    """
    head = first_events(df.select(*keys, ts, tie, *dims), keys, cfg.calibration_events, ts, tie)
    folded = head.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(ts, tie, *[F.col(d) for d in dims]))).alias("_rows")
    )
    am, av = cfg.alpha_mean, cfg.alpha_var

    def learn(d):
        def step(s, r):
            x = r[d]
            m = x * am + s["m"] * (1.0 - am)
            dev = x - m
            return F.when(
                s["m"].isNull(), F.struct(x.alias("m"), F.lit(0.0).alias("v"))
            ).otherwise(F.struct(m.alias("m"), (dev * dev * av + s["v"] * (1.0 - av)).alias("v")))

        start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(0.0).alias("v"))
        return F.aggregate("_rows", start, step)

    n = F.size("_rows").cast("long")
    states = folded.select(
        *keys, n.alias("event_count"), *[learn(d).alias("_s_" + d) for d in dims]
    )
    return states.select(
        *keys,
        "event_count",
        (F.col("event_count") < cfg.calibration_events).alias("is_calibrating"),
        *[F.col(f"_s_{d}.m").alias("mean_" + d) for d in dims],
        *[F.col(f"_s_{d}.v").alias("var_" + d) for d in dims],
    )
