"""Evidence buffers per model: the last 500 scored events, judged at every event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.config import DriftConfig
from driftloom.operators.timeline import TOTAL, exact, ranked, row_blocks

CFG = DriftConfig()


def evidence_stats(
    scored: DataFrame, cfg: DriftConfig = CFG, key: str = "model_version"
) -> DataFrame:
    """Adds, per scored event, what its model's buffer looks like at that moment.

    Columns: buffer_len, n_anomalous, mean_anomalous, std_anomalous, and n_<w>s / avg_<w>s per
    persistence window. Rows are ranked per model and placed in row blocks with a halo of one
    buffer, so a model's rows spread over many tasks. The buffer and a time window both end at
    the current row; their intersection is the shorter one, whose start has the larger total.
    """
    buf = cfg.buffer_rows
    rows = row_blocks(
        ranked(scored, [key], ["ts_us", "request_id"]), "rn", cfg.block_rows, buf - 1
    )
    part = W.partitionBy(key, "_block")
    line = part.orderBy("ts_us", "request_id")
    upto = line.rowsBetween(W.unboundedPreceding, W.currentRow)

    hit = F.col("composite") >= cfg.anomalous_at
    x = F.when(hit, exact(F.col("composite")))
    xx = F.when(hit, exact(F.col("composite") * F.col("composite")))
    zero = F.lit(0).cast(TOTAL)
    rows = rows.withColumns(
        {
            "_n": F.count(x).over(upto),
            "_s": F.coalesce(F.sum(x).over(upto), zero),
            "_q": F.coalesce(F.sum(xx).over(upto), zero),
        }
    )
    lagged = {
        "_n0": F.coalesce(F.lag("_n", buf).over(line), F.lit(0)),
        "_s0": F.coalesce(F.lag("_s", buf).over(line), zero),
        "_q0": F.coalesce(F.lag("_q", buf).over(line), zero),
    }
    for w in cfg.persistence_windows_s:
        before = part.orderBy("ts_us").rangeBetween(
            W.unboundedPreceding, -(w * 1_000_000 + 1)
        )
        lagged[f"_n_{w}"] = F.count(x).over(before)
        lagged[f"_s_{w}"] = F.coalesce(F.sum(x).over(before), zero)
    rows = rows.withColumns(lagged)

    n = F.col("_n") - F.col("_n0")
    s = (F.col("_s") - F.col("_s0")).cast("double")
    q = (F.col("_q") - F.col("_q0")).cast("double")
    mean = F.when(n > 0, s / n)
    cols = {
        "buffer_len": F.least(F.col("rn") + 1, F.lit(buf)),
        "n_anomalous": n,
        "mean_anomalous": mean,
        "std_anomalous": F.when(
            n > 0, F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0)))
        ),
    }
    for w in cfg.persistence_windows_s:
        k = F.col("_n") - F.greatest(F.col("_n0"), F.col(f"_n_{w}"))
        t = (F.col("_s") - F.greatest(F.col("_s0"), F.col(f"_s_{w}"))).cast("double")
        cols[f"n_{w}s"] = k
        cols[f"avg_{w}s"] = F.when(k > 0, t / k)
    drop = [c for c in rows.columns if c.startswith("_") and c not in ("_block", "_halo")]
    return rows.withColumns(cols).drop(*drop)


def qualified(cfg: DriftConfig = CFG):
    """Significant, coherent and persistent at once."""
    ok = (
        (F.col("n_anomalous") >= cfg.min_anomalous)
        & (F.col("mean_anomalous") != 0.0)
        & (F.col("std_anomalous") / F.col("mean_anomalous") < cfg.max_variation)
    )
    for w in cfg.persistence_windows_s:
        ok = ok & (F.col(f"n_{w}s") > 0) & (F.col(f"avg_{w}s") >= cfg.persistence_at)
    return F.coalesce(ok, F.lit(False))


def with_evidence_ids(
    stats: DataFrame, emitted, cfg: DriftConfig = CFG, key: str = "model_version"
) -> DataFrame:
    """Rows where `emitted` holds, each with the last 50 request ids of its buffer.

    Id lists are built only around emitted rows: all other rows are dropped first, which keeps
    the 49 rows before every emitted one.
    """
    ids = cfg.evidence_ids
    line = W.partitionBy(key, "_block").orderBy("ts_us", "request_id")
    own = emitted & ~F.col("_halo")
    near = F.max(own.cast("int")).over(line.rowsBetween(W.currentRow, ids - 1))
    kept = stats.withColumn("_emit", own).withColumn("_near", near).filter(F.col("_near") == 1)
    return (
        kept.withColumn(
            "evidence_request_ids",
            F.collect_list("request_id").over(line.rowsBetween(-(ids - 1), W.currentRow)),
        )
        .filter("_emit")
        .drop("_emit", "_near", "_block", "_halo")
    )


def own_rows(stats: DataFrame) -> DataFrame:
    """Statistics without the halo copies."""
    return stats.filter(~F.col("_halo")).drop("_block", "_halo")
