import pandas as pd
import numpy as np

from driftloom.plans import synthesis as S


def test_texts_are_written_once(spark, monkeypatch):
    """Only samples of clusters fetch their texts; rows of one request id stay apart."""
    tables, cut = [], S.cut

    def watched(df):
        out = cut(df)
        tables.append(out.columns)
        return out

    monkeypatch.setattr(S, "cut", watched)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(3, 8))
    v = np.repeat(centers, 30, axis=0) + rng.normal(scale=0.02, size=(90, 8))
    v = np.vstack([v, rng.normal(size=(6, 8))])
    rows = pd.DataFrame({
        "request_id": [f"r{i // 2}" for i in range(len(v))], "prompt": [f"prompt number{i}" for i in range(len(v))],
        "response": "no", "mean_logprob": -1.0, "embedding": [x.tolist() for x in v],
    })
    table, noise = S.find_clusters(spark.createDataFrame(rows))
    found = table.collect()
    assert not any("prompt" in columns for columns in tables)
    assert sum(r.member_count for r in found) + noise.count() == len(v)
    assert len(found) == 3 and all(len(r.representative_samples) == 10 for r in found)
    for r in found:
        blocks = {int(s.prompt.removeprefix("prompt number")) // 30 for s in r.representative_samples}
        assert len(blocks) == 1
    assert set(noise.columns) == {*rows.columns, "cluster_id"}
