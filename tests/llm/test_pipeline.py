"""The corpus pipeline against a plain chain over a small fixture."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from driftloom.llm.mixing import mixed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = np.array(["w%d" % i for i in range(500)])
    bad = ["scum", "moron", "trash", "loser"]
    texts = []
    for i in range(240):
        own = rng.choice(words, int(rng.integers(30, 120))).tolist()
        if i % 6 == 0:
            own += [bad[i // 6 % 4], bad[(i // 6 + 1) % 4], bad[(i // 6 + 2) % 4]]
        texts.append(" ".join(own))
    clean = [i for i in range(240) if i % 6]
    texts += [texts[clean[0]]] * 5 + [texts[clean[1]]] * 2  # 240-246
    for i in range(4):  # near copies, 247-250
        near = texts[clean[2]].split()
        near[-1] = "other%d" % i
        texts.append(" ".join(near))
    texts += [None, "", "two words", "Two words"]  # 251-254
    sources = ["s1", "s2", "s1", None, "s1"]
    rows = [(i, t, "en", sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240) if i % 3 != 1]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_a_plain_chain(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    state = {r[0]: r for r in rows}
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]

    got = cp.STAGES[0][1](spark, docs, path)
    assert got.columns == docs.columns
    state = {i: r for i, r in state.items() if not (i < 240 and i % 6 == 0)}
    docs = spark.createDataFrame(got.collect(), SCHEMA)
    assert {r["doc_id"] for r in docs.collect()} == set(state)

    got = cp.STAGES[1][1](spark, docs, path)
    last = {}
    for i in sorted(state):
        last[state[i][1] or ""] = i
    state = {i: state[i] for i in last.values()}
    docs = spark.createDataFrame(got.collect(), SCHEMA)
    assert got.columns == docs.columns and {r["doc_id"] for r in docs.collect()} == set(state)

    got = cp.STAGES[2][1](spark, docs, path)
    sets, kept = {i: _shingles(r[1]) for i, r in state.items()}, []
    root = {i: i for i in state}
    for i in sorted(state):
        for j in sorted(state):
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    kept = {i for i in state if root[i] == i}
    docs = spark.createDataFrame(got.collect(), SCHEMA)
    assert {r["doc_id"] for r in docs.collect()} == kept and len(kept) < len(state)

    copies = {r["doc_id"]: r["copies"] for r in mixed(docs).collect()}
    got = cp.STAGES[3][1](spark, docs, path)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == Counter({i: n for i, n in copies.items() if n})


def test_run_packs_the_mix(spark, folder):
    path, _ = folder
    pieces = cp.run(spark, path).collect()
    ids = {r["doc_id"] for r in pieces}
    assert ids and not any(i < 240 and i % 6 == 0 for i in ids)
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark, folder, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert cp.run(spark, path).isEmpty()


def test_stages_keep_clashing_columns(spark, folder):
    path, rows = folder
    docs = spark.createDataFrame(rows[1:5], SCHEMA)
    for name in ("score", "copies", "size", "row", "component", "target"):
        docs = docs.withColumn(name, F.lit(7))
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, path)
        assert got.columns == docs.columns, name
        assert all(r["score"] == r["copies"] == r["component"] == 7 for r in got.collect()), name
