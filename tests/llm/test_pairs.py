"""Joins, deduplication and search next to brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from driftloom.llm import graph, lines, sketch
from driftloom.llm.exact import ExactDedup
from driftloom.llm.jaccard import jaccard_groups
from driftloom.llm.lines import dedup_lines
from driftloom.llm.scratch import Scratch
from driftloom.llm.substrings import COVER, PERIOD, covers, remove_repeats
from driftloom.llm.topk import Lists, quantised, top_k

LAST = 1 << 62


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def grams(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(docs, corpus, none):
    sets = [grams(r[1]) for r in corpus]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    label = roots(len(sets), links)
    least = defaultdict(list)
    for k, r in enumerate(corpus):
        least[label[k]].append(r[0])
    want = sorted(
        (str(r[0]), len(sets[k]), min((d for d in least[label[k]] if d is not None), default=None) if sets[k] else r[0])
        for k, r in enumerate(corpus)
    )
    for sizes in ({}, {"band_rows": 3, "tile_pairs": 4}):
        got = jaccard_groups(docs, **sizes).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted((str(a), b, c) for a, b, c in got) == want
    assert jaccard_groups(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 300), (7, 7)]
    df = spark.createDataFrame(edges, graph.EDGE).repartition(6)
    for native in (False, True):
        got = dict(tuple(r) for r in graph.components(Scratch(spark, "test"), df, native).collect())
        assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}


def test_bloom(spark):
    bits = sketch.bloom(spark.range(0, 500).select(F.xxhash64("id").alias("x")), 1 << 16)
    own = np.array([r[0] for r in spark.range(0, 500).select(F.xxhash64("id")).collect()], np.int64)
    assert sketch.bit_found(own, bits).all()


def test_exact(docs, corpus, none):
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[t or ""].append(d)
    want = sorted(
        (str(d), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for d, t, *_ in corpus
    )
    run = ExactDedup(docs, files_per_batch=1)
    got = run.decisions().collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["digest"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    kept = run.kept()
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert ExactDedup(none).kept().count() == 0


def test_exact_survives_colliding_digests(docs, corpus):
    """A digest of one digit: nearly every hit is another text, full bytes decide."""
    run = ExactDedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 1), share_rows=7)
    groups = defaultdict(list)
    for d, t, *_ in corpus:
        groups[t or ""].append(d)
    got = run.decisions().collect()
    assert sorted((str(r["doc_id"]), r["group_size"]) for r in got) == sorted((str(d), len(groups[t or ""])) for d, t, *_ in corpus)
    assert run.kept().count() == len(groups)


def test_cover():
    assert covers(COVER, PERIOD) and not covers((0, 1), 31)


def test_substrings(docs, corpus, none):
    order = lambda d: LAST if d is None else d
    starts = {}
    for d, t, *_ in corpus:
        w = words(t)
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            starts[k] = min(starts.get(k, LAST), order(d))
    want = []
    for d, t, *_ in corpus:
        w = words(t)
        gone = set()
        for p in range(len(w) - 49):
            if starts[tuple(w[p : p + 50])] < order(d):
                gone.update(range(p, p + 50))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((str(d), len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    got = remove_repeats(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(want)
    for r in got:
        if r["kept_text"] is not None:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert remove_repeats(none).count() == 0


def test_lines(spark, none):
    long = "the quick brown fox jumps over the lazy dog and runs far away from the old grey house near the river bank " * 4
    rows = [
        (1, "Hello, World\n" + long + "\n--\nonly here"), (2, "hello world!\nother line\n--"),
        (3, long.replace("grey", "gray", 1) + "\nother  LINE"), (4, None), (5, ""), (None, "hello   world"), (2, "only there\nhello world"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["n_lines"]): r for r in dedup_lines(df).collect()}
    assert got[1, 4]["n_removed"] == 0 and got[1, 4]["kept_text"] == rows[0][1]
    assert got[2, 3]["kept_text"] == "other line\n--"
    assert got[2, 2]["kept_text"] == "only there"
    assert got[None, 1]["kept_text"] == "" and got[4, 0]["n_removed"] == 0 and got[5, 0]["kept_text"] == ""
    # one word in eighty differs: the SimHash decides whether the lines meet; never the other way round
    assert got[3, 2]["n_removed"] in (1, 2) and "other" not in got[3, 2]["kept_text"].lower()
    assert dedup_lines(none).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    x = np.round(base[rng.integers(0, 6, 400)] + 0.1 * rng.normal(size=(400, 8)), 2)
    x[50:120] = x[50]  # ties
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    rows += [(400, None), (450, [1.0] * 7 + [None]), (500, [float("nan")] * 8), (None, [1.0] * 8), (550, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    vectors = quantised(df)
    q = np.floor(256 * np.vstack([x, np.zeros((1, 8))])).astype(np.int64)
    ids = [*range(400), 550]
    want = set()
    for k, name in enumerate(ids):
        if name % 50 == 0:
            best = sorted((-int(q[k] @ q[j]), ids[j]) for j in range(len(ids)) if j != k)[:5]
            want |= {(name, r + 1, v, -s) for r, (s, v) in enumerate(best)}
    for sizes in ({}, {"block_rows": 20, "pivots": 5, "tile": 3}):
        got = top_k(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"), **sizes)
        assert {tuple(r) for r in got.collect()} == want
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_lists_are_read_together():
    rng = np.random.default_rng(9)
    for big in (40, 1 << 28):  # beyond 2**53 products stay whole numbers
        rows = rng.integers(-big, big, (300, 12))
        rows[100:150] = rows[100]  # ties
        ids = rng.permutation(1000)[:300]
        queries = np.vstack([rows[::10], rows[100:103], np.zeros((1, 12), np.int64)])
        own = np.append(ids[::10], [*ids[100:103], -5])
        scores = [[(-sum(int(a) * int(b) for a, b in zip(q, r)), int(i)) for r, i in zip(rows, ids) if i != o] for q, o in zip(queries, own)]
        want = [sorted(x)[:5] for x in scores]
        none = np.full(len(queries), -(2**62))
        q, score, vec = Lists(ids, rows).search(queries, own, 5, none)
        got = [[(-int(s), int(v)) for s, v in zip(score[q == i], vec[q == i])] for i in range(len(queries))]
        assert got == want
        floors = np.array([-x[2][0] for x in want])  # the third best of each
        q, score, vec = Lists(ids, rows).search(queries, own, 5, floors)
        got = [[(-int(s), int(v)) for s, v in zip(score[q == i], vec[q == i])] for i in range(len(queries))]
        assert all(g[:3] == w[:3] for g, w in zip(got, want))


def test_line_keys_come_in_rounds(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pool = np.array(["w%d" % i for i in range(300)])
    texts = [rng.choice(pool, 70).tolist() for _ in range(60)]
    texts += [[*t[:-1], "other"] for t in texts[:40]] + [[*t[:-1], "third"] for t in texts[:20]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    out, sizes = [], []
    write = Scratch.write

    def seen(self, table, name):
        got = write(self, table, name)
        if name == "hashes":
            sizes.append(got.count())
        return got

    monkeypatch.setattr(Scratch, "write", seen)
    for size in (10, 2, 3):  # at once, and in rounds
        monkeypatch.setattr(lines, "ROUND", size)
        out.append(sorted((r["doc_id"], r["n_removed"]) for r in dedup_lines(df).collect()))
    assert out[0] == out[1] == out[2] and sum(n for _, n in out[0]) > 0
    assert sizes == [120] * 3  # hashes are written, so the shuffle of their votes is freed before the keys'


def test_line_pairs_need_fitting_lengths(spark, tmp_path, monkeypatch):
    """Lines of one word repeated have one hash: only pairs of fitting length are made; groups stay exact."""
    made = []
    alike = lines._alike

    def counted(scratch, pairs, *rest):
        made.append(pairs.count())
        return alike(scratch, pairs, *rest)

    monkeypatch.setattr(lines, "_alike", counted)
    texts = [" ".join(["same"] * n) for n in (1, 2, 4, 8, 16, 32, 64, 128)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, texts[5] + " same")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(df).collect()}
    assert [i for i, n in got.items() if n] == [90]
    assert sum(made) <= 20  # one pair, found once at most under each of the ten keys by either step; 360 of all lengths


def test_line_distance_without_shared_ends(spark):
    """Shared words at both ends are left out; the decision is that of the whole lines."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["a", "bb", "a b", "ccc", "ü", "dd d"])
    pairs = [("a b", "a"), ("b", "a b"), ("a a", "a a a"), ("a", "b"), ("a x b", "a b"), ("x", "x y"), ("a b a", "a b a b a")]
    for _ in range(300):
        a = rng.choice(vocabulary, rng.integers(1, 9)).tolist()
        b = list(a)
        for _ in range(rng.integers(1, 4)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.choice(vocabulary, rng.integers(0, 3)).tolist()
        pairs.append((" ".join(a), " ".join(b)))
    rows = [(i, i, a, b, most) for i, (a, b) in enumerate(pairs) for most in range(6) if a and b]
    df = spark.createDataFrame([(100 * i + most, i, a, b, most) for i, _, a, b, most in rows], "u long, v long, a string, b string, most int")
    want = {r["u"] for r in df.where("levenshtein(a, b) <= most").collect()}
    assert {r["u"] for r in lines._within(df).collect()} == want and 0 < len(want) < len(rows)


def test_simhash_votes(spark):
    """Bits are set where most words have them, ties are not; votes are counted without a branch for each bit."""
    rng = np.random.default_rng(4)
    texts = ["a", "a a b", "a b", *[" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in rng.integers(1, 40, 60)]]
    nodes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, line string")
    hashes = lines.simhashes(nodes)
    names = nodes.select(F.explode(F.split("line", " ")).alias("w")).distinct()
    of = {r["w"]: r["x"] & (1 << 64) - 1 for r in names.select("w", F.xxhash64("w").alias("x")).collect()}
    for r in hashes.collect():
        words_of = texts[r["id"]].split(" ")
        want = sum(1 << j for j in range(64) if 2 * sum(of[w] >> j & 1 for w in words_of) > len(words_of))
        assert r["h"] & (1 << 64) - 1 == want and r["len"] == len(texts[r["id"]])
    assert "CASE" not in hashes._jdf.queryExecution().optimizedPlan().toString()
