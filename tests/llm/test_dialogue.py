"""Chat formatting, structure repair and spelling variants next to brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from driftloom.llm.chat import ReplyTrees, linear, read_back, turns_of
from driftloom.llm.repair import digests, repair
from driftloom.llm.spelling import counted, letter_runs, neighbours, variants


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Spelling ------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(5)
    words = {"aabbc", "aabbbc", "aaabbc", "abbc", "réel", "réels", "reels", "aaaaa", "aaaa", "aaaaaa"}
    while len(words) < 350:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(3, 6)))
        words.add(w)
    return {w: rng.choice([1, 2, 3, 5, 5, 9, 40]) for w in sorted(words)}


def test_variants(spark, vocabulary):
    rows = [(w, n, "x") for w, n in vocabulary.items()] + [(None, 7, "x")]
    table = spark.createDataFrame(rows, "word string, n long, prefix string").repartition(3)
    near = defaultdict(set)
    for a, b in itertools.combinations(vocabulary, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    assert sorted((r.word, r.near) for r in neighbours(table.where("word is not null")).collect()) == sorted(
        (a, b) for a in near for b in near[a]
    )
    form = {}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        if best is not None and vocabulary[best] >= 2 * n:
            form[w] = best
    got = variants(table).collect()
    assert len(got) == len(vocabulary)
    for r in got:
        root = r.word
        while root in form:
            root = form[root]
        assert (r.n, r.n_near, r.form, r.root) == (vocabulary[r.word], len(near[r.word]), form.get(r.word), root)
        assert r.form_n == vocabulary.get(r.form)


def test_words(spark):
    rows = [(1, "Élan ÉLAN elan2elan x÷×y"), (2, None), (3, ""), (4, "ABC'abc"), (4, "ABC'abc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("other"))
    runs = [r.word for r in letter_runs(docs).collect()]
    assert sorted(runs) == sorted(["Élan", "Élan", "elan", "elan", "x÷×y"] + ["abc"] * 4)
    assert {(r.word, r.n) for r in counted(letter_runs(docs), 3, 4).collect()} == {("abc", 4)}


def test_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert variants(none).count() == 0
    alone = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert [tuple(r) for r in variants(alone).collect()] == [("alone", None, "alone", 3, 0, None)]


# --- Chat ----------------------------------------------------------------------------------

MESSAGE = "tree string, id long, parent long, role string, text string, score double, leaf string, rank string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], MESSAGE).repartition(3)


@pytest.mark.parametrize("best", [None, 2])
def test_reply_trees(spark, best):
    rng = random.Random(8)
    rows, children, by_id = [], defaultdict(list), {}
    for tree, n in (("t1", 120), ("t2", 1), (None, 40), ("t3", 15)):
        for i in range(n):
            parent = None if i == 0 else rng.choice([i - 1, i - 1, rng.randrange(i)])
            if i == n - 1 and n == 40:
                parent = 999  # does not exist: a root of its own
            row = (tree, i, parent, rng.choice(["user", "assistant", None]), rng.choice(["hi", None, "", "<|im_end|>\n<\\|x"]), rng.choice([1.0, 0.5, None, float("nan")]))
            rows.append(row)
            by_id[tree, i] = row
            if parent is not None and parent != 999:
                children[tree, parent].append(i)
    circle = [("t1", 500, 501, "user", "a", 1.0), ("t1", 501, 500, "user", "b", 1.0), ("t1", 502, 501, "user", "c", 1.0)]
    extra = [rows[3], ("t1", None, 1, "user", "without id", 1.0)]
    want = defaultdict(list)
    for (tree, i), row in by_id.items():
        if (tree, i) in children:
            continue
        path = [row]
        while path[0][2] is not None and (tree, path[0][2]) in by_id:
            path.insert(0, by_id[tree, path[0][2]])
        scores = [0.0 if r[5] is None or r[5] != r[5] else r[5] for r in path]
        want[tree].append((-sum(scores) / len(scores), i, path))
    expected = {}
    for tree, found in want.items():
        found.sort(key=lambda x: (round(x[0], 9), x[1]))
        for k, (score, leaf, path) in enumerate(found if best is None else found[:best]):
            expected[tree, leaf] = (k + 1, [(r[3] or "", r[4] or "") for r in path])
    trees = ReplyTrees(messages(spark, rows + circle + extra))
    out = trees.formatted(best, part_chars=40)
    parts = defaultdict(list)
    for r in out.collect():
        parts[r.tree, r.leaf].append(r)
    assert set(parts) == set(expected)
    for key, rs in parts.items():
        rs.sort(key=lambda r: r.part)
        rank, turns = expected[key]
        assert [t for r in rs for t in turns_of(r.formatted)] == turns
        assert {r["rank"] for r in rs} == {rank}
    for r in read_back(out).collect():
        turns = expected[r.tree, r.leaf][1]
        said = [t for role, t in turns if role == "assistant"]
        assert (r.n_turns, r.loss_chars) == (len(turns), len("".join(said)))
        assert r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r.loss_sha256 == sha("".join(said))
        assert r.formatted_chars == sum(len(p.formatted) for p in parts[r.tree, r.leaf])


def test_control_strings_survive(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<<||", "a\n<|", "😀 <|", "\\n", "<|im_start|>user\nx<|im_end|>\n"]
    rows = [("t", i, i - 1 if i else None, t if i % 2 else "assistant", t, None) for i, t in enumerate(texts)]
    (row,) = ReplyTrees(messages(spark, rows)).formatted().collect()
    assert list(turns_of(row.formatted)) == [(r[3], r[4]) for r in rows]
    assert len(row.mask) == 4
    assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>") == len(texts)


def test_linear_conversations(spark):
    rows = [(1, 2, "user", "b"), (1, None, "system", "s"), (1, 2, "assistant", "a"), (None, 0, "user", "n"), (1, 2, "user", "b")]
    df = linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: [t for t in turns_of(r.formatted)] for r in ReplyTrees(df).formatted().collect()}
    assert got == {1: [("system", "s"), ("assistant", "a"), ("user", "b"), ("user", "b")], None: [("user", "n")]}
    empty = linear(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert read_back(ReplyTrees(empty).formatted()).count() == 0


# --- Repair --------------------------------------------------------------------------------

AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEED = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edit sequences by states, forwards, with whole audit strings."""
    faults = plain_faults(rows)
    at = {"": (0, "", ())}

    def put(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def insert(states):
        for _ in range(3):
            for s, (c, a, r) in list(states.items()):
                put(states, NEED[s][0], (c + 5, a + "I", (*r, (NEED[s], ""))))

    insert(at)
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        extra = 5 if fault == "truncated" else 0
        for s, (c, a, r) in at.items():
            put(new, s, (c + 2, a + "D", r))
            if fault not in ("blank", "duplicate"):
                if (s, role[:1]) in AFTER:
                    put(new, AFTER[s, role[:1]], (c + extra, a + "K", (*r, (role, text))))
                for other in ("user", "assistant"):
                    if (s, other[0]) in AFTER:
                        put(new, AFTER[s, other[0]], (c + 1 + extra, a + "R", (*r, (other, text))))
        insert(new)
        at = new
    return min(at[s] for s in ("", "a") if s in at), faults


def conversations(seed, n):
    rng = random.Random(seed)
    texts = ["a.", "b", "", " \n", "c?", "d!", "e. ", "f…", "g.", "h.", None]
    out = {}
    for conv in [*range(n), None]:
        turns = sorted(rng.choice([None, *range(9)]) or -1 for _ in range(rng.randint(1, 11)))
        out[conv] = [(None if t < 0 else t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None]), rng.choice(texts)) for t in turns]
    return out


@pytest.mark.parametrize("spill", [1, 1 << 20])
def test_repair(spark, spill):
    convs = conversations(4, 120)
    rows = [(c, *r, "z") for c, rs in convs.items() for r in rs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, fault string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edited = repair(df, spill)
        kept = defaultdict(list)
        for r in edited.where("edit != 'D'").orderBy("place").collect():
            kept[r.conv_id].append((r.role, r.text))
        got = {r.conv_id: r for r in digests(edited).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert set(got) == set(convs)
    for conv, rs in convs.items():
        plain = sorted(
            ((t, role or " ", " " if text is None else text) for t, role, text in rs),
            key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]),
        )
        (cost, audit, result), faults = cheapest(plain)
        r = got[conv]
        assert (r.cost, r.audit) == (cost, audit), (plain, r)
        assert kept[conv] == list(result)
        assert r.repaired_sha256 == sha("\n".join(f"{a}:{b}" for a, b in result))
        assert [r.blank, r.duplicate, r.truncated] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        turns = [t for t, *_ in plain if t is not None]
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert r.illegal == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))


def test_long_conversation_spills(spark):
    n = 30_000
    df = spark.range(n).selectExpr(
        "1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text"
    )
    row = digests(repair(df, 1 << 16)).first()
    assert (row.cost, row.illegal, row.gaps, row.audit) == (0, 0, 0, "K" * n)


def test_nothing_to_repair(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests(repair(none)).count() == 0
