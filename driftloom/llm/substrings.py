"""Substring deduplication: removes words of passages that also stand in an earlier document.

Method (difference-cover anchors). A cover D of a period p has, for any two numbers, a shift below
p that takes both into D modulo p. So of two equal windows of `window` words, however they lie in
their documents, some shift gives two anchors of `window - p + 1` words that both start at a cover
position. Only these anchors are hashed, about |D| / p of all positions:

1. every distinct word sequence emits its anchors; those that occur in one sequence only go;
2. anchors that are left extend to the windows around them: the hash of every window that holds
   one, with the smallest doc_id among the sequences that have it;
3. a window whose smallest doc_id lies below its own document's is a copy, its words are removed.

Equal documents are one sequence, so a group of copies of any size costs one. Windows are judged
on the input. Neither occurrences nor texts of a passage are ever gathered: hot passages are
reduced by the smallest doc_id before and while they are shuffled. 64-bit hashes stand for word
sequences, pairs of them for windows.

Null and empty texts have no words. A null doc_id counts as larger than any other. Rows with equal
doc_id do not remove from each other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm import sketch
from driftloom.llm.scratch import Scratch, checked_broadcast
from driftloom.llm.words import BASES, signed, slices, span_hashes, window_hashes, word_spans

#: Difference cover modulo 31: each residue is a difference of two members (fixed values).
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
LAST = (1 << 63) - 1
BLOOM_BYTES = 1 << 21
EMPTY = hashlib.sha256(b"").hexdigest()


def covers(cover: tuple[int, ...], period: int) -> bool:
    return len({(a - b) % period for a in cover for b in cover}) == period


def _joined(data: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, bounds: np.ndarray):
    """Bytes of each text with its words joined by one space."""
    keep = np.zeros(len(data) + 1, np.int8)
    if len(begins):
        keep[begins] += 1
        inner = np.ones(len(begins), bool)
        last = bounds[1:] - 1
        inner[last[bounds[1:] > bounds[:-1]]] = False
        stop = ends + inner
        np.add.at(keep, stop, -1)
    inside = np.cumsum(keep[:-1], dtype=np.int8) > 0
    out = data.copy()
    if len(begins):
        out[ends[inner]] = 32
    kept = out[inside]
    place = np.concatenate([[0], np.cumsum(inside)])[at]
    return kept, place


def _texts(batches):
    """(batch, row, word hashes, joined bytes) of every text of a task."""
    for batch in batches:
        for lo, _, data, at in slices(batch.column("text")):
            begins, ends, bounds = word_spans(data, at)
            words = span_hashes(data, begins, ends)
            kept, place = _joined(data, at, begins, ends, bounds)
            for i in range(len(bounds) - 1):
                yield batch, lo + i, words[bounds[i] : bounds[i + 1]], kept[place[i] : place[i + 1]]


def _seq(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sequences(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, n_words, sha) of every row."""

    def run(batches):
        rows = []

        def out():
            got = pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                names=["doc_id", "seq", "n_words", "sha"],
            )
            rows.clear()
            return got

        for batch, i, words, kept in _texts(batches):
            d = hashlib.sha256(kept)
            rows.append((batch.column("doc_id")[i].as_py(), _seq(d.digest()), len(words), d.hexdigest()))
            if len(rows) >= 4096:
                yield out()
        yield out()

    return docs.mapInArrow(run, "doc_id long, seq long, n_words long, sha string")


def anchors(docs: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """(hash, seq, pos) of the anchors of every word sequence, once in a task."""
    size = window - period + 1
    at_cover = np.isin(np.arange(period), cover)

    def run(batches):
        seen, held, made = set(), [], 0

        def out():
            sizes = [len(h[1]) for h in held]
            got = pa.RecordBatch.from_arrays([
                pa.array(signed(np.concatenate([h[1] for h in held])) if held else np.empty(0, np.int64)),
                pa.array(np.repeat(np.array([h[0] for h in held], np.int64), sizes)),
                pa.array(np.concatenate([h[2] for h in held]).astype(np.int32) if held else np.empty(0, np.int32)),
            ], names=["hash", "seq", "pos"])
            held.clear()
            return got

        for _, _, words, kept in _texts(batches):
            if len(words) < window:
                continue
            seq = _seq(hashlib.sha256(kept).digest())
            if seq in seen:
                continue
            seen.add(seq)
            hashes = window_hashes(words, size)
            pos = np.flatnonzero(at_cover[np.arange(len(hashes)) % period])
            held.append((seq, hashes[pos], pos))
            made += len(pos)
            if made >= 1 << 16:
                yield out()
                made = 0
        yield out()

    return docs.mapInArrow(run, "hash long, seq long, pos int")


def chosen_texts(docs: DataFrame, window: int, wanted) -> DataFrame:
    """(seq, text) of the sequences that a filter lets through, once in a task; words joined."""

    def run(batches):
        bits, seen, rows, size = wanted.value, set(), [], 0

        def out():
            got = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["seq", "text"],
            )
            rows.clear()
            return got

        for _, _, words, kept in _texts(batches):
            if len(words) < window:
                continue
            seq = _seq(hashlib.sha256(kept).digest())
            if seq not in seen and sketch.bit_found(np.array([seq], np.int64), bits)[0]:
                seen.add(seq)
                rows.append((seq, kept.tobytes()))
                size += len(kept)
                if size >= 1 << 20:
                    yield out()
                    size = 0
        yield out()

    return docs.mapInArrow(run, "seq long, text binary")


def _words_of(text: bytes):
    data = np.frombuffer(text, np.uint8)
    begins, ends, _ = word_spans(data, np.array([0, len(data)]))
    return data, begins, ends


def windows(texts: DataFrame, window: int, period: int) -> DataFrame:
    """(a, b, first, seq, start): two hashes of every window that holds a shared anchor."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("seq", "first", "text", "hits")]
            for seq, first, text, hits in zip(*cols):
                data, begins, ends = _words_of(text)
                words = span_hashes(data, begins, ends)
                n = len(words) - window + 1
                mark = np.zeros(n + 1, np.int64)
                hits = np.array(hits, np.int64)
                np.add.at(mark, np.minimum(np.maximum(hits - period + 1, 0), n), 1)
                np.add.at(mark, np.minimum(hits + 1, n), -1)
                start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                one, two = (window_hashes(words, window, b)[start] for b in BASES)
                yield pa.RecordBatch.from_arrays([
                    pa.array(signed(one)), pa.array(signed(two)),
                    pa.array(np.full(len(start), first, np.int64)), pa.array(np.full(len(start), seq, np.int64)),
                    pa.array(start.astype(np.int32)),
                ], names=["a", "b", "first", "seq", "start"])

    return texts.mapInArrow(run, "a long, b long, first long, seq long, start int")


def cut_texts(texts: DataFrame, window: int) -> DataFrame:
    """(seq, n_removed, sha, text): what is left of each text without its copied windows."""

    def run(batches):
        for batch in batches:
            out = []
            cols = [batch.column(k).to_pylist() for k in ("seq", "text", "starts")]
            for seq, text, starts in zip(*cols):
                data, begins, ends = _words_of(text)
                gone = np.zeros(len(begins) + 1, np.int64)
                starts = np.array(starts, np.int64)
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + window, -1)
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                left = b" ".join(text[begins[k] : ends[k]] for k in keep.tolist())
                out.append((seq, len(begins) - len(keep), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["seq", "n_removed", "cut_sha", "cut_text"],
            )

    return texts.mapInArrow(run, "seq long, n_removed long, cut_sha string, cut_text string")


def remove_repeats(
    docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of docs (doc_id, text).

    kept_text is null where nothing was removed (the text stays as it is) and else what is left,
    words joined by one space.
    """
    if not covers(cover, period) or not 0 < period <= window:
        raise ValueError("the cover must have every difference modulo a period of at most a window")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = scratch.write(sequences(docs), "rows").withColumn("o", F.coalesce("doc_id", F.lit(LAST)))
    firsts = rows.where(f"n_words >= {window}").groupBy("seq").agg(F.min("o").alias("first"))

    same = Window.partitionBy("hash")
    hits = (
        anchors(docs, window, period, cover)
        .withColumn("x", F.min("seq").over(same))
        .withColumn("y", F.max("seq").over(same))
        .where("x != y").select("seq", "pos")
    )
    hits = scratch.write(hits, "hits")
    bits = sketch.bloom(hits.select("seq"), BLOOM_BYTES)
    wanted = checked_broadcast(spark, bits, bits.nbytes, BLOOM_BYTES)
    texts = (
        chosen_texts(docs, window, wanted).dropDuplicates(["seq"])
        .join(firsts, "seq")
        .join(hits.groupBy("seq").agg(F.collect_set("pos").alias("hits")), "seq")
    )
    texts = scratch.write(texts, "texts")

    found = windows(texts, window, period)
    alike = Window.partitionBy("a", "b")
    copied = (
        found.withColumn("least", F.min("first").over(alike))
        .where("least < first").groupBy("seq").agg(F.collect_set("start").alias("starts"))
    )
    cut = scratch.write(cut_texts(texts.select("seq", "text").join(copied, "seq"), window), "cut")

    named = rows.join(firsts, "seq", "left").join(cut, "seq", "left")
    later = F.col("n_words") >= window
    later = later & (F.col("o") > F.col("first"))
    return named.select(
        "doc_id", "n_words",
        F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(later, F.lit(EMPTY)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(later, F.lit("")).otherwise(F.col("cut_text")).alias("kept_text"),
    )
