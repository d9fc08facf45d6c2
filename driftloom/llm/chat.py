"""Reply trees to chat transcripts: root-to-leaf paths, ranked, formatted with a loss mask.

Messages are rows (tree, id, parent, role, text, score). Paths come from self-joins that double:
after round k every message knows the one 2^k replies above it and the sum of the scores between.
So the rounds grow with the log of the deepest path, and a tree that holds a third of all messages
is dealt over all tasks. The leaves of a tree are ranked by the mean score of their paths; the same
jump tables then list the messages of the chosen paths, again one self-join a round.

A path becomes one transcript:

    <|im_start|>role\\n text <|im_end|>\\n      for every message

Inside texts and roles every `<`, any backslashes, `|` gets one backslash more, so that no control
string can occur there, and taking one away gives the text back. In roles backslashes and line ends
are written as \\\\ and \\n before that. The mask lists where the texts of the trained roles stand.

Turns of a path are brought together by a sort and stream through a task in batches; transcripts of
more than `part_chars` code points go out in parts that end between turns, so memory holds one part.

Defined cases: null role, text and score count as empty, empty and 0 (as do NaN and infinite
scores); a null tree is a tree of its own; messages without id are left out; of messages with the
same tree and id the least (parent, role, text, score) counts; a parent that does not exist makes
its child a root; messages on a circle of replies, or below one, have no root and are on no path.
An empty table gives an empty result. Other columns of the caller are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftloom.llm.scratch import Scratch

START, STOP = "<|im_start|>", "<|im_end|>"
PART_CHARS = 1 << 22
TRAINED = ("assistant",)
PART = (
    "tree string, leaf string, rank int, path_score double, part int, formatted string, "
    "mask array<struct<start:long,length:long>>"
)
DIGEST = (
    "tree string, leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(plain)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _same(a: str, b: str, key: str, other: str) -> Column:
    """Equality of two messages' places; a null tree is equal to a null tree."""
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{key}") == F.col(f"{b}.{other}"))


def _messages(messages: DataFrame) -> DataFrame:
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    score = F.when(F.isnan(score) | (F.abs(score) == float("inf")), 0.0).otherwise(score)
    plain = messages.where("id is not null").select(
        "tree", "id", "parent", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), score.alias("score"),
    )
    return plain.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select(
        "tree", "id", "m.*"
    )


class ReplyTrees:
    """Paths of a table of messages; every round is a written table."""

    def __init__(self, messages: DataFrame):
        self.scratch = Scratch(messages.sparkSession, "chat")
        self.messages = self.scratch.write(_messages(messages), "messages")
        self.jumps, self.done = self._doubled()

    def _doubled(self) -> tuple[list[DataFrame], DataFrame]:
        """Tables (tree, id, above, total, steps): for each round the messages that have one 2^k
        replies above, and all messages whose root is reached, with their whole path's total."""
        own, up = self.messages.select("tree", "id", "parent", "score").alias("a"), self.messages.select("tree", "id").alias("b")
        first = own.join(up, _same("a", "b", "parent", "id"), "left").select(
            "a.tree", "a.id", F.col("b.id").alias("above"), F.col("a.score").alias("total"), F.lit(1).cast("long").alias("steps")
        )
        now, left = self.scratch.write(first, "jumps"), self.messages.count()
        levels, done = [now.where("above is not null")], now.where("above is null")
        while left > 1 and not levels[-1].isEmpty():
            # only messages that have not reached their root take part in the next round
            a, b = levels[-1].alias("a"), levels[-1].unionAll(done).alias("b")
            now = self.scratch.write(
                a.join(b, _same("a", "b", "above", "id")).select(
                    "a.tree", "a.id", F.col("b.above").alias("above"),
                    (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.steps") + F.col("b.steps")).alias("steps"),
                ), "jumps",
            )
            levels.append(now.where("above is not null"))
            done = done.unionAll(now.where("above is null"))
            left //= 2  # no path is longer than the number of messages: what is still open is a circle
        return levels, done

    def leaves(self, best: int | None = None) -> DataFrame:
        """(tree, leaf, rank, path_score, n_turns) of every path, or of the `best` ones of each tree."""
        last, up = self.done.alias("a"), self.jumps[0].alias("b")
        ends = last.join(up, _same("a", "b", "id", "above"), "left_anti").select(
            "tree", F.col("id").alias("leaf"), (F.col("total") / F.col("steps")).alias("path_score"),
            F.col("steps").alias("n_turns"),
        )
        order = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
        ranked = ends.withColumn("rank", F.row_number().over(order))
        return ranked if best is None else ranked.where(F.col("rank") <= best)

    def paths(self, best: int | None = None) -> DataFrame:
        """(tree, leaf, rank, path_score, place, id): the messages of the chosen paths, root first."""
        chosen = self.leaves(best).select(
            "tree", "leaf", "rank", "path_score", (F.col("n_turns") - 1).alias("place"), F.col("leaf").alias("id")
        )
        listed = self.scratch.write(chosen, "paths")
        for k, jumps in enumerate(self.jumps[:-1]):
            a, b = listed.alias("a"), jumps.alias("b")
            more = a.join(b, _same("a", "b", "id", "id")).select(
                "a.tree", "a.leaf", "a.rank", "a.path_score", (F.col("a.place") - (1 << k)).alias("place"), F.col("b.above").alias("id")
            )
            listed = listed.unionAll(self.scratch.write(more, "paths"))
        return listed

    def formatted(
        self, best: int | None = None, trained: tuple[str, ...] = TRAINED, part_chars: int = PART_CHARS
    ) -> DataFrame:
        """(tree, leaf, rank, path_score, part, formatted, mask): one transcript for each chosen path."""
        kinds = {c: self.messages.schema[c].dataType for c in ("tree", "id")}
        a, b = self.paths(best).alias("a"), self.messages.alias("b")
        head = F.concat(F.lit(START), escaped_role(F.col("b.role")), F.lit("\n"))
        turns = a.join(b, _same("a", "b", "id", "id")).select(
            F.col("a.tree").cast("string").alias("tree"), F.col("a.leaf").cast("string").alias("leaf"), "rank",
            "path_score", "place", head.alias("head"), escaped(F.col("b.text")).alias("body"),
            F.col("b.role").isin(*trained).alias("trained"),
        )
        dealt = turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place")
        out = dealt.mapInPandas(lambda frames: _join_turns(frames, part_chars), PART)
        return self.scratch.write(
            out.withColumns({"tree": F.col("tree").cast(kinds["tree"]), "leaf": F.col("leaf").cast(kinds["id"])}), "transcripts"
        )


def _join_turns(frames: Iterator[pd.DataFrame], part_chars: int) -> Iterator[pd.DataFrame]:
    now, part, held, mask, size = None, 0, [], [], 0
    done, done_size = [], 0

    def flush():
        nonlocal held, mask, size, part, done_size
        done.append((*now, part, "".join(held), mask))
        done_size += size
        held, mask, size, part = [], [], 0, part + 1

    def out():
        nonlocal done, done_size
        frame = pd.DataFrame(done, columns=["tree", "leaf", "rank", "path_score", "part", "formatted", "mask"])
        done, done_size = [], 0
        return frame

    for frame in frames:
        for tree, leaf, rank, score, _, head, body, trained in frame.itertuples(index=False):
            if now is None or (tree, leaf) != now[:2]:
                if held:
                    flush()
                now, part = (tree, leaf, rank, score), 0
            if trained:
                mask.append({"start": size + len(head), "length": len(body)})
            held += [head, body, STOP + "\n"]
            size += len(head) + len(body) + len(STOP) + 1
            if size >= part_chars:
                flush()
            if done_size >= part_chars or len(done) >= 1000:
                yield out()
    if held:
        flush()
    if done:
        yield out()


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a transcript, as they were before formatting."""
    for m in re.finditer(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.DOTALL):
        yield unescaped_role(m[1]), unescaped(m[2])


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    now, done = None, []

    def out(rows):
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    def close():
        done.append((*now, turns, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for frame in frames:
        for tree, leaf, text, mask in zip(frame["tree"], frame["leaf"], frame["formatted"], frame["mask"], strict=True):
            if (tree, leaf) != now:
                if now is not None:
                    close()
                now, turns, loss_chars, chars = (tree, leaf), 0, 0, 0
                whole, loss = hashlib.sha256(), hashlib.sha256()
            for role, said in turns_of(text):
                turns += 1
                whole.update(f"{role}\n{said}\n".encode())
            for span in mask:
                said = unescaped(text[span["start"] : span["start"] + span["length"]])
                loss_chars += len(said)
                loss.update(said.encode())
            chars += len(text)
        if done:
            yield out(done)
            done = []
    if now is not None:
        close()
        yield out(done)


def read_back(transcripts: DataFrame) -> DataFrame:
    """(tree, leaf, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of transcripts.

    Everything is taken from `formatted` and `mask`: turns are parsed and unescaped, the trained text
    is what stands under the mask.
    """
    kinds = {c: transcripts.schema[c].dataType for c in ("tree", "leaf")}
    rows = transcripts.select(
        F.col("tree").cast("string").alias("tree"), F.col("leaf").cast("string").alias("leaf"), "part", "formatted", "mask"
    )
    dealt = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")
    return dealt.mapInPandas(_read, DIGEST).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def linear(turns: DataFrame) -> DataFrame:
    """Messages of conversations without branches (conv_id, turn, role, text): each replies to the one before.

    Turns are numbered by turn (nulls first), role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text",
        F.lit(0.0).alias("score"),
    )
