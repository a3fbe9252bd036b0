"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut into windows of whole turns. Prefix sums of turn tokens choose how many fit
into a window's budget; a leading system turn stands in every window, and some of the turns before the window are
repeated as history, within a budget of their own. Loss covers the assistant texts a window is the first to hold: repeated
ones are masked. A turn larger than the budget has a window of its own.

Template: ``<s>``, then ``<<SYS>> text <</SYS>>``, ``[INST] text [/INST]`` and ``[ANSWER] text </s>`` for system, user and assistant
turns, ``[TURN "role"] text [/TURN]`` for other roles. A control string inside a text gets a backslash more than it has;
reading takes one away, so texts come back as they were.

Turns are numbered within their conversation by position (ranges are sorted in parallel and shifted by the sizes of those
before), so turn numbers may be negative, sparse or times. A conversation is formatted in blocks of ``BLOCK_TURNS`` positions,
so that a very long one is spread over tasks: a window ends where its block does, and the next block's first window
repeats history from up to ``CARRIED_TURNS`` turns before the border. Rows stream through in order: memory holds one window.

Defined cases: null text is empty, null role is the role ""; turns without a number come first; rows of one turn go by role
and text; repeated rows are turns of their own; a null conv_id is one conversation; an empty table has no windows.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordpiece
from .common import materialize, scoped

WINDOW_TOKENS, HISTORY_TOKENS, BLOCK_TURNS, CARRIED_TURNS = 1024, 256, 4096, 256
#: Fixed control strings of the template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN", "[/TURN]", "[ANSWER]")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_MARKED = re.compile(rf"(\\*)({_CONTROL})")
_ESCAPED = re.compile(rf"\\(\\*)({_CONTROL})")


def escape(text: str) -> str:
    return _MARKED.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


_FRAMES = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("[ANSWER] ", " </s>")}


def frame(role: str, text: str) -> tuple[str, str, str]:
    """What stands before a turn's text, its escaped text, and what stands after it."""
    before, after = _FRAMES.get(role) or (f"[TURN {json.dumps(role)}] ", " [/TURN]")
    return before, escape(text), after


_CLOSE = {"<<SYS>>": ("system", "<</SYS>>"), "[INST]": ("user", "[/INST]"), "[ANSWER]": ("assistant", "</s>")}


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted window: role, text, and the place of the escaped text."""
    if not text.startswith("<s>"):
        raise ValueError("no window starts here")
    at, turns = 3, []
    while at < len(text):
        if text.startswith("[TURN ", at):
            role, start = json.JSONDecoder().raw_decode(text, at + 6)
            start, closer = start + 2, "[/TURN]"
        else:
            opener = next(o for o in _CLOSE if text.startswith(o, at))
            role, closer = _CLOSE[opener]
            start = at + len(opener) + 1
        for m in _MARKED.finditer(text, start):
            if not m[1] and m[2] == closer:
                break
        else:
            raise ValueError(f"turn at {at} doesn't end")
        end = m.start() - 1
        turns.append((role, unescape(text[start:end]), start, end))
        at = m.end()
    return turns


class _Windows:
    """Windows of one block, written as rows arrive. Turns are (role, text, tokens)."""

    def __init__(self, system: str | None, first: bool, budget: int, history: int, count):
        self.system, self.first, self.budget, self.history, self.count = system, first, budget, history, count
        self.head = 0 if system is None else count(system)
        self.past: list[tuple[str, str]] = []  # turns of the window before, for history
        self.past_sum = [0]
        self.turns: list[tuple[str, str]] = []
        self.sum = [0]
        self.window = 0
        self.skip = system is not None and first  # the system turn itself comes as the first row

    def carry(self, role: str, text: str) -> None:
        """A turn of the block before, for history."""
        self.past.append((role, text))
        self.past_sum.append(self.past_sum[-1] + self.count(text))

    def add(self, role: str, text: str):
        tokens = self.count(text)
        if self.turns and self.sum[-1] + tokens > self.budget - self.head - self._kept_tokens():
            yield self.flush()
        self.turns.append((role, text))
        self.sum.append(self.sum[-1] + tokens)

    def _history_from(self) -> int:
        return bisect_left(self.past_sum, self.past_sum[-1] - self.history)

    def _kept_tokens(self) -> int:
        return self.past_sum[-1] - self.past_sum[self._history_from()]

    def flush(self) -> tuple[int, str, list[int], list[int], int, int]:
        lead = [("system", self.system)] if self.system is not None and not (self.first and self.window == 0) else []
        kept = self.past[self._history_from() :]
        if lead and kept[:1] == lead and self.first and self.window == 1 and len(kept) == len(self.past):
            kept = kept[1:]  # the system turn is there already
        parts, starts, ends, at = ["<s>"], [], [], 3
        repeated = len(lead) + len(kept)
        for k, (role, text) in enumerate(lead + kept + self.turns):
            before, body, after = frame(role, text)
            if role == "assistant" and k >= repeated:
                starts.append(at + len(before))
                ends.append(at + len(before) + len(body))
            parts += (before, body, after)
            at += len(before) + len(body) + len(after)
        out = (self.window, "".join(parts), starts, ends, repeated, len(self.turns))
        self.window += 1
        self.past, self.past_sum = self.turns, self.sum
        self.turns, self.sum = [], [0]
        return out


WINDOW_SCHEMA = "conv_id long, block long, window int, text string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_turns int"


def _formatter(budget, history, vocabulary):
    def run(batches):
        match = wordpiece.load(vocabulary)
        count = lambda text: match.text_counts(text)[1]
        rows, key, open_block = [], None, None

        def batch():
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.strip().split()[0] for x in WINDOW_SCHEMA.split(", ")])
            rows.clear()
            return out

        for b in batches:
            conv, block, role, text, system, first, carried = (b.column(k).to_pylist() for k in range(7))
            for k in range(b.num_rows):
                if open_block is None or key != (conv[k], block[k]):
                    if open_block is not None and open_block.turns:
                        rows.append((*key, *open_block.flush()))
                    key, open_block = (conv[k], block[k]), _Windows(system[k], first[k], budget, history, count)
                if carried[k]:
                    open_block.carry(role[k], text[k])
                else:
                    rows += [(*key, *w) for w in open_block.add(role[k], text[k])]
                if len(rows) >= 500:
                    yield batch()
        if open_block is not None and open_block.turns:  # behind a last full block only carried turns may stand
            rows.append((*key, *open_block.flush()))
        if rows:
            yield batch()

    return run


def _numbered(batches):
    """Rows sorted by conversation -> with their task and their number within conversation and task."""
    task, last, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        conv, at = b.column(0).to_pylist(), []
        for c in conv:
            n = n + 1 if (c,) == last else 0
            last = (c,)
            at.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([task] * len(conv), pa.int32()), pa.array(at, pa.int64())], names=["conv_id", "role", "text", "part", "k"])


def positions(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text) -> (conv_id, role, text, position)``, positions from 0 in the order of turn, role and text.

    Only conversations that begin in an earlier range have a shift, one for each border between ranges at most.
    """
    order = ["conv_id", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    ranged = materialize(ranged.mapInArrow(_numbered, "conv_id long, role string, text string, part int, k long"), "turns")
    sizes = ranged.groupBy("conv_id", "part").agg((F.max("k") + 1).alias("n"))
    shift = sizes.select(F.col("conv_id").alias("of"), F.col("part").alias("at"), (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("shift")).where("shift > 0")
    x = ranged.join(shift, F.expr("conv_id <=> of and part = at"), "left")
    return x.select("conv_id", "role", "text", (F.col("k") + F.coalesce("shift", F.lit(0))).alias("position"))


def format_conversations(conversations: DataFrame, budget: int = WINDOW_TOKENS, history: int = HISTORY_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """``conversations (conv_id, turn, role, text)`` -> windows, see ``WINDOW_SCHEMA``; ``block`` and ``window`` order them."""
    c = scoped(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    c = positions(c)
    opening = c.where("position = 0 and role = 'system'").select(F.col("conv_id").alias("opened"), F.col("text").alias("system"))
    opening = materialize(opening, "openings")  # written, so that Spark can split the join of a long conversation
    own = F.floor(F.col("position") / BLOCK_TURNS).cast("long")
    borders = F.col("position") % BLOCK_TURNS >= BLOCK_TURNS - CARRIED_TURNS
    places = [F.struct(own.alias("block"), F.lit(False).alias("carried")), F.struct((own + 1).alias("block"), F.lit(True).alias("carried"))]
    rows = c.join(opening, F.expr("conv_id <=> opened"), "left").withColumn("place", F.explode(F.when(borders, F.array(*places)).otherwise(F.array(places[0]))))
    # the leading system turn stands in every window anyway
    rows = rows.where("not (place.carried and position = 0 and system is not null)").select("conv_id", "place.block", "role", "text", "system", (F.col("place.block") == 0).alias("first"), "place.carried", "position")
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "position").drop("position")
    return dealt.mapInArrow(_formatter(budget, history, vocabulary or wordpiece.default_vocabulary()), WINDOW_SCHEMA)


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _reader(batches):
    rows, key, state = [], None, None

    def done():
        return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for b in batches:
        conv, _, _, text, starts, ends, repeated, _ = (c.to_pylist() for c in b.columns)
        for k in range(b.num_rows):
            if key != (conv[k],):
                if key is not None:
                    rows.append(done())
                key, state = (conv[k],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said, _, _ in parse(text[k])[repeated[k] :]:
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for s, e in zip(starts[k], ends[k]):
                said = unescape(text[k][s:e])
                state[2] += len(said)
                state[3].update(said.encode("utf-8", "surrogatepass"))
            state[4] += len(text[k])
        if rows:
            yield _digest_batch(rows)
            rows = []
    if key is not None:
        yield _digest_batch([done()])


def _digest_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.strip().split()[0] for x in DIGEST_SCHEMA.split(", ")])


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, parsed from windows; a conversation streams through in order."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return dealt.mapInArrow(_reader, DIGEST_SCHEMA)
