"""Removal of long byte strings that occur twice: distributed prefix doubling on content-chosen positions.

Every ``SPAN``-byte string that also starts elsewhere is removed where it stands; overlaps count, matches stay inside a
document, and strings are judged on the input. Prefix doubling gives each position a rank for the string of the current
length that starts there; the rank of a longer string is made from a pair of ranks, that of the position and that at an
offset. Lengths grow until a rank is unique or the threshold is passed. To keep below one row for each byte, positions
are rows only where that is needed:

* Anchors. Each window of ``SPAN`` bytes names the leftmost of its smallest ``SEED``-byte hashes as its anchor, which
  depends on the window's bytes alone, so equal windows have equal anchors at equal distances. Ranks of ``SEED`` bytes are
  doubled (pairs at offsets 32, 64, 128, and a last pair that overlaps) to about half the span, ahead of the anchor for
  its windows that start near it and around it for the others. The first round drops windows whose rank is unique.
* Ranges. Windows of one anchor are ranked together while they can be: for a range of distances the rank of the bytes
  all its windows share (the intersection) and of those they span together (the union), each a pair of ranks of 256 bytes
  at an offset. A unique intersection ends the range as unique, a repeated union ends it as repeated past the threshold,
  and only what is left is ranked again at greater length in narrower ranges (widths 64, 8, 1: intersections of 337, 393
  and 400 bytes; at 1 both strings are the window itself). Of each repeated union whose intersection also occurs with
  other surroundings one range goes on, for those others to be compared with.
* Copies. Rows with equal texts are found first, by two 64-bit hashes and the length. All their bytes go if the text has
  ``SPAN`` of them; of each group one row takes part in the rounds and counts for all, so a group of any size is one text.

A rank is a name, equal for equal strings: 64 bits where it only lets rows through to the next round, 128 bits where it
decides. Spark counts ranks with map-side sums; no group is gathered anywhere, and a rank that holds many rows only
meets a written table with one row for each rank, in a join whose large partitions can be split.

Defined cases: null text is empty; texts under ``SPAN`` bytes lose nothing; repeated rows are occurrences of one another;
rows are told apart by doc_id and text; an empty table gives an empty result. A character of which a part is removed is
dropped from the cleaned text, while the digest is of the bytes that remain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scoped, spans_of

SPAN, SEED, WIDTHS = 400, 32, (64, 8, 1)
_SEGMENT = 1 << 20
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the two lanes of a rank.
_LANES = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9], [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x94D049BB133111EB]], np.uint64)


def seed_hashes(data: np.ndarray, seed: int = SEED) -> np.ndarray:
    """64-bit rank of the ``seed`` (a power of two) bytes from each position, by doubling from single bytes."""
    h, k, step = _TABLE[data], 1, _STEP
    while k < seed:
        h = h[:-k] * step + h[k:]
        step = step * step | np.uint64(1)
        k *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _paired(a: np.ndarray, b: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks; ``lane`` holds three multipliers."""
    x = a * lane[0]
    x ^= x >> np.uint64(32)
    x += b
    x *= lane[1]
    x ^= x >> np.uint64(29)
    x *= lane[2]
    x ^= x >> np.uint64(32)
    return x


def doubled(first, at: np.ndarray, length: int, seed: int, lane: np.ndarray) -> np.ndarray:
    """Rank of ``length`` bytes from each position: ``first(at)`` gives ranks of ``seed`` bytes, then pairs at growing offsets.

    The last pair overlaps where ``length`` is no power of two times ``seed``.
    """
    if length == seed:
        return first(at)
    half = seed
    while 2 * half < length:
        half *= 2
    return _paired(doubled(first, at, half, seed, lane), doubled(first, at + (length - half), half, seed, lane), lane)


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, seed: int = SEED, segment: int = _SEGMENT) -> list[np.ndarray]:
    """First round's rows of the texts that lie one after the other in ``data`` (text k from ``offsets[k]`` to ``offsets[k + 1]``).

    Returns the text's number, the anchor's position in the text, the least and greatest distance back to its windows of
    one class (those that start less than half a span before it, and the others), and the class's rank. The bytes are
    read in segments of ``segment`` window starts; a class is given once, also where its windows lie in several.
    """
    if not 0 < segment <= (1 << 24) - span:
        raise ValueError("a segment and the span behind it must fit into 24 bits")
    n, width, half = int(offsets[-1]), span - seed + 1, span // 2
    whole = np.flatnonzero(np.diff(offsets) >= span)
    begin, end = offsets[whole], offsets[whole + 1] - span + 1  # window starts of each text
    classes: tuple[list, list] = ([], [])
    with np.errstate(over="ignore"):
        lo = int(begin[0]) if len(whole) else n
        while lo < n:
            a, z = np.searchsorted(end, lo, "right"), np.searchsorted(begin, lo + segment, "left")
            if a == z:  # no window starts here
                lo = int(begin[a]) if a < len(begin) else n
                continue
            part = data[lo : min(n, lo + segment + span - 1)]
            h = seed_hashes(part, seed)
            key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
            rows = -(-len(key) // width)
            grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
            grid[: len(key)] = key
            grid = grid.reshape(rows, width)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            windows = len(key) - width + 1
            turn = np.zeros(windows + 1, np.int8)
            turn[np.clip(begin[a:z] - lo, 0, windows)] += 1
            turn[np.clip(end[a:z] - lo, 0, windows)] -= 1
            start = np.flatnonzero(np.cumsum(turn[:-1], dtype=np.int8))
            owner = (np.minimum(behind[start], ahead[start + width - 1]) & np.uint64(0xFFFFFF)).astype(np.int64)
            if len(start):
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                last = np.concatenate((first[1:], [len(owner)])) - 1
                at = owner[first]
                near, far = at - start[last], at - start[first]
                for k, (part_of, back, length) in enumerate(((near < half, 0, span - half), (far >= half, half, half + seed))):
                    p = at[part_of]
                    rank = doubled(h.__getitem__, p - back, length, seed, _LANES[0])
                    low, high = (near[part_of], np.minimum(far[part_of], half - 1)) if k == 0 else (np.maximum(near[part_of], half), far[part_of])
                    classes[k].append((p + lo, low, high, rank ^ np.uint64(k)))
            lo += segment
    out = []
    for found in classes:
        if found:
            at, low, high, rank = (np.concatenate(x) for x in zip(*found))
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(at)) - 1 if len(at) else first  # windows of an anchor are neighbours, the farthest first
            out.append((at[first], low[last], high[first], rank[first]))
    if not out:
        return [np.zeros(0, np.int64)] * 5
    at, low, high, rank = (np.concatenate(x) for x in zip(*out))
    text = np.searchsorted(offsets, at, "right") - 1
    return [text, at - offsets[text], low, high, rank.view(np.int64)]


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where its rows begin and end; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


FOUND = "d long, th long, at int, near int, far int, rank long"


def _find_anchors(span, seed, segment):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = _text_buffer(b.column(2))
            text, at, near, far, rank = anchors(data, offsets, span, seed, segment)
            d, th = (b.column(k).to_numpy(zero_copy_only=False)[text] for k in (0, 1))
            small = [pa.array(x.astype(np.int32)) for x in (at, near, far)]
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), *small, pa.array(rank)], names=["d", "th", "at", "near", "far", "rank"])

    return run


RANKED = "d long, th long, w long, at int, near int, far int, i1 long, i2 long, u1 long, u2 long"


def _first_ranks(data: np.ndarray, seed: int, lane: np.ndarray):
    """Ranks of ``seed`` bytes at given positions only."""
    words = np.lib.stride_tricks.sliding_window_view(data, seed) if len(data) >= seed else None

    def first(at):
        cut = np.ascontiguousarray(words[at]).view("<u8")
        x = np.full(len(at), lane[2])
        for k in range(cut.shape[1]):
            x = _paired(x, cut[:, k], lane)
        return x

    return first


def _rank_ranges(data, at, low, width, span, seed):
    """Two lanes of the ranks of each range's intersection; ``at`` are positions in ``data``, ``low`` least distances."""
    reach = span - seed
    high = np.minimum(low + width - 1, reach)
    out = []
    for union in (False, True):
        length = span + (high - low if union else low - high)
        lanes = np.zeros((2, len(at)), np.uint64)
        for lane in (0, 1):
            first = _first_ranks(data, seed, _LANES[lane])
            for k in np.unique(length):  # the last range of an anchor is shorter
                own = length == k
                begin = at[own] - (high if union else low)[own]
                fits = (begin >= 0) & (begin + k <= len(data))
                rank = np.zeros(len(begin), np.uint64)
                rank[fits] = doubled(first, begin[fits], int(k), seed, _LANES[lane])
                lanes[lane, own] = _paired(rank, low[own].astype(np.uint64), _LANES[lane])
        out.append(lanes.view(np.int64))
        if width == 1:
            return out * 2
    return out


def _rank_items(span, seed, width, step=50_000):
    """For each range of distances the rank of its intersection and, if it lies in the text, of its union."""
    names = [x.split()[0] for x in RANKED.split(", ")]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = _text_buffer(b.column(3))
            items = b.column(4)
            text = np.repeat(np.arange(b.num_rows), np.diff(items.offsets.to_numpy()))
            flat = items.flatten()
            at, near, far = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            n_ranges = far // width - near // width + 1
            item = np.repeat(np.arange(len(at)), n_ranges)
            low = (near // width)[item] * width + width * (np.arange(len(item)) - np.repeat(np.cumsum(n_ranges) - n_ranges, n_ranges))
            text, at = text[item], at[item]
            near, far = np.maximum(near[item], low), np.minimum(far[item], low + width - 1)
            # a range with windows of both classes of an anchor is one range
            order = np.lexsort((low, at, text))
            text, at, low, near, far = (x[order] for x in (text, at, low, near, far))
            same = (text[1:] == text[:-1]) & (at[1:] == at[:-1]) & (low[1:] == low[:-1])
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(low)), bool), ~same)))
            if len(first):
                near, far = np.minimum.reduceat(near, first), np.maximum.reduceat(far, first)
                text, at, low = text[first], at[first], low[first]
            ids = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            with np.errstate(over="ignore"):
                for lo in range(0, len(low), step):
                    t, p, l = (x[lo : lo + step] for x in (text, at, low))
                    (i1, i2), (u1, u2) = _rank_ranges(data, p + offsets[t], l, width, span, seed)
                    h = np.minimum(l + width - 1, span - seed)
                    out_of = (p - h < 0) | (p + span - l > (offsets[t + 1] - offsets[t]))
                    cols = [x[t] for x in ids]
                    small = [pa.array(x.astype(np.int32)) for x in (p, near[lo : lo + step], far[lo : lo + step])]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *small, pa.array(i1), pa.array(i2), pa.array(u1, mask=out_of), pa.array(u2, mask=out_of)], names=names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return scoped(docs, "doc_id", "text").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def copies(docs: DataFrame) -> DataFrame:
    """Rows whose text another row has too: ``(d, th, w, first, times, n_bytes)``, once for each distinct row.

    ``w`` counts the rows with that text, ``first`` is the one of them that stands for all, ``times`` counts equal rows.
    """
    base = _keyed(docs).select("d", "th", F.xxhash64("text", F.lit(1)).alias("th2"), F.octet_length("text").cast("long").alias("n_bytes"))
    base = materialize(base.groupBy("d", "th", "th2", "n_bytes").agg(F.count("*").alias("times")), "rows")
    groups = base.groupBy("th", "th2", "n_bytes").agg(F.sum("times").alias("w"), F.min("d").alias("one")).where("w > 1")
    found = base.join(materialize(groups, "groups"), ["th", "th2", "n_bytes"])
    return materialize(found.select("d", "th", "w", (F.col("d") == F.col("one")).alias("first"), "times", "n_bytes"), "copies")


def repeated_windows(docs: DataFrame, same: DataFrame, span: int = SPAN, seed: int = SEED, segment: int = _SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Texts with a repeated first rank ``(d, th, w, text, items)`` and runs of repeated windows ``(d, th, w, first, last)``.

    ``same`` are the copies; one row of each group takes part, with the group's size as its weight ``w``.
    """
    if seed & (seed - 1) or seed < 8 or span < 2 * seed:
        raise ValueError("seed must be a power of two from 8, span at least twice as long")
    keyed = _keyed(docs)
    found = materialize(keyed.mapInArrow(_find_anchors(span, seed, segment), FOUND), "anchors")
    twice = materialize(found.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), "repeated-ranks")
    items = found.join(twice, "rank", "left_semi").groupBy("d", "th").agg(F.collect_set(F.struct("at", "near", "far")).alias("items"))
    items = items.join(same.select("d", "th", "w", "first").hint("merge"), ["d", "th"], "left").where("first is null or first")
    items = items.select("d", "th", F.coalesce("w", F.lit(1)).cast("long").alias("w"), "items")
    texts = keyed.join(items, ["d", "th"]).select("d", "th", "w", "text", "items")
    if not same.where("first and times > 1").isEmpty():
        texts = texts.dropDuplicates(["d", "th"])
    texts = materialize(texts, "texts")
    todo, repeated = texts, None
    me = F.struct("d", "th", "at")
    widths = [w for w in WIDTHS if span - w + 1 >= seed]
    for width in widths:
        ranked = materialize(todo.mapInArrow(_rank_items(span, seed, width), RANKED), "ranks")
        unions = ranked.where("u1 is not null").groupBy("u1", "u2").agg(F.sum("w").alias("nu"), F.min(me).alias("first")).where("nu > 1")
        unions = materialize(unions, "unions")  # a table of its own, so that Spark can split a join's hot rank
        judged = ranked
        if width > 1:
            mixed = "count(u1) < count(*) or min(u1) < max(u1) or min(u2) < max(u2)"
            inners = ranked.groupBy("i1", "i2").agg(F.sum("w").alias("ni"), F.expr(mixed).alias("mixed")).where("ni > 1")
            judged = ranked.join(materialize(inners, "inners"), ["i1", "i2"])  # a range with a unique intersection is done
        # ranges without union are spread by a key of their own that meets none
        own = F.coalesce("u1", F.xxhash64("d", "th", "at", "near"))
        judged = judged.withColumn("k1", own).withColumn("k2", F.coalesce("u2", F.col("at").cast("long"))).join(unions.withColumnsRenamed({"u1": "k1", "u2": "k2"}), ["k1", "k2"], "left")
        judged = judged.withColumn("whole", F.col("nu").isNotNull() & F.col("u1").isNotNull())
        on = F.when(F.col("whole"), F.col("mixed") & (F.col("first") == me)).otherwise(True) if width > 1 else F.lit(False)
        judged = judged.withColumn("on", on)
        judged = materialize(judged.where("whole or on").select("d", "th", "w", "at", "near", "far", "whole", "on"), "judged")
        part = judged.where("whole").select("d", "th", "w", (F.col("at") - F.col("far")).alias("first"), (F.col("at") - F.col("near")).alias("last"))
        repeated = part if repeated is None else repeated.union(part)
        if width > 1:
            items = judged.where("on").groupBy("d", "th").agg(F.collect_set(F.struct("at", "near", "far")).alias("items"))
            todo = texts.drop("items").join(items, ["d", "th"]).select("d", "th", "w", "text", "items")
    return texts, repeated


def _cut(span):
    names = ["d", "th", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches):
        for b in batches:
            data, offsets = _text_buffer(b.column(2)) if b.num_rows else (None, None)
            rows = []
            for k in range(b.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                runs = b.column(3)[k].values
                edges = np.zeros(len(text) + 1, np.int64)
                np.add.at(edges, runs.field(0).to_numpy(zero_copy_only=False), 1)
                np.add.at(edges, runs.field(1).to_numpy(zero_copy_only=False) + span, -1)
                gone = np.cumsum(edges[:-1]) > 0
                kept = text[~gone].tobytes()
                rows.append((int(gone.sum()), len(spans_of(gone)), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))]], names=names)

    return run


def removals(docs: DataFrame, span: int = SPAN, seed: int = SEED, segment: int = _SEGMENT) -> DataFrame:
    """Texts that lose bytes: ``(d, th, n_removed, n_spans, kept_sha256, kept)``, once for each distinct row."""
    same = copies(docs)
    texts, repeated = repeated_windows(docs, same, span, seed, segment)
    runs = repeated.where("w = 1").groupBy("d", "th").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    hit = texts.join(runs, ["d", "th"]).select("d", "th", "text", "runs")
    lost = hit.mapInArrow(_cut(span), "d long, th long, n_removed long, n_spans long, kept_sha256 string, kept string")
    whole = same.where(F.col("n_bytes") >= span).select("d", "th", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit("").alias("kept"))
    return lost.unionByName(whole)


def removal_report(docs: DataFrame, span: int = SPAN, seed: int = SEED, segment: int = _SEGMENT) -> DataFrame:
    """``documents -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256)``, one row for each input row."""
    lost = removals(docs, span, seed, segment).drop("kept")
    base = scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"),
        F.xxhash64("text").alias("th"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("sha"),
    )
    return base.join(lost, ["d", "th"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def clean(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """Documents with repeated strings removed from ``text`` (``n_chars`` follows if present), other columns unchanged."""
    lost = removals(docs, span, seed).select(F.col("d").alias("_d"), F.col("th").alias("_th"), F.col("kept").alias("_kept"))
    key = (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == F.col("_d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_th"))
    out = docs.join(lost, key, "left")
    text = F.coalesce("_kept", docs["text"])
    made = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[made[c].alias(c) if c in made else docs[c] for c in docs.columns])
