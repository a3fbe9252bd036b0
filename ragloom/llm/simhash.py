"""SimHash near-duplicates by multi-index hashing.

Words are lower-cased (A-Z only); 4-word shingles, repeats included, are hashed with XXH64 (seed 42); a fingerprint bit
is set where more than half of the hashes have it. Fingerprints within ``MAX_BITS`` differing bits are linked.

Search: a fingerprint is cut into two 32-bit segments. If two differ in at most 4 bits, one segment differs in at most
2, and then the radius-1 Hamming balls of the two segment values meet. Each distinct fingerprint therefore writes the 33
values of its ball for each segment into the table and looks the same 33 up (66 rows each, whatever the corpus), and
every match is verified on all 64 bits. Of the values that two balls share one is canonical, so a pair is found once.
Equal fingerprints are one class: copies are never paired with one another.

Defined cases: null or wordless text has fingerprint zero and links like any other; fewer than four words make one
shingle of the whole sequence; repeated rows share a fingerprint; an empty table gives an empty result. Null doc_ids
keep their row but never name a component of others.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import connected_components, materialize, scoped

WIDTH, SEED, MAX_BITS = 4, 42, 4
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()  # bytes.split(): space and \x09-\x0d
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    cuts = map(slice, start[: len(words) - width + 1].tolist(), end[width - 1 :].tolist())
    return np.fromiter(map(xxh64_intdigest, map(line.__getitem__, cuts), repeat(seed)), np.uint64, len(words) - width + 1)


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of one text."""
    h = shingle_hashes(text, width, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[lo : lo + 65536].astype(">u8"))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0].astype(np.int64))


def _prints(batches):
    for b in batches:
        out = pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``documents -> (doc_id, fp long)``."""
    return scoped(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(_prints, "doc_id long, fp long")


def _ball(segment: F.Column) -> F.Column:
    """The value and its 32 neighbours at one bit."""
    return F.array(segment, *[segment.bitwiseXOR(F.lit(1 << i)) for i in range(32)])


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs of distinct fingerprints with at most ``max_bits`` (0 to 5) differing bits: ``(fp) -> (a, b)``, a < b."""
    if not 0 <= max_bits <= 5:
        raise ValueError("two segments with balls of radius one find up to 5 differing bits")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    table = prints.select("fp", F.posexplode(F.array(low, high)).alias("part", "seg")).select("fp", "part", F.explode(_ball(F.col("seg"))).alias("k"))
    table = table.select((F.shiftleft(F.col("part").cast("long"), 32) + F.col("k")).alias("key"), "fp")
    a, b = table.alias("a"), table.alias("b")
    pair = """a.key = b.key and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {m} and (
        case when a.key < 4294967296 then
          case when bit_count((a.fp ^ b.fp) & 4294967295) <= 1 then a.key = (a.fp & 4294967295)
               else a.key < ((a.fp & 4294967295) ^ (b.fp & 4294967295) ^ a.key) end
        else bit_count((a.fp ^ b.fp) & 4294967295) > 2 and
          case when bit_count(shiftrightunsigned(a.fp ^ b.fp, 32)) <= 1 then (a.key & 4294967295) = shiftrightunsigned(a.fp, 32)
               else (a.key & 4294967295) < (shiftrightunsigned(a.fp ^ b.fp, 32) ^ (a.key & 4294967295)) end
        end)""".format(m=max_bits)
    # Spark doesn't see that each fingerprint becomes 66 rows, and would broadcast the table far beyond its threshold
    return a.join(b.hint("merge"), F.expr(pair)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``documents -> (doc_id, fingerprint, component_id)``, one row for each input row."""
    prints = materialize(fingerprints(docs), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comp = connected_components(fingerprint_links(classes.select("fp"), max_bits))
    named = materialize(classes.join(comp, classes.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root")), "classes")
    first = materialize(named.groupBy("root").agg(F.min("rep").alias("component_id")), "first")  # written, so that a join can split a large component
    labels = named.join(first, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the smallest doc_id stays, columns unchanged.

    Of rows that repeat that doc_id and its text one stays. Rows without doc_id can't be named and stay.
    """
    labels = materialize(near_duplicates(docs, max_bits).select("doc_id", "component_id"), "components").where("doc_id is not null")
    ids = labels.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("rep"))
    ids = materialize(ids.where("n > 1 or not rep"), "ids")
    gone = ids.where("not rep").select("doc_id")
    # a merge join at every size: a broadcast would pass the driver, and switch plans as the table grows
    out = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    if ids.where("n > 1").isEmpty():
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id is null"))
