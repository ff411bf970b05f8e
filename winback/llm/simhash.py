"""SimHash near-dedup by bit-sliced comparison.

Fingerprints come from the whole lower-cased text. Equal fingerprints are folded to one row with the smallest doc_id. The 64
bits are cut into blocks; if at most `radius` bits differ, at least blocks - radius blocks are equal, so every pair within the
radius meets in the bucket of some choice of that many blocks: the search is exact. Inside a bucket, bit planes of all members
stand vertically (one machine word holds one bit of 64 members); the differences of a member to 64 others are counted at
once in carry-save counters, and the planes left are skipped for words in which every lane has passed the radius. A bucket
above CHUNK rows is cut into a triangle of cells, so no task holds a large group, and a cell emits a spanning forest of its
links, never all pairs.

Defined cases: a null or empty text has fingerprint 0 and links like any other; texts below the shingle length give one
shingle; repeated rows share a component; a row without a doc_id has the component of its
fingerprint, null where only such rows have it, and links nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.llm.common import U64, components, cut, forest, give_back, only, sorted_groups

SEED = 42
#: Members of a bucket that are compared as one cell side.
CHUNK = 2048
#: Buckets of this mean size are small enough; beyond it, bits are cut into one block more.
MEAN_BUCKET = 4096


def fingerprint(text: str | None, words: int = 4) -> int:
    """Bit i is 1 if over half of the shingle hashes have it."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    ones = np.zeros(64, np.int64)
    n = len(found) - words + 1
    for lo in range(0, n, 1 << 15):
        hi = min(n, lo + (1 << 15))
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[lo:hi].tolist(), end[lo + words - 1: hi + words - 1].tolist())), U64, hi - lo)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): fp as a long with the fingerprint's bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), U64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], schema=schema)
            give_back()

    return only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """64 bit planes; bit j of word w of plane b is bit b of fingerprint 64 * w + j."""
    words = -(-len(fp) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(U64)


def within(query: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with at most `radius` bits between query[i] and fp[j], by carry-save counters over bit planes."""
    side = planes(fp)
    words = side.shape[1]
    width = (radius + 1).bit_length()
    hits_i, hits_j = [], []
    # Pairs of (query, word of 64 lanes) that are still in play; abandoned ones are dropped between rounds of planes.
    step = max(1, (1 << 18) // max(1, words))
    full = ~U64(0)
    tail = np.full(words, full)
    if len(fp) % 64:
        tail[-1] = U64((1 << (len(fp) % 64)) - 1)
    for lo in range(0, len(query), step):
        q = query[lo: lo + step]
        qi = np.repeat(np.arange(len(q)), words)
        wi = np.tile(np.arange(words), len(q))
        dead = ~tail[wi]
        count = [np.zeros(len(qi), U64) for _ in range(width)]
        masks = (U64(0) - ((q[:, None] >> np.arange(64, dtype=U64)) & U64(1))).T.copy()
        for bit in range(64):
            carry = side[bit][wi] ^ masks[bit][qi]
            for c in count:
                c ^= carry
                carry &= ~c
            dead |= carry
            if bit % 8 == 7 and bit > 8:
                dead |= over(count, radius)
                live = np.flatnonzero(dead != full)
                if len(live) < 0.7 * len(dead):
                    qi, wi, dead, count = qi[live], wi[live], dead[live], [c[live] for c in count]
        dead |= over(count, radius)
        live = np.flatnonzero(dead != full)
        if len(live):
            lanes = np.unpackbits((~dead[live]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(lanes)
            hits_i.append(lo + qi[live[r]])
            hits_j.append(wi[live[r]] * 64 + lane)
    return (np.concatenate(hits_i), np.concatenate(hits_j)) if hits_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            equal &= count[k]
        else:
            above |= equal & count[k]
            equal &= ~count[k]
    return above


def buckets(rows: int, radius: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Block edges, and the choices of blocks that are a bucket's key. Any number of blocks finds all pairs; more make buckets smaller."""
    for blocks in range(radius + 1, radius + 6):
        edges = [64 * k // blocks for k in range(blocks + 1)]
        if rows <= MEAN_BUCKET << (64 * (blocks - radius) // blocks):
            break
    return edges, list(itertools.combinations(range(blocks), blocks - radius))


def links(reps: DataFrame, rows: int, radius: int = 4) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of the fingerprints within the radius; a and b are rep ids. reps has fp and rep, one row per fp."""
    edges, choices = buckets(rows, radius)
    mask = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(len(edges) - 1)]
    masks = [sum(mask[k] for k in c) for c in choices]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])).alias("key")
    keyed = reps.select(key, "fp", "rep")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    spread = (keyed.join(sizes, "key")
              .withColumn("chunks", F.ceil(F.col("n") / CHUNK))
              .withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
              .select(F.xxhash64("key", F.least("c", "other"), F.greatest("c", "other")).alias("cell"),
                      ((F.col("c") <= F.col("other")).cast("int") + 2 * (F.col("c") >= F.col("other")).cast("int")).alias("side"), "fp", "rep"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for g in sorted_groups(batches, "cell"):
            fp, rep = g["fp"].to_numpy().view(U64), g["rep"].to_numpy()
            side = g["side"].to_numpy()
            order = np.argsort(rep, kind="stable")
            fp, rep, side = fp[order], rep[order], side[order]
            left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            if len(rep) < 2 or not len(left) or not len(right):
                continue
            i, j = within(fp[left], fp[right], radius)
            i, j = left[i], right[j]
            keep = i != j
            low = forest(len(rep), i[keep], j[keep])
            moved = np.flatnonzero(low != np.arange(len(rep)))
            if len(moved):
                held.append((rep[moved], rep[low[moved]]))
            if len(held) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], schema=schema)

    return spread.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    prints = cut(fingerprints(docs, words), "simhash")
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-reps")
    named_reps = reps.where("rep IS NOT NULL")
    found = components(links(named_reps, named_reps.count(), radius), "simhash-links")
    named = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
