"""Removal of repeated byte strings by prefix doubling over sampled positions.

A rank names the bytes at a position; ranks of twice the length come from pairs of ranks an offset apart (1, 2, 4, ... bytes),
and only ranks that are not unique are carried to the next length, up to the threshold of `length` bytes. Equality is all
that is asked of a rank here, so a rank is a 64-bit name of its pair instead of a place in a sorted list, and sorting happens where
positions meet.

- Up to 16 bytes a rank depends on nearby bytes alone and is made where the text is. A window of `length` bytes is
  filed under the smallest 16-byte rank inside it. Equal windows have equal smallest ranks, and neighbouring windows mostly share theirs,
  so only about one rank in 18 bytes has to be told to others.
- Round 16: every block of documents sends its distinct smallest ranks, dealt by rank, 32 bits each; they are sorted and each block
  is told which of its ranks some other block has too. Positions under a unique rank are finished.
- Round `length`: runs of windows under the ranks left send their bytes, dealt by rank, once for each block and content. Their window ranks
  are made by doubling further (16, 32, length), sorted with the smallest doc_id first, and each block is told the windows that start in
  a smaller document somewhere. Two independent 64-bit names must agree.

A passage in a third of all documents is one entry for each block in either round. Blocks are rows of some MB of text, compressed, written
once to the shared folder; each round joins its answers to them by block number. Nothing is broadcast or collected.

Defined cases: a null or empty text has 0 bytes and the digest of no bytes; texts shorter than `length` lose nothing; rows with equal doc_id
don't count against each other; a null doc_id counts as larger than all others; an empty table gives no rows; further columns are
kept by `without_repeats` and ignored by `repeats`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.llm.common import SLICE_BYTES, U64, cut, give_back, mix, only, row_of, slices, sorted_groups, span_hashes, text_bytes

LENGTH = 50
#: Bytes of the ranks that are made locally.
FIRST = 16
BLOCK_BYTES = 2 << 20
#: Windows of a run that are sent together at most; longer runs (of one repeated byte, say) are sent in parts.
RUN = 64
#: Buckets of ranks for each shuffle partition: what meets in one bucket is held in memory.
BUCKETS = 16
LARGEST = np.iinfo(np.int64).max
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def byte_ranks(raw: np.ndarray, salt: int) -> np.ndarray:
    return mix(np.arange(256, dtype=U64) + U64(256 * salt + 1))[raw]


def paired(rank: np.ndarray, offset: int, salt: int = 0) -> np.ndarray:
    """Ranks of the pairs (rank[i], rank[i + offset])."""
    if len(rank) <= offset:
        return np.zeros(0, U64)
    out = rank[:-offset] * U64(_ODD[salt])
    out ^= out >> U64(29)
    out += rank[offset:] * U64(_ODD[salt + 1])
    out ^= out >> U64(32)
    return out


def first_ranks(raw: np.ndarray, salt: int = 0) -> np.ndarray:
    rank, size = byte_ranks(raw, salt), 1
    while size < FIRST:
        rank = paired(rank, size, salt)
        size *= 2
    return rank


def window_ranks(raw: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Ranks of all windows of `length` bytes, by doubling; the last pair overlaps."""
    rank, size = first_ranks(raw, salt), FIRST
    while 2 * size <= length:
        rank = paired(rank, size, salt)
        size *= 2
    return paired(rank, length - size, salt) if length > size else rank


def smallest(rank: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbouring ranks."""
    size = 1
    while 2 * size <= width:
        rank = np.minimum(rank[:-size], rank[size:])
        size *= 2
    if size < width:
        rank = np.minimum(rank[: len(rank) - (width - size)], rank[width - size:])
    return rank


class Runs:
    """Runs of windows of a block that are filed under one rank: start, end (windows), doc (row), and the rank's number among the distinct ones."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, length: int) -> None:
        starts, ends, docs, ranks = [], [], [], []
        for lo, hi in slices(at, rows=1 << 30):
            a, part = at[lo], raw[at[lo]: at[hi]]
            if len(part) < length:
                continue
            low = smallest(first_ranks(part), length - FIRST + 1)
            inner = at[lo: hi + 1] - a
            open_ = np.ones(len(low), bool)
            for e in inner[1:-1]:  # windows over the end of a row are none
                open_[max(0, e - length + 1): e] = False
            new = np.empty(len(low), bool)
            new[0] = True
            new[1:] = (low[1:] != low[:-1]) | (open_[1:] != open_[:-1])
            s = np.flatnonzero(new)
            e = np.append(s[1:], len(low))
            keep = open_[s]
            s, e = s[keep], e[keep]
            starts.append(s + a)
            ends.append(e + a)
            docs.append(row_of(inner, s) + lo)
            ranks.append(low[s])
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.start, self.end, self.doc = cat(starts, np.int64), cat(ends, np.int64), cat(docs, np.int64)
        self.names, self.name = np.unique(cat(ranks, U64), return_inverse=True)


def dealt(names: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket numbers present, edges): distinct ranks put together by bucket."""
    bucket = (names % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    kept, first = np.unique(bucket[order], return_index=True)
    return order, kept, np.append(first, len(order))


def run_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the runs' bytes; starts are in order, and the text is passed in parts."""
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        a = int(start[lo])
        hi = int(np.searchsorted(start, a + SLICE_BYTES, "left"))
        out[lo:hi] = span_hashes(raw[a: int(end[lo:hi].max())], start[lo:hi] - a, end[lo:hi] - a)
        lo = hi
    return out


def to_blob(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_blob(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_next_batch()


def own_id(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("_id")).fill_null(LARGEST).to_numpy(zero_copy_only=False)


def blocks(docs: DataFrame) -> DataFrame:
    """(block, blob): rows of docs, with columns _id and _text first, in compressed blocks of some MB."""
    schema = pa.schema([("block", pa.int64()), ("blob", pa.binary())])

    def run(batches):
        base, made, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def flush():
            nonlocal made, held, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays([pa.array([base + made]), pa.array([to_blob(whole)], pa.binary())], schema=schema)
            made, held, size = made + 1, [], 0
            return out

        for b in batches:
            _, at = text_bytes(b.column(1))
            for lo, hi in slices(at, BLOCK_BYTES, rows=1 << 30):
                if held and size + at[hi] - at[lo] > BLOCK_BYTES:
                    yield flush()
                held.append(b.slice(lo, hi - lo))
                size += at[hi] - at[lo]
        if held:
            yield flush()

    return docs.mapInArrow(run, "block long, blob binary")


ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("answer", pa.binary())])


def shared_ranks(whole: DataFrame, length: int, buckets: int) -> DataFrame:
    """Round 16. (block, bucket, answer): one bit for each rank that the block sent to the bucket, set if another block has it too."""
    sent = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("ranks", pa.binary())])

    def send(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1)):
                raw, at = text_bytes(from_blob(blob).column(1))
                names = Runs(raw, at, length).names
                if len(names):
                    order, kept, edge = dealt(names, buckets)
                    short = (names[order] >> U64(32)).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array([block] * len(kept), pa.int64()), pa.array([short[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary())], schema=sent)

    def meet(batches):
        for g in sorted_groups(batches, "bucket"):
            parts = [np.frombuffer(x.as_buffer(), "<u4") for x in g["ranks"]]
            every = np.concatenate(parts)
            order = np.argsort(every, kind="stable")
            same = every[order][1:] == every[order][:-1]
            found = np.zeros(len(every), bool)
            found[order[1:][same]] = True
            found[order[:-1][same]] = True
            edge = np.cumsum([0] + [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([g["block"].combine_chunks(), g["bucket"].combine_chunks(), pa.array([np.packbits(found[x:y]).tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary())], schema=ANSWER)

    return (whole.mapInArrow(send, "bucket long, block long, ranks binary").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(meet, "block long, bucket long, answer binary"))


def with_answers(whole: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with all that was answered to them. The shuffle of the blocks is the same in every round, so Spark makes it once."""
    told = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return whole.join(told.hint("merge"), "block", "left")


def by_block(batches):
    """(block, its rows, [(bucket, answer)])."""
    for b in batches:
        for block, blob, answers in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            told = answers.values
            yield block, from_blob(blob), [] if told is None else list(zip(told.field("bucket").to_pylist(), told.field("answer")))
            give_back()


def repeated_windows(whole: DataFrame, ranks: DataFrame, length: int, buckets: int) -> DataFrame:
    """Round `length`. (block, bucket, answer): pairs (first window, end) of windows, as places in the block's text, that start in a smaller document."""
    sent = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("text", pa.binary()), ("runs", pa.binary())])
    kinds = np.dtype([("doc", "<i8"), ("start", "<u4"), ("windows", "<u2")])

    def send(batches):
        pack = zstandard.ZstdCompressor(3)
        for block, rows, answers in by_block(batches):
            raw, at = text_bytes(rows.column(1))
            ids, runs = own_id(rows), Runs(raw, at, length)
            order, kept, edge = dealt(runs.names, buckets)
            shared = np.zeros(len(order), bool)
            place = dict(zip(kept.tolist(), zip(edge[:-1].tolist(), edge[1:].tolist())))
            for bucket, answer in answers:
                x, y = place[bucket]
                shared[order[x:y]] = np.unpackbits(np.frombuffer(answer.as_buffer(), np.uint8), count=y - x).astype(bool)
            if len(runs.name):  # or by two documents of this block
                owner = ids[runs.doc]
                least, most = np.full(len(order), LARGEST), np.full(len(order), np.iinfo(np.int64).min)
                np.minimum.at(least, runs.name, owner)
                np.maximum.at(most, runs.name, owner)
                shared |= least < most
            pick = np.flatnonzero(shared[runs.name])
            if not len(pick):
                continue
            parts = -(-(runs.end[pick] - runs.start[pick]) // RUN)
            pick = np.repeat(pick, parts)
            nth = np.arange(len(pick)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = runs.start[pick] + nth * RUN
            end = np.minimum(start + RUN, runs.end[pick])
            doc, name = ids[runs.doc[pick]], runs.name[pick]
            # Runs of equal bytes: those of the smallest document are sent; the others are known to repeat.
            content = run_names(raw, start, end + length - 1)
            by = np.lexsort((doc, end - start, content))
            head = np.ones(len(by), bool)
            head[1:] = (content[by][1:] != content[by][:-1]) | ((end - start)[by][1:] != (end - start)[by][:-1])
            least = np.empty(len(by), np.int64)
            least[by] = doc[by][np.flatnonzero(head)][np.cumsum(head) - 1]
            known = doc > least
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array([-1 - block]), pa.array([block]), pa.array([b""], pa.binary()), pa.array([np.stack([start[known], end[known]], 1).astype("<i8").tobytes()], pa.binary())], schema=sent)
            send_ = np.flatnonzero(~known)
            bucket = (runs.names[name[send_]] % U64(buckets)).astype(np.int64)
            send_ = send_[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            b, first = np.unique(bucket, return_index=True)
            edge = np.append(first, len(bucket))
            texts, heads = [], []
            for x, y in zip(edge[:-1], edge[1:]):
                mine = send_[x:y]
                texts.append(pack.compress(b"".join(raw[s: e + length - 1].tobytes() for s, e in zip(start[mine].tolist(), end[mine].tolist()))))
                head_ = np.zeros(y - x, kinds)
                head_["doc"], head_["start"], head_["windows"] = doc[mine], start[mine], end[mine] - start[mine]
                heads.append(head_.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array([block] * len(b), pa.int64()), pa.array(texts, pa.binary()), pa.array(heads, pa.binary())], schema=sent)

    def meet(batches):
        unpack = zstandard.ZstdDecompressor()
        for g in sorted_groups(batches, "bucket"):
            give_back()
            bucket = g["bucket"][0].as_py()
            if bucket < 0:  # known already; on their way to their block
                yield pa.RecordBatch.from_arrays([g["block"].combine_chunks(), pa.array([0] * g.num_rows, pa.int64()), g["runs"].combine_chunks()], schema=ANSWER)
                continue
            raw = np.frombuffer(b"".join(unpack.decompress(x.as_py()) for x in g["text"]), np.uint8)
            heads = [np.frombuffer(x.as_buffer(), kinds) for x in g["runs"]]
            owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            head = np.concatenate(heads)
            count = head["windows"].astype(np.int64)
            begin = np.cumsum(count + length - 1) - (count + length - 1)
            run = np.repeat(np.arange(len(head)), count)
            nth = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            spot = begin[run] + nth
            rank, check = window_ranks(raw, length)[spot], window_ranks(raw, length, 2)[spot]
            doc = head["doc"][run]
            by = np.argsort(rank, kind="stable")
            first = np.ones(len(by), bool)
            first[1:] = (rank[by][1:] != rank[by][:-1]) | (check[by][1:] != check[by][:-1])
            groups = np.flatnonzero(first)
            least = np.empty(len(by), np.int64)
            least[by] = np.repeat(np.minimum.reduceat(doc[by], groups), np.diff(np.append(groups, len(by))))
            bad = least < doc
            edge = bad.copy()
            edge[1:] = bad[1:] & ~(bad[:-1] & (run[1:] == run[:-1]))
            stop = bad.copy()
            stop[:-1] = bad[:-1] & ~(bad[1:] & (run[1:] == run[:-1]))
            s, e = np.flatnonzero(edge), np.flatnonzero(stop)
            if not len(s):
                continue
            pairs = np.stack([head["start"][run[s]] + nth[s], head["start"][run[s]] + nth[e] + 1], 1).astype("<i8")
            who = owner[run[s]]
            cuts = np.flatnonzero(np.diff(who)) + 1
            ends = np.append(cuts, len(who))
            ids = g["block"].to_numpy()[who[np.append(0, cuts)]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([bucket] * len(ids), pa.int64()), pa.array([pairs[x:y].tobytes() for x, y in zip(np.append(0, cuts), ends)], pa.binary())], schema=ANSWER)

    return (with_answers(whole, ranks).mapInArrow(send, "bucket long, block long, text binary, runs binary").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(meet, "block long, bucket long, answer binary"))


def covered(rows: pa.RecordBatch, answers: list, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, which bytes go) of a block."""
    raw, at = text_bytes(rows.column(1))
    change = np.zeros(len(raw) + 1, np.int32)
    for _, answer in answers:
        pairs = np.frombuffer(answer.as_buffer(), "<i8").reshape(-1, 2)
        np.add.at(change, pairs[:, 0], 1)
        np.add.at(change, pairs[:, 1] + length - 1, -1)
    return raw, at, np.cumsum(change[:-1], out=change[:-1]) > 0


def row_sums(member: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each row are members."""
    upto = np.zeros(len(member) + 1, np.int32 if len(member) < 1 << 31 else np.int64)
    np.cumsum(member, out=upto[1:])
    return (upto[at[1:]] - upto[at[:-1]]).astype(np.int64)


def marked(docs: DataFrame, length: int) -> DataFrame:
    """Blocks of docs (with _id and _text first) with the windows that go."""
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = cut(blocks(docs), "suffix-blocks")
    return with_answers(whole, repeated_windows(whole, shared_ranks(whole, length, buckets), length, buckets))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each byte under a `length`-byte string that also starts in a smaller document is removed."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for _, rows, answers in by_block(batches):
            raw, at, gone = covered(rows, answers, length)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edge = at[:-1][at[1:] > at[:-1]]
            first[edge] = gone[edge]
            removed, spans = row_sums(gone, at), row_sums(first, at)
            digests = [hashlib.sha256((raw[a:b][~gone[a:b]] if n else raw[a:b]).tobytes()).hexdigest() for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist())]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(at)), pa.array(removed), pa.array(spans), pa.array(digests, pa.string())], schema=schema)

    own = only(docs, _id="doc_id", _text="text").select(F.col("_id").cast("long").alias("_id"), "_text")
    return marked(own, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes taken out of text and n_chars counted anew; a character goes when any of its bytes goes. A document that loses all its text goes."""
    names = docs.columns
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != "text"])
    others = [(i, c) for i, c in enumerate(names) if c != "text"]
    text_at = names.index("text")

    def run(batches):
        for _, rows, answers in by_block(batches):
            raw, at, gone = covered(rows, answers, length)
            if gone.any():  # whole characters: a removed byte takes its character's other bytes along
                lead = (raw & 0xC0) != 0x80
                char = np.cumsum(lead) - 1
                lost = np.zeros(int(char[-1]) + 1, bool)
                lost[char[gone]] = True
                gone = lost[char]
            removed = row_sums(gone, at)
            texts = [raw[a:b][~gone[a:b]].tobytes().decode() if n else old for old, a, b, n in zip(rows.column(1).to_pylist(), at[:-1].tolist(), at[1:].tolist(), removed.tolist())]
            stay = pa.array((removed == 0) | (removed < np.diff(at)))
            columns: list = [None] * len(names)
            for k, (i, c) in enumerate(others):
                columns[i] = rows.column(2 + k)
                if c == "n_chars":
                    columns[i] = pa.array([None if t is None else len(t) for t in texts], rows.column(2 + k).type)
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(names))]).filter(stay)

    fields = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]
    return marked(own, length).mapInArrow(run, ", ".join(fields)).toDF(*names)
