"""Best-fit packing of documents into sequences of at most `capacity` tokens.

Bounded-space online best-fit: a task keeps a fixed number of open bins. An integer is used as a bitset with one bit per free
space, next to a list of the open bins with that much room; the smallest free space that still holds a piece is the
lowest set bit at or above its length. When all places are taken, the fullest bin closes. Pieces pass through the task once, in runs
that are placed longest first, so memory is the open bins and one run. Tokens are counted where the text is read; only lengths and checksums are shuffled, by doc_id.

Defined cases: a null or empty text is one token (the end id); a text longer than a sequence is cut, the first piece may be
shorter; repeated doc_ids are packed row by row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.llm.common import give_back, only

CAPACITY = 2048
OPEN_BINS = 1024
#: Pieces that are placed longest first before the next ones are looked at.
RUN = 2048
END_ID = 0
_LOADED: dict[tuple[str, str], tuple] = {}


def encoder(ranks_path: str, pattern: str, json_path: str):
    """text -> ids of the byte-level vocabulary. Texts that spell a special token go through the tokenizers library itself."""
    slot = (ranks_path, json_path)
    if slot not in _LOADED:
        import tiktoken
        from tokenizers import Tokenizer
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full = Tokenizer.from_file(json_path)
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        _LOADED[slot] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), full, special)
    fast, full, special = _LOADED[slot]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, after what is left over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""
    import public_tokenizers
    pattern = public_tokenizers.PATTERN
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        encode = encoder(ranks_path, pattern, json_path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                raw = np.array(ids, "<u4")
                rows += [(doc, k, s, n, zlib.crc32(raw[s: s + n])) for k, (s, n) in enumerate(cut_points(len(raw), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            give_back()

    return only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins:
    """At most `room` open bins; place() gives (bin, offset) of a piece."""

    def __init__(self, capacity: int, room: int) -> None:
        self.capacity, self.room = capacity, room
        self.free = 0
        self.at: dict[int, deque] = defaultdict(deque)
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.room:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
            space, number = self.capacity, self.made
            self.made += 1
        if space > length:
            self.at[space - length].append(number)
            self.free |= 1 << (space - length)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.at[space].popleft()
        if not self.at[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def pack(found: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length. Rows are dealt by doc_id and sorted, so a repeated task packs the same way."""
    def run(batches):
        bins, base = Bins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            at = np.empty((len(length), 2), np.int64)
            for lo in range(0, len(length), RUN):
                order = lo + np.argsort(-length[lo: lo + RUN], kind="stable")
                at[order] = [bins.place(n) for n in length[order].tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at[:, 0] + base), pa.array(at[:, 1])], names=[*b.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return found.repartition("doc_id").sortWithinPartitions("doc_id", "piece", "length", "ids_crc32").mapInArrow(run, schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    return pack(pieces(docs, capacity), capacity, open_bins)
