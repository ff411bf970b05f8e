"""Byte-level BPE encoding and decoding by overlapping chunks.

A text of more than one chunk is cut into chunks of `chunk` code points that reach `overlap` further into their follower. Chunks are rows of a written
table, so the chunks of one long text are spread over all tasks. Each is pre-tokenised from its own start, right or wrong; where the pre-token
boundaries of two neighbours fall together inside their overlap, both scans go on alike from there, since the pattern looks at nothing before
its match. By induction from the first chunk such a place is a boundary of the whole text, and text cut there encodes piece by piece as it does
whole. Neighbours meet by junction, not by document, and a junction without a common boundary (one long run) joins its chunks into one
piece. Pieces are encoded where their chunk is; the ids of a document come together last. Decoding concatenates the bytes of the ids.

Boundaries near the end of a chunk depend on what follows and are not used. Pre-tokens are found with the letter, number and space classes of the
encoder itself: code points that another Unicode version classes otherwise are replaced by one of the right class before the scan.

Defined cases: a null or empty text has no ids; a run without any boundary is one piece however long; texts that spell a special token are ordinary
text; repeated rows and null doc_ids give a row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winback.llm.common import cut, give_back, only

CHUNK = 1 << 14
OVERLAP = 512
#: A boundary nearer than this to a chunk's end can move with what follows (a contraction is a mark and two letters).
UNSURE = 3
_LOADED: dict[tuple[str, str], tuple] = {}
_SCANS: dict[str, Callable[[str], np.ndarray]] = {}


def vocabulary(ranks_path: str, pattern: str) -> tuple:
    """(encoder, bytes of each id)."""
    slot = (ranks_path, pattern)
    if slot not in _LOADED:
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _LOADED[slot] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table)
    return _LOADED[slot]


def reclassed() -> dict[int, str]:
    """Code points that `regex` and the encoder class differently, each with a code point that both put where the encoder does."""
    import regex
    import tiktoken
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    kinds, odd = {}, set()
    for kind, stand_in in ((r"\p{L}", "é"), (r"\p{N}", "²"), (r"\s", " ")):
        theirs = set(bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        odd |= theirs ^ set(regex.findall(kind, every))
        kinds[stand_in] = theirs
    return {ord(c): next((s for s, members in kinds.items() if c in members), "¤") for c in odd}


def scan(pattern: str) -> Callable[[str], np.ndarray]:
    """text -> ends of its pre-tokens, in code points."""
    if pattern not in _SCANS:
        import regex
        find, table = regex.compile(pattern).finditer, reclassed()

        def ends(text: str) -> np.ndarray:
            return np.array([m.end() for m in find(text if text.isascii() else text.translate(table))], np.int64)

        _SCANS[pattern] = ends
    return _SCANS[pattern]


def chunk_count(n: int, chunk: int, overlap: int) -> int:
    """Chunks of n code points; each reaches `overlap` into its follower, and the last is longer than that."""
    return max(1, -(-(n - overlap) // chunk))


def chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc, doc_id, k, last, size, text) of texts with more than one chunk. doc names a doc_id and its text."""
    schema = pa.schema([("doc", pa.string()), ("doc_id", pa.int64()), ("k", pa.int32()), ("last", pa.bool_()), ("size", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, doc_id, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = value.as_py()
                n = chunk_count(len(text), chunk, overlap)
                for lo in range(0, n, 64):
                    ks = range(lo, min(n, lo + 64))
                    parts = [text[k * chunk:] if k == n - 1 else text[k * chunk: (k + 1) * chunk + overlap] for k in ks]
                    columns = [[doc] * len(ks), [doc_id] * len(ks), list(ks), [k == n - 1 for k in ks], [len(text)] * len(ks), parts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            give_back()

    named = docs.select(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")), 256).alias("doc"), "doc_id", "text")
    return named.mapInArrow(run, "doc string, doc_id long, k int, last boolean, size long, text string")


def stitched(parts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, k, piece, begin, until, alone): the code points of the whole text that chunk k gives to its piece."""
    schema = pa.schema([("doc", pa.string()), ("k", pa.int32()), ("size", pa.int64()), ("head", pa.list_(pa.int64())), ("tail", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = scan(pattern)
        for b in batches:
            rows = []
            for doc, k, last, size, text in zip(*(b.column(i).to_pylist() for i in range(5))):
                e, base = np.append(0, ends(text)), k * chunk
                rows.append((doc, k, size, (e[e <= overlap - UNSURE] + base).tolist(), None))
                if not last:
                    rows.append((doc, k + 1, size, None, (e[(e >= chunk) & (e <= chunk + overlap - UNSURE)] + base).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    seen = parts.select("doc", "k", "last", "size", "text").mapInArrow(run, "doc string, k int, size long, head array<long>, tail array<long>")
    junctions = seen.groupBy("doc", "k").agg(F.max("size").alias("size"), F.max("head").alias("head"), F.max("tail").alias("tail"))
    met = junctions.select("doc", "k", "size", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "tail"))).alias("common"))
    order = Window.partitionBy("doc").orderBy("k")
    begun = met.select("doc", "k", "size", F.coalesce("common", F.col("k") * F.lit(chunk)).alias("begin"), F.max(F.when(F.col("common").isNotNull(), F.col("k"))).over(order).alias("piece"))
    return begun.select("doc", "k", "piece", "begin", F.coalesce(F.lead("begin").over(order), F.col("size")).alias("until"),
                        (F.count("*").over(Window.partitionBy("doc", "piece")) == 1).alias("alone"))


def long_ids(docs: DataFrame, ranks_path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, ids) of texts with more than one chunk."""
    parts = cut(chunks(docs, chunk, overlap), "bpe-chunks")
    placed = parts.select("doc", "doc_id", "k", "text").join(stitched(parts, pattern, chunk, overlap), ["doc", "k"])
    fields = pa.schema([("doc", pa.string()), ("doc_id", pa.int64()), ("k", pa.int32()), ("piece", pa.int32()), ("ids", pa.binary()), ("text", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = vocabulary(ranks_path, pattern)
        for b in batches:
            rows = []
            for doc, doc_id, k, text, piece, begin, until, alone in zip(*(b.column(i).to_pylist() for i in range(8))):
                own = text[begin - k * chunk: until - k * chunk]
                rows.append((doc, doc_id, k, piece, np.array(known.encode_ordinary(own), "<i4").tobytes() if alone else None, None if alone else own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
            give_back()

    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def document(doc_id: int | None, copies: int, held: list[tuple[int, bytes | None, str | None]], known) -> Iterator[pa.RecordBatch]:
        """held: (piece, ids, text) in order; texts of one piece are encoded together."""
        whole, text = [], []
        for n, (piece, ids, own) in enumerate(held):
            if ids is not None:
                whole.append(np.frombuffer(ids, "<i4"))
                continue
            text.append(own)
            if n + 1 == len(held) or held[n + 1][0] != piece:
                whole.append(np.array(known.encode_ordinary("".join(text)), np.int32))
                text = []
        row = pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.ListArray.from_arrays(pa.array([0, sum(map(len, whole))], pa.int32()), pa.array(np.concatenate(whole)))], schema=out)
        for _ in range(copies):
            yield row

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = vocabulary(ranks_path, pattern)
        last, held, seen, copies = None, [], -1, 0
        for b in batches:
            for doc, doc_id, k, piece, ids, own in zip(*(b.column(i).to_pylist() for i in range(6))):
                if last is not None and doc != last[0]:
                    yield from document(last[1], copies, held, known)
                    held, seen, copies = [], -1, 0
                last = doc, doc_id
                copies += k == 0
                if k > seen:  # a repeated row has the same chunks again
                    held.append((piece, ids, own))
                    seen = k
        if last is not None:
            yield from document(last[1], copies, held, known)
        give_back()

    pieces = placed.select("doc", "doc_id", "k", "text", "piece", "begin", "until", "alone").mapInArrow(encode, "doc string, doc_id long, k int, piece int, ids binary, text string")
    return pieces.repartition("doc").sortWithinPartitions("doc", "k").mapInArrow(gather, "doc_id long, ids array<int>")


def encoded(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row."""
    import public_tokenizers
    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    if not UNSURE < overlap < chunk:
        raise ValueError(f"the overlap must be over {UNSURE} and below the chunk")
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    single = F.length("text") <= chunk + overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, _ = vocabulary(ranks_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids = [np.array(known.encode_ordinary(t.as_py()), np.int32) for t in part.column(1)]
                at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])
            give_back()

    return rows.where(single).mapInArrow(run, "doc_id long, ids array<int>").union(long_ids(rows.where(~single), ranks_path, pattern, chunk, overlap))


def decoded(tokens: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds the column `decoded`: the bytes of the column `ids`, one after the other. Null ids have no bytes."""
    import public_tokenizers
    ranks_path, pattern = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    names = tokens.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = vocabulary(ranks_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [b"".join(map(table.__getitem__, x.as_py() or ())) for x in part.column(names.index("ids"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "decoded"])
            give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(run, f"{schema}, decoded binary")
