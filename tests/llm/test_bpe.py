"""Chunked byte-level BPE against the encoder on whole texts, and back to the bytes."""

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from winback.llm import bpe


@pytest.fixture(scope="module")
def whole():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def awkward():
    rng = random.Random(8)
    bits = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "word", "É", "日本", "9", "12", "!?", "😀", "՘", "\U00011de0", " ", " ", "re", "s"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 400))) for _ in range(80)]
    texts += ["a" * 3000, " " * 2000 + "x", "'" * 1500, "\n" * 999, "ab " * 700, "a" * 700 + " b c " * 90 + "9" * 800 + " d", "日本語" * 500, "՘" * 400]
    return texts


@pytest.mark.parametrize("chunk, overlap", [(40, 8), (64, 32), (bpe.CHUNK, bpe.OVERLAP)])
def test_chunks_change_nothing(spark, whole, chunk, overlap):
    data = [(i % 50 if i % 9 else None, t) for i, t in enumerate(awkward())]
    data += [data[3], data[3], data[81], (None, "a" * 3000), (None, "a" * 3000)]
    got = bpe.decoded(bpe.encoded(spark.createDataFrame(data, "doc_id long, text string").repartition(5), chunk=chunk, overlap=overlap)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((i, tuple(whole.encode_ordinary(t)), t.encode()) for i, t in data)


def test_documents(docs, rows, whole):
    got = bpe.decoded(bpe.encoded(docs)).collect()
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got) == Counter((r[0], tuple(whole.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)


def test_scan_has_the_encoders_classes(whole):
    """Single-byte ranks show where the encoder's pattern begins and ends a letter run: all code points are classed alike after the replacement."""
    table = bpe.reclassed()
    single = {bytes([b]): b for b in range(256)}
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    import regex
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = set(bytes(tiktoken.Encoding("c", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary("".join(every))).decode())
        own = regex.compile(kind)
        assert {c for c in every if own.match(table.get(ord(c), c))} == theirs


def test_stitches_are_used(spark):
    """Prose is cut at every junction; a run without boundaries at none."""
    prose, run = "the river and the stone " * 60, "a" * 1400
    df = spark.createDataFrame([(1, prose), (2, run)], "doc_id long, text string")
    parts = bpe.chunks(df, 100, 30)
    got = bpe.stitched(parts, public_tokenizers.PATTERN, 100, 30).join(parts.select("doc", "k", "doc_id"), ["doc", "k"]).collect()
    assert all(r["alone"] and r["piece"] == r["k"] for r in got if r["doc_id"] == 1)
    assert {r["piece"] for r in got if r["doc_id"] == 2} == {0}
    for doc, text in ((1, prose), (2, run)):
        spans = sorted((r["begin"], r["until"]) for r in got if r["doc_id"] == doc)
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_empty(no_docs):
    assert bpe.decoded(bpe.encoded(no_docs)).collect() == []


def test_bad_overlap(docs):
    with pytest.raises(ValueError):
        bpe.encoded(docs, chunk=10, overlap=10)
