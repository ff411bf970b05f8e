"""The pipeline, stage by stage, against brute force on what each stage was given."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import duck, fingerprint, repeats


@pytest.fixture(scope="module")
def steps(spark, docs):
    out, now = {"documents": docs}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.cut(stage(spark, now, ""), f"test-{name}")
        out[name] = now
    return out


def plain(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()]


def test_columns(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_passages", "mixture", "pack"]
    for name in names[:-1]:
        assert steps[name].columns == steps["documents"].columns and steps[name].count() > 0


def test_language(steps):
    want = [r for r in plain(steps["documents"]) if r[0] is not None and any(map(str.isalpha, r[1] or ""))]
    assert Counter(plain(steps["language"])) == Counter(want)


def test_language_without_labels(spark, docs):
    """Where no model can be learned, the documents with a letter stay."""
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    want = [r for r in plain(bare) if r[0] is not None and any(map(str.isalpha, r[1] or ""))]
    assert want and Counter(plain(corpus_pipeline.language(spark, bare, ""))) == Counter(want)


def test_near_duplicates(steps):
    given = plain(steps["language"])
    fps = [fingerprint(r[1]) for r in given]
    label = list(range(len(given)))
    for _ in given:
        label = [min(label[j] for j in range(len(given)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(given))]
    least = {c: min(r[0] for r, x in zip(given, label) if x == c) for c in set(label)}
    want = {r for r, c in zip(given, label) if r[0] == least[c]}
    assert Counter(plain(steps["near_duplicates"])) == Counter(want)


def test_repeated_passages(steps):
    given, kept = plain(steps["near_duplicates"]), plain(steps["repeated_passages"])
    want = {d: n - gone for d, n, gone, _, _ in repeats(given)}
    assert {r[0] for r in kept} == {d for d, n in want.items() if n}
    for r in kept:
        assert len(r[1].encode()) <= want[r[0]] and len(r[1].encode()) > want[r[0]] - 8 and r[4] == len(r[1])


def test_mixture(steps):
    given = plain(steps["repeated_passages"])
    columns, rows = duck(given, "op8_mixing")
    times = {r[columns.index("doc_id")]: r[columns.index("taken")] // max(1, r[columns.index("size")]) for r in rows}
    assert Counter(plain(steps["mixture"])) == Counter({r: times[r[0]] for r in given if times[r[0]]})


def test_pack(steps):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = Counter()
    for r in plain(steps["mixture"]):
        lengths[r[0]] += len(tok.encode(r[1], add_special_tokens=False).ids) + 1
    got = Counter()
    for r in steps["pack"].collect():
        got[r["doc_id"]] += r["length"]
    assert got == lengths


def test_run(spark, tmp_path, docs, steps):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    once = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(once) == key(steps["pack"])
    assert np.all([r["length"] <= 2048 for r in once.collect()])
