"""Keyed stores: whole versions, few files, nothing applied twice."""

import random

import pytest

from winback.streaming.keyed import KeyedStore, folds


def rows(spark, data):
    return spark.createDataFrame(data, "customer_id long, v long")


def put(spark, store, version, data, **meta):
    draft = store.begin(version)
    if draft is None:
        return False
    draft.put("t", rows(spark, data))
    draft.commit(**meta)
    return True


def content(df):
    return {r["customer_id"]: r["v"] for r in df.collect()}


def test_last_row_of_a_key_and_bounded_files(spark, tmp_path):
    store, rng, want, opened = KeyedStore(spark, str(tmp_path), buckets=2, segments=3), random.Random(1), {}, []
    for version in range(12):
        data = {rng.randrange(40): version * 100 + k for k in range(rng.choice([1, 6]))}
        want |= data
        assert put(spark, store, version, list(data.items()), n=version)
        opened.append(len(store.names("t")))
    assert content(store.read("t")) == want and store.meta() == {"n": 11}
    assert max(opened) <= 2 * 3


def test_a_version_is_applied_once(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path))
    assert put(spark, store, 4, [(1, 10)], spent=10)
    assert not put(spark, store, 4, [(1, 99), (2, 99)], spent=99) and not put(spark, store, 3, [(5, 5)])
    assert content(store.read("t")) == {1: 10} and store.meta()["spent"] == 10


def test_readers_see_whole_versions(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), buckets=3)
    put(spark, store, 0, [(k, 0) for k in range(9)])
    before = store.read("t")
    draft = store.begin(1)
    draft.put("t", rows(spark, [(k, 1) for k in range(9)]))
    assert set(content(store.read("t")).values()) == {0}          # written, not committed
    draft.commit()
    assert set(content(store.read("t")).values()) == {1}
    assert set(content(before).values()) == {0} == set(content(store.read("t", 0)).values())   # an open reader keeps its version


def test_a_draft_left_behind_is_never_read(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path))
    put(spark, store, 0, [(1, 1)])
    store.begin(1).put("t", rows(spark, [(1, 2), (3, 2)]))        # the writer dies here
    assert content(store.read("t")) == {1: 1}
    assert put(spark, store, 1, [(1, 5)]) and content(store.read("t")) == {1: 5}


def test_reading_some_keys_opens_their_buckets(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), buckets=32)
    put(spark, store, 0, [(k, k) for k in range(200)])
    some = store.read("t", keys=rows(spark, [(7, 0), (9, 0), (999, 0)]))
    assert content(some) == {7: 7, 9: 9} and len(some.inputFiles()) <= 3


def test_empty_batches_and_missing_tables(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path))
    assert store.read("t") is None and store.meta() == {} and store.names("t") == []
    put(spark, store, 0, [])
    assert store.read("t").collect() == []
    put(spark, store, 1, [(None, 3), (1, 1)])                     # a missing key is a key
    assert content(store.read("t")) == {None: 3, 1: 1}


def test_expire_keeps_what_the_last_versions_name(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), buckets=2)
    for v in range(6):
        put(spark, store, v, [(k, v) for k in range(8)])
    assert store.expire(keep=2) > 0 and store.versions() == [4, 5]
    assert set(content(store.read("t")).values()) == {5} and set(content(store.read("t", 4)).values()) == {4}


@pytest.mark.parametrize("sizes, want", [([100], 1), ([100, 10], 1), ([100, 60], 2), ([100, 30, 20], 3), ([900, 100, 1], 1), ([5000, 900, 100, 10, 1], 2)])
def test_folds(sizes, want):
    assert folds(sizes, 4) == want
