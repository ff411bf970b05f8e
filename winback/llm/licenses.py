"""License scan by diagonal voting.

Every rolling pair of words of every text is hashed and joined by Spark to the positions of the same pairs in license templates. A hit
votes for the diagonal (position in the text minus position in the template). Votes are counted by diagonal, neighbouring diagonals of a
template are merged into one span (words may be added or left out), and a span is verified by the share of distinct template pairs that it
holds. A base phrase is a short template that has to be complete on one diagonal. Only hits and one row per text are shuffled; the
template table is fixed, some hundred rows, and broadcast.

Hashes have 64 bits, so a chance hit needs about 2^64 / (template pairs) text pairs; even then it needs company on its diagonal to count.

Defined cases: a null or empty text has no words and no label; a phrase never crosses documents; repeated rows with one doc_id and text give
one row each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winback.llm.common import LOWER, U64, byte_class, mix, only, row_of, runs, span_hashes, text_slices

WORD = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Phrases whose places are counted exactly, and their labels; fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Wording of licenses in use, and the labels of the method's own.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution"),
    ("cc", "licensed under cc by nc"),
    ("cc", "licensed under cc by sa"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Share of a notice's pairs that a span has to hold.
SHARE = 0.75
#: Largest step between diagonals of one span.
DRIFT = 3


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words of each row."""
    low = LOWER[raw]
    start, end = runs(WORD[low], at)
    return span_hashes(low, start, end), row_of(at, start)


def pairs(word: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    return mix(word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:])


def templates(spark: SparkSession) -> DataFrame:
    """(gram, template, label, phrase, size, spot): every pair of every template."""
    rows = []
    for n, (text, label, phrase) in enumerate([(p, x, True) for p, x in PHRASES.items()] + [(t, x, False) for x, t in NOTICES]):
        raw = np.frombuffer(text.encode(), np.uint8)
        word, _ = words_of(raw, np.array([0, len(raw)]))
        gram = pairs(word).view(np.int64).tolist()
        rows += [(g, n, label, phrase, len(gram), k) for k, g in enumerate(gram)]
    return spark.createDataFrame(rows, "gram long, template int, label string, phrase boolean, size int, spot int")


def grams(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, grams): the pair hashes of each text, in order. row tells rows apart that share a doc_id."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            for lo, hi, raw, at in text_slices(b, "text"):
                word, doc = words_of(raw, at)
                count = np.bincount(doc, minlength=hi - lo)
                inside = doc[1:] == doc[:-1] if len(doc) else np.zeros(0, bool)
                gram = pairs(word)[inside].view(np.int64) if len(word) else np.zeros(0, np.int64)
                edge = np.append(0, np.cumsum(np.maximum(count - 1, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edge), pa.array(gram))], schema=schema)

    own = only(docs, doc_id="doc_id", text="text").select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "row long, doc_id long, n_words long, grams array<long>")


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    marker = F.lit(0).cast("long")  # one entry a text that carries n_words as its position, so that a text without hits stays
    table = templates(docs.sparkSession)
    marked = table.union(docs.sparkSession.createDataFrame([(0, -1, "", False, 0, 0)], table.schema))
    hits = (grams(docs).select("row", "doc_id", "n_words", F.posexplode(F.concat(F.col("grams"), F.array(marker))).alias("pos", "gram"))
            .join(F.broadcast(marked), "gram").where("template >= 0 OR pos = greatest(n_words - 1, 0)"))
    votes = hits.groupBy("row", "doc_id", "template", "label", "phrase", "size", (F.col("pos") - F.col("spot")).alias("diagonal")).agg(
        F.collect_set("spot").alias("spots"), F.min("pos").alias("first"), F.max("n_words").alias("n_words"), F.count("*").alias("n"))
    along = Window.partitionBy("row", "doc_id", "template").orderBy("diagonal")
    near = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) <= DRIFT, F.lit(False)) & ~F.col("phrase")
    spans = (votes.withColumn("span", F.sum((~near).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("row", "doc_id", "template", "label", "phrase", "size", "span")
             .agg(F.size(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("held"), F.min("diagonal").alias("start"), F.max("n_words").alias("n_words"), F.max("n").alias("n")))
    share = F.col("held") / F.nullif("size", F.lit(0))
    good = F.when(F.col("phrase"), F.col("held") == F.col("size")).otherwise(share >= SHARE) & (F.col("template") >= 0)
    base = good & F.col("phrase")
    join = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    found = spans.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        join(base).alias("base_labels"), join(good).alias("labels"), F.coalesce(F.max(F.when(good, share)), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template") == -1, F.col("n"))).alias("rows"))
    # equal rows (same doc_id and text) were counted together: one row each again
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
