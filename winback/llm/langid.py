"""Language identification by mixture inference.

A text is taken for a bag of letter pairs drawn from a mixture of languages. Pair counts per language are summed over all
labelled training documents; expectation-maximisation finds the mixture weights that make the text likeliest. Nested sets
of languages, taken by falling weight, are each fitted and the set with the best penalised likelihood is kept. The
prediction is the heaviest language of that set and the score its weight.

Pairs are of 64 byte classes (letters, each lead and continuation byte of accented letters, digits, breaks), so the model is |languages| x 4096
numbers, whatever the corpus; only languages that occur as labels are learned. lang, source and doc_id never enter a prediction.

Defined cases: null, empty and letterless texts are `und` with score 0; with no training document all texts are `und`; ties go to the
language that sorts first; repeated rows give equal predictions; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.llm.common import LOWER, give_back, only, row_of, slices, text_bytes, text_slices

UNKNOWN = "und"
CLASSES = 64
ROUNDS = 12
#: Weight of the penalty: half the logarithm of the pair count for each language beyond the first.
PENALTY = 1.0


def _classes() -> np.ndarray:
    """0 for a break, 1-26 for letters, 27 for digits, the rest for bytes of longer characters."""
    out = np.zeros(256, np.uint8)
    out[97:123] = np.arange(1, 27)
    out[65:91] = np.arange(1, 27)
    out[48:58] = 27
    out[0x80:0xC0] = 28 + np.arange(64) % 32
    out[0xC0:0x100] = 60 + np.arange(64) // 16
    return out


TO_CLASS = _classes()
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def pair_counts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, count) of the pairs of each row; runs of breaks count once, and a text begins and ends with a break."""
    kinds = TO_CLASS[LOWER[raw]]
    n = len(at) - 1
    # a break after every row: the previous row's is the next one's opening break
    padded = np.zeros(len(raw) + n, np.uint8)
    rows = np.repeat(np.arange(n), np.diff(at))
    padded[np.arange(len(raw)) + rows] = kinds
    owner = np.repeat(np.arange(n), np.diff(at) + 1)
    before = np.concatenate(([0], padded[:-1])).astype(np.int64)
    keep = (before != 0) | (padded != 0)
    code = (owner[keep] * CLASSES + before[keep]) * CLASSES + padded[keep]
    dense = np.bincount(code, minlength=n * CLASSES * CLASSES)
    hit = np.flatnonzero(dense)
    return hit // (CLASSES * CLASSES), hit % (CLASSES * CLASSES), dense[hit]


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each row has a letter; texts with neither A-Z nor a-z are looked at by character."""
    seen = np.zeros(len(at) - 1, bool)
    seen[row_of(at, np.flatnonzero(LETTER[raw]))] = True
    for r in np.flatnonzero(~seen & (at[1:] > at[:-1])):
        seen[r] = any(map(str.isalpha, raw[at[r]: at[r + 1]].tobytes().decode("utf-8", "replace")))
    return seen


class Model:
    """Sorted languages and the pair probabilities, pairs x languages."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.probability = ((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)).T.copy() if len(languages) else np.zeros((CLASSES * CLASSES, 0))

    def infer(self, row: np.ndarray, pair: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(best language, its weight) of each row that has pairs; rows are numbered 0 to rows - 1 and sorted."""
        k = len(self.languages)
        best, weight = np.zeros(rows, np.int64), np.zeros(rows)
        if not len(row) or not k:
            return best, weight
        first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
        owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(row))))
        c, like = count.astype(float), self.probability[pair]
        total = np.add.reduceat(c, first)

        def fit(allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            pi = allowed / allowed.sum(1, keepdims=True)
            for _ in range(rounds):
                share = pi[owner] * like
                share *= (c / share.sum(1))[:, None]
                pi = np.add.reduceat(share, first, axis=0) / total[:, None]
            return pi, np.add.reduceat(c * np.log((pi[owner] * like).sum(1)), first)

        every = fit(np.ones((len(first), k)), ROUNDS)
        place = np.argsort(np.argsort(-every[0], axis=1, kind="stable"), axis=1, kind="stable")
        top = np.full(len(first), -np.inf)
        chosen = np.zeros((len(first), k))
        for size in range(1, k + 1):
            pi, fitness = every if size == k else fit((place < size).astype(float), ROUNDS * (size > 1))
            fitness = fitness - PENALTY * 0.5 * (size - 1) * np.log(np.maximum(total, 2))
            better = fitness > top
            top[better], chosen[better] = fitness[better], pi[better]
        best[row[first]], weight[row[first]] = chosen.argmax(1), chosen.max(1)
        return best, np.clip(weight, 0, 1)


def train(labelled: DataFrame) -> Model:
    """Sums pair counts over all rows of (text, lang) with a lang. What reaches the driver is languages x 4096 sums."""
    schema = pa.schema([("lang", pa.string()), ("pair", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), object)
            for lo, hi, raw, at in text_slices(b, "text"):
                row, pair, count = pair_counts(raw, at)
                for lang in set(langs[lo:hi]):
                    mine = (langs[lo:hi] == lang)[row]
                    sums[lang] = sums.get(lang, 0) + np.bincount(pair[mine], count[mine], CLASSES * CLASSES)
        for lang, s in sums.items():
            hit = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(s[hit].astype(np.int64))], schema=schema)

    rows = only(labelled, text="text", lang="lang").where("lang is not null").mapInArrow(run, "lang string, pair int, n long").groupBy("lang", "pair").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    counts = np.zeros((len(languages), CLASSES * CLASSES))
    for r in rows:
        counts[languages.index(r["lang"]), r["pair"]] = r["n"]
    return Model(languages, counts)


def predictor(model: Model):
    """text -> (lang_pred, score), from the whole text alone."""
    names = np.array([*model.languages, UNKNOWN], object)

    @F.pandas_udf("lang_pred string, score double")
    def read(texts: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, pa.string())
        raw, at = text_bytes(column)
        langs, scores = [], []
        for lo, hi in slices(at):
            part, edge = raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]
            best, score = model.infer(*pair_counts(part, edge), hi - lo)
            known = has_letter(part, edge) & bool(model.languages)
            langs.append(names[np.where(known, best, len(model.languages))])
            scores.append(np.where(known, score, 0.0))
        give_back()
        return pd.DataFrame({"lang_pred": np.concatenate(langs) if langs else [], "score": np.concatenate(scores) if scores else []})

    return read


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score)."""
    return only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), predictor(model)("text").alias("found")).select("doc_id", "found.lang_pred", "found.score")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 4 == 2


def learn(docs: DataFrame) -> Model:
    """The model of the labelled documents that are not held out."""
    return train(docs.where(~held_out(docs["doc_id"])))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the documents that are not held out."""
    return predict(docs, learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def lettered(texts):
    """Whether a text has a letter."""
    @F.pandas_udf("boolean")
    def read(texts: pd.Series) -> pd.Series:
        raw, at = text_bytes(pa.array(texts, pa.string()))
        seen = [has_letter(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo]) for lo, hi in slices(at)]
        give_back()
        return pd.Series(np.concatenate(seen) if seen else np.zeros(0, bool))

    return read(texts)


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language can be told; where no language could be learned, nothing is known against a text with a letter, and all of those stay."""
    model = learn(docs)
    return docs.where(predictor(model)(docs["text"])["lang_pred"] != UNKNOWN if model.languages else lettered(docs["text"]))
