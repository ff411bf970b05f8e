"""Quality rules with thresholds that follow the data.

Base rules are fixed. The method's own limits come from mergeable quantile sketches of four integer ratios for each language and source. A
sketch is a count for each value rounded down to five significant bits (an error of at most 1/16), so sketches of any two sets of
documents merge by adding counts, partial sketches are built before the shuffle, and reruns agree. Sketches of sources merge to a
sketch of the language, and those to one of everything. A group's own limits are its quartiles, SPREADS times their distance further out, and the ratio's
slack, so up to a quarter of junk in a group does not move them. They are blended with those of the level above at every size, as if PARENT documents of a
group were like its parent's: (n * own + PARENT * parent) div (n + PARENT).

Defined cases: a null or empty text has no words and fails a base rule; null language and null source are groups of their own; repeated rows
count each time in sketches and are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winback.llm.common import NOT_SPACE, U64, byte_class, cut, mix, row_of, runs, span_hashes, text_slices

WINDOW = 5
SYMBOL = byte_class(lambda b: chr(b) in "#*$%&|<>")
#: Ratios per mille of the words (word length: thousandths of a character) and their slack, both ways for word length and upwards for the rest:
#: two characters, a symbol a word, a repeated line for five words, a fifth of the words.
RATIOS = {"word_length": ("1000 * word_chars div n_words", 2000), "symbols": ("1000 * n_symbols div n_words", 1000),
          "dup_lines": ("1000 * n_dup_lines div n_words", 200), "repeats": ("1000 * n_repeat_words div n_words", 200)}
PARENT = 200
SPREADS = 3
SIGNIFICANT = 5


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) from the whole text."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *[(n, pa.int64()) for n in names]])

    def run(batches):
        for b in batches:
            for lo, hi, raw, at in text_slices(b, "text"):
                n = hi - lo
                word = NOT_SPACE[raw]
                totals = [np.append(0, np.cumsum(m)) for m in (word & ((raw & 0xC0) != 0x80), SYMBOL[raw])]
                starts, ends = runs(word, at)
                doc = row_of(at, starts)
                repeat = np.zeros(len(starts), bool)
                if len(starts) >= WINDOW:
                    names_ = span_hashes(raw, starts, ends)
                    whole = np.flatnonzero(doc[WINDOW - 1:] == doc[: len(doc) - WINDOW + 1])
                    gram = mix(doc[whole].astype(U64) + U64(1))
                    for k in range(WINDOW):
                        gram = mix(gram * U64(0x9E3779B97F4A7C15) + names_[whole + k])
                    twice = _again(gram, first_too=True)
                    change = np.zeros(len(starts) + 1, np.int64)
                    np.add.at(change, whole[twice], 1)
                    np.add.at(change, whole[twice] + WINDOW, -1)
                    repeat = np.cumsum(change[:-1]) > 0
                ls, le = runs(raw != 10, at)
                full = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
                ls, le = ls[full], le[full]
                line_doc = row_of(at, ls)
                again = _again(mix(span_hashes(raw, ls, le) + line_doc.astype(U64) * U64(0x9E3779B97F4A7C15)), first_too=False)
                columns = [np.bincount(doc, minlength=n), totals[0][at[1:]] - totals[0][at[:-1]], totals[1][at[1:]] - totals[1][at[:-1]],
                           np.bincount(line_doc[again], minlength=n), np.bincount(doc[repeat], minlength=n)]
                yield pa.RecordBatch.from_arrays([*[b.column(k).slice(lo, n) for k in range(3)], *[pa.array(c.astype(np.int64)) for c in columns]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names))


def _again(key: np.ndarray, first_too: bool) -> np.ndarray:
    """Which keys are equal to an earlier one, or to any other one."""
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    out = np.zeros(len(key), bool)
    out[by[1:][same]] = True
    if first_too:
        out[by[:-1][same]] = True
    return out


def rounded(value: Column) -> Column:
    """Down to five significant bits."""
    bits = F.greatest(F.length(F.bin(value)) - SIGNIFICANT, F.lit(0))
    step = F.expr("1L").cast("long")
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits) * step


def limits(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Own low and high limit of each ratio of each group from its merged sketch; the windows see one group's sketch, some hundred counts."""
    merged = sketches.groupBy(*keys, "ratio", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("total", F.sum("n").over(group))
    at = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("total") * p, F.col("value")))
    q = ranked.groupBy(*keys, "ratio").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("n"))
    slack = F.create_map(*[F.lit(x) for n, (_, s) in RATIOS.items() for x in (n, s)])[F.col("ratio")]
    reach = SPREADS * (F.col("q3") - F.col("q1")) + slack
    low = F.when(F.col("ratio") == "word_length", F.greatest(F.col("q1") - reach, F.lit(0))).otherwise(F.lit(0))
    return q.select(*keys, "ratio", "n", low.cast("long").alias("low"), (F.col("q3") + reach).cast("long").alias("high"))


def blended(own: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Limits drawn towards those of the level above, by a weight that is the same rule at every size."""
    above = parent.select(*keys, F.col("low").alias("_low"), F.col("high").alias("_high"))
    return own.join(above, keys).select(*[c for c in own.columns if c not in ("low", "high")],
                                        *[F.expr(f"(n * {c} + {PARENT} * _{c}) div (n + {PARENT})").alias(c) for c in ("low", "high")])


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every document."""
    found = cut(measure(docs), "quality-measures").withColumns({"l": F.concat(F.lit("="), "lang"), "s": F.concat(F.lit("="), "source")}).na.fill("", ["l", "s"])
    ratios = F.explode(F.array(*[F.struct(F.lit(n).alias("ratio"), F.expr(e).alias("value")) for n, (e, _) in RATIOS.items()])).alias("r")
    sketches = cut(found.where("n_words > 0").select("l", "s", ratios).select("l", "s", "r.ratio", rounded(F.col("r.value")).alias("value")).groupBy("l", "s", "ratio", "value").agg(F.count("*").alias("n")), "quality-sketches")
    coarse = limits(sketches.withColumn("a", F.lit(0)), ["a"])
    middle = blended(limits(sketches, ["l"]), coarse, ["ratio"])
    fine = blended(limits(sketches, ["l", "s"]), middle, ["l", "ratio"])
    bands = fine.groupBy("l", "s").agg(F.map_from_entries(F.collect_list(F.struct("ratio", F.struct("low", "high")))).alias("bands"))  # four entries a group
    rows = found.join(bands, ["l", "s"], "left")
    band = F.col("bands")
    inside = F.lit(True)
    for name, (e, _) in RATIOS.items():
        inside &= F.expr(e).between(band[name]["low"], band[name]["high"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       F.when(failed, False).otherwise(F.coalesce(inside, F.lit(True))).alias("kept"))
