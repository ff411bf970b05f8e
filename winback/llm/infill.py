"""Fill-in-middle transformation by displacement scatter.

Two cuts split a text into prefix, middle and suffix; the output holds them in another order behind marks. Where the bytes of a slice of texts go
is written as a difference array: at the first byte of each part stands the change of displacement against the part before it. Its running
sum is the displacement of every byte, one scatter moves all bytes of the slice, another writes the marks. Restoring finds the marks in the
output, writes the difference array of the restored text and gathers its bytes from the output.

Draws are the first four 8-digit groups of the hex SHA-256 of `seed:doc_id`; they, the form and the cuts are made by SQL functions. Cuts count code points.

Defined cases: a null text is empty; an empty text and a text that holds a mark are plain, which means the output is the text; a null doc_id
is written as nothing in the draw, so all such rows draw alike; repeated rows give repeated results; an empty table gives no rows; further
columns are ignored. A row whose marks don't fit its form isn't an output of this operator: restoring it is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.llm.common import give_back, only, row_of, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Length of a mark; all three are as long.
MARK = 3
#: Bytes and rows moved at once; a single longer text is moved alone.
MOVE_BYTES, MOVE_ROWS = 1 << 20, 4096
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")


def planned(docs: DataFrame, seed: int, plain_percent: int, spm_percent: int) -> DataFrame:
    """(doc_id, text, n, form, one, two): the form and the two cuts of each text, in code points."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("draw", 8 * k - 7, 8), 16, 10).cast("long")
    rows = only(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), draw.alias("draw"))
    marked: Column = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    rows = rows.withColumn("n", F.length("text").cast("long"))
    form = F.when((F.col("n") == 0) | marked | (number(3) % 100 >= 100 - plain_percent), "plain").when(number(4) % 100 < spm_percent, "spm").otherwise("psm")
    a, b = number(1) % (F.col("n") + 1), number(2) % (F.col("n") + 1)
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("one"), F.greatest(a, b).alias("two"))


def displaced(size: int, first: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Where each of `size` places goes: parts begin at `first` (ascending, empty ones included) and are moved by `shift`."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, first, np.diff(shift, prepend=0))
    return np.cumsum(step[:size]) + np.arange(size)


def scattered(raw: np.ndarray, at: np.ndarray, form: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the outputs of a slice of texts. one and two are the cuts in code points."""
    points = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    before = np.searchsorted(points[:-1], at[:-1])
    moved = form != PLAIN
    cut1, cut2 = np.where(moved, points[before + np.where(moved, one, 0)], at[1:]), np.where(moved, points[before + np.where(moved, two, 0)], at[1:])
    out = at + np.concatenate(([0], np.cumsum(3 * MARK * moved)))
    o, a, b, c = out[:-1], cut1 - at[:-1], cut2 - cut1, at[1:] - cut2
    spm = form == SPM
    to_prefix = o + np.where(spm, 2 * MARK + c, MARK) * moved
    to_suffix = o + np.where(spm, MARK, 2 * MARK + a) * moved
    to_middle = o + 3 * MARK + a + c
    to_middle, to_suffix = np.where(moved, to_middle, o + a), np.where(moved, to_suffix, o + a + b)
    first = np.stack([at[:-1], cut1, cut2], 1)
    shift = np.stack([to_prefix, to_middle, to_suffix], 1) - first
    result = np.zeros(len(raw) + 3 * MARK * np.count_nonzero(moved), np.uint8)
    result[displaced(len(raw), first.ravel(), shift.ravel())] = raw
    for place, mark in ((to_prefix, PREFIX), (to_suffix, SUFFIX), (to_middle, MIDDLE)):
        result[place[moved][:, None] - MARK + np.arange(MARK)] = np.frombuffer(mark.encode(), np.uint8)
    return result, out


def gathered(raw: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts that a slice of outputs was made of."""
    moved = form != PLAIN
    hit = np.zeros(0, np.int64)
    if len(raw) >= MARK:
        inner = np.isin(raw[1:-1], np.frombuffer(b"PSM", np.uint8))
        hit = np.flatnonzero((raw[:-2] == ord("<")) & inner & (raw[2:] == ord(">")))
    row = row_of(at, hit)
    hit, row = hit[own := moved[row] & (hit + MARK <= at[row + 1])], row[own]
    if not np.array_equal(row, np.repeat(np.flatnonzero(moved), 3)):
        raise ValueError("an output must hold each of its marks once")
    marks = np.zeros((len(form), 3), np.int64)
    marks[moved] = hit.reshape(-1, 3)
    m1, m2, m3 = marks.T
    ends = np.stack([m2, m3], 1)
    spm = form == SPM
    # source parts: what stands behind the prefix's, the suffix's and the middle's mark
    prefix, prefix_end = np.where(spm, m2, m1) + MARK, np.where(spm, ends[:, 1], ends[:, 0])
    suffix, suffix_end = np.where(spm, m1, m2) + MARK, np.where(spm, ends[:, 0], ends[:, 1])
    middle, middle_end = m3 + MARK, at[1:]
    prefix, prefix_end = np.where(moved, prefix, at[:-1]), np.where(moved, prefix_end, at[1:])
    middle, middle_end = np.where(moved, middle, at[1:]), np.where(moved, middle_end, at[1:])
    suffix, suffix_end = np.where(moved, suffix, at[1:]), np.where(moved, suffix_end, at[1:])
    back = at - np.concatenate(([0], np.cumsum(3 * MARK * moved)))
    to_middle = back[:-1] + prefix_end - prefix
    first = np.stack([back[:-1], to_middle, to_middle + middle_end - middle], 1)
    shift = np.stack([prefix, middle, suffix], 1) - first
    return raw[displaced(int(back[-1]), first.ravel(), shift.ravel())], back


def strings(raw: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def _codes(column: pa.Array) -> np.ndarray:
    return np.array([FORMS.index(x) for x in column.to_pylist()], np.int8)


def transformed(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(1))
            form, one, two = _codes(b.column(3)), b.column(4).to_numpy(), b.column(5).to_numpy()
            for lo, hi in slices(at, MOVE_BYTES, MOVE_ROWS):
                out, to = scattered(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo], form[lo:hi], one[lo:hi], two[lo:hi])
                plain = form[lo:hi] == PLAIN
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo), pa.array(one[lo:hi], mask=plain),
                                                  pa.array((two - one)[lo:hi], mask=plain), strings(out, to)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            give_back()

    return planned(docs, seed, plain_percent, spm_percent).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame) -> DataFrame:
    """Adds the column `restored`, the text made from output and form alone."""
    names = outputs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = text_bytes(b.column(names.index("output")))
            form = _codes(b.column(names.index("form")))
            for lo, hi in slices(at, MOVE_BYTES, MOVE_ROWS):
                text, to = gathered(raw[at[lo]: at[hi]], at[lo: hi + 1] - at[lo], form[lo:hi])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, strings(text, to)], names=[*names, "restored"])
            give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in outputs.schema)
    return outputs.mapInArrow(run, f"{schema}, restored string")
