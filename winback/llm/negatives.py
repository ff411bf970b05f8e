"""Hard-negative mining over Hilbert-curve-ordered Parquet blocks with zone maps.

Components become whole numbers. Rows are ordered by dimension, label and their place on a Hilbert curve through the components that vary most, and
written as Parquet blocks; each block has the least and greatest value of every component and of the label, its zone. For an anchor, interval
arithmetic over a zone bounds all scores in the block from both sides. A search has windows of scores for each anchor: a block is
read for a group of anchors only if the bounds of one of its anchors meet one of that anchor's windows, and inside a task a block is skipped as well once
the scores kept so far are out of its reach. The first search looks for the best rows of the anchor's own label, from the score that its own block already
guarantees; the second looks for rows of other labels in the window that each positive opens. Scores are exact integers.

Anchors are gathered in tiles along the same order. A cell is a tile and a run of neighbouring blocks; cells are spread over all tasks, blocks pass through
one at a time, and a cell leaves the best few of each anchor in one row. Cells of a tile are merged one after the other. So a label, a copy group
or a dimension that holds most rows is only more blocks. On vectors without any clusters bounds exclude nothing and every block is read.

Defined cases: rows with a null vec_id, label or vector, or with any null or non-finite component take no part; an empty vector scores 0 with empty ones; vectors of
different dimension don't meet; repeated rows count one by one, as anchors and as candidates; a component beyond +-65536 counts as that; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winback.llm.common import cut, give_back, sorted_groups

#: Rows of a block and anchors of a tile at most, and bytes of their components.
BLOCK, TILE, MATRIX_BYTES = 512, 1024, 1 << 20
#: Neighbouring blocks of a cell, a power of two below 2^20.
RUN = 32
#: Zones compared with a tile at once.
ZONES = 1024
#: Components that order the rows, and bits of each on the curve.
AXES, BITS = 8, 7
SCALE, LIMIT = 256, 1 << 24
#: Scores compared at once.
STRIP = 1 << 18
NONE, FAR = -(1 << 62), 1 << 62
BLOCK_FIELDS = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("first_label", pa.int64()), ("last_label", pa.int64()), ("low", pa.binary()), ("high", pa.binary()),
                          ("ids", pa.binary()), ("labels", pa.binary()), ("parts", pa.binary()), ("anchor", pa.binary())])
#: floors and ceilings: the windows of each anchor; tag_ids and tag_scores: what each window belongs to.
TILE_FIELDS = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("windows", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("parts", pa.binary()),
                         ("floors", pa.binary()), ("ceilings", pa.binary()), ("tag_ids", pa.binary()), ("tag_scores", pa.binary())])
FOUND_FIELDS = pa.schema([*TILE_FIELDS, ("best_ids", pa.binary()), ("best_scores", pa.binary())])


def sql(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def longs(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(shape) if shape else np.frombuffer(raw, "<i8")


def row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def raw(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<i8").tobytes()


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def portions(batches: Iterator[pa.RecordBatch], key: str, most: Callable[[int], int]) -> Iterator[pa.Table]:
    """At most so many successive rows of one key at a time."""
    held: list[pa.RecordBatch] = []
    n, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            last = int(keys[a])
            while a < b:
                take = min(b - a, most(last) - n)
                held.append(batch.slice(a, take))
                n, a = n + take, a + take
                if n == most(last):
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def most_rows(dim: int, rows: int) -> int:
    return max(1, min(rows, MATRIX_BYTES // max(1, 4 * dim)))


# ---------------------------------------------------------------- order and blocks

def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve through k axes of 2^bits steps, of an n x k matrix; k * bits stays below 64. Cubes are turned from the top bit down, then read in Gray code."""
    axes = [c.astype(np.int64) for c in x.T]
    if not axes:
        return np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for c in range(len(axes)):
            upper = (axes[c] >> bit & 1).astype(bool)
            swap = np.where(upper, 0, (axes[0] ^ axes[c]) & below)
            axes[0] = axes[0] ^ np.where(upper, below, swap)
            if c:
                axes[c] = axes[c] ^ swap
    for c in range(1, len(axes)):
        axes[c] = axes[c] ^ axes[c - 1]
    flip = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> bit & 1, (1 << bit) - 1, 0)
    place = np.zeros(len(x), np.int64)
    for bit in range(bits - 1, -1, -1):
        for a in axes:
            place = place << 1 | ((a ^ flip) >> bit & 1)
    return place


def usable(vectors: DataFrame, anchors: Column) -> DataFrame:
    """(id, label, dim, anchor, parts) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = F.transform("vec", lambda x: F.floor(F.greatest(F.least(x * float(SCALE), F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int"))
    return rows.select("id", "label", F.size("vec").alias("dim"), "anchor", whole.alias("parts"))


def spreads(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, and mean and deviation of each component, by dimension: three numbers a component reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            dims = b.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                x = matrix(b.column(1).filter(pa.array(dims == d)), d).astype(float)
                old = sums.get(d, (0, 0.0, 0.0))
                sums[d] = [old[0] + len(x), old[1] + np.append(x.sum(0), 0), old[2] + np.append((x * x).sum(0), 0)]
        for d, (n, s, q) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d, np.int32)), pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(np.full(d + 1, n)), pa.array(s), pa.array(q)], names=["dim", "c", "n", "s", "q"])

    out: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for r in rows.select("dim", "parts").mapInArrow(run, "dim int, c int, n long, s double, q double").groupBy("dim", "c").agg(*[F.sum(x).alias(x) for x in "nsq"]).toLocalIterator():
        _, mean, deviation = out.setdefault(r["dim"], (r["n"], np.zeros(r["dim"]), np.zeros(r["dim"])))
        if r["c"] < r["dim"]:
            mean[r["c"]] = r["s"] / r["n"]
            deviation[r["c"]] = np.sqrt(max(0.0, r["q"] / r["n"] - mean[r["c"]] ** 2))
    return out


def blocks(rows: DataFrame) -> DataFrame:
    spread = spreads(rows)
    axes = {d: np.argsort(-deviation, kind="stable")[:AXES] for d, (_, _, deviation) in spread.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, at = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                here = dims == d
                x = matrix(b.column(4).filter(pa.array(here)), d)[:, axes[d]]
                scaled = (x - spread[d][1][axes[d]]) / np.maximum(spread[d][2][axes[d]], 1e-9)
                at[here] = hilbert(np.clip((scaled + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["id", "label", "dim", "anchor", "parts", "place"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for t in portions(batches, "dim", lambda d: most_rows(d, BLOCK)):
            d = t["dim"][0].as_py()
            parts, labels = matrix(t["parts"], d), t["label"].to_numpy()
            yield row(BLOCK_FIELDS, number, d, int(labels[0]), int(labels[-1]), raw(parts.min(0)), raw(parts.max(0)), raw(t["id"].to_numpy()), raw(labels),
                      parts.astype("<i4").tobytes(), t["anchor"].to_numpy().astype(np.uint8).tobytes())
            number += 1

    files = max(1, sum(-(-n // (64 * most_rows(d, BLOCK))) for d, (n, _, _) in spread.items()))
    order = ["dim", "label", "place", "id"]
    placed = rows.select("id", "label", "dim", "anchor", "parts").mapInArrow(place, "id long, label long, dim int, anchor boolean, parts array<int>, place long")
    return placed.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(build, sql(BLOCK_FIELDS))


# ---------------------------------------------------------------- scores and bounds

def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers; in floating point where every sum fits its mantissa."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that each anchor can have with anything in each zone."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


class Tile:
    def __init__(self, r: dict) -> None:
        self.row = r
        self.ids, self.labels = longs(r["ids"]), longs(r["labels"])
        n = len(self.ids)
        self.parts = np.frombuffer(r["parts"], "<i4").astype(np.int64).reshape(n, r["dim"])
        self.floors, self.ceilings = longs(r["floors"], n, r["windows"]), longs(r["ceilings"], n, r["windows"])

    def wants(self, floors: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray, same: bool) -> np.ndarray:
        """Which anchors (rows) must read which zones (columns)."""
        least, greatest = bounds(self.parts, low, high)
        mine = self.labels[:, None]
        fits = (first <= mine) & (mine <= last) if same else (first != mine) | (last != mine)
        meets = np.zeros(fits.shape, bool)
        for w in range(self.row["windows"]):
            floor, ceiling = floors[:, w, None], self.ceilings[:, w, None]
            meets |= (greatest >= floor) & (least <= ceiling) & (floor <= ceiling)
        return fits & meets


def kept(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row, by score from the top and id."""
    order = np.lexsort((ids, -scores), axis=-1)[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


class Best:
    """The best k (score, id) of each anchor and window."""

    def __init__(self, anchors: int, windows: int, k: int) -> None:
        self.k = k
        self.scores, self.ids = np.full((anchors, windows, k), NONE, np.int64), np.full((anchors, windows, k), np.iinfo(np.int64).max, np.int64)

    def take(self, window: int, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Scores of the anchors `at` with a block's rows; ok marks those in the window."""
        if scores.shape[1] > self.k:
            least = -np.partition(np.where(ok, -scores, -NONE), self.k - 1, axis=1)[:, self.k - 1]
            ok = ok & (scores >= least[:, None])
        i, j = np.nonzero(ok)
        if not len(i):
            return
        hit, i = np.unique(i, return_inverse=True)
        whose = np.concatenate((i, np.repeat(np.arange(len(hit)), self.k)))
        all_scores = np.concatenate((scores[hit[i], j], self.scores[at[hit], window].ravel()))
        all_ids = np.concatenate((ids[j], self.ids[at[hit], window].ravel()))
        order = np.lexsort((all_ids, -all_scores, whose))
        begins = np.searchsorted(whose[order], np.arange(len(hit)))
        first = order[begins[:, None] + np.arange(self.k)]
        self.scores[at[hit], window], self.ids[at[hit], window] = all_scores[first], all_ids[first]

    def merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores, self.ids = kept(np.concatenate((self.scores, scores), -1), np.concatenate((self.ids, ids), -1), self.k)


def read(tile: Tile, block: dict, best: Best, same: bool) -> None:
    """Compares the anchors that still want the block with its rows."""
    floors = np.maximum(tile.floors, best.scores[..., -1])
    low, high = longs(block["low"])[None], longs(block["high"])[None]
    at = np.flatnonzero(tile.wants(floors, low, high, np.array([block["first_label"]]), np.array([block["last_label"]]), same)[:, 0])
    ids, labels = longs(block["ids"]), longs(block["labels"])
    parts = np.frombuffer(block["parts"], "<i4").astype(np.int64).reshape(len(ids), block["dim"])
    for lo in range(0, len(at), max(1, STRIP // len(ids))):
        some = at[lo: lo + max(1, STRIP // len(ids))]
        scores = products(tile.parts[some], parts)
        label = (tile.labels[some][:, None] == labels) == same
        for w in range(tile.row["windows"]):
            best.take(w, some, scores, ids, label & (scores >= floors[some, w][:, None]) & (scores <= tile.ceilings[some, w][:, None]))


# ---------------------------------------------------------------- searches

def tiles(stored: DataFrame, k: int) -> DataFrame:
    """Anchors in tiles, each with one window: from the score that k rows of its own label in its own block reach."""
    fields = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("label", pa.int64()), ("id", pa.int64()), ("floor", pa.int64()), ("parts", pa.list_(pa.int64()))])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids, labels, at = longs(b["ids"]), longs(b["labels"]), np.flatnonzero(np.frombuffer(b["anchor"], np.uint8))
                parts = np.frombuffer(b["parts"], "<i4").astype(np.int64).reshape(len(ids), b["dim"])
                scores = np.where(labels[at][:, None] == labels, products(parts[at], parts), NONE)
                floor = np.sort(scores, 1)[:, -k] if len(ids) >= k else np.full(len(at), NONE)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * b["dim"], pa.int32()), pa.array(parts[at].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), b["block"])), pa.array(np.full(len(at), b["dim"], np.int32)), pa.array(labels[at]), pa.array(ids[at]), pa.array(floor), flat], schema=fields)

    anchors = cut(stored.mapInArrow(seed, "block long, dim int, label long, id long, floor long, parts array<long>"), "negatives-anchors")
    counts = {r["dim"]: r["n"] for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator()}
    files = max(1, sum(-(-n // most_rows(d, TILE)) for d, n in counts.items()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for t in portions(batches, "dim", lambda d: most_rows(d, TILE)):
            d, n = t["dim"][0].as_py(), t.num_rows
            yield row(TILE_FIELDS, number, d, 1, raw(t["id"].to_numpy()), raw(t["label"].to_numpy()), matrix(t["parts"], d).astype("<i4").tobytes(),
                      raw(t["floor"].to_numpy()), raw(np.full(n, FAR)), b"", b"")
            number += 1

    order = ["dim", "label", "block", "id", "floor", "parts"]
    return anchors.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(build, sql(TILE_FIELDS))


def zones(stored: DataFrame) -> tuple[DataFrame, int]:
    """(group, dim, blocks, first, last, low, high): the zones of many blocks in a row, and the number of groups."""
    fields = pa.schema([("group", pa.int32()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("blocks", "first", "last", "low", "high")]])
    groups = -(-stored.count() // ZONES) or 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "group", lambda g: ZONES):
            for d in sorted(set(part["dim"].to_pylist())):
                t = part.filter(pa.compute.equal(part["dim"], d))
                yield row(fields, t["group"][0].as_py(), d, *[raw(t[c].to_numpy()) for c in ("block", "first_label", "last_label")], *[b"".join(t[c].to_pylist()) for c in ("low", "high")])

    spread = stored.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), "dim", "block", "first_label", "last_label", "low", "high")
    return spread.repartition("group").sortWithinPartitions("group").mapInArrow(pack, "`group` int, dim int, blocks binary, first binary, last binary, low binary, high binary"), groups


def chosen(anchors: DataFrame, stored: DataFrame, same: bool) -> DataFrame:
    """(tile, block, wanted): blocks that some anchors of a tile must read."""
    fields = pa.schema([("tile", pa.int64()), ("block", pa.int64()), ("wanted", pa.int64())])
    packed, groups = zones(stored)
    # each zone group meets each tile: the query set against all zones, group by group
    asked = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = asked.join(packed.select("group", "dim", *[F.col(c).alias(f"zone_{c}") for c in ("blocks", "first", "last", "low", "high")]), ["group", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tile, numbers = Tile(r), longs(r["zone_blocks"])
                shape = len(numbers), r["dim"]
                wanted = tile.wants(tile.floors, longs(r["zone_low"], *shape), longs(r["zone_high"], *shape), longs(r["zone_first"]), longs(r["zone_last"]), same).sum(0)
                hit = np.flatnonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r["tile"])), pa.array(numbers[hit]), pa.array(wanted[hit].astype(np.int64))], schema=fields)

    return both.mapInArrow(run, sql(fields))


def searched(anchors: DataFrame, stored: DataFrame, same: bool, k: int) -> DataFrame:
    """Tiles with the best k rows of each window, among rows of the anchor's own label or of all others."""
    picks = cut(chosen(anchors, stored, same).withColumn("cell", F.concat_ws("-", "tile", F.shiftright("block", RUN.bit_length() - 1))), "negatives-blocks")
    nothing = lambda schema, names: [F.lit(None).cast(sql(pa.schema([f])).split()[-1]).alias(f.name) for f in schema if f.name in names]
    block_names, tile_names = BLOCK_FIELDS.names, TILE_FIELDS.names
    only_block, only_tile = [c for c in block_names if c not in tile_names and c != "anchor"], [c for c in tile_names if c not in block_names]
    shared = [c for c in block_names if c in tile_names]
    columns = ["cell", "side", *only_block, *only_tile, *shared]
    heads = picks.select("cell", "tile").distinct().join(anchors, "tile").select("*", F.lit(0).alias("side"), *nothing(BLOCK_FIELDS, only_block))
    bodies = picks.select("cell", "block").join(stored.drop("anchor"), "block").select("*", F.lit(1).alias("side"), *nothing(TILE_FIELDS, only_tile))
    partial = pa.schema([("tile", pa.int64()), ("best_ids", pa.binary()), ("best_scores", pa.binary())])

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, "cell"):
            head, *body = sorted(g.to_pylist(), key=lambda r: r["side"])
            tile = Tile(head)
            best = Best(len(tile.ids), head["windows"], k)
            reach = [bounds(tile.parts, longs(b["low"])[None], longs(b["high"])[None])[1].max() for b in body]
            for i in np.argsort(-np.array(reach), kind="stable"):
                read(tile, body[i], best, same)
            yield row(partial, head["tile"], raw(best.ids), raw(best.scores))
            give_back()

    found = heads.select(columns).union(bodies.select(columns)).repartition("cell").sortWithinPartitions("cell", "side", "block").mapInArrow(cell, sql(partial))
    merged = [*tile_names, "best_ids", "best_scores"]
    first = anchors.select(*tile_names, *[F.lit(None).cast("binary").alias(c) for c in merged[-2:]])
    rest = found.select("tile", *nothing(TILE_FIELDS, tile_names[1:]), "best_ids", "best_scores")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):  # one state is held, however many cells a tile has
                r = batch.slice(i, 1).to_pylist()[0]
                if r["ids"] is not None:
                    if head:
                        yield row(FOUND_FIELDS, *[head[c] for c in tile_names], raw(best.ids), raw(best.scores))
                    head, best = r, Best(len(longs(r["ids"])), r["windows"], k)
                else:
                    best.merge(longs(r["best_scores"], *best.scores.shape), longs(r["best_ids"], *best.ids.shape))
        if head:
            yield row(FOUND_FIELDS, *[head[c] for c in tile_names], raw(best.ids), raw(best.scores))

    return first.union(rest).repartition("tile").sortWithinPartitions("tile", F.col("ids").isNull()).mapInArrow(merge, sql(FOUND_FIELDS))


def percent(scores: np.ndarray, share: int, up: bool) -> np.ndarray:
    """share percent of each score, rounded up or down, without leaving 64 bits."""
    whole, rest = np.divmod(scores, 100)
    return whole * share + (-(-rest * share // 100) if up else rest * share // 100)


def opened(found: DataFrame, positives: int, low: int, high: int) -> DataFrame:
    """Tiles with a window for each positive: the anchor itself is taken out once, and the first `positives` others open one each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tile = Tile(r)
                n, k = len(tile.ids), positives + 1
                ids, scores = longs(r["best_ids"], n, k), longs(r["best_scores"], n, k)
                own = (ids == tile.ids[:, None]) & (scores == (tile.parts * tile.parts).sum(1)[:, None])
                out = np.where(own.any(1), own.argmax(1), positives)
                rest = np.arange(positives) + (np.arange(positives) >= out[:, None])
                ids, scores = np.take_along_axis(ids, rest, 1), np.take_along_axis(scores, rest, 1)
                real = scores > NONE
                safe = np.where(real, scores, 0)
                yield row(TILE_FIELDS, r["tile"], r["dim"], positives, r["ids"], r["labels"], r["parts"], raw(np.where(real, percent(safe, low, True), FAR)),
                          raw(np.where(real, percent(safe, high, False), NONE)), raw(ids), raw(scores))

    return found.mapInArrow(run, sql(TILE_FIELDS))


def mined(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first `positives` rows of the same label, the first
    `negatives` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. anchors is a condition on the columns of vectors."""
    stored = cut(blocks(usable(vectors, anchors)), "negatives-rows")
    first = cut(tiles(stored, positives + 1), "negatives-tiles")
    second = cut(opened(searched(first, stored, True, positives + 1), positives, low, high), "negatives-windows")
    fields = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()), ("positive_score", pa.int64()), ("negative_score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = longs(r["ids"])
                shape = len(ids), positives, negatives
                scores, names, tags, tag_scores = longs(r["best_scores"], *shape), longs(r["best_ids"], *shape), longs(r["tag_ids"], *shape[:2]), longs(r["tag_scores"], *shape[:2])
                a, p, n = np.nonzero(scores > NONE)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[a], tags[a, p], n + 1, names[a, p, n], tag_scores[a, p], scores[a, p, n]), fields)], schema=fields)

    return searched(second, stored, False, negatives).mapInArrow(run, sql(fields))
