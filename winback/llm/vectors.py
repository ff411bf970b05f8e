"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned into the basis of their principal components, largest first. They are cut into tiles along the
first component; two tiles meet only if the boxes round them in the leading components come near enough. Inside a pair of tiles,
products are summed over leading dimensions first; what the rest can still add is bounded by the product of the norms of the suffixes,
and a strip of pairs is left as soon as no cosine in it can reach the threshold. What survives is checked in double precision on the
vectors as given. The basis only decides how soon a pair is left, never whether it is found.

Equal vectors, known by a digest of 128 bits, are folded first and counted with their number; a vector itself is shuffled once, into its tile. Tiles are
written, a folder each, and pairs of tiles are shuffled as numbers: a cell of the grid of pairs holds a few tiles and reads the others one at a time, so
disk follows the table, not the pairs. A pair of tiles emits link counts and a spanning forest, never all links. Cells are spread over all tasks, whatever
group the vectors belong to.

Defined cases: vectors that are null, empty, of length zero or hold null or non-finite components link with nothing; vectors of different
dimension don't link; repeated rows link with each other; a row with a null vec_id counts as a link of the others, and has a null
component and kept false; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winback.llm.common import components, cut, forest, only, sorted_groups
from winback.sources.replay import opened
from winback.sources.staging import new_path

#: Vectors of a tile at most, and bytes of its matrix in single precision.
TILE = 4096
TILE_BYTES = 1 << 20
STRIP = 512
#: Leading components that bound a tile.
BOX = 8
#: Room for rounding in single precision; survivors are checked in double precision.
SLACK = 1e-4
#: Neighbouring parts on the two sides of a cell at most; a task holds the tiles of the first.
HOLD, RUN = 8, 64
#: Digests that a task remembers at once while it leaves out copies.
SEEN = 1 << 20
BLOCKS = "tile long, dim int, size int, low array<double>, high array<double>, nodes binary, counts binary, given binary"


def folded(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows with vec, vec_id and dim, those of them that can link). Unusable vectors are null."""
    rows = only(vectors, vec_id="vec_id", vec="embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<float>").alias("vec"))
    fine = F.coalesce((F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.select(F.when(fine, F.transform("vec", lambda x: x + F.lit(0.0).cast("float"))).alias("vec"), "vec_id").withColumn("dim", F.when(F.col("vec").isNotNull(), F.size("vec")))
    return rows, rows.where("vec IS NOT NULL")


def digests(x: np.ndarray) -> list[bytes]:
    """128 bits of each row as given; equal vectors, and no others, share them."""
    return [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x.astype("<f4")]


def along(x: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The component of each row, scaled to length 1, along an axis, in whole numbers: the same for equal rows whatever rows are beside them."""
    q = np.rint(x / np.abs(x).max(1, keepdims=True) * (1 << 20)).astype(np.int64)
    return (q * np.rint(axis * (1 << 20)).astype(np.int64)).sum(1) / np.sqrt((q * q).sum(1).astype(float)) / (1 << 20)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def tile_rows(dim: int) -> int:
    return max(1, min(TILE, TILE_BYTES // (4 * dim)))


def by_dim(batch: pa.RecordBatch):
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """Principal components by dimension from second moments summed over all vectors: dim x dim numbers reach the driver."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, part in by_dim(b):
                x = unit(matrix(part.column(0)))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], names=["dim", "i", "j", "v"])

    out: dict[int, np.ndarray] = {}
    for r in classes.select("vec", "dim").mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        m = out.setdefault(r["dim"], np.zeros((r["dim"], r["dim"])))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["v"]
    return {d: np.linalg.eigh(m)[1][:, ::-1].astype(np.float64) for d, m in out.items()}


class Places:
    """Which part, neighbours along the first component, a vector lies in; `rows` has (vec_id, digest, part) of all rows, without their vectors."""

    def __init__(self, rows: DataFrame) -> None:
        self.basis = basis = bases(rows.where("vec IS NOT NULL"))

        def first(batches):
            for b in batches:
                there = b.column(0).is_valid()
                lost = b.filter(pc.invert(there))
                yield pa.RecordBatch.from_arrays([lost.column(1), pa.nulls(len(lost), pa.binary()), lost.column(2), pa.nulls(len(lost), pa.float64())], names=["vec_id", "digest", "dim", "c"])
                for d, part in by_dim(b.filter(there)):
                    x = matrix(part.column(0))
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(digests(x), pa.binary()), part.column(2), pa.array(along(x, basis[d][:, 0]))], names=["vec_id", "digest", "dim", "c"])

        placed = cut(rows.select("vec", "vec_id", "dim").mapInArrow(first, "vec_id long, digest binary, dim int, c double"), "vector-places")
        self.bounds: dict[int, np.ndarray] = {}
        self.tiles = 0
        for r in placed.where("dim IS NOT NULL").groupBy("dim").agg(F.count("*").alias("rows")).collect():
            d, parts = r["dim"], -(-r["rows"] // tile_rows(r["dim"]))
            probes = [k / parts for k in range(1, parts)]
            self.bounds[d] = np.array(placed.where(F.col("dim") == d).agg(F.percentile_approx("c", probes, max(10_000, 20 * parts))).first()[0] if probes else [])
            self.tiles += parts
        bounds = self.bounds

        def number(batches):
            for b in batches:
                dims, c = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
                part = np.zeros(len(dims), np.int64)
                for d in bounds:
                    part[dims == d] = np.searchsorted(bounds[d], c[dims == d]) + (d << 32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, mask=~b.column(2).is_valid().to_numpy(zero_copy_only=False))], names=["vec_id", "digest", "part"])

        self.rows = placed.mapInArrow(number, "vec_id long, digest binary, part long")

    def dealt(self, usable: DataFrame) -> DataFrame:
        """(part, dim, digest, vec): of equal vectors that follow in a task's input one."""
        basis, bounds = self.basis, self.bounds

        def run(batches):
            seen: set[bytes] = set()
            for b in batches:
                for d, part in by_dim(b):
                    x, fresh = matrix(part.column(0)), []
                    names = digests(x)
                    for k, name in enumerate(names):
                        if name not in seen:
                            seen.add(name)
                            fresh.append(k)
                    at = np.searchsorted(bounds[d], along(x[fresh], basis[d][:, 0])) + (d << 32) if fresh else np.zeros(0, np.int64)
                    part = part.take(pa.array(fresh, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), part.column(2), pa.array([names[k] for k in fresh], pa.binary()), part.column(0)], names=["part", "dim", "digest", "vec"])
                if len(seen) > SEEN:
                    seen.clear()

        return usable.select("vec", "vec_id", "dim").mapInArrow(run, "part long, dim int, digest binary, vec array<float>")


def classes(slim: DataFrame) -> DataFrame:
    """(part, digest, first, n, node) of distinct usable vectors. node is the smallest vec_id, first, where there is one, else a negative number from the digest."""
    counted = slim.where("digest IS NOT NULL").groupBy("part", "digest").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    return counted.withColumn("node", F.coalesce("first", F.lit(-1) - F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")))


def tiles(usable: DataFrame, places: Places | None = None, known: DataFrame | None = None) -> DataFrame:
    """(tile, dim, size, low, high, nodes, counts, given): blocks of at most TILE vectors and TILE_BYTES, neighbours along the first component."""
    places = places or Places(usable)
    known = classes(places.rows) if known is None else known
    basis = places.basis
    fields = [("tile", pa.int64()), ("dim", pa.int32()), ("size", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
              ("nodes", pa.binary()), ("counts", pa.binary()), ("given", pa.binary())]

    def build(batches):
        for g in sorted_groups(batches, "part"):
            named = g.filter(pc.is_valid(g["node"]))
            given = g.filter(pc.is_valid(g["vec"]))
            _, once = np.unique(np.array(given["digest"].to_pylist(), object), return_index=True)
            given = given.take(pa.array(once))  # in the order of digests, as the names are
            d = given["dim"][0].as_py()
            part, rows = g["part"][0].as_py(), tile_rows(d)
            for k, lo in enumerate(range(0, given.num_rows, rows)):
                x = matrix(given["vec"].slice(lo, rows).combine_chunks())
                head = (unit(x) @ basis[d])[:, :BOX]
                own = named.slice(lo, rows)
                values = [[(part << 16) + k], [d], [len(x)], [head.min(0).tolist()], [head.max(0).tolist()], [own["node"].to_numpy().astype("<i8").tobytes()],
                          [own["n"].to_numpy().astype("<i8").tobytes()], [x.astype("<f4").tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, (_, kind) in zip(values, fields)], schema=pa.schema(fields))

    # names and vectors of a part meet in one shuffle, in which each vector is moved once
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = known.select("part", nothing("int", "dim"), "digest", "node", "n", nothing("array<float>", "vec")).union(
        places.dealt(usable).select("part", "dim", "digest", nothing("long", "node"), nothing("long", "n"), "vec"))
    return (both.repartition("part").sortWithinPartitions("part", "digest")
            .mapInArrow(build, BLOCKS))


def near_tiles(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b) with a <= b: pairs of tiles whose boxes are no farther apart than linked vectors can be. They meet by slabs of the first component."""
    far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    box = blocks.select("tile", "dim", "low", "high")
    slab = lambda x: F.floor(x / far)
    one = box.select(*[F.col(c).alias(f"{c}_a") for c in box.columns], F.explode(F.sequence(slab(F.col("low")[0]), slab(F.col("high")[0]))).alias("slab"), F.col("dim").alias("dim"))
    two = box.select(*[F.col(c).alias(f"{c}_b") for c in box.columns], F.explode(F.sequence(slab(F.col("low")[0] - far), slab(F.col("high")[0] + far))).alias("slab"), F.col("dim").alias("dim"))
    away = lambda i: F.greatest(F.lit(0.0), F.get("low_a", F.lit(i)) - F.get("high_b", F.lit(i)), F.get("low_b", F.lit(i)) - F.get("high_a", F.lit(i)))
    apart = sum((away(i) * away(i) for i in range(1, BOX)), away(0) * away(0))
    return one.join(two, ["dim", "slab"]).where((F.col("tile_a") <= F.col("tile_b")) & (apart <= far * far)).select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b")).distinct()


class Tile:
    def __init__(self, row: dict, basis: np.ndarray) -> None:
        d = row["dim"]
        self.nodes, self.counts = np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["counts"], "<i8")
        self.exact = np.frombuffer(row["given"], "<f4").reshape(-1, d).astype(float)
        self.turned = (unit(self.exact) @ basis).astype(np.float32)
        edges = [e for e in (8, 16, 32) if e < d] + [d]
        self.stages = list(zip([0, *edges[:-1]], edges))
        squares = self.turned.astype(float) ** 2
        # norm of what follows each stage
        self.rest = [np.sqrt(squares[:, e:].sum(1)).astype(np.float32) for _, e in self.stages]
        self.norm = np.sqrt((self.exact * self.exact).sum(1))


class Shelf:
    """Written tiles, read by a task through Arrow's file systems as it needs them; it holds the last few."""

    def __init__(self, path: str, basis: dict[int, np.ndarray], most: int) -> None:
        self.path, self.basis, self.most = path, basis, most
        self.held: dict[int, Tile] = {}

    def __getitem__(self, tile: int) -> Tile:
        got = self.held.pop(tile, None)
        if got is None:
            while len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
            fs, base = opened(self.path)
            row = ds.dataset(f"{base}/tile={tile}", filesystem=fs, format="parquet").to_table(use_threads=False, columns=["dim", "nodes", "counts", "given"]).to_pylist()[0]
            got = Tile(row, self.basis[row["dim"]])
        self.held[tile] = got
        return got


def linked(a: Tile, b: Tile, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the rows of a and all of b with a cosine of the threshold or more."""
    part = np.zeros((len(a.nodes[rows]), len(b.nodes)), np.float32)
    for k, (x, y) in enumerate(a.stages):
        part += a.turned[rows, x:y] @ b.turned[:, x:y].T
        can = part >= np.float32(threshold - SLACK) - np.outer(a.rest[k][rows], b.rest[k])
        left = np.count_nonzero(can)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left < can.size // 16:
            break
    i, j = np.nonzero(can)
    keep = []
    for lo in range(0, len(i), 1 << 15):
        p, q = i[lo: lo + (1 << 15)] + rows.start, j[lo: lo + (1 << 15)]
        keep.append(np.einsum("ij,ij->i", a.exact[p], b.exact[q]) / (a.norm[p] * b.norm[q]) >= threshold)
    keep = np.concatenate(keep)
    return i[keep] + rows.start, j[keep]


def cells(n: int) -> tuple[int, int]:
    """Neighbouring parts on the two sides of a cell of the grid of pairs: few while there are few tiles, so that there are cells enough for all tasks."""
    return min(HOLD, 1 + n // 256), min(RUN, 1 + n // 32)


def compared(pairs: DataFrame, path: str, basis: dict[int, np.ndarray], n: int, threshold: float) -> DataFrame:
    """(a, b, n): n links of node a (b = a), or an edge of the spanning forest (n = 0). What is shuffled are the numbers of tiles; a cell reads the tiles themselves, one of its
    second side after the other, beside the few of its first."""
    hold, run_ = cells(n)
    number = lambda c, size: F.floor(F.shiftright(F.col(c), 16) / size).cast("long")
    grid = pairs.withColumn("cell", F.xxhash64(number("a", hold), number("b", run_)))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        shelf = Shelf(path, basis, hold + 2)
        for batch in batches:
            for first, second in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                a, b = shelf[first], shelf[second]
                own = first == second
                shift = 0 if own else len(a.nodes)
                nodes, counts = (a.nodes, a.counts) if own else (np.append(a.nodes, b.nodes), np.append(a.counts, b.counts))
                links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
                for lo in range(0, len(a.nodes), STRIP):
                    i, j = linked(a, b, slice(lo, min(lo + STRIP, len(a.nodes))), threshold)
                    if own:
                        i, j = i[i < j], j[i < j]
                    j = j + shift
                    if len(i):
                        links += np.bincount(i, counts[j], len(nodes)).astype(np.int64) + np.bincount(j, counts[i], len(nodes)).astype(np.int64)
                        label = forest(len(nodes), np.append(i, np.arange(len(nodes))), np.append(j, label))
                hit, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(nodes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(nodes[hit], nodes[moved])), pa.array(np.append(nodes[hit], nodes[label[moved]])),
                                                  pa.array(np.append(links[hit], np.zeros(len(moved), np.int64)))], schema=schema)

    # as many partitions as asked for: joined by their bytes, which are few, all pairs would be one task
    count = max(1, (n // hold + 1) * (n // run_ + 1) // 2)
    parts = min(count, max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // 4))
    return grid.select("cell", "a", "b").repartition(parts, "cell").sortWithinPartitions("cell", "b", "a").mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows, usable = folded(vectors)
    places = Places(rows)
    rows = cut(places.rows, "vector-rows")
    known = cut(classes(rows), "vector-classes")
    path = new_path(rows.sparkSession, "vector-tiles")
    tiles(usable, places, known).write.partitionBy("tile").parquet(path)  # a folder a tile
    blocks = rows.sparkSession.read.schema(BLOCKS).parquet(path)
    found = cut(compared(near_tiles(blocks, threshold), path, places.basis, places.tiles, threshold), "vector-links")
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    # a node made up for vectors without any id can't name a component: nodes are renamed by their component's smallest real id
    part = components(found.where("n = 0").select("a", "b"), "vector-components")
    joined = known.join(links, "node", "left").join(part, "node", "left").select(
        "digest", "first", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("part"))
    least = joined.groupBy("part").agg(F.min("first").alias("least"))
    named = joined.join(least, "part").select("digest", "links", "least")
    out = rows.join(named, "digest", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                                                    F.when(F.col("vec_id").isNotNull(), F.coalesce("least", "vec_id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
