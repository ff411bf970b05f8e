"""Replays a table of events as a stream: so many rows a tick, in order, from the start again at the end.

`prepare` writes the events once with their place in the order, in slots of a fixed number of rows. The reader's offset is the number of rows given out so
far, over all rounds; a tick's rows are read by executors, slot by slot. An offset is reserved in the source's own folder before the engine hears of it, so after a
restart the next one lies behind everything that was ever planned: the engine's checkpoint says where to begin, and nothing is repeated or lost. A micro-batch may take several whole
ticks (`ticks`), as one that catches up must; every row bears the number of its tick.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampNTZType, TimestampType

from winback.functions.ranking import ordered_totals

SLOT_ROWS = 50_000


def prepare(events: DataFrame, order: list[str], path: str, slot_rows: int = SLOT_ROWS) -> int:
    """Writes the events with `place` (from 0) to path and gives their number. order should end in a unique column."""
    placed = ordered_totals(events, [(c, False) for c in order], {"place": F.lit(1).cast("long")}).withColumn("place", F.col("place") - 1)
    placed = placed.withColumn("slot", F.floor(F.col("place") / slot_rows).cast("long"))
    placed.repartition("slot").sortWithinPartitions("place").write.partitionBy("slot").parquet(path)
    return events.sparkSession.read.parquet(path).count()


def backlog(total: int, rows: int, rounds: int, batches: int) -> int:
    """Whole ticks a micro-batch, so that a table that is all there is taken in at most so many micro-batches."""
    return max(1, -(-total * rounds // (rows * batches)))


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Places [first, until) of one slot in one round."""
    round: int
    slot: int
    first: int
    until: int


class EventReplay(DataSource):
    """Options: path, total, rows (a tick), ticks (a micro-batch, 1), rounds (0: without end), slot_rows, shift_us (added to the time column for each round), time, mark (a folder for the offset)."""

    @classmethod
    def name(cls) -> str:
        return "event_replay"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReplayReader(dict(self.options), schema)


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        names = schema.names
        #: files may hold times in nanoseconds, and without their zone
        self.times = {f.name: pa.timestamp("us", "UTC" if isinstance(f.dataType, TimestampType) else None) for f in schema if isinstance(f.dataType, (TimestampType, TimestampNTZType))}
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.mark, self.names, self.time = low["path"], low["mark"], names, low.get("time", "event_time")
        self.total, self.rows, self.rounds = int(low["total"]), int(low["rows"]), int(low.get("rounds", 1))
        self.slot_rows, self.shift = int(low.get("slot_rows", SLOT_ROWS)), int(low.get("shift_us", 0))
        self.ticks = int(low.get("ticks", 1))
        if self.rows < 1 or self.ticks < 1:
            raise ValueError("a tick has one row and a micro-batch one tick at least")

    def _reserved(self) -> int:
        fs, base = opened(self.mark)
        info = fs.get_file_info(f"{base}/offset.json")
        if info.type == pafs.FileType.NotFound:
            return 0
        with fs.open_input_stream(info.path) as f:
            return json.loads(f.read())["row"]

    def _reserve(self, row: int) -> None:
        fs, base = opened(self.mark)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/offset.json.new") as f:
            f.write(json.dumps({"row": row}).encode())
        fs.move(f"{base}/offset.json.new", f"{base}/offset.json")

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        at = self._reserved()
        end = at + self.rows * self.ticks if self.total else 0
        if self.rounds:
            end = min(end, self.total * self.rounds)
        if end > at:
            self._reserve(end)
        return {"row": end}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out, at = [], start["row"]
        while at < end["row"]:
            turn, place = divmod(at, self.total)
            slot = place // self.slot_rows
            until = min(place + end["row"] - at, (slot + 1) * self.slot_rows, self.total)
            out.append(Piece(turn, slot, place, until))
            at += until - place
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        fs, base = opened(self.path)
        here = (pc.field("place") >= partition.first) & (pc.field("place") < partition.until)
        for batch in ds.dataset(f"{base}/slot={partition.slot}", filesystem=fs, format="parquet").to_batches(filter=here, use_threads=False):
            columns = {n: batch.column(n) for n in batch.schema.names} | {"round": pa.array([partition.round] * batch.num_rows, pa.int32())}
            columns["tick"] = pc.divide(pc.add(columns["place"], pa.scalar(partition.round * self.total, pa.int64())), pa.scalar(self.rows, pa.int64()))
            for n, kind in self.times.items():
                columns[n] = columns[n].cast(kind)
            if self.shift and self.time in columns:
                columns[self.time] = pc.add(columns[self.time], pa.scalar(partition.round * self.shift, pa.duration("us")))
            yield pa.RecordBatch.from_arrays([columns[n] for n in self.names], names=self.names)

    def commit(self, end: dict) -> None:
        pass


def replay(spark: SparkSession, path: str, mark: str, rows: int, rounds: int = 1, total: int | None = None, **options) -> DataFrame:
    """The stream of a prepared table, with the columns of its rows, `place`, `round` and `tick`. mark is a folder of the stream's own, kept for as long as its checkpoint."""
    spark.dataSource.register(EventReplay)
    table = spark.read.parquet(path).drop("slot")
    total = table.count() if total is None else total
    reader = spark.readStream.format("event_replay").schema(StructType([*table.schema.fields, StructField("round", IntegerType()), StructField("tick", LongType())]))
    return reader.options(path=path, mark=mark, rows=rows, rounds=rounds, total=total, **options).load()
