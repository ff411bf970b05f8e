"""The batch run as a graph of stages: each writes one table, and a run that broke off goes on where it stopped.

A stage's table lies in a folder named by a digest of the stage's own version, of its inputs' digests and of the source files, so a table is used again exactly as long
as nothing above it has changed. A finished table has Spark's success mark, which is written last; a table without it is written anew. Every attempt appends a row to the log.
"""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from winback import params
from winback.sources.catalog import exists
from winback.sources.staging import version

LOG_SCHEMA = "job string, started_at timestamp, finished_at timestamp, seconds double, status string, result_rows long, message string"


def logged(spark: SparkSession, path: str, job: str, step: Callable[[], int]) -> int | None:
    """Run a step; append start, finish, duration and result to the log whether it works or not."""
    start = dt.datetime.now(dt.timezone.utc)
    rows, status, message = None, "success", ""
    try:
        rows = step()
    except Exception as exc:
        status, message = "failed", str(exc)
        raise
    finally:
        end = dt.datetime.now(dt.timezone.utc)
        spark.createDataFrame([(job, start, end, (end - start).total_seconds(), status, rows, message)], LOG_SCHEMA).write.mode("append").parquet(path)
    return rows


@dataclass(frozen=True)
class Stage:
    """build gets the written tables of the inputs, in their order. revision changes when the stage's rules do."""
    name: str
    build: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ()
    revision: int = 1


class Run:
    """Stages over one source. Stages may be listed in any order; one whose input is missing or that needs itself is an error before anything runs."""

    def __init__(self, spark: SparkSession, folder: str, source: str, stages: list[Stage]) -> None:
        self.spark, self.folder, self.source = spark, folder.rstrip("/"), source
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("two stages have one name")
        self.order = self._ordered()
        #: of the source as it is now: one run sees one version
        self.digest = self._digests()

    def _ordered(self) -> list[str]:
        out, open_ = [], []

        def visit(name: str) -> None:
            if name in out:
                return
            if name not in self.stages:
                raise ValueError(f"no stage {name}")
            if name in open_:
                raise ValueError("stages need each other: " + " > ".join([*open_, name]))
            open_.append(name)
            for i in self.stages[name].inputs:
                visit(i)
            open_.pop()
            out.append(name)
        for name in self.stages:
            visit(name)
        return out

    def _digests(self) -> dict[str, str]:
        files = version(self.spark, self.source)
        out: dict[str, str] = {}
        for name in self.order:
            s = self.stages[name]
            out[name] = hashlib.sha1(f"{name} {s.revision} {files} {[out[i] for i in s.inputs]}".encode()).hexdigest()[:16]
        return out

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}/{self.digest[name]}"

    def finished(self, name: str) -> bool:
        return exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def go(self, only: list[str] | None = None) -> dict[str, str]:
        """Brings all stages (or some, with what they need) up to date. Each stage's outcome: kept or built; a failing one stops the run, and the next run goes on with it."""
        wanted = set(only or self.order)
        for name in reversed(self.order):
            if name in wanted:
                wanted |= set(self.stages[name].inputs)
        out = {}
        for name in [n for n in self.order if n in wanted]:
            if self.finished(name):
                out[name] = "kept"
                continue
            stage = self.stages[name]

            def step(stage: Stage = stage) -> int:
                stage.build(*[self.table(i) for i in stage.inputs]).write.mode("overwrite").parquet(self.path(stage.name))
                return self.table(stage.name).count()
            logged(self.spark, f"{self.folder}/log", name, step)
            out[name] = "built"
        return out

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.folder}/log")

    def rows(self) -> DataFrame:
        """(stage, n) of every finished stage."""
        return self.spark.createDataFrame([(n, self.table(n).count()) for n in self.order if self.finished(n)], "stage string, n long")


def batch_stages(spark: SparkSession, d: str) -> list[Stage]:
    """The batch run over the test tables: summary, fitted models, decisions with both plain and fitted scores, and reports."""
    from winback.operators import cohort, policy
    from winback.plans import decision, fitted
    from winback.plans.summary import customer_summary
    from winback.sources import adapters
    return [
        Stage("summary", lambda: customer_summary(spark, d)),
        Stage("segments", lambda summary: decision.segments(spark, d), ("summary",)),
        Stage("cohorts", lambda: cohort.retention(adapters.customers(spark, d), adapters.order_events(spark, d))),
        Stage("pool", lambda segments: decision.pool(spark, d), ("segments",)),
        Stage("uplift_model", lambda summary: fitted.uplift_scores(spark, d, summary), ("summary",)),
        Stage("survival_model", lambda summary: fitted.survival_scores(spark, d, summary), ("summary",)),
        Stage("dose_model", lambda summary: fitted.dose_scores(spark, d, summary), ("summary",)),
        Stage("fitted_actions", fitted.actions, ("summary", "uplift_model", "survival_model", "dose_model")),
        Stage("fitted_pool", lambda acts: policy.candidate_pool(acts, params.RISK_THRESHOLD), ("fitted_actions",)),
        Stage("fitted_selected", fitted.selected, ("fitted_pool",)),
    ]
