"""Stage graph: order, reuse, and going on after a failure. Held-out uplift."""

import random

import pytest
from pyspark.sql import functions as F

from winback.operators import uplift
from winback.plans.jobs import Run, Stage


def graph(spark, calls, broken=(), revision=1, factor=2):
    def build(name, fn):
        def run(*tables):
            calls.append(name)
            if name in broken:
                raise RuntimeError(f"{name} is lost")
            return fn(*tables)
        return run
    return [
        Stage("both", build("both", lambda a, b: a.join(b, "id")), ("double", "base")),
        Stage("double", build("double", lambda a: a.select("id", (F.col("id") * factor).alias("x"))), ("base",), revision),
        Stage("base", build("base", lambda: spark.range(5))),
        Stage("alone", build("alone", lambda: spark.range(3))),
    ]


def test_a_broken_run_goes_on(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    folder, calls = str(tmp_path / "run"), []
    with pytest.raises(RuntimeError, match="double is lost"):
        Run(spark, folder, source, graph(spark, calls, broken=("double",))).go()
    assert calls == ["base", "double"]
    calls.clear()
    run = Run(spark, folder, source, graph(spark, calls))
    assert run.go() == {"base": "kept", "double": "built", "both": "built", "alone": "built"} and calls == ["double", "both", "alone"]
    assert {(r["stage"], r["n"]) for r in run.rows().collect()} == {("base", 5), ("double", 5), ("both", 5), ("alone", 3)}
    calls.clear()
    assert set(run.go().values()) == {"kept"} and calls == []
    assert [(r["job"], r["status"]) for r in run.log().orderBy("started_at").collect()] == [("base", "success"), ("double", "failed"), ("double", "success"), ("both", "success"), ("alone", "success")]


def test_a_change_rebuilds_what_hangs_on_it(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    folder = str(tmp_path / "run")
    Run(spark, folder, source, graph(spark, [])).go()
    newer = Run(spark, folder, source, graph(spark, [], revision=2, factor=3))
    assert newer.go() == {"base": "kept", "double": "built", "both": "built", "alone": "kept"}
    assert newer.table("both").agg(F.sum("x")).first()[0] == 30
    spark.range(4).write.mode("overwrite").parquet(source)
    assert set(Run(spark, folder, source, graph(spark, [])).go().values()) == {"built"}


def test_only_what_is_asked_for(spark, tmp_path):
    calls = []
    Run(spark, str(tmp_path / "run"), str(tmp_path / "source"), graph(spark, calls)).go(["double"])
    assert calls == ["base", "double"]


@pytest.mark.parametrize("stages, words", [([Stage("a", None, ("b",)), Stage("b", None, ("a",))], "need each other"), ([Stage("a", None, ("x",))], "no stage x"), ([Stage("a", None), Stage("a", None)], "one name")])
def test_bad_graphs(spark, tmp_path, stages, words):
    with pytest.raises(ValueError, match=words):
        Run(spark, str(tmp_path), str(tmp_path), stages)


@pytest.mark.parametrize("learner", ["t_learner", "dr_learner"])
def test_scores_do_not_see_their_own_outcomes(spark, learner):
    """Turning the outcomes of one fold round leaves that fold's scores as they were, for models of the arms; the last model of the
    doubly robust learner is fitted on the other folds too."""
    rng = random.Random(8)
    rows = [(i, rng.random(), "ab"[i % 2], float(i % 2), float(rng.random() < 0.3 + 0.4 * (i % 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "customer_id long, x double, persona string, treatment_flag double, retained double")
    mine = uplift.fold(2) == 0
    score = lambda d: {r["customer_id"]: r["predicted_uplift"] for r in uplift.cross_fitted(d, learner, ["x"], ["persona"], folds=2, trees=5).where(mine).collect()}
    before = score(df)
    after = score(df.withColumn("retained", F.when(mine, 1 - F.col("retained")).otherwise(F.col("retained"))))
    assert len(before) > 100 and before.keys() == after.keys()
    if learner == "t_learner":
        assert all(before[k] == pytest.approx(after[k]) for k in before)
    else:                                   # its own pseudo-outcomes change, those of the fold its last model is fitted on come from models of this fold
        assert all(-0.5 <= v <= 0.5 for v in [*before.values(), *after.values()])
