"""Encodings, flags and hand-over tables."""

import time

from pyspark.sql import functions as F

from winback.operators.ingest import flag
from winback.sources.catalog import read_text_table
from winback.sources.staging import staged


def test_late_cp949_row(spark, tmp_path):
    path = tmp_path / "late.csv"
    lines = ["id,name"] + [f"{i},plain" for i in range(3000)]
    lines[2500] = "2499,고객"
    path.write_bytes("\n".join(lines).encode("cp949"))
    got = read_text_table(spark, str(path), "id long, name string")
    assert got.count() == 3000 and got.where("id = 2499").first()["name"] == "고객"


def test_flag_reads_any_number(spark):
    texts = ["1e3", "0.0000001", "1234567890", "-1", "0", "yes", "no", "", None, " 2 ", "nan"]
    got = [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", flag(F.col("t"))).orderBy("i").collect()]
    assert got[:10] == [1, 1, 1, 0, 0, 1, 0, 0, 0, 1]


def test_changed_source_is_built_anew(spark, tmp_path):
    source = str(tmp_path / "src")
    build = lambda: spark.read.parquet(source)
    spark.range(3).write.parquet(source)
    assert staged(spark, source, "t", build).count() == 3
    time.sleep(0.01)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert staged(spark, source, "t", build).count() == 5
