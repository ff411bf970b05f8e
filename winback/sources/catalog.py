"""Readers and writers of the named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winback.sources.schemas import SCHEMAS

ENCODINGS = ["utf-8", "cp949", "euc-kr", "latin-1"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV table, or an empty frame of its schema where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).csv(path, header=True)


def read_text_table(spark: SparkSession, path: str, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """CSV or TSV by the suffix of the name. Without a given encoding it is the first of the list that breaks no character of any row."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")     # cp949 and euc-kr are not in the default list
    sep = "\t" if path.rstrip("/").endswith((".tsv", ".tsv.gz")) else ","
    reader = spark.read.schema(schema) if schema else spark.read
    if encoding is None:
        for enc in ENCODINGS:
            whole = spark.read.option("encoding", enc).option("sep", sep).csv(path)
            broken = F.count_if(F.contains(F.concat_ws("|", *whole.columns), F.lit("\ufffd")))
            if whole.agg(broken).first()[0] == 0:
                encoding = enc
                break
    return reader.option("encoding", encoding or ENCODINGS[-1]).option("sep", sep).csv(path, header=True)


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first path of the list that is there and has rows."""
    for p in paths:
        if exists(spark, p):
            df = spark.read.parquet(p)
            if not df.isEmpty():
                return df
    return None


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object or list as a table."""
    return spark.read.json(path, multiLine=True)


class Catalog:
    """The canonical tables under one folder, as lazy readers and temporary views."""

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet"):
        self.spark, self.folder, self.fmt = spark, folder.rstrip("/"), fmt

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}" + (".csv" if self.fmt == "csv" else "")

    def read(self, name: str, columns: list[str] | None = None) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(f"unknown table {name}")
        if self.fmt == "csv":
            df = read_optional(self.spark, self.path(name), SCHEMAS[name])
        elif exists(self.spark, self.path(name)):
            df = self.spark.read.parquet(self.path(name))
        else:
            df = self.spark.createDataFrame([], SCHEMAS[name])
        return df.select(*columns) if columns else df

    def available(self) -> DataFrame:
        rows = [(n, exists(self.spark, self.path(n))) for n in SCHEMAS]
        return self.spark.createDataFrame(rows, "table_name string, present boolean")

    def register(self) -> None:
        for n in SCHEMAS:
            if exists(self.spark, self.path(n)):
                self.read(n).createOrReplaceTempView(n)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        w.option("header", True).csv(f"{folder}/{name}.csv") if fmt == "csv" else w.parquet(f"{folder}/{name}")


def write_preprocessed(tables: dict[str, DataFrame], metadata: dict, folder: str) -> None:
    """The tables and a one-row JSON table of metadata."""
    write_tables(tables, folder)
    spark = next(iter(tables.values())).sparkSession
    names = list(metadata)
    spark.createDataFrame([tuple(str(metadata[n]) for n in names)], ", ".join(f"{n} string" for n in names)).write.mode("overwrite").json(f"{folder}/metadata")


class FeatureStore:
    """Feature tables partitioned by their as-of day, with a metadata row per save."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, name: str, features: DataFrame, as_of: str) -> None:
        features.withColumn("as_of_date", F.lit(as_of).cast("date")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(f"{self.folder}/{name}")
        meta = self.spark.createDataFrame([(name, as_of, len(features.columns))], "dataset string, as_of string, feature_columns int")
        meta.write.mode("append").parquet(f"{self.folder}/_metadata_{name}")

    def load(self, name: str, as_of: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}")
        return df.where(F.col("as_of_date") == F.lit(as_of).cast("date")) if as_of else df

    def metadata(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/_metadata_{name}")
