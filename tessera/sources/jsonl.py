"""JSON-lines import and export, log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.scope import Scope

#: Required: content and topic; the rest has defaults.
SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("importance", T.DoubleType()),
        T.StructField("workspace", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def read(spark: SparkSession, path: str, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of JSON lines: bad lines and lines without content or topic are rejected, known ids are skipped."""
    raw = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | F.col("content").isNull() | F.col("topic").isNull()
    # the corrupt-record column can't be the only one read: keep the parsed rows together
    raw = raw.withColumn("rejected", bad)
    good = raw.where(~F.col("rejected")).drop("_corrupt", "rejected")
    good = good.withColumns(
        {
            "id": F.coalesce("id", F.sha2(F.concat_ws("\x1f", "topic", "content"), 256)),
            "type": F.coalesce("type", F.lit("fact")),
            "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
            "importance": F.coalesce("importance", F.lit(0.5)),
        }
    ).dropDuplicates(["id"])
    if existing is not None:
        good = good.join(existing.select("id"), "id", "left_anti")
    return good, raw.where("rejected").drop("rejected")


def write(fragments: DataFrame, path: str, scope: Scope | None = None, confirm_full: bool = False) -> None:
    """Export as JSON lines; an export without a scope has to be confirmed."""
    if scope is None and not confirm_full:
        raise ValueError("an export of all tenants needs confirm_full=True")
    rows = fragments if scope is None else scope.apply(fragments)
    rows.write.mode("overwrite").json(path)


def logs(spark: SparkSession, path: str, level: str | None = None, contains: str | None = None) -> DataFrame:
    """(file, at, level, message) of text logs ``ts [level]: message``; lines without a head belong to the record before.

    Lines are numbered by the reader inside a file, so files are read whole: one row a file is split by the JVM.
    """
    head = r"^(\S+(?: \S+)?) \[(\w+)\]: ?(.*)$"
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line")).where("line != ''")
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_head", F.col("line").rlike(head)).withColumn("record", F.sum(F.col("is_head").cast("int")).over(w))
    records = lines.where("record > 0").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("text"))
    first = F.substring_index("text", "\n", 1)
    out = records.select("file", F.regexp_extract(first, head, 1).alias("at"), F.lower(F.regexp_extract(first, head, 2)).alias("level"), F.regexp_replace("text", r"^\S+(?: \S+)? \[\w+\]: ?", "").alias("message"))
    if level:
        out = out.where(F.col("level") == level.lower())
    return out.where(F.contains(F.col("message"), F.lit(contains))) if contains else out
