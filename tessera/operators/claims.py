"""Claims of fragments: who says what of which subject, with polarity and confidence; a resumable backfill into a stored table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import plain_tokens

# Markers of polarity, in the order in which they are tried.
POSITIVE = [
    "사용한다", "사용함", "사용", "선호한다", "선호함", "선호", "설정한다", "설정함", "설정", "채택한다", "채택", "활성화한다", "활성화", "적용한다", "적용", "지원한다", "지원", "포함한다", "포함", "필수", "권장",
    "use", "uses", "prefer", "prefers", "enable", "enabled", "apply", "applies", "support", "supports", "adopt", "adopts", "required", "recommended",
]
NEGATIVE = [
    "사용하지않", "사용하지 않", "쓰지않", "쓰지 않", "금지", "제외", "비활성화", "비활성", "미지원", "지원하지 않", "제거", "삭제", "사용 안", "사용안", "허용하지 않", "허용하지않", "없다", "없음", "않음", "않는다",
    "않습니다", "하지 않", "하지않", "되지 않", "되지않", "권장되지", "권장하지", "do not use", "don't use", "does not use", "disable", "disabled", "deprecated", "reject", "rejected", "forbid", "forbidden", "remove",
    "removed", "never use", "not supported", "unsupported", "not recommended",
]
UNCERTAIN = [
    "아마", "아마도", "추정", "추정된다", "가능성", "불확실", "일 수도 있", "로 보임", "로 보인다", "일 것으로 보", "maybe", "possibly", "likely", "perhaps", "might", "could be", "seems", "appears to",
]
#: Polarity, its markers and its confidence, the first that has a marker in the text decides.
POLARITIES = (("uncertain", UNCERTAIN, 0.5), ("negative", NEGATIVE, 0.75), ("positive", POSITIVE, 0.7))
#: Characters that don't count when a marker is looked for a second time.
LOOSE = r"[\s·,.!?'\"`~@#$%^&*()_+=|\\\-/<>{}\[\]]"
RULES = "v1"


def compact(marker: str) -> str:
    return re.sub(LOOSE, "", marker)


def marker_of(markers: list[str], low: Column, tight: Column) -> Column:
    """The first marker in the text, blanks and signs in it or not; null without one. Later markers aren't looked for."""
    return F.coalesce(*(F.when(F.contains(low, F.lit(m)) | F.contains(tight, F.lit(compact(m))), F.lit(m)) for m in markers))


def extract(fragments: DataFrame, tokens=plain_tokens) -> DataFrame:
    """(id, key_id, subject, predicate, object, polarity, confidence, extractor, rule_version): one claim of every fragment whose text isn't blank.

    The subject is the topic, else the first token; the predicate is the marker that decided, else the first token that is one, else ``mentions``; the
    object is the last token that isn't the subject, if there are two tokens or more. ``tokens`` makes the tokens of a column.
    """
    f = fragments.where(F.col("content").rlike(r"\S")).select("id", "key_id", F.nullif(F.trim("topic"), F.lit("")).alias("topic"), F.lower("content").alias("low"), tokens(F.col("content")).alias("tokens"))
    f = f.withColumn("tight", F.regexp_replace("low", LOOSE, ""))
    for name, markers, _ in POLARITIES:
        f = f.withColumn(name, marker_of(markers, F.col("low"), F.col("tight")))
    named = F.get(F.filter("tokens", lambda t: t.isin(*POSITIVE, *NEGATIVE)), F.lit(0))
    subject = F.coalesce("topic", F.get("tokens", F.lit(0)), F.lit("unknown"))
    f = f.select("id", "key_id", subject.alias("subject"), "tokens", named.alias("named"), *(p[0] for p in POLARITIES))
    rest = F.filter("tokens", lambda t: t != F.col("subject"))
    decided = [F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("polarity"), F.lit(c).alias("confidence"))) for name, _, c in POLARITIES]
    return f.select(
        "id", "key_id", "subject",
        F.coalesce(*(p[0] for p in POLARITIES), "named", F.lit("mentions")).alias("predicate"),
        F.when(F.size("tokens") > 1, F.get(rest, F.size(rest) - 1)).alias("object"),
        F.coalesce(*decided, F.struct(F.lit("uncertain").alias("polarity"), F.lit(0.4).alias("confidence"))).alias("found"),
    ).select("id", "key_id", "subject", "predicate", "object", "found.*", F.lit("morpheme-rule").alias("extractor"), F.lit(RULES).alias("rule_version"))


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all finished batches of a claims table, or None; a batch that was cut off has no _SUCCESS and doesn't count."""
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return None
    found = [s.getPath().toString() for s in fs.listStatus(where)]
    done = [one for one in found if fs.exists(_folder(spark, f"{one}/_SUCCESS")[0])]
    return spark.read.parquet(*done) if done else None


def backfill(fragments: DataFrame, path: str, batch: int = 50_000, least: float = 0.5, batches: int | None = None) -> dict[str, int]:
    """Extract claims of all active fragments into a table, in batches by id descending within every tenant; a second call goes on where the first ended.

    The place of each tenant is the least id that its finished batches have looked at, so a lost batch is made again and a finished one never is. Claims under ``least`` are looked
    at and not kept (their row says so). Returns counts of this call: batches, examined, kept.
    """
    spark = fragments.sparkSession
    active = fragments.where("valid_to_h is null and content is not null")
    made = {"batches": 0, "examined": 0, "kept": 0}
    while batches is None or made["batches"] < batches:
        before = stored(spark, path)
        todo = active
        if before is not None:
            places = before.groupBy("key_id").agg(F.min("id").alias("place")).withColumnRenamed("key_id", "of_key")
            todo = active.join(places, F.col("key_id").eqNullSafe(F.col("of_key")), "left").where(F.col("place").isNull() | (F.col("id") < F.col("place"))).drop("of_key", "place")
        page = todo.withColumn("rn", F.row_number().over(Window.partitionBy("key_id").orderBy(F.desc("id")))).where(F.col("rn") <= batch).drop("rn")
        found = extract(page).select("*", (F.col("confidence") >= least).alias("kept"))
        # a blank text has no claim, but its row was looked at
        looked = page.select("id", "key_id").join(found.drop("key_id"), "id", "left")
        one = f"{path}/batch-{uuid.uuid4().hex}"
        looked.write.parquet(one)
        examined, kept = (int(x or 0) for x in spark.read.schema(looked.schema).parquet(one).agg(F.count("*"), F.count_if("kept")).first())
        if not examined:
            where, fs = _folder(spark, one)
            fs.delete(where, True)
            break
        made = {"batches": made["batches"] + 1, "examined": made["examined"] + examined, "kept": made["kept"] + kept}
    return made


def claims_of(spark: SparkSession, path: str) -> DataFrame | None:
    """The claims of a backfilled table."""
    found = stored(spark, path)
    return None if found is None else found.where("kept").drop("kept")
