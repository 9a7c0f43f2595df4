"""Reading and writing tables: CSV with null marks, split Parquet, JSON reports, folder checks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.hashing import row_text
from tabforge.operators.profile import check_columns

# Texts read as missing.
NULL_MARKS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).exists(_path(spark, path))


def is_complete(spark: SparkSession, path: str) -> bool:
    """True once the write of ``path`` has finished."""
    return exists(spark, f"{path}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below ``path``, none when it does not exist."""
    if not exists(spark, path):
        return []
    return sorted(
        s.getPath().toString() for s in _file_system(spark, path).listStatus(_path(spark, path)) if s.isDirectory()
    )


def remove(spark: SparkSession, path: str) -> bool:
    return _file_system(spark, path).delete(_path(spark, path), True)


def require(spark: SparkSession, path: str, what: str = "Path") -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{what} not found: {path}")
    return path


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Numeric CSV with a header. Columns are checked by name; null marks become NULL.

    Every column is read as text and cast, since Spark's reader knows one null mark only. Any other text that is no
    number fails the job and is named; ``csv_rejects`` lists such texts. ``key`` adds an identifier made from
    the row's values.
    """
    raw = _csv_texts(spark, path, columns)
    numbers = []
    for c in columns:
        number = F.col(c).try_cast("double")
        refusal = F.raise_error(F.concat(F.lit(f"{c} holds no number: "), F.col(c))).cast("double")
        numbers.append(F.when(F.col(c).isNotNull() & number.isNull(), refusal).otherwise(number).alias(c))
    clean = raw.select(*numbers)
    return clean.withColumn(key, F.md5(row_text(clean))) if key else clean


def _csv_texts(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The columns of a CSV as trimmed texts, null marks as NULL."""
    require(spark, path, "Dataset")
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST")
    check_columns(raw.columns, columns)
    trimmed = {c: F.trim(F.col(f"`{c}`")) for c in columns}
    return raw.select(*[F.when(~text.isin(list(NULL_MARKS)), text).alias(c) for c, text in trimmed.items()])


def csv_rejects(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Every text of the columns that is neither a number nor a null mark, with the row it stands in."""
    raw = _csv_texts(spark, path, columns)
    bad = [
        F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("text")))
        for c in columns
    ]
    row = F.to_json(F.struct(*columns)).alias("row")
    return raw.select(row, F.inline(F.array_compact(F.array(*bad))))


def write_split(df: DataFrame, path: str) -> None:
    """Key, features and target of both sides, one folder per side."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, side: str | None = None) -> DataFrame:
    """Both sides or one of them; Spark reads only the folder of that side."""
    rows = spark.read.parquet(require(spark, path, "Processed data"))
    return rows if side is None else rows.where(F.col("split") == side).drop("split")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(spark: SparkSession, body: dict, path: str) -> None:
    """One JSON document as a text folder; parents are made and numbers of any kind written."""
    text = json.dumps(body, default=_plain)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(require(spark, path)).first()["value"])


def _plain(value):
    for convert in ("tolist", "isoformat"):
        if hasattr(value, convert):
            return getattr(value, convert)()
    return str(value)
