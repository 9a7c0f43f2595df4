"""Derived tables the query catalogue works on, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.hashing import hash_below, uniform
from tabforge.functions.scalars import half_away
from tabforge.session import spread
from tabforge.spec import FeatureSpec

FRAME = FeatureSpec(
    key="row_key",
    features=("l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "is_open"),
    categorical=("is_open",),
    target="y",
)

PARTS = FeatureSpec(key="p_partkey", features=("p_size", "p_price", "p_code"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row_key() -> Column:
    return F.concat_ws(
        "|",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("int"),
        half_away(F.col("l_extendedprice") * 100, 0).cast("bigint"),
    )


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem with its part: a key, six features and a target that depends on them."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    lines = spread(table(spark, sf_dir, "lineitem"))
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    keyed = joined.select(
        _row_key().alias("row_key"),
        "l_orderkey",
        "l_quantity",
        "l_discount",
        "l_tax",
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
        (F.col("l_linestatus") == "O").cast("double").alias("is_open"),
    )
    noise = 4 * (uniform(F.col("row_key"), ":noise") - F.lit(0.5))
    return keyed.withColumn(
        "y",
        20 + 0.4 * F.col("l_quantity") - 120 * F.col("l_discount") + 0.1 * F.col("p_size") + noise,
    )


FRAME_CTE = """keyed AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   cast(l_quantity AS int), cast(round(l_extendedprice * 100) AS bigint)) AS row_key,
         l_orderkey, l_quantity, l_discount, l_tax, p_size::double AS p_size, p_retailprice,
         (l_linestatus = 'O')::int::double AS is_open
  FROM lineitem JOIN part ON l_partkey = p_partkey),
frame AS (
  SELECT *, 20 + 0.4 * l_quantity - 120 * l_discount + 0.1 * p_size
            + 4 * ({noise} - 0.5) AS y
  FROM keyed)"""


def u_sql(key: str, tag: str = "") -> str:
    return f"(('0x' || substr(md5(concat({key}, '{tag}')), 1, 8))::bigint / 4294967296.0::double)"


def rank_sql(key: str, tag: str = "") -> str:
    return f"('0x' || substr(md5(concat({key}, '{tag}')), 1, 15))::bigint"


FRAME_CTE = FRAME_CTE.format(noise=u_sql("row_key", ":noise"))


def frame_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with each feature NULL in one row out of twenty."""
    return frame(spark, sf_dir).withColumns(
        {
            f: F.when(~hash_below(F.col("row_key"), f":null:{f}", 0.05), F.col(f))
            for f in FRAME.features
        }
    )


NULLS_CTE = FRAME_CTE + """,
frame_nulls AS (SELECT row_key, l_orderkey, y, {cols} FROM frame)""".format(
    cols=", ".join(
        f"CASE WHEN {u_sql('row_key', f':null:{f}')} >= 0.05 THEN {f} END AS {f}"
        for f in FRAME.features
    )
)


def with_nan(df: DataFrame, key: str, features) -> DataFrame:
    """The same values written otherwise: half of the gaps as NaN, half of the zeros as -0.0."""

    def otherwise(f: str) -> Column:
        half = hash_below(F.col(key).cast("string"), f":nan:{f}", 0.5)
        return F.when(half & F.col(f).isNull(), float("nan")).when(half & (F.col(f) == 0), -0.0).otherwise(F.col(f))

    return df.withColumns({f: otherwise(f) for f in features})


def part_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with three whole-number features, two of them with gaps."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")

    def gap(name: str, value: Column) -> Column:
        return F.when(~hash_below(key, f":null:{name}", 0.05), value).alias(name)

    return part.select(
        "p_partkey",
        gap("p_size", F.col("p_size").cast("double")),
        gap("p_price", F.floor("p_retailprice").cast("double")),
        (key % 100).cast("double").alias("p_code"),
    )


PARTS_CTE = f"""part_nulls AS (
  SELECT p_partkey,
    CASE WHEN {u_sql('p_partkey', ':null:p_size')} >= 0.05 THEN p_size::double END AS p_size,
    CASE WHEN {u_sql('p_partkey', ':null:p_price')} >= 0.05 THEN floor(p_retailprice)::double END AS p_price,
    (p_partkey % 100)::double AS p_code
  FROM part)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame with the prediction of a fixed formula."""
    return frame(spark, sf_dir).withColumn(
        "prediction", 20 + 0.4 * F.col("l_quantity") - 120 * F.col("l_discount")
    )


SCORED_CTE = FRAME_CTE + """,
scored AS (SELECT *, 20 + 0.4 * l_quantity - 120 * l_discount AS prediction FROM frame)"""


def split_sql(source: str, name: str = "parted", seed: int = 42, test_size: float = 0.2) -> str:
    """CTE that adds the exact-size train/test split to ``source``."""
    rank = rank_sql("row_key", f":split:{seed}")
    return f"""{name} AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY {rank}) <= ceil(count(*) OVER () * {test_size}::double)
                 THEN 'test' ELSE 'train' END AS split
  FROM {source})"""
