"""Readers and cleaning of raw draw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urnstat.functions import text
from urnstat.games import G5, G6, GameSpec
from urnstat.sources.records import read_records


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


RAW_G5 = _strings("draw_date", "results", "jackpot", "outcome")
RAW_G6 = _strings("year", "date", "series", "bonus")

DRAWS = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("draw_id", T.LongType()),
        T.StructField("draw_date", T.DateType()),
        T.StructField("balls", T.ArrayType(T.IntegerType())),
        T.StructField("bonus", T.IntegerType()),
        T.StructField("jackpot", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)


def _read(spark: SparkSession, path: str, schema: T.StructType, header: bool) -> DataFrame:
    """Quoted fields may span lines; files of any size are read by byte ranges."""
    shape = T.StructType([*schema.fields, *_strings("_extra", "_broken").fields])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    records = read_records(spark, path)
    records = records.where((F.col("record") != "") & ~(F.lit(header) & F.col("first")))
    parsed = records.select(F.from_csv("record", shape.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("_r"))
    return parsed.select("_r.*")


def read_raw_g5(spark: SparkSession, path: str) -> DataFrame:
    """Raw 5+1 records with a header row, cleaned."""
    df = _read(spark, path, RAW_G5, header=True)
    return clean_raw_g5(df.drop("_extra", "_broken"))


def read_raw_g6(spark: SparkSession, path: str) -> DataFrame:
    """Raw 6+1 records without a header row, cleaned; only rows of width 4 count."""
    df = _read(spark, path, RAW_G6, header=False)
    df = df.where(F.col("_extra").isNull() & F.col("bonus").isNotNull())
    return clean_raw_g6(df.drop("_extra", "_broken"))


def clean_raw_g5(raw: DataFrame) -> DataFrame:
    """Folded date, jackpot, outcome and six result tokens; other rows go.

    Columns the four raw ones do not cover pass through.
    """
    rest = [c for c in raw.columns if c not in RAW_G5.names]
    tokens = F.split(text.fold(F.col("results")), " ")
    return raw.withColumn("tokens", tokens).where(F.size("tokens") == G5.slots + 1).select(
        *rest,
        text.fold(F.col("draw_date")).alias("draw_date_raw"),
        "tokens",
        F.trim("jackpot").alias("jackpot"),
        F.trim("outcome").alias("outcome"),
    )


def clean_raw_g6(raw: DataFrame) -> DataFrame:
    """Year, date, six series tokens plus the bonus token; other rows go."""
    rest = [c for c in raw.columns if c not in RAW_G6.names]
    tokens = F.transform(F.split(F.trim(F.col("series")), r"\r?\n|,"), lambda t: F.trim(t))
    return raw.withColumn("tokens", tokens).where(F.size("tokens") == G6.slots).select(
        *rest,
        F.trim("year").alias("year"),
        F.trim("date").alias("date"),
        F.concat(F.col("tokens"), F.array(F.trim("bonus"))).alias("tokens"),
    )


def parse_balls(clean: DataFrame, spec: GameSpec = G5) -> DataFrame:
    """Tokens → ``balls`` and ``bonus``; rows with a token that is no integer go."""
    numbers = F.transform("tokens", text.to_number)
    return (
        clean.withColumn("_n", numbers)
        .where((F.size("_n") == spec.slots + 1) & F.forall("_n", lambda n: n.isNotNull()))
        .withColumn("balls", F.slice("_n", 1, spec.slots))
        .withColumn("bonus", F.get("_n", F.lit(spec.slots)))
        .drop("_n", "tokens")
    )


def with_draw_date(df: DataFrame) -> DataFrame:
    """Date of the spoken form; rows whose date does not parse keep a null."""
    return df.withColumn("draw_date", text.parse_draw_date(F.col("draw_date_raw")))


def with_day(df: DataFrame) -> DataFrame:
    """Date of separate date and year texts, and the weekday name."""
    dated = df.withColumn("draw_date", text.parse_day_and_year(F.col("date"), F.col("year")))
    return dated.withColumn("day", F.date_format("draw_date", "EEEE"))


def to_draws(parsed: DataFrame, series: str) -> DataFrame:
    """Parsed raw records as history rows of ``series``.

    Raw records carry no id, so it is a hash of date text and numbers: the same
    record gets the same id in every load, and order inside a day is fixed.
    """
    blank = F.lit(None).cast("string")
    df = parsed if "draw_date" in parsed.columns else with_draw_date(parsed)
    texts = [c for c in ("draw_date_raw", "year", "date") if c in df.columns]
    return df.select(
        F.lit(series).alias("series"),
        F.xxhash64(*texts, "balls", "bonus").alias("draw_id"),
        "draw_date",
        "balls",
        "bonus",
        *[F.col(c) if c in df.columns else blank.alias(c) for c in ("jackpot", "outcome")],
    )
