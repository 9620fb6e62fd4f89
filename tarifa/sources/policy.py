"""Sources: delimited files, policy-year and renewal tables, and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import day_first, exposure_years, is_missing, number, term_end, zero_or_more

#: Coverages of the test analog, by line number.
COVERAGES = ("liability", "property_damage", "theft", "fire", "glass", "legal_protection", "occupants")


def delimited(spark: SparkSession, path: str, sep: str = ";", columns: list[str] | None = None) -> DataFrame:
    """A delimited file with a header, every column a string; ``columns`` prunes the scan.  A byte-order mark goes."""
    df = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip('"') for c in df.columns])
    return df.select(*columns) if columns else df


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A JSON document as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")
    return df


def valid_policy_years(df: DataFrame, years: tuple[int, ...]) -> DataFrame:
    """Rows of the given years with positive exposure and claims and incurred of 0 or more; numbers coerced."""
    names = [c for c in ("year", "total_exposure", "total_claims", "total_incurred", "total_premium") if c in df.columns]
    df = df.withColumns({c: number(c) for c in names})
    good = F.col("year").isin(*map(float, years)) & (F.col("total_exposure") > 0)
    return df.where(good & (F.col("total_claims") >= 0) & (F.col("total_incurred") >= 0)).withColumn("year", F.col("year").cast("int"))


def renewals(df: DataFrame, numeric: tuple[str, ...] = ()) -> DataFrame:
    """The renewal table with ``renewal_date``, ``renewal_year``, ``raw_exposure``, ``Exposure`` and clean claims and costs.

    Not yet filtered: ``valid_renewals`` drops rows without a year or positive exposure.
    """
    require_columns(df, "ID", "Date_last_renewal", "Date_next_renewal", "N_claims_year", "Cost_claims_year")
    lapse = day_first("Date_lapse") if "Date_lapse" in df.columns else None
    df = df.withColumn("renewal_date", day_first("Date_last_renewal"))
    end = term_end(day_first("Date_next_renewal"), lapse)
    return df.withColumns(
        {
            "renewal_year": F.year("renewal_date"),
            "Exposure": exposure_years("renewal_date", end),
            "N_claims_year": zero_or_more("N_claims_year"),
            "Cost_claims_year": zero_or_more("Cost_claims_year"),
            **{c: number(c) for c in numeric},
        }
    )


def valid_renewals(df: DataFrame) -> DataFrame:
    return df.where(F.col("renewal_year").isNotNull() & (F.col("Exposure") > 0))


def renewal_audit(df: DataFrame) -> DataFrame:
    """One row of counts over what ``renewals`` returns."""
    kept = F.count_if(F.col("renewal_year").isNotNull() & (F.col("Exposure") > 0))
    no_year = F.count_if(F.col("renewal_year").isNull())
    return df.agg(
        F.count("*").alias("source_rows"),
        kept.alias("valid_rows"),
        (F.count("*") - kept - no_year).alias("removed_nonpositive_or_missing_exposure"),
        no_year.alias("missing_renewal_year"),
        F.count_if(F.coalesce("Exposure", F.lit(0.0)) <= 0).alias("raw_nonpositive_exposure"),
    )


def date_range(df: DataFrame, date: str) -> DataFrame:
    """First and last date and the sorted distinct years of a date column, in one pass."""
    return df.agg(
        F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.array_sort(F.collect_set(F.year(date))).alias("years")
    )


def usable_years(df: DataFrame, year: str, least: int = 1000) -> DataFrame:
    """Years with at least ``least`` rows."""
    return df.groupBy(year).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)


def missing_audit(df: DataFrame) -> DataFrame:
    """(column, missing, rate) for every column of an all-string table, in one pass."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(is_missing(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return counts.select("rows", F.explode(cells).alias("x")).select(
        "x.column", "x.missing", F.when(F.col("rows") > 0, F.col("x.missing") / F.col("rows")).alias("rate")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) with null as the empty text."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, head, container) of files, by their first bytes."""
    files = spark.read.format("binaryFile").load(path)
    head = F.lower(F.hex(F.substring("content", 1, 32)))
    kind = F.when(head.startswith("504b"), "zip").when(head.startswith("d0cf11e0a1b11ae1"), "ole_compound_binary")
    return files.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), head.alias("head"),
        kind.otherwise("text_or_other").alias("container"),
    )


# ---------------------------------------------------------------- the analog over the test tables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def policy_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy-year table over ``lineitem`` and ``part`` with closed-form predictions.

    Columns that a query doesn't use are pruned from both scans.
    """
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    hit = F.col("l_returnflag") == "R"
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("insured_id"),
        F.year("l_shipdate").alias("year"),
        F.col("l_shipdate").alias("ship_ts"),
        (F.col("l_quantity") / 50).alias("total_exposure"),
        F.when(hit, 1.0 + F.col("l_linenumber") % 2).otherwise(0.0).alias("total_claims"),
        F.when(hit, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0).alias("total_incurred"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("total_premium"),
        F.col("l_linestatus").alias("business_type"),
        F.col("p_brand").alias("vehicle_brand"),
        F.col("p_type").alias("policy_type"),
        F.col("p_size").cast("double").alias("driver_age"),
        F.col("p_retailprice").alias("vehicle_value"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").alias("seats"),
        (0.3 + F.col("p_size") / 200).alias("glm_freq"),
        (0.3 + F.col("l_tax") * 2).alias("xgb_freq"),
        (500.0 + F.col("p_size") * 12).alias("glm_loss"),
        (500.0 + F.col("l_discount") * 9000).alias("xgb_loss"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax",
    )


#: A total order over the analog's rows.
ROW_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
