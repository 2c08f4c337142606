"""Checks and filters on raw events."""

from pyspark.sql import functions as F

from cartlens.functions.expressions import parsed_time
from cartlens.functions.ordered import exact_quantiles
from cartlens.functions.rules import not_null
from cartlens.schema import REQUIRED_COLUMNS


def require_columns(df, columns=REQUIRED_COLUMNS):
    """Raise before any job runs when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the events lack {', '.join(missing)}")
    return df


def drop_null_rows(df):
    """Rows without a null; a NaN counts as missing too."""
    complete = not_null(df)
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            complete = complete & ~F.isnan(field.name)
    return df.where(complete)


def drop_duplicate_rows(df, key="row_id"):
    """One of each set of rows that are equal in all columns but ``key``: the smallest key stays."""
    if key not in df.columns:
        return df.dropDuplicates()
    raw = [c for c in df.columns if c != key]
    return df.groupBy(*raw).agg(F.min(key).alias(key)).select(*df.columns)


def clean(df):
    """Complete, distinct rows; an ``event_time`` given as text is parsed first."""
    return drop_duplicate_rows(drop_null_rows(with_parsed_time(require_columns(df))))


def with_parsed_time(df, column="event_time"):
    """``column`` as a timestamp; text that is no timestamp becomes null."""
    if df.schema[column].dataType.typeName() != "string":
        return df
    return df.withColumn(column, parsed_time(column))


def iqr_fences(df, column, reach=1.5):
    """One row: the quartiles and the fences ``reach`` interquartile ranges outside them."""
    quartiles = exact_quantiles(df, [column], [0.25, 0.75])
    spread = F.col("q1") - F.col("q0")
    return quartiles.select(
        F.col("q0").alias("lower_quartile"),
        F.col("q1").alias("upper_quartile"),
        (F.col("q0") - reach * spread).alias("lower_fence"),
        (F.col("q1") + reach * spread).alias("upper_fence"),
    )


def outliers_iqr(df, column, reach=1.5):
    """Rows outside the fences."""
    fences = iqr_fences(df, column, reach).select(F.struct("lower_fence", "upper_fence")).scalar()
    below = F.col(column) < fences.getField("lower_fence")
    return df.where(below | (F.col(column) > fences.getField("upper_fence")))
