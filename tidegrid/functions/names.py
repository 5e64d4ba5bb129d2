"""File names, identifiers, labels and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the accepted file names, eight digits with an optional task.
NAME = r"^(\d{8})(?:_([A-Za-z]+))?\.txt$"
NO_TASK = "unspecified"


def parse_name(name: Column) -> dict[str, Column]:
    """subject_id and task of a valid file name; null for others."""
    valid = name.rlike(NAME)
    task = F.regexp_extract(name, NAME, 2)
    return {"subject_id": F.when(valid, F.regexp_extract(name, NAME, 1)), "task": F.when(valid, F.when(task == "", NO_TASK).otherwise(F.lower(task)))}


def quarantine(name: Column) -> Column:
    return F.when(F.coalesce(name.rlike(NAME), F.lit(False)), "valid").otherwise("quarantined")


def canonical_id(value: Column) -> Column:
    """Trimmed, without a trailing '.0', filled with zeros to eight characters and never cut."""
    bare = F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")
    return F.when(F.length(bare) < 8, F.lpad(bare, 8, "0")).otherwise(bare)


def group_label(value: Column) -> Column:
    """1 for labels that begin with MDD, 0 for HC, else null."""
    upper = F.upper(F.trim(value))
    return F.when(upper.startswith("MDD"), 1).when(upper.startswith("HC"), 0)


def sex_from_text(value: Column) -> Column:
    """1.0 for texts from M, 0.0 for texts from F, and for the single letters H and W."""
    upper = F.upper(F.trim(value))
    return F.when(upper.startswith("M") | (upper == "H"), 1.0).when(upper.startswith("F") | (upper == "W"), 0.0)


def parse_sex(df: DataFrame, column: str, out: str = "sex") -> DataFrame:
    """Text first; remaining numbers by what values the whole column has: 1/2 as male/female, 0/1 as they are.

    The coding is a one-row aggregate over the table, joined back to every row.
    """
    text = sex_from_text(F.col(column))
    code = F.when(text.isNull(), F.col(column).try_cast("double"))
    coding = df.agg(F.bool_and(code.isin(1.0, 2.0)).alias("__one_two"), F.bool_and(code.isin(0.0, 1.0)).alias("__zero_one"))
    coded = F.when(F.col("__one_two"), F.lit(2.0) - code).when(F.col("__zero_one"), code)
    return df.join(F.broadcast(coding)).withColumn(out, F.coalesce(text, coded)).drop("__one_two", "__zero_one")


def unwrap(value: Column, bits: int = 32) -> Column:
    """Values above half the unsigned range as the negative numbers that they stand for."""
    return F.when(value > 2 ** (bits - 1), value - 2**bits).otherwise(value)


def is_wrapped(value: Column, bits: int = 32) -> Column:
    return value > 2 ** (bits - 1)


def sex_report(df: DataFrame, column: str) -> DataFrame:
    """One row: how many values were read as text, as numbers or not at all, and the coding of the numbers."""
    parsed = parse_sex(df, column, "__sex")
    text = sex_from_text(F.col(column))
    code = F.when(text.isNull(), F.col(column).try_cast("double"))
    coding = F.when(F.bool_and(code.isin(1.0, 2.0)), "1=male,2=female").when(F.bool_and(code.isin(0.0, 1.0)), "0/1").otherwise("none")
    return parsed.agg(F.count(F.lit(1)).alias("n"), F.count(text).alias("n_text"), F.count_if(text.isNull() & F.col("__sex").isNotNull()).alias("n_numeric"), F.count_if(F.col("__sex").isNull()).alias("n_unresolved"), coding.alias("coding"))
