"""The subjects' sheet: one row per subject with group label and covariates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.names import canonical_id, group_label, parse_sex

KEPT = ("subject_id", "label", "label_raw", "age", "sex", "education_years", "id_prefix")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """CSV (all columns as text) or Parquet. Spreadsheets have no Spark reader and must be exported first."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path)
    raise ValueError("metadata must be .csv or .parquet")


@dataclass(frozen=True)
class Rule:
    """How one canonical column is found in a sheet and read."""

    out: str
    names: tuple[str, ...] = ()
    beginning: tuple[str, ...] = ()
    required: bool = False
    read: Callable[[Column], Column] = lambda c: c

    def matches(self, name: str) -> bool:
        return name in self.names or name.startswith(self.beginning or ("\0",))


# The accepted column names.
RULES = (
    Rule("subject_id", ("id", "participant_id"), ("subject",), True, canonical_id),
    Rule("label_raw", ("type", "group", "class", "diagnosis", "diagnostic_group"), (), True, lambda c: F.trim(c.cast("string"))),
    Rule("age", ("age",), (), False, lambda c: c.try_cast("double")),
    Rule("sex_raw", (), ("gender", "sex"), False, lambda c: c.cast("string")),
    Rule("education_years", (), ("education",), False, lambda c: c.try_cast("double")),
)


def plain_name(column: str) -> str:
    return column.strip().lower().replace(" ", "_")


def chosen_columns(columns: Sequence[str]) -> dict[str, str]:
    """Canonical name -> column of the sheet; ValueError lists all that is missing or doubled."""
    named = {c: plain_name(c) for c in columns}
    found = {rule: [c for c, name in named.items() if rule.matches(name)] for rule in RULES}
    wrong = [f"{rule.out}: {len(of)} columns {of}" for rule, of in found.items() if len(of) > 1 or (rule.required and not of)]
    if wrong:
        raise ValueError("one column is expected for each of " + "; ".join(wrong))
    return {rule.out: of[0] for rule, of in found.items() if of}


def normalise(sheet: DataFrame) -> DataFrame:
    """The sheet under canonical names: id, label from the group's prefix, numeric covariates, sex and the id's first four characters.

    One select reads the columns, and one aggregate gathers everything that the contract forbids.
    """
    chosen = chosen_columns(sheet.columns)
    read = {rule.out: rule.read for rule in RULES}
    rows = sheet.select(*(read[out](F.col(f"`{c}`")).alias(out) for out, c in chosen.items()))
    rows = rows.withColumns({"label": group_label(F.col("label_raw")), "id_prefix": F.substring("subject_id", 1, 4)})
    by_id = rows.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("unknown"))
    facts = by_id.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("unknown").alias("unknown")).first()
    said = {"the sheet is empty": not facts.rows, f"{facts.repeated} subject ids are repeated": facts.repeated, f"{facts.unknown} group labels are neither MDD nor HC": facts.unknown}
    if any(said.values()):
        raise ValueError("; ".join(text for text, wrong in said.items() if wrong))
    if "sex_raw" in chosen:
        rows = parse_sex(rows, "sex_raw")
    return rows.select(*(c for c in KEPT if c in rows.columns))
