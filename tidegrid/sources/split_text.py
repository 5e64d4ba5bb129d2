"""Text recordings of any size, read in splits.

Spark cuts large text files into splits, so that many tasks read one file. A line's number is the number of lines before its split, a running sum of
one count for each split of the file, plus its place in the split. Every line is checked by itself, and its samples have their place in the
recording; a file with a broken line is an error with the line's number, and none of its samples are returned.

Defined results: blank lines are no samples but have numbers; an empty file is an error; of several broken lines of a file the first
is named. Compressed files can't be cut, and are read whole by one task each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegrid.config import Acquisition
from tidegrid.functions.expr import finite
from tidegrid.functions.names import parse_name, quarantine
from tidegrid.sources.shared import written


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def numbered_lines(spark: SparkSession, folder: str, glob: str = "*.txt", name: Callable[[Column], Column] = file_name) -> DataFrame:
    """(source_name, line from 1, value) of every line of the files below a folder, written."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    meta = F.col("_metadata")
    # inside a split the numbers rise with the lines, whatever other splits the task reads; they are written with the lines
    own = written(read.select(name(meta["file_path"]).alias("source_name"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value"), "lines")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = own.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n")).select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    placed = own.withColumn("inside", inside).join(splits, ["path", "block"])
    return written(placed.select("source_name", (F.col("before") + F.col("inside")).alias("line"), "value"), "numbered-lines")


def checked(lines: DataFrame, width: int) -> DataFrame:
    """(source_name, line, x, error) of the lines that aren't blank: the values, or what is wrong with the line."""
    parts = F.filter(F.split("value", r"\s+"), lambda p: p != "")
    own = lines.select("source_name", "line", parts.alias("p")).filter(F.size("p") > 0).withColumn("x", F.transform("p", lambda v: v.try_cast("double")))
    whole = lambda v: F.abs(v - F.rint(v)) <= 1e-8 + 1e-5 * F.abs(F.rint(v))
    error = F.when(F.size("p") != width, F.lit(f"expected {width} columns")).when(F.exists("x", lambda v: v.isNull()), F.lit("a value that is no number"))
    error = error.when(F.exists("x", lambda v: ~finite(v)), F.lit("a value that is not finite")).when(F.exists("x", lambda v: ~whole(v)), F.lit("a value that is not an integer"))
    return own.select("source_name", "line", "x", error.alias("error"))


def read_split(spark: SparkSession, folder: str, cfg: Acquisition, glob: str = "*.txt", name: Callable[[Column], Column] = file_name, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """(samples, reports) of the recordings below a folder.

    samples(source_name, i from 0, x): one row for each sample, x by channel, wrapped values put right. reports(source_name, n_samples,
    duration_s, n_wraparound_fixed, dc_offset, error): one row for each file. With ``named``, names must be those of recordings of an
    expected task.
    """
    width = len(cfg.channels)
    lines = written(checked(numbered_lines(spark, folder, glob, name), width), "checked-lines")
    # scans skip empty files; the listing that every read makes has them
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).inputFiles()
    files = spark.createDataFrame([(p,) for p in listed], "path string").select(name(F.col("path")).alias("source_name")).distinct()
    top = 2.0 ** (cfg.container_bits - 1)
    wrapped = F.transform("x", lambda v: F.when(v > top, v - 2.0**cfg.container_bits).otherwise(v))
    good = lines.select("source_name", "line", "error", wrapped.alias("x"), F.size(F.filter("x", lambda v: v > top)).alias("fixed"))
    first = F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error")))
    facts = good.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.sum("fixed").alias("fixed"), F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(width))).alias("dc"), first.alias("first"))
    every = files.join(facts, "source_name", "left")
    long_ = F.col("n") / cfg.fs > cfg.max_seconds
    error = F.when(F.col("n").isNull(), F.lit("no samples")).when(F.col("first").isNotNull(), F.concat(F.lit("line "), F.col("first.line").cast("string"), F.lit(": "), F.col("first.error"))).when(long_, F.lit("recording is too long"))
    if named:
        parsed = parse_name(F.col("source_name"))
        accepted = quarantine(F.col("source_name")) == "valid"
        error = F.when(~accepted, F.lit("name not accepted")).when(~parsed["task"].isin(*cfg.tasks), F.concat(F.lit("task "), parsed["task"], F.lit(" is not expected"))).otherwise(error)
    reports = every.withColumn("error", error)
    fine = F.col("error").isNull()
    reports = reports.select("source_name", F.when(fine, F.col("n")).alias("n_samples"), F.when(fine, F.col("n") / cfg.fs).alias("duration_s"), F.when(fine, F.col("fixed")).alias("n_wraparound_fixed"), F.when(fine, F.col("dc")).alias("dc_offset"), "error")
    reports = written(reports, "reports")
    # a sample's place counts the samples before it: blank lines have line numbers, but no places
    place = _places(good)
    samples = place.join(reports.filter("error is null").select("source_name"), "source_name", "left_semi")
    return samples, reports


def _places(good: DataFrame, span: int = 65_536) -> DataFrame:
    """(source_name, i, x): samples numbered in the order of their lines, by running sums over spans of lines."""
    spans = good.withColumn("span", F.floor(F.col("line") / span))
    before = Window.partitionBy("source_name").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = spans.groupBy("source_name", "span").agg(F.count(F.lit(1)).alias("n")).select("source_name", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("source_name", "span").orderBy("line"))
    return spans.withColumn("inside", inside).join(counts, ["source_name", "span"]).select("source_name", (F.col("before") + F.col("inside") - 1).alias("i"), "x")
