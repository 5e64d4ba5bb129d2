"""Rows that every document operator must stand: nulls, empty and long texts, ties, repeats, clashing columns."""

ODD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 12, "en", "src0", 0),
    (2, "The quick brown fox jumps over the lazy dog. " * 12, "en", "src0", 0),
    (2, "The quick brown fox jumps over the lazy dog. " * 12, "en", "src0", 0),
    (3, None, None, None, None),
    (4, "", "de", "", 0),
    (5, " \n\t ", "de", "src1", 4),
    (6, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich\n" * 30, "de", "src1", 1),
    (None, "no id here but some words", "en", "src2", 2),
    (7, "x" * 70_000, "en", "src0", 70_000),
    (8, "1234 5678 !!! ### $$$", None, "src0", 5),
    (9, "one", "fr", "src0", 3),
    (10, " ".join(f"w{i}" for i in range(9000)), "fr", "src9", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark, extra: bool = True):
    docs = spark.createDataFrame(ODD, COLUMNS)
    if extra:  # names that an operator might use itself
        from pyspark.sql import functions as F

        for name in ("code", "component_id", "bucket", "rid", "kept", "n_words", "spans", "score", "u", "v", "piece", "h", "n", "key"):
            docs = docs.withColumn(name, F.lit("own"))
    return docs


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
