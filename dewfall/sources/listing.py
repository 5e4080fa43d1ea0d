"""An index of files by year and month out of their names, from a listing of a folder; strict where every month must be there once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: six digits of a file name that are not part of a longer number.
_YEAR_MONTH = r"(?:^|[^0-9])([0-9]{4})([0-9]{2})(?:[^0-9]|$)"


def year_month(name: Column) -> tuple[Column, Column]:
    """Year and month in a file name, null where there is none or the month is not 1 to 12."""
    year, month = (F.nullif(F.regexp_extract(name, _YEAR_MONTH, k), F.lit("")).cast("int") for k in (1, 2))
    good = month.between(1, 12)
    return F.when(good, year), F.when(good, month)


def listed(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, year, month, bytes) of the files below a folder whose names match. Spark lists them; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    name = F.substring_index("path", "/", -1)
    year, month = year_month(name)
    return files.select("path", name.alias("name"), year.alias("year"), month.alias("month"), F.col("length").alias("bytes"))


def months(files: DataFrame) -> DataFrame:
    """(year, month, files, state) of files(year, month) for every month of the years that appear: missing, single or duplicate. Files without a month count for none."""
    known = files.where("year is not null and month is not null")
    found = known.groupBy("year", "month").agg(F.count("*").alias("files"))
    due = found.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    n = F.coalesce("files", F.lit(0))
    return due.join(found, ["year", "month"], "left").select("year", "month", n.alias("files"), F.when(n == 0, "missing").when(n > 1, "duplicate").otherwise("single").alias("state"))


def file_of_month(files: DataFrame) -> DataFrame:
    """(year, month, path): the file of each month; an error that names a month with several files or none."""
    state = months(files).where("state <> 'single'").select("year", "month", F.col("state").alias("bad"))
    paths = files.where("year is not null and month is not null").groupBy("year", "month").agg(F.min("path").alias("path"))
    note = F.concat(F.col("bad"), F.lit(" month "), F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("month").cast("string"), 2, "0"))
    checked = F.when(F.col("bad").isNotNull(), F.raise_error(note)).otherwise(F.col("path"))
    return paths.join(state, ["year", "month"], "full").select("year", "month", checked.alias("path"))
