"""Text readers and writers for edge lists, integer tokens and delimited vectors.

Parsing is strict: a field that is no number of its type fails the job, as does an empty line. Lines that hold
white space only have no fields; trailing white space is ignored, leading white space is an empty first field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.draws import seeded_hash, uniform


def lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """`value` per line; partitions deals the lines out anew, evenly."""
    df = spark.read.text(path)
    return df.repartition(partitions) if partitions else df


def fields(value: Column) -> Column:
    """The line's fields between white space; null for a line of white space alone."""
    return F.when(value.rlike(r"^\s+$"), None).otherwise(F.split(F.regexp_replace(value, r"\s+$", ""), r"\s+"))


def edges(text: DataFrame) -> DataFrame:
    """(src, dst) of each line's first two fields; a line with fewer fails."""
    f = fields(F.col("value"))
    checked = F.when(F.size(f) >= 2, f).otherwise(F.raise_error(F.concat(F.lit("no edge in line: "), F.col("value"))))
    return text.select(checked.alias("f")).select(F.col("f")[0].cast("int").alias("src"), F.col("f")[1].cast("int").alias("dst"))


def tokens(text: DataFrame) -> DataFrame:
    """`token`: every field of every line as an integer."""
    return text.select(F.explode(fields(F.col("value"))).alias("token")).select(F.col("token").cast("int"))


def vectors(text: DataFrame, dim: int) -> DataFrame:
    """`x` of lines like (id,,v1,,v2,,...): the first field is dropped, as are those beyond dim; fewer fail."""
    f = F.split(F.translate("value", "()", ""), ",,")
    enough = F.when(F.size(f) > dim, F.slice(f, 2, dim)).otherwise(F.raise_error(F.concat(F.lit("too few fields in line: "), F.col("value"))))
    return text.select(F.transform(enough, lambda v: F.trim(v).cast("double")).alias("x"))


def space_vectors(text: DataFrame) -> DataFrame:
    """`x`: all fields of each line as numbers, however many."""
    return text.select(F.transform(fields(F.col("value")), lambda v: v.cast("double")).alias("x"))


def random_labels(df: DataFrame, seed: int, id_column: str, share: float = 0.2) -> DataFrame:
    """Adds y: +1 for about `share` of the rows, -1 for the others. A row's draw depends on the seed and its id only."""
    return df.withColumn("y", F.when(uniform(seeded_hash(seed, F.col(id_column))) < share, 1.0).otherwise(-1.0))


def write_pairs(df: DataFrame, path: str, left: str, right: str) -> None:
    """A line (left,right) per row."""
    df.select(F.format_string("(%s,%s)", F.col(left).cast("string"), F.col(right).cast("string")).alias("value")).write.text(path)


def write_edges(df: DataFrame, path: str) -> None:
    """A line `src dst` per row."""
    df.select(F.concat_ws(" ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")).write.text(path)


def points(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Stored points (Parquet with x array<double>); a row of another dimension fails when it is read."""
    df = spark.read.parquet(path)
    return df.withColumn("x", F.when(F.size("x") == dim, F.col("x")).otherwise(F.raise_error(F.lit(f"a point is not of dimension {dim}"))))


def write_points(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
