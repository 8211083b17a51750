"""Evaluation files: line-wise JSON in file order, score logs, resuming, reports, and a text corpus as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORES = T.StructType(
    [T.StructField(n, t) for n, t in (("suite", T.StringType()), ("task", T.StringType()), ("_id", T.StringType()), ("method", T.StringType()), ("pred", T.StringType()), ("score", T.DoubleType()), ("n_input_tokens", T.LongType()), ("error", T.StringType()))]
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) without blank lines. line_no orders the lines of a file: it grows with the place in the file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return lines.filter(F.trim("line") != "")


def first_rows(spark: SparkSession, path: str, schema: T.StructType, n: int) -> DataFrame:
    """The first n rows of line-wise JSON in file order."""
    lines = numbered_lines(spark, path).orderBy("file", "line_no").limit(n)
    return lines.select("line_no", F.from_json("line", schema).alias("r")).select("line_no", "r.*")


def scores(spark: SparkSession, path: str, suite: str | None = None, tasks: list[str] | None = None) -> DataFrame:
    """A score log: lines that don't parse (a cut last line) go, of a repeated (task, _id) the last line stays, `repeats` tells how many there were before it."""
    lines = numbered_lines(spark, path).withColumn("r", F.from_json("line", SCORES)).select("file", "line_no", "r.*").filter("_id is not null and task is not null")
    lines = lines.filter(F.col("suite") == suite) if suite else lines
    lines = lines.filter(F.col("task").isin(tasks)) if tasks else lines
    return last_wins(lines, [F.desc("file"), F.desc("line_no")])


def last_wins(rows: DataFrame, order: list) -> DataFrame:
    w = Window.partitionBy("task", "_id")
    return rows.withColumn("_r", F.row_number().over(w.orderBy(*order))).withColumn("repeats", F.count("*").over(w) - 1).filter("_r = 1").drop("_r", "file", "line_no")


def remaining(samples: DataFrame, done: DataFrame) -> DataFrame:
    """samples(suite, task, _id, ...) that no done row has."""
    return samples.join(done.select("suite", "task", "_id").distinct(), ["suite", "task", "_id"], "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A report of a few rows as line-wise JSON in one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


#: Rows of long-context question sets (fixed names).
LONG_ROWS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("_id", "dataset", "language", "context", "input")]
    + [T.StructField("answers", T.ArrayType(T.StringType())), T.StructField("all_classes", T.ArrayType(T.StringType())), T.StructField("length", T.LongType())]
)


def long_rows(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Rows of such a set, of one dataset if it is named; a line that doesn't parse has nulls and goes."""
    rows = spark.read.schema(LONG_ROWS).json(path).filter("_id is not null")
    return rows.filter(F.col("dataset") == dataset) if dataset else rows


def dump_rank_stats(objects: DataFrame, path: str) -> None:
    """objects(rank, value), value being a JSON object name -> number, each in a file of its own."""
    objects.select("rank", "value").write.partitionBy("rank").mode("overwrite").text(path)


def corpus(texts: DataFrame, first: int, most: int, order: str = "doc_id") -> DataFrame:
    """One row (tokens): the first texts that aren't blank joined by an empty line, split at blanks, cut to `most` tokens; `enough` tells if there were as many."""
    held = texts.filter(F.trim("text") != "").orderBy(order).limit(first)
    whole = held.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda e: e["text"]), "\n\n").alias("t"))
    tokens = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    return whole.select(F.slice(tokens, 1, most).alias("tokens"), (F.size(tokens) >= most).alias("enough"))


def rank_stats(spark: SparkSession, path: str) -> DataFrame:
    """(name, total, ranks) of per-rank JSON objects name -> number."""
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("name", "x"))
    return rows.groupBy("name").agg(F.sum("x").alias("total"), F.count("*").alias("ranks"))
