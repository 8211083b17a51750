from pyspark.sql import functions as F

from vexil.sources.shared import stash


def test_a_written_table_can_be_filtered_by_a_column_of_many_values(spark):
    """3,000 numbers make a dictionary page of 12 KB, which a pushed filter reads in pieces of 8 KB."""
    rows = spark.range(0, 30000, 1, 1).select("id", (F.col("id") % 3000).cast("int").alias("n"))
    assert stash(rows, "many").filter("n > 0").count() == 30000 - 10
