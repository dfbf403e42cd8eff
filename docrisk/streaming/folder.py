"""A folder watched as a stream: new documents are extracted, screened and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docrisk.functions import text
from docrisk.operators import parsing, rules
from docrisk.sources import files


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they arrive: (doc_id, text, name, filename); doc_id is a hash of the path, so a retried batch gives the same ids."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    named = stream.where(files.wanted(F.col("path"))).withColumn("filename", F.expr("url_decode(substring_index(path, '/', -1))"))
    got = files.extract(named)
    name = F.coalesce(text.file_name_part(F.col("filename")), F.regexp_replace("filename", r"\.[^.]+$", ""))
    return got.select(F.xxhash64("path").alias("doc_id"), "text", name.alias("name"), "filename")


def screen_folder(spark: SparkSession, folder: str, output: str, checkpoint: str, as_of: tuple[int, int] = rules.AS_OF) -> StreamingQuery:
    """Append screened records to a Parquet table; everything is a projection, so no state is kept."""
    screened = rules.screen(parsing.parse(incoming(spark, folder)), as_of).select("doc_id", "name", "filename", "parse_quality", "findings", "levels", "overall", "summary")
    return screened.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
