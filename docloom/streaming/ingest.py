"""Codes per scope kept up to date from a folder that receives documents. An extension: batch does the same over all files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocks import parse_blocks
from ..functions import text as T
from ..sources.documents import SCHEMA


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return files.select(F.xxhash64("doc_name").alias("doc_ord"), "doc_name", "content")


def stream_codes(docs: DataFrame) -> DataFrame:
    """(doc_name, scope, code) of table rows as they arrive; no state is kept."""
    rows = parse_blocks(docs).where("type = 'table'").select("doc_name", F.explode("rows").alias("cells")).select("doc_name", T.flatten_row(F.col("cells")).alias("row_text"))
    found = rows.select("doc_name", T.scope(F.col("row_text")).alias("scope"), F.explode(T.codes(F.col("row_text"))).alias("code"))
    return found.where("scope is not null and code <> scope")


def start(codes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to a Parquet table; each file is read once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.distinct().withColumn("batch", F.lit(number)).write.mode("append").parquet(table)

    return codes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
