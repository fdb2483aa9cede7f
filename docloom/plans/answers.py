"""Answers of a model in an append-only table: a batch that was cut short asks only what it hasn't got yet."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pacing import RateLimit
from .providers import Chat, complete_column

SCHEMA = "key string, raw string, seconds double"
#: Prompts that are asked before their answers are committed.
WAVE = 1024


class Answers:
    """A folder of Parquet files, of which each append is committed whole or not at all. The key of an answer is a digest of
    the model and its settings, the system prompt, the prompt and the number of tokens asked for."""

    def __init__(self, spark: SparkSession, path: str, wave: int = WAVE):
        self.spark, self.path, self.wave = spark, path, wave
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    @staticmethod
    def key(chat: Chat, system: str) -> Column:
        parts = [F.lit(chat.identity()), F.lit(system), F.coalesce("prompt", F.lit("")), F.coalesce(F.col("max_tokens").cast("string"), F.lit(""))]
        return F.sha2(F.concat(*(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts)), 256)

    def complete(self, rows: DataFrame, chat: Chat, system: str, limit: RateLimit | None = None) -> DataFrame:
        """rows (qid, prompt, max_tokens, ...) with raw and seconds. Prompts without an answer are asked in waves, alike ones once;
        a wave that fails leaves those before it in the table."""
        keyed = rows.drop("raw", "seconds").withColumn("_key", self.key(chat, system))
        wanted = keyed.select(F.col("_key").alias("key"), "prompt", "max_tokens").dropDuplicates(["key"])
        open_ = wanted.join(self.read().select("key"), "key", "left_anti")
        waves = -(-open_.count() // self.wave)
        for i in range(waves):
            # What a wave has answered isn't asked again, so the table is looked at anew.
            own = wanted.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == i).join(self.read().select("key"), "key", "left_anti")
            complete_column(own, chat, system, limit).select("key", "raw", "seconds").write.mode("append").parquet(self.path)
        found = self.read().dropDuplicates(["key"]).withColumnRenamed("key", "_key")
        return keyed.join(found, "_key", "left").drop("_key")
