"""Message bus: events in and out (needs the Kafka connector on the class path)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.zeek import EVENT


def read(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000) -> DataFrame:
    """Stream of normalized events; offsets are kept by the query's checkpoint, and nothing is dropped under pressure."""
    raw = spark.readStream.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("subscribe", topic).option("startingOffsets", "earliest").option(
        "maxOffsetsPerTrigger", per_trigger
    ).load()
    return parse(raw)


def parse(raw: DataFrame) -> DataFrame:
    """key, value (binary) of messages as event columns; what is no event comes out with a null ts."""
    return raw.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def messages(events: DataFrame) -> DataFrame:
    """key (flow, so that a flow stays in order on one partition) and value (JSON)."""
    key = F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port"), F.lit("->"), F.col("dst_ip"), F.lit(":"), F.col("dst_port"))
    return events.select(key.alias("key"), F.to_json(F.struct("*")).alias("value"))


def write(events: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return messages(events).writeStream.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("topic", topic).option("checkpointLocation", checkpoint).start()
