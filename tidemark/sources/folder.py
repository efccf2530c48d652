"""All logs of a folder, whatever their kind, as one table of events in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import eve, zeek


def read(spark: SparkSession, path: str) -> DataFrame:
    """Events of the *.log files (TSV or NDJSON) and *.json files (EVE) below `path`; each file is read once.

    A folder without files of a kind gives none of it; a path that doesn't exist is an error. See zeek.events() and
    eve.rejects() for what can't be read.
    """
    found, _ = zeek.events(zeek.read_folder(spark, path, "*.log"))
    raw = spark.read.schema(eve.SCHEMA).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return found.unionByName(eve.events(raw))


def in_order(events: DataFrame) -> DataFrame:
    """Stable order of time: ties by engine, flow, kind and record, so that every run gives the same order."""
    return events.orderBy("ts", "source_engine", "flow_id", "event_type", "source_id", "query_name", "orig_bytes", "resp_bytes")
