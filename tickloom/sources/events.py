"""Recorded bus log: partitioned JSON lines in, tables out, and the streaming counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema
from tickloom.functions import instruments as I
from tickloom.functions import ladders as L

PARTITIONS = ("stream", "venue", "date")
BAD = "_corrupt_record"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events from raw JSON text; malformed lines carry their text in ``_corrupt_record``."""
    body = F.from_json(F.col(column), f"{schema.EVENT}, {BAD} STRING",
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    keep = [c for c in lines.columns if c != column]
    return lines.select(*keep, F.explode(F.array(body)).alias("_e")).select(*keep, "_e.*")


def read_events(spark: SparkSession, base: str, stream: str | None = None,
                venue: str | None = None, dates: tuple[str, str] | None = None) -> DataFrame:
    """Landed events below ``base``; the filters prune partitions before any file is opened."""
    df = (spark.read.schema(f"{schema.EVENT}, {BAD} STRING, stream STRING, venue STRING, date DATE")
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(base))
    return _prune(df, stream, venue, dates)


def _prune(df: DataFrame, stream, venue, dates) -> DataFrame:
    if stream:
        df = df.filter(F.col("stream") == stream)
    if venue:
        df = df.filter(F.col("venue") == venue)
    if dates:
        df = df.filter(F.col("date").between(F.lit(dates[0]).cast("date"),
                                             F.lit(dates[1]).cast("date")))
    return df


def good(events: DataFrame) -> DataFrame:
    return events.filter(F.col(BAD).isNull() & F.col("payload").isNotNull())


def bad_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count(BAD).alias("bad_lines"))


def stream_events(spark: SparkSession, base: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(
        f"{schema.EVENT}, stream STRING, venue STRING, date DATE")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(base)


def payload(events: DataFrame, kind: str) -> DataFrame:
    """Rows of one payload kind, its fields flattened next to the envelope."""
    child = F.col(f"payload.{kind}")
    return events.filter(child.isNotNull()).select(
        "topic", "source", F.col("ts_ns").alias("event_ts_ns"),
        F.col("seq").alias("event_seq"), f"payload.{kind}.*")


def books(events: DataFrame) -> DataFrame:
    df = payload(events, "Book")
    return df.withColumn("bids", L.from_pairs(F.col("bids"))).withColumn(
        "asks", L.from_pairs(F.col("asks")))


def payload_kind() -> Column:
    names = list(schema.PAYLOADS)
    return F.coalesce(*[F.when(F.col(f"payload.{k}").isNotNull(), k) for k in names])


def payload_key() -> Column:
    """Instrument a message is about; signals key on their target, latency on its name."""
    fields = {"Signal": "target", "Latency": "name"}
    return F.coalesce(*[F.col(f"payload.{k}.{fields.get(k, 'instrument')}")
                        for k in schema.PAYLOADS])


def with_partitions(events: DataFrame) -> DataFrame:
    return (events.withColumn("stream", I.stream_of(F.col("topic")))
            .withColumn("venue", I.topic_venue(F.col("topic"), F.col("source")))
            .withColumn("date", I.utc_date_ns(F.col("ts_ns"))))


def write_events(events: DataFrame, base: str, files_per_partition: int = 8) -> None:
    """Append by stream, venue and date; busy partitions are spread over several files."""
    df = with_partitions(events)
    spread = F.pmod(F.xxhash64("topic", "seq"), F.lit(files_per_partition))
    (df.repartition(*PARTITIONS, spread).write.mode("append")
     .partitionBy(*PARTITIONS).json(base))


def stream_to_files(events: DataFrame, base: str, checkpoint: str, every: str = "1 second",
                    available_now: bool = False):
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (with_partitions(events).writeStream.format("json").partitionBy(*PARTITIONS)
            .option("path", base).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())


def write_results(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
