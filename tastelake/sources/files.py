"""Readers and writers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATING_CSV = "userId string, movieId int, rating double, timestamp bigint"
ITEM_JSON = (
    "id int, title string, genres string, year int, overview string, poster_url string, vote_average double, "
    "vote_count int, popularity double"
)
SCORED_LIST_JSON = "key string, items array<struct<item_id: bigint, score: double>>"
EVENT_JSON = "event_id bigint, ts timestamp, user_id bigint, interaction_type string, intensity double, item_id bigint"


def read_csv(spark: SparkSession, path: str, schema: str = RATING_CSV) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str = ITEM_JSON) -> DataFrame:
    """Files that each hold one JSON array of objects. One file is one task: keep such files small."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_scored_lists(spark: SparkSession, path: str) -> DataFrame:
    """Nested lists back to long form (key, rank, item_id, score)."""
    lists = spark.read.schema(SCORED_LIST_JSON).json(path)
    return lists.select("key", F.posexplode("items").alias("pos", "entry")).select(
        "key", (F.col("pos") + 1).alias("rank"), F.col("entry.item_id").alias("item_id"), F.col("entry.score").alias("score")
    )


def write_scored_lists(ranked: DataFrame, path: str, key: str) -> None:
    """Ranked rows (key, rank, item_id, score) as one JSON object per key. Lists are top-k lists, hence short."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "item_id", "score")))
    shaped = F.transform(entries, lambda e: F.struct(e["item_id"].alias("item_id"), e["score"].alias("score")))
    ranked.groupBy(F.col(key).cast("string").alias("key")).agg(shaped.alias("items")).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int = 5_000_000) -> None:
    """Snappy Parquet. Rows of one partition value are written by several tasks, so a hot value is not one file."""
    writer = df.write.mode("overwrite").option("compression", "snappy").option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def relational_options(url: str, table: str, *, column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Options of a parallel JDBC read, split on a numeric column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_relational(spark: SparkSession, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**relational_options(**kwargs)).load()


def write_relational(df: DataFrame, url: str, table: str, *, batch: int = 500, connections: int = 16) -> None:
    """Batched inserts over a bounded number of connections."""
    df.coalesce(connections).write.format("jdbc").mode("append").options(
        url=url, dbtable=table, batchsize=str(batch)
    ).save()


def read_event_stream(spark: SparkSession, path: str, schema: str = EVENT_JSON, fmt: str = "parquet", **options) -> DataFrame:
    """Interaction events arriving as files."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def read_event_topic(spark: SparkSession, servers: str, topic: str, schema: str = EVENT_JSON) -> DataFrame:
    """The same events from a Kafka topic (needs the Kafka package on the cluster)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
