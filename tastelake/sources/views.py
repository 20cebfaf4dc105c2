"""Recommender views over the retail tables: customers are users, parts are items, order lines are ratings.

Every view is lazy; Catalyst prunes columns down to what a query touches. Hash-checked oracle SQL repeats the same
definitions as common table expressions (``tastelake.plans.oracle``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastelake.session import stored


class Views:
    """The normalised inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        year = (F.lit(1960) + F.col("p_size")).cast("int")
        return self.table("part").select(
            F.col("p_partkey").alias("item_id"),
            F.concat("p_name", F.lit(" ("), year.cast("string"), F.lit(")")).alias("title"),
            F.concat_ws("|", "p_type", "p_brand").alias("genres"),
            year.alias("year"),
            F.col("p_name").alias("overview"),
            F.lit(None).cast("string").alias("poster_url"),
            (F.col("p_retailprice") / F.lit(100.0)).alias("vote_average"),
        )

    @cached_property
    def item_genres(self) -> DataFrame:
        return self.items.select("item_id", F.explode(F.split("genres", r"\|")).alias("genre"))

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_id"),
            F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def ratings_raw(self) -> DataFrame:
        """One row per order line; the same user may rate an item several times."""
        return self._rated(self.table("lineitem"))

    def _rated(self, lines: DataFrame) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("item_id"),
            (F.ceil(F.col("l_quantity") / 5).cast("double") / F.lit(2.0).cast("double")).alias("rating"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").alias("seq"),
        )

    @cached_property
    def ratings(self) -> DataFrame:
        """Latest rating and first time of every (user, item)."""
        return self._latest(self.ratings_raw)

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        # few pairs repeat: sums of parts before the shuffle would sort all rows for nothing
        return rows.repartition("user_id", "item_id").groupBy("user_id", "item_id").agg(F.max_by("rating", "seq").alias("rating"), F.min("ts").alias("ts"))

    @cached_property
    def stored_ratings(self) -> DataFrame:
        """``ratings`` for jobs that read them more than once."""
        return stored(self.ratings, "ratings")

    @cached_property
    def interactions(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            F.col("event_type").alias("interaction_type"),
            F.col("value").alias("intensity"),
            F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            F.col("event_type").alias("endpoint"),
            F.col("value").alias("latency_ms"),
            (F.col("event_type") == "error").alias("is_error"),
        )

    @cached_property
    def item_vectors(self) -> DataFrame:
        """Item factors; stored as float, used as double."""
        return self.table("embeddings").select(
            F.col("vec_id").alias("item_id"),
            F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
            F.col("label").alias("class"),
        )

    @cached_property
    def vector_ratings(self) -> DataFrame:
        """``ratings`` of items that have a vector, for jobs that need no others; order lines of other items leave before they are joined."""
        items = self.item_vectors.select("item_id")
        if "stored_ratings" in self.__dict__:
            return self.stored_ratings.join(items, "item_id", "left_semi").select("user_id", "item_id", "rating", "ts")
        return stored(self.ratings_of(items), "vector-ratings")

    def ratings_of(self, items: DataFrame) -> DataFrame:
        """``ratings`` of the given items (item_id) only."""
        lines = self.table("lineitem").join(items.select(F.col("item_id").alias("l_partkey")), "l_partkey", "left_semi")
        return self._latest(self._rated(lines))

    @cached_property
    def user_vectors(self) -> DataFrame:
        """Rating-weighted mean of the vectors a user has rated: a deterministic stand-in for trained user factors."""
        from tastelake.operators.similarity import weighted_mean_vectors

        return stored(weighted_mean_vectors(self.vector_ratings, self.item_vectors), "user-vectors")

    @cached_property
    def corpus(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "lang", "source")
