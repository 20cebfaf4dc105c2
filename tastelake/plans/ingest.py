"""Sources, sinks and table maintenance."""

from pyspark.sql import functions as F

from tastelake.operators import trending
from tastelake.operators.ordering import top_n
from tastelake.plans.oracle import sql
from tastelake.plans.registry import query
from tastelake.session import work_path
from tastelake.sources import files, tables


@query(
    "csv_ratings_scan",
    "S1 P7",
    sql("""SELECT item_id, count(*) AS n, sum(rating) AS rating_sum, min(epoch(ts))::BIGINT AS first_seconds
           FROM ratings_raw GROUP BY item_id"""),
)
def csv_ratings_scan(v):
    path = work_path(v.spark, "ratings-csv")
    raw = v.ratings_raw.select(
        F.col("user_id").cast("string").alias("userId"),
        F.col("item_id").cast("int").alias("movieId"),
        "rating",
        F.unix_timestamp("ts").alias("timestamp"),
    )
    raw.write.option("header", True).csv(path)
    read = files.read_csv(v.spark, path).withColumn("ts", F.timestamp_seconds("timestamp"))
    return read.groupBy(F.col("movieId").cast("bigint").alias("item_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"), F.unix_timestamp(F.min("ts")).alias("first_seconds")
    )


@query(
    "scored_list_json",
    "S2 S3 P23",
    sql("""SELECT genre AS key, rank, item_id, score FROM (
             SELECT genre, item_id, score,
                    CAST(row_number() OVER (PARTITION BY genre ORDER BY score DESC, item_id) AS INTEGER) AS rank
             FROM trending JOIN item_genres USING (item_id)) WHERE rank <= 20"""),
)
def scored_list_json(v):
    scored = trending.scores(v.ratings_raw, v.items).join(v.item_genres, "item_id")
    ranked = top_n(scored, ["genre"], [F.col("score").desc(), F.col("item_id")], 20)
    path = work_path(v.spark, "scored-lists")
    files.write_scored_lists(ranked, path, "genre")
    return files.read_scored_lists(v.spark, path)


@query(
    "parquet_year_partition",
    "S4 S11",
    sql("""SELECT user_id, count(*) AS n, sum(rating) AS rating_sum FROM ratings_raw
           WHERE year(ts) = 1998 GROUP BY user_id"""),
)
def parquet_year_partition(v):
    path = work_path(v.spark, "ratings-by-year")
    files.write_parquet(v.ratings_raw.select("user_id", "item_id", "rating", F.year("ts").alias("year")), path, ["year"])
    read = v.spark.read.schema("user_id bigint, item_id bigint, rating double, year int").parquet(path)
    year = read.filter(F.col("year") == 1998)
    return year.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("rating_sum"))


@query(
    "bulk_insert_new",
    "S6",
    sql("""SELECT user_id, item_id, rating FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, l_orderkey, l_linenumber,
                                          l_quantity, l_extendedprice) AS rn
             FROM ratings_raw WHERE ts >= TIMESTAMP '1998-01-01') b
           WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM ratings_raw t WHERE t.ts < TIMESTAMP '1998-01-01'
                                        AND t.user_id = b.user_id AND t.item_id = b.item_id)"""),
)
def bulk_insert_new(v):
    target = v.ratings_raw.filter(F.col("ts") < F.lit("1998-01-01").cast("timestamp"))
    batch = v.ratings_raw.filter(F.col("ts") >= F.lit("1998-01-01").cast("timestamp"))
    rows = batch.select("user_id", "item_id", "rating", "seq")
    return tables.insert_new(target, rows, ["user_id", "item_id"], "seq").select("user_id", "item_id", "rating")


@query(
    "rating_upsert",
    "S7 X10",
    sql("SELECT user_id, item_id, rating, epoch(ts)::BIGINT AS first_seconds FROM ratings"),
)
def rating_upsert(v):
    cut = F.lit("1999-01-01").cast("timestamp")
    base = v.ratings_raw.filter(F.col("ts") < cut)
    delta = v.ratings_raw.filter(F.col("ts") >= cut)
    merged = tables.upsert_ratings(base, delta)
    return merged.select("user_id", "item_id", "rating", F.unix_timestamp("ts").alias("first_seconds"))


@query(
    "interaction_append",
    "S8",
    sql("""SELECT interaction_type, count(*) AS n, round(sum(coalesce(intensity, 1.0)), 4) AS intensity_sum
           FROM interactions WHERE user_id IS NOT NULL AND item_id IS NOT NULL AND interaction_type <> ''
           GROUP BY interaction_type"""),
)
def interaction_append(v):
    rows = tables.append_interactions(v.interactions)
    return rows.groupBy("interaction_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("intensity"), 4).alias("intensity_sum")
    )


@query(
    "ingest_validation",
    "S12 D:quarantine",
    sql("""SELECT broken, count(*) AS n FROM (
             SELECT concat_ws(',', CASE WHEN NOT (rating BETWEEN 1.0 AND 5.0) THEN 'rating_range' END,
                                   CASE WHEN ts < TIMESTAMP '1996-01-01' THEN 'timestamp_valid' END) AS broken
             FROM ratings_raw) GROUP BY broken"""),
)
def ingest_validation(v):
    rules = {
        "rating_range": F.col("rating").between(1.0, 5.0),
        "timestamp_valid": F.col("ts") >= F.lit("1996-01-01").cast("timestamp"),
    }
    good, bad = tables.split_valid(v.ratings_raw.select("rating", "ts"), rules)
    marked = good.select(F.lit("").alias("broken")).unionByName(bad.select(F.concat_ws(",", "broken_rules").alias("broken")))
    return marked.groupBy("broken").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedup_keep_first",
    "U5",
    sql("""SELECT user_id, item_id, rating FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, l_orderkey, l_linenumber,
                                          l_quantity, l_extendedprice) AS rn FROM ratings_raw) WHERE rn = 1"""),
)
def dedup_keep_first(v):
    return tables.keep_first(v.ratings_raw.select("user_id", "item_id", "rating", "seq"), ["user_id", "item_id"], "seq")
