"""Posts of a stream of files, read to its end, against the batch."""

import datetime
import random

from pyspark.sql import functions as F

from rulewright.operators.cases import classified
from rulewright.streaming import posts

SCHEMA = "raw_id string, text string, media array<string>, authorities array<string>, followers int, location string, posted timestamp"


def made(n):
    r, start = random.Random(3), datetime.datetime(2026, 1, 1)
    texts = ["short weight in Mumbai", "no bill given", "MRP overcharged at the station", "", None, "Short weight in Mumbai "]
    return [(f"p{i}", r.choice(texts), [], [], 5, r.choice(["Pune", "Delhi", None]), start + datetime.timedelta(minutes=r.randrange(600))) for i in range(n)]


def drained(spark, stream, name, mode):
    """All rows of a stream that ends with its input."""
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(120)
    finally:
        run.stop()
    return spark.table(name)


def test_volumes_and_first_posts_equal_the_batch(spark, tmp_path):
    batch = spark.createDataFrame(made(150), SCHEMA)
    batch.repartition(3).write.parquet(f"{tmp_path}/posts")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/posts")
    got = drained(spark, posts.volumes(stream, "posted"), "volumes", "complete")
    want = classified(batch).groupBy(F.window("posted", "1 hour"), "city", "category").agg(F.count("*").alias("posts"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    first = drained(spark, posts.first_posts(stream, "posted"), "first_posts", "append")
    assert sorted(r[0] for r in first.select("content_hash").collect()) == sorted(r[0] for r in classified(batch).select("content_hash").distinct().collect())
