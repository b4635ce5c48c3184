"""The same folds over streams. The analytics being rebuilt are batch; this is an extension that shares their expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.operators.cases import classified

def first_posts(posts: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Classified posts of a stream, each text once within `delay`."""
    return classified(posts).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def volumes(posts: DataFrame, event_time: str, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Posts of a stream counted by window of event time, city and category; late ones count until `delay` has passed."""
    return classified(posts).withWatermark(event_time, delay).groupBy(F.window(event_time, window), "city", "category").agg(F.count("*").alias("posts"))
