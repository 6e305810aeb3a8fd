"""The feed dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.profile import SiteProfile
from feedloom.schema import CATEGORY


def categories(spark: SparkSession, profile: SiteProfile) -> DataFrame:
    """The feeds of the site: (category, path, cat_idx) in loop order, with their url."""
    rows = [(name, path, i) for i, (name, path) in enumerate(profile.categories)]
    url: Column = F.concat(F.lit(profile.base_url + profile.feed_path), F.col("path"))
    return spark.createDataFrame(rows, CATEGORY).withColumn("url", url)
