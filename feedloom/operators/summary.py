"""Run summary."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_summary(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Links found and articles saved per category; the row without category is the total."""
    found = links.select("category", F.lit(1).alias("found"), F.lit(0).alias("saved"))
    saved = articles.select("category", F.lit(0).alias("found"), F.lit(1).alias("saved"))
    return (
        found.unionByName(saved)
        .rollup("category")
        .agg(F.sum("found").alias("links_found"), F.sum("saved").alias("articles_saved"))
    )
