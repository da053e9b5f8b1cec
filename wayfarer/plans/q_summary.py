"""Catalogue queries: place summary and first-non-empty metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfarer.operators.summary import place_summary
from wayfarer.plans.places import ORDER, place_rows
from wayfarer.plans.registry import query
from wayfarer.plans.sqlparts import summary_sql, with_p

AS_OF = "2024-06-01"


def summary_of_p(spark, sf_dir):
    s = place_summary(place_rows(spark, sf_dir), ORDER, as_of=AS_OF)
    return s.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd"))


@query("place_summary", sql=with_p() + summary_sql())
def q_place_summary(spark, sf_dir):
    return summary_of_p(spark, sf_dir)
