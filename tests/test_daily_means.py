from pyspark.sql import functions as F

from gaugeworks.plans import metric_queries


def test_daily_means_cover_all_days(spark, monkeypatch):
    rows = [("a.b", "2023-12-31 23:59:59", 1.0), ("a.b", "2024-01-05 00:00:00", 2.0), ("a.b", "2024-02-01 00:00:00", 3.0)]
    obs = spark.createDataFrame(rows, "fq_name string, at string, value double").select("fq_name", F.to_timestamp("at").alias("observed_at"), "value")
    monkeypatch.setattr(metric_queries.T, "obs_events", lambda *_: obs)
    assert {r.day for r in metric_queries.daily_means(spark, "").collect()} == {"2023-12-31", "2024-01-05", "2024-02-01"}
