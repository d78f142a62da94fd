"""How rows go from files to the registry."""

import re

from pyspark.sql import functions as F

from monthmatch.fixed_values import required_columns
from monthmatch.sources.registry import Registry
from monthmatch.sources.submissions import headers_frame, load_rows


def test_rows_stay_in_the_tasks_that_read_them(spark, tmp_path):
    """Shuffled on their header or file, all rows would come to one task."""
    header, name = ",".join(required_columns("IND")), "AA0126_IND.csv"
    paths = [str(tmp_path / str(i) / name) for i in range(3)]
    for i, path in enumerate(paths):
        (tmp_path / str(i)).mkdir()
        with open(path, "w") as f:
            f.write(f"{header}\n" + f"F{i},C,20260101\n" * (i + 1))
    files = spark.createDataFrame([(f"file:{p}", header) for p in paths], "uri STRING, header STRING")
    rows = load_rows(spark, "IND", files, headers_frame(spark, [("IND", header)]), paths, 20, "b")
    assert {r["FacilityAccNum"]: r["count"] for r in rows.groupBy("FacilityAccNum").count().collect()} == {"F0": 1, "F1": 2, "F2": 3}
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("BroadcastHashJoin", plan)) == 2 and "Exchange hashpartitioning" not in plan


def test_rows_of_one_partition(spark, tmp_path):
    """They lie in it as they would without being told; no row leaves no folder."""
    registry = Registry(spark, str(tmp_path / "registry")).create()
    rows = spark.range(50).select(F.col("id").cast("string").alias("Covered"), F.lit("IND").alias("SubmissionType"))
    within = {"SubmissionType": "IND", "BatchID": "b"}
    registry.append("open_covered", rows.withColumn("BatchID", F.lit("b")), within)
    registry.append("open_covered", rows.withColumn("BatchID", F.lit("c")))
    registry.append("open_covered", rows.filter("Covered < 0"), {"SubmissionType": "BUS", "BatchID": "b"})
    found = registry.everything("open_covered").groupBy("SubmissionType", "BatchID").count()
    assert sorted(map(tuple, found.collect())) == [("IND", "b", 50), ("IND", "c", 50)]
    assert [p.name for p in (tmp_path / "registry/open_covered").glob("SubmissionType=*")] == ["SubmissionType=IND"]


def test_rows_of_a_subscriber_are_not_brought_together(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry")).create()
    some = spark.createDataFrame([("AA",)], "SubscriberCode STRING")
    for rows in (registry.prior_raw("IND", "2026-01", some), registry.prior_clean("IND", "2026-01", some)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
