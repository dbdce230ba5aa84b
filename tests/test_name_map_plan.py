"""Name lookups are built once per key, not once per part."""

from cadence.plans import library as lib
from cadence.sources import testdata as td


def test_payloads_are_built_and_parsed_above_the_aggregate(spark, tmp_path):
    spark.range(1, 400).selectExpr("id as p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    names = lib.name_map(td.raw_name_map(spark, str(tmp_path))).where("recording_mbid is not null")
    plan = names._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "json" in plan and "json" not in plan[plan.index("aggregate"):]
    # 40 keys: every 7th lookup failed, every 11th id is malformed
    assert names.count() == 31
