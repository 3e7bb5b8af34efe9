import datetime

import __spark_entry__ as entry
from pressmill.operators import profile as p


def test_anomalies_of_merged_states(spark):
    """A null rate of 0.2 after loads of about 0.02 is out of control, far below the fixed drift of 0.25; so is a code's share."""
    checks = [p.Check("code", "code", ("A", "B"))]
    rows = [(load, None if i < (20 if load == 9 else 2 + load % 2) else "B" if load == 8 and i < 30 else "A") for load in range(10) for i in range(100)]
    data = spark.createDataFrame([*rows, (None, None)], "load int, code string")
    entries = [p.scan_entries(data.where(f"load <> 8 AND hash(code, load) % 2 {op} 0").withColumn("id", p.F.lit("r")), checks, "load", "id") for op in ("=", "<>")]
    assert p.drifted(entries[0].unionByName(entries[1]), checks).count() == 0
    assert {tuple(r) for r in p.drifted(entries[0].unionByName(entries[1]), checks, 0.15).collect()} == {("code", 9)}
    halves = [p.compile_state(data.where(f"hash(code, load) % 2 {op} 0"), checks, "load") for op in ("=", "<>")]
    found = {(r.metric, r.partition): r for r in p.anomalies(halves[0].unionByName(halves[1]), checks).collect()}
    assert ("null_rate", 9) in found and ("share B", 8) in found and ("bad_rate", 9) not in found
    assert abs(found["null_rate", 9].value - 0.2) < 1e-9 and abs(found["null_rate", 9].center - sum(2 + i % 2 for i in range(9)) / 900) < 1e-9
    assert {part for _, part in found} == {8, 9}


def test_query(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    folder = str(tmp_path)
    spark.createDataFrame([("NO_TEXT", "error"), ("LOW", "warning")], "code string, code_type string").write.parquet(f"{folder}/code_catalog.parquet")
    items = [(f"{load}-{i}", "NO_TEXT", [], load, at) for load in range(8) for i in range(50)]
    spark.createDataFrame(items, "id string, error_code string, warning_codes array<string>, load_id int, ingested_at timestamp").write.parquet(f"{folder}/ingestion_items.parquet")
    cands = [(f"{load}-{i}", None if load == 7 and i < 5 else 0.8, load) for load in range(8) for i in range(50)]
    spark.createDataFrame(cands, "id string, confidence_overall double, load_id int").write.parquet(f"{folder}/candidates.parquet")
    got = {(r.tbl, r.column_name, r.load_id, r.metric) for r in entry.queries()["p6_anomalies"](spark, folder).collect()}
    assert got == {("candidates", "confidence_overall", "7", "null_rate")}
