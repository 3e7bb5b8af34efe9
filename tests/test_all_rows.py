import datetime

import pytest

import __spark_entry__ as entry

AT = datetime.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("rows")
    rows = [("nan", float("nan"), "High", ["1", None, "1", None]), ("null", None, None, None), ("high", 0.85, "low", []), ("mid", 0.6, "odd", [None]), ("low", 0.59, "HIGH", ["1", "2"])]
    spark.createDataFrame([(i, 1, AT, 1, c, w, p) for i, c, w, p in rows], "id string, version int, ingested_at timestamp, load_id int, confidence_overall double, confidence_label string, phones array<string>").write.parquet(str(path / "candidates.parquet"))
    docs = [(1, "b 0712345678 a 0112345678 b 0712345678"), (2, "none"), (3, "+94712345678, 0712345678"), (4, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_labels_of_all(spark, folder):
    got = {r.id: (r.label, r.stated) for r in entry.queries()["g5_confidence_labels"](spark, folder).collect()}
    assert got == {"nan": ("low", 0.9), "null": ("low", 0.75), "high": ("high", 0.4), "mid": ("medium", 0.75), "low": ("low", 0.9)}


def test_repeated_numbers(spark, folder):
    got = {r.doc_id: r.phones for r in entry.queries()["f13_phone_scan"](spark, folder).collect()}
    assert got == {1: "0712345678,0112345678", 2: "", 3: "+94712345678,0712345678", 4: None}


def test_null_entries(spark, folder):
    got = {r.id: (r.phones, r.n) for r in entry.queries()["r1_distinct_phones"](spark, folder).collect()}
    assert got == {"nan": ("1|-", 4), "high": ("", 0), "mid": ("-", 1), "low": ("1|2", 2)}
