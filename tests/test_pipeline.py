import datetime
import json

from pyspark.sql import functions as F

from pressmill.functions import geometry
from pressmill.operators import pipeline, validation

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def us(seconds):
    return int(at(seconds).timestamp() * 1_000_000)


ITEMS = "id string, status string, attempt_count int, error_code string, created_at timestamp, updated_at timestamp"


def test_queue(spark):
    rows = [("fresh", "uploaded", 0, None, at(0), at(0)), ("waits", "uploaded", 3, "OCR_TIMEOUT", at(0), at(95)), ("due", "uploaded", 1, "OCR_TIMEOUT", at(5), at(50)), ("late", "ocr_processing", 1, None, at(0), at(-400)), ("last", "llm_processing", 3, None, at(0), at(-301)), ("held", "preprocessing", None, None, at(0), at(-200)), ("nulls", None, None, None, None, None)]
    queue, now = pipeline.queue_state(spark.createDataFrame(rows, ITEMS)), F.lit(us(100))
    assert [r.id for r in pipeline.claims(queue, now, 5).collect()] == ["fresh", "due"]
    first = pipeline.claims(queue, now, 1).collect()[0]
    assert (first.id, first.attempt_count, first.claim_token, first.lease_us) == ("fresh", 1, "fresh#1", us(400))
    got = {r.id: (r.status, r.error_code) for r in pipeline.reaped(queue, F.lit(us(0))).collect()}
    assert got == {"late": ("uploaded", None), "last": ("needs_attention", "LEASE_EXPIRED")}


def test_failures(spark):
    rows = [("a", "x", 1, "LLM_TIMEOUT", T0, at(0)), ("b", "x", 3, "LLM_TIMEOUT", T0, at(0)), ("c", "x", 0, "LLM_BAD_REQUEST", T0, at(0)), ("d", "x", 2, "IMAGE_UNREADABLE", T0, at(0)), ("e", "x", 2, "IMAGE_LOST", T0, at(0)), ("f", "x", 1, None, T0, at(0)), ("g", "x", None, "INTERNAL_ERROR", T0, at(0))]
    got = {r.id: (r.status, r.run_after_us) for r in pipeline.failed(spark.createDataFrame(rows, ITEMS)).collect()}
    park = ("needs_attention", None)
    assert got == {"a": ("uploaded", us(2)), "b": park, "c": park, "d": park, "e": ("uploaded", us(4)), "g": ("uploaded", us(2))}


def test_attempts(spark):
    runs = spark.createDataFrame([("i", "r1", 1, False), ("i", "r2", 2, True), ("i", "r3", 3, True), ("j", "r4", 1, False)], "item string, id string, t int, ok boolean")
    got = {r.id: (r.attempt, r.winner_id, r.outcome) for r in pipeline.numbered_attempts(runs, ["item"], ["t"], F.col("ok")).collect()}
    assert got == {"r1": (1, "r2", "recorded"), "r2": (2, "r2", "recorded"), "r3": (3, "r2", "yielded"), "r4": (1, None, "recorded")}
    started = spark.createDataFrame([("c1", "k", 1), ("c2", "k", 2), ("c3", "k", 3)], "run string, key string, at int")
    finished = spark.createDataFrame([("c1", "odd", "y" * 30_000), ("c2", "validated", "ok")], "run string, status string, raw_text string")
    calls = {r.run: (r.attempt, r.status, len(r.raw_text or "")) for r in pipeline.call_attempts(started, finished, "key", "run").collect()}
    assert calls == {"c1": (1, "provider_error", 20_000), "c2": (2, "validated", 2), "c3": (3, "running", 0)}


def test_audit_and_creation(spark):
    rows = [("a", 1, "pending", "x"), ("a", 2, "active", "x"), ("a", 3, "active", None), ("b", 1, "pending", "x"), ("a", 2, "active", "x")]
    events = pipeline.audit_events(spark.createDataFrame(rows, "id string, version int, status string, place string"), "id", "version", ["status", "place"]).collect()
    assert [(e.id, e.version, e.changed, json.loads(e.before_values), json.loads(e.after_values)) for e in events] == [("a", 2, "status", {"status": "pending"}, {"status": "active"})]
    made = pipeline.created(spark.createDataFrame([("i", 1, 0), ("i", 1, 1), ("i", 1, 1)], "item string, generation int, index int"), ["item", "generation"]).collect()
    again = pipeline.created(spark.createDataFrame([("i", 1, 0)], "item string, generation int, index int"), ["item", "generation"]).collect()
    assert len(made) == 2 and {r.status for r in made} == {"pending"} and again[0].ad_id in {r.ad_id for r in made}


def test_drafts(spark):
    cats = spark.createDataFrame([("cars", "vehicles")], "key string, slug string")
    ad = lambda ids, **more: {"source_block_ids": ids, "confidence": {"overall": 0.9}, **more}
    answers = [("p", json.dumps({"schema_version": "2.0", "advertisements": [ad([1, 9], title=" A ", category="Cars", price={"raw": "Rs. 5", "amount": 5}, warnings=[{"code": "SCHEMA_VERSION_UNSUPPORTED", "message": "m"}]), ad([9]), ad([2])]}), [1, 2]), ("q", None, [1])]
    df = spark.createDataFrame(answers, "page_id string, answer string, known_ids array<int>")
    seen = spark.createDataFrame([("p", 3, "2.0", True)], "page_id string, n_ads int, schema_version string, truncated boolean")
    got = pipeline.drafts(validation.semantic_candidates(df, cats, 2), seen, 2).orderBy("index").collect()
    assert [(r["index"], r.title, r.price, r.category, r.confidence_label, r.warning_codes) for r in got] == [(0, "A", "Rs. 5", "vehicles", "high", ["SCHEMA_VERSION_UNSUPPORTED", "EVIDENCE_BLOCK_UNKNOWN", "OCR_TRUNCATED", "CANDIDATE_LIMIT_EXCEEDED"])]


def test_hybrid_and_region_order(spark):
    widths = spark.createDataFrame([(d, 1000) for d in "abcde"], "doc string, page_width int")
    detected = spark.createDataFrame([("a", True, False, 3), ("b", True, True, 3), ("c", True, False, 0), ("d", False, False, 3)], "doc string, available boolean, failed boolean, n_lines int")
    regions = spark.createDataFrame([("a", n, left, top, 100, 20) for n, (left, top) in enumerate([(500, 10), (0, 50), (20, 10), (510, 5)], 1)], "doc string, region_no int, left int, top int, width int, height int")
    got = {r.doc: r.warning for r in pipeline.hybrid_paths(widths, detected, regions, "doc").collect()}
    assert got == {"a": None, "b": "DETECTOR_FAILED", "c": "NO_REGIONS_DETECTED", "d": "DETECTOR_UNAVAILABLE", "e": "DETECTOR_UNAVAILABLE"}
    assert {r.doc: r.warning for r in pipeline.hybrid_paths(widths, detected, regions, "doc", 3).collect()}["a"] == "TOO_MANY_REGIONS"
    assert [r.region_no for r in pipeline.ordered_regions(regions, widths, "doc").orderBy("position").collect()] == [3, 2, 4, 1]


def test_calls(spark):
    assert validation.retry_outcome([("retryable", 1), ("ok", 2)], deadline_s=1.0, seconds=0.0)[:2] == ("failed", 1)
    assert validation.retry_outcome([("retryable", 1), ("ok", 2)], deadline_s=9.0, seconds=3.0)[:2] == ("validated", 2)
    rows = [(200, "{}", None), (200, "x", None), (401, "", None), (404, "", None), (429, '{"error":{"message":"slow"}}', "7"), (503, "down", "Tue"), (418, '{"error":"tea"}', "3"), (None, None, None)]
    df = spark.createDataFrame(rows, "status int, body string, header string").withColumn("code", validation.http_class(F.col("status"), F.col("body")))
    got = df.select("code", validation.retry_after(F.col("header"), F.col("code")).alias("wait"), validation.body_excerpt(F.col("body"), 4).alias("said")).collect()
    assert [r.code for r in got] == [None, "LLM_SERVER_ERROR", "LLM_AUTH_FAILED", "LLM_MODEL_UNAVAILABLE", "LLM_RATE_LIMITED", "LLM_SERVER_ERROR", "LLM_BAD_REQUEST", "LLM_TRANSPORT_ERROR"]
    assert [r.wait for r in got] == [None, None, None, None, 7.0, None, None, None] and [r.said for r in got][4:7] == ["slow", "down", "tea"]
    waits = spark.createDataFrame([(3, None, 60.0), (3, 9.0, 60.0), (9, None, 5.0), (1, 2.0, -1.0)], "attempt int, asked double, rest double").select(geometry.call_wait(F.col("attempt"), F.col("asked"), F.col("rest")).alias("w")).collect()
    assert [r.w for r in waits] == [4.0, 9.0, 5.0, 0.0]


def test_rule_reader(spark):
    df = spark.createDataFrame([("p", "Toyota car\nRs 1,250,000 Kandy 0712345678", [1]), ("q", "no price", [1]), ("r", " \n", [1]), ("s", None, [1])], "page_id string, text string, known_ids array<int>")
    got = {r.page_id: json.loads(r.answer)["advertisements"] for r in validation.rule_based_answers(df).collect()}
    assert got["p"][0]["price"] == {"raw": "Rs. 1,250,000", "amount": 1250000, "currency": "LKR"} and got["q"][0]["price"] == {"raw": "Price pending"}
    assert got["r"] == [] and got["s"] == []
