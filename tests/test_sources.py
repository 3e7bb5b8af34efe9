import base64
import datetime as dt
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from pressmill.sources import blobs, documents
from pressmill.streaming import ingest


def test_blob_store(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A") + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    os.makedirs(tmp_path / "in")
    for name, body in (("a.png", png), ("b.png", png), ("c.bin", b"zz")):
        (tmp_path / "in" / name).write_bytes(body)
    staged = blobs.scan(spark, str(tmp_path / "in")).withColumn("p", blobs.probe(F.col("content"))).withColumn("content_type", F.coalesce("p.content_type", F.lit("")))
    got = {r.path[-5:]: r for r in staged.collect()}
    assert (got["a.png"].p.width, got["a.png"].p.height, got["c.bin"].p.content_type) == (640, 480, None)
    done = blobs.promote(staged, spark.createDataFrame([], "key string"))
    assert done.where("was_written").count() == 2
    again = blobs.promote(staged, done.select("key"))
    assert again.where("was_written").count() == 0
    stored = blobs.enumerate_keys(spark, str(tmp_path / "in"))
    assert {r.key for r in stored.collect()} == {"a.png", "b.png", "c.bin"}
    late = F.lit(dt.datetime.now() + dt.timedelta(days=2))
    assert {r.key for r in blobs.sweep(stored, spark.createDataFrame([("a.png",)], "key string"), late, 3600).collect()} == {"b.png", "c.bin"}
    assert blobs.sweep(stored, spark.createDataFrame([], "key string"), F.lit(dt.datetime.now()), 10**7).count() == 0
    safe = spark.createDataFrame([("a/b",), ("../x",), ("/abs",), ("a//b",), ("a/./b",), (None,)], "k string").select(blobs.safe_key(F.col("k"))).collect()
    assert [r[0] for r in safe] == [True, False, False, False, False, False]


def test_serving(spark):
    assets = spark.createDataFrame([("a", "k1", "c1", "present"), ("b", "k2", "c2", "purged"), ("c", "k3", "c3", "absent")], "asset_id string, storage_key string, checksum string, bytes_state string")
    derived = spark.createDataFrame([("a", "page", "d1", "x1", "1"), ("a", "page", "d2", "x2", "2")], "asset_id string, purpose string, storage_key string, checksum string, id string")
    assert {(r.asset_id, r.key, r.status) for r in blobs.serve(assets, derived, "page").collect()} == {("a", "d2", 200), ("b", None, 404), ("c", None, 404)}
    assert {(r.asset_id, r.status) for r in blobs.serve(assets, derived, "original").collect()} == {("a", 200), ("b", 410), ("c", 404)}


def test_json_store(spark, tmp_path):
    url = "data:image/png;base64," + base64.b64encode(b"abc").decode()
    store = {"assets": {"1": {"id": "1", "filename": "f", "content_type": "image/png", "data_url": url}, "2": {"id": "2", "data_url": "x"}}, "extractions": {}, "advertisements": {"9": {"id": "9", "title": "t"}}}
    path = tmp_path / "store.json"
    path.write_text(json.dumps(store, indent=1))
    assets = documents.decode_assets(documents.read_store(spark, str(path), "assets"))
    assert {(r.store_id, r.error) for r in assets.collect()} == {("1", None), ("2", "UNDECODABLE")}
    ads = documents.read_store(spark, str(path), "advertisements")
    first = documents.import_rows(ads, spark.createDataFrame([], "store_id string"))
    assert tuple(documents.import_report(first).collect()[0]) == (1, 1, 0)
    assert tuple(documents.import_report(documents.import_rows(ads, first)).collect()[0]) == (1, 0, 1)
    kept = documents.read_store(spark, str(path), "assets")
    documents.write_store({"advertisements": ads, "assets": kept}, str(tmp_path / "out"))
    for part, rows in (("assets", kept), ("advertisements", ads)):
        back = documents.read_store(spark, str(tmp_path / "out"), part)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert documents.read_store(spark, str(tmp_path / "out"), "extractions").count() == 0
    odd = ads.withColumn("title", documents.F.lit('a "quoted" \\ line\nbreak'))
    documents.write_store({"advertisements": odd}, str(tmp_path / "odd"))
    assert documents.read_store(spark, str(tmp_path / "odd"), "advertisements").collect()[0].title == 'a "quoted" \\ line\nbreak'
    documents.write_store({"assets": kept.limit(0)}, str(tmp_path / "none"))
    assert documents.read_store(spark, str(tmp_path / "none"), "assets").count() == 0


def test_fake_modes(spark):
    import pytest

    from pressmill.operators import validation

    page = spark.createDataFrame([("p", "Land 5 perches", [1], "ask cat")], "page_id string, text string, known_ids array<int>, prompt string")
    say = lambda mode: documents.fake_answers(page, mode, [{"name": "1", "match": "cat", "response": {"n": 1}}]).collect()[0].answer
    assert validation.structural_errors(say("rule_based")) == [] and validation.structural_errors(say("empty")) == []
    assert len(validation.structural_errors(say("always_invalid"))) == 2 and json.loads(say("fixture")) == {"n": 1}
    with pytest.raises(ValueError):
        say("other")


def test_engine_table(spark):
    lines = ["\t".join(documents.TSV), '5\t1\t1\t1\t1\t1\t0\t0\t10\t5\t96.5\tsay "hi"\tyou', "5\t1\t1", "5\t1\t1\t1\t1\t2\tx\t0\t10\t5\t90\tbad", ""]
    words = documents.words_of(documents.read_tsv(spark.createDataFrame([("d", s) for s in lines], "doc string, value string"))).collect()
    assert len(words) == 1 and words[0].text == 'say "hi"\tyou' and words[0].confidence == 96.5


def test_prompts(spark, tmp_path):
    import hashlib

    (tmp_path / "a.txt").write_text("hello")
    good = {"a.txt": hashlib.sha256(b"hello").hexdigest()}
    assert documents.load_prompts(spark, str(tmp_path), good) == {"a.txt": "hello"}
    with pytest.raises(ValueError):
        documents.load_prompts(spark, str(tmp_path), {"a.txt": "0"})
    with pytest.raises(FileNotFoundError):
        documents.load_prompts(spark, str(tmp_path), {"b.txt": "0"})
    prompts = spark.createDataFrame([("p", "xx cat"), ("q", "none")], "page_id string, prompt string")
    got = documents.recorded_answers(prompts, [{"name": "2", "match": "xx", "response": {"n": 2}}, {"name": "1", "match": "cat", "response": {"n": 1}}])
    assert {(r.page_id, r.answer) for r in got.collect()} == {("p", '{"n": 1}'), ("q", None)}


def test_stream_once_each(spark, tmp_path):
    t = dt.datetime(2015, 1, 1)
    rows = [("a", t), ("a", t), ("b", t + dt.timedelta(minutes=1)), ("a", t + dt.timedelta(minutes=2))]
    spark.createDataFrame(rows, "id string, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = ingest.once_each(ingest.read_items(spark, str(tmp_path / "in"), "id string, ts timestamp_ntz"), "id", "ts")
    for _ in range(2):
        ingest.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").schema("id string, ts timestamp").parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_stream_leases(spark, tmp_path):
    t = dt.datetime(2015, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    rows = [("i", "w1", "claim", at(0)), ("i", "w2", "claim", at(1)), ("i", "w1", "heartbeat", at(4)), ("i", "w2", "claim", at(20)), ("i", "w1", "finish", at(21)), ("i", "w2", "finish", at(22)), ("j", "w1", "claim", at(0))]
    spark.createDataFrame(rows, "id string, worker string, action string, ts timestamp_ntz").write.parquet(str(tmp_path / "in"))
    stream = ingest.leases(ingest.read_items(spark, str(tmp_path / "in"), "id string, worker string, action string, ts timestamp_ntz"))
    ingest.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.option("recursiveFileLookup", "true").schema(ingest.LEASE_OUT).parquet(str(tmp_path / "out")).collect()
    events = sorted((r.event, r.attempts) for r in got if r.id == "i")
    assert events == sorted([("granted", 1), ("refused", 1), ("requeued", 1), ("granted", 2), ("claim_lost", 2), ("finished", 2)])
    assert ("granted", 1) in [(r.event, r.attempts) for r in got if r.id == "j"]
