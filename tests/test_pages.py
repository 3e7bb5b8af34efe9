import random

from pyspark.sql import functions as F

from pressmill.operators import pages, records, validation


def plain_order(boxes, width):
    """The same order by plain loops."""
    placed = sorted((b for b in boxes if b[1]), key=lambda b: (b[1][0], b[0]))
    bands, limit = [], max(1, int(width * 0.15))
    for b in placed:
        if bands and b[1][0] - bands[-1][-1][1][0] <= limit:
            bands[-1].append(b)
        else:
            bands.append([b])
    return [b[0] for band in bands for b in sorted(band, key=lambda b: (b[1][1], b[1][0], b[0]))] + [b[0] for b in boxes if not b[1]]


def test_reading_order_is_the_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for page in range(12):
        boxes = [(i, [rnd.choice((10, 14, 400, 410, 800)) + rnd.randint(0, 9), rnd.randint(0, 900), 100, 20] if rnd.random() > 0.1 else None) for i in range(1, 15)]
        rows += [(page, i, box) for i, box in boxes]
        want[page] = plain_order(boxes, 1200)
    df = spark.createDataFrame(rows, "page_id int, id int, box array<int>")
    got = pages.reading_order(df, F.lit(1200), ["page_id"], "id").collect()
    for page, order in want.items():
        assert [r.id for r in sorted((r for r in got if r.page_id == page), key=lambda r: r.position)] == order


def test_blocks_from_words(spark):
    rows = [("d", 1, 1, 1, 1, 1, "Hello", 0, 0, 10, 5, "90"), ("d", 1, 1, 1, 1, 2, "you", 12, 0, 8, 5, "80"), ("d", 1, 1, 1, 2, 1, "there", 0, 10, 9, 5, "70"), ("d", 1, 1, 1, 2, 2, "x", 0, 10, 900, 5, "-1"), ("d", 1, 1, 1, 2, 3, " ", 0, 10, 900, 5, "99"), ("d", 2, 1, 1, 1, 1, "p2", 0, 0, 3, 3, "50"), ("d", 2, 1, 1, 1, 2, "bad", 0, 0, 3, 3, "abc")]
    df = spark.createDataFrame(rows, "doc string, page int, block int, paragraph int, line int, word int, text string, left int, top int, width int, height int, confidence string")
    got = {(r.page, r.block): r for r in pages.blocks_of(pages.usable_words(df)).collect()}
    first = got[1, 1]
    assert (first.text, first.box, first.confidence, first.line_count, first.source_ref) == ("Hello you\nthere", [0, 0, 20, 15], 0.8, 2, "page=1;block=1;par=1")
    assert got[2, 1].text == "p2"
    assert pages.blocks_of(pages.usable_words(df.limit(0))).count() == 0


def test_regions():
    assert pages.merge_regions([]) == []
    assert pages.merge_regions([(0, 0, 100, 10), (0, 12, 100, 10), (0, 100, 100, 10)]) == [(0, 0, 100, 22), (0, 100, 100, 10)]
    assert len(pages.merge_regions([(0, 0, 100, 10), (300, 0, 100, 10), (0, 12, 90, 10), (300, 12, 95, 10)])) == 2
    shuffled = [(0, 24, 100, 10), (0, 0, 100, 10), (0, 12, 100, 10)]
    assert pages.merge_regions(shuffled) == [(0, 0, 100, 34)]
    assert len(pages.merge_regions([(0, 0, 10, 10), (1, 30, 10, 10)], min_iou=0.5)) == 2


def test_structure_errors():
    ad = '{"confidence": {"overall": 0.5}}'
    assert validation.structural_errors('{"schema_version": "1.0", "advertisements": [' + ad + "]}") == []
    bad = ['{"confidence": {"overall": NaN}}', '{"confidence": {"overall": 1.1}}', '{"confidence": {"overall": 0.5}, "x": 1}', '{"confidence": {"overall": 0.5}, "price": {"amount": -1}}', '{"confidence": {"overall": 0.5}, "price": {"currency": "USD"}}', '{"confidence": {"overall": 0.5}, "language": "fr"}', "{}", '{"confidence": {"overall": 0.5}, "source_block_ids": ["one"]}', '{"confidence": {"overall": "high"}}', '{"confidence": {"overall": 0.5}, "title": "' + "x" * 301 + '"}']
    for b in bad:
        assert len(validation.structural_errors('{"schema_version": "1.0", "advertisements": [' + b + "]}")) == 1, b
    assert validation.structural_errors(None) and validation.structural_errors("{") and validation.structural_errors("[]")


def test_semantic_candidates(spark):
    answer = """{"schema_version": "1.0", "advertisements": [
      {"source_block_ids": [9], "confidence": {"overall": 0.9}},
      {"source_block_ids": [2, 9, 2, 1], "title": " A ", "category": "Cars", "contacts": {"phones": ["077 123 4567", "zz"]}, "confidence": {"overall": 0.7}, "warnings": [{"code": "W", "message": "m"}]},
      {"source_block_ids": [1], "category": "space", "confidence": {"overall": 0.2}}]}"""
    answers = spark.createDataFrame([("p", answer, [1, 2]), ("q", None, [1]), ("r", "broken", [1])], "page_id string, answer string, known_ids array<int>")
    book = spark.createDataFrame([("cars", "vehicles"), ("other", "other")], "key string, slug string")
    got = sorted(validation.semantic_candidates(answers, book).collect(), key=lambda r: r.candidate_index)
    assert [(r.candidate_index, r.source_block_ids, r.title, r.category, r.phones) for r in got] == [(0, [2, 1], "A", "vehicles", ["0771234567", "zz"]), (1, [1], None, "other", [])]
    assert got[0].warning_codes == ["W", "EVIDENCE_BLOCK_UNKNOWN", "PHONE_UNPARSEABLE"] and got[1].warning_codes == ["CATEGORY_UNMAPPED"]


def test_retry_budgets(spark):
    assert validation.retry_outcome([("invalid", 1), ("ok", 2)])[:2] == ("validated", 2)
    assert validation.retry_outcome([("invalid", 1), ("invalid", 2), ("ok", 3)])[:2] == ("failed", 2)
    assert validation.retry_outcome([("retryable", 1)] * 3 + [("ok", 4)])[:2] == ("failed", 3)
    assert validation.retry_outcome([("truncated", 1), ("ok", 2)]) == ("validated", 2, 6144)
    calls = spark.createDataFrame([("a", 2, "ok"), ("a", 1, "invalid"), ("b", 1, "fatal")], "id string, attempt int, result string")
    assert {(r.id, r.outcome) for r in validation.retry_outcomes(calls, "id").collect()} == {("a", "validated"), ("b", "failed")}


def test_wire_formats(spark):
    bodies = {"messages": '{"content":[{"text":"```json\\n{}\\n```"}],"stop_reason":"max_tokens","usage":{"output_tokens":3}}', "generate": '{"candidates":[{"content":{"parts":[{"text":"{}"}]},"finishReason":"MAX_TOKENS"}],"usageMetadata":{"candidatesTokenCount":3}}', "chat": '{"choices":[{"message":{"content":"{}"},"finish_reason":"length"}],"usage":{"completion_tokens":3}}'}
    for wire, body in bodies.items():
        r = spark.createDataFrame([(body,)], "b string").select(validation.wire_answer(F.col("b"), wire).alias("a")).collect()[0].a
        assert tuple(r) == ("{}", "truncated", 3), wire


def test_schema_dialects():
    schema = {"$defs": {"A": {"type": "object", "properties": {"x": {"anyOf": [{"type": "string"}, {"type": "null"}], "default": None}}}}, "type": "object", "properties": {"a": {"$ref": "#/$defs/A"}}}
    assert "$defs" not in validation.inline_refs(schema)
    assert validation.strict_schema(schema)["properties"]["a"]["required"] == ["x"]
    assert validation.nullable_schema(schema)["properties"]["a"]["properties"]["x"] == {"type": "string", "nullable": True}


def test_records(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("a", 2, "y")], "k string, v int, s string")
    assert {(r.k, r.s) for r in records.latest(df, ["k"], ["v"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.k, r.s) for r in records.first_per(df, ["k"], ["v", "s"]).collect()} == {("a", "x"), ("b", "z")}
    events = spark.createDataFrame([("i", 1, 5), ("i", 2, -2), ("j", 1, 1)], "k string, seq int, d int")
    got = {r.k: (r.state, r.n_events) for r in records.fold_events(events, "k", ["seq"], F.lit(0), lambda s, e: s + e["d"]).collect()}
    assert got == {"i": (3, 2), "j": (1, 1)}
    assert records.latest(df.limit(0), ["k"], ["v"]).count() == 0


def test_engine_seam(spark):
    from pressmill.operators import engines

    def shout(batches):
        for b in batches:
            yield b.assign(answer=b["text"].str.upper())[["request_hash", "answer"]]

    requests = spark.createDataFrame([("h1", "a"), ("h2", "b"), ("h2", "b")], "request_hash string, text string")
    recorded = spark.createDataFrame([("h1", "kept")], "request_hash string, answer string")
    out = engines.run_engine(requests, shout, "request_hash string, answer string", recorded, at_once=1)
    assert sorted(map(tuple, out.collect())) == [("h1", "kept"), ("h2", "B")]
    ids = spark.createDataFrame([("op_a",), ("a b",), ("x" * 65,), ("",), (None,)], "v string").select(engines.operator_id(F.col("v"))).collect()
    assert [r[0] for r in ids] == [True, False, False, False, False]
