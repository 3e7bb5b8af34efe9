import unicodedata

import pytest
from pyspark.sql import functions as F

from pressmill.functions import geometry as g
from pressmill.functions import keys
from pressmill.functions import text as tx


def values(spark, column, rows, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column(F.col("v"))).collect()]


def test_phones(spark):
    rows = ["0771234567", "+94 77 123 4567", "771234567", "(011) 234-5678", "94771234567", "12345", "", None, "077 123 456 789", "no phone"]
    assert values(spark, tx.normalize_phone, rows) == ["0771234567", "0771234567", "0771234567", "0112345678", "0771234567", None, None, None, None, None]


def test_phone_lists(spark):
    got = values(spark, tx.normalize_phones, [["077 1234567", "0771234567", "call", None, " "], [], None], "v array<string>")
    assert (got[0].phones, got[0].unparseable) == (["0771234567", "call"], True)
    assert (got[1].phones, got[1].unparseable) == ([], False) and got[2].phones is None


def test_filenames(spark):
    rows = ["../../etc/passwd", "C:\\a\\b.png", "...hidden", "", "con.txt", 'a"b\r\n.jpg', "x" * 300, "NUL", None]
    got = values(spark, tx.safe_filename, rows)
    assert got == ["passwd", "b.png", "hidden", "upload", "file-con.txt", "ab.jpg", "x" * 255, "file-NUL", None]


def test_sanitize_and_clean(spark):
    odd = "e" + chr(0x301) + chr(0x202E) + "a" + chr(0) + "\n\t" + chr(0x7F)
    assert values(spark, tx.sanitize, [odd, None]) == [unicodedata.normalize("NFC", "é") + "a\n\t", None]
    assert values(spark, tx.clean, [chr(0xA0) + " x " + chr(0x3000), "   ", None]) == ["x", None, None]


def test_rule_based_fields(spark):
    text = " - \nToyota car for sale\nRs 1,250,000 Kandy 5\nCall 0771234567"
    lines = values(spark, tx.joined_lines, [text])[0]
    assert lines == ["Toyota car for sale", "Rs 1,250,000 Kandy 5", "Call 0771234567"]
    joined = " ".join(lines)
    assert values(spark, tx.first_price, [joined, "free"]) == ["Rs. 1,250,000", "Price pending"]
    assert values(spark, tx.first_location, [joined, "near GALLEface", "x"]) == ["Kandy 5", "Galle", "Location pending"]
    assert values(spark, tx.keyword_category, [joined, "take care", "zzz"]) == ["Vehicles", "Vehicles", "Other"]
    assert values(spark, tx.scan_phones, ["0771234567 +94771234567 0771234567"]) == [["0771234567", "+94771234567"]]


def test_language_and_data_urls(spark):
    assert values(spark, tx.script_language, ["abc", "අආ", "අආ ab", "අආඇඈඉඊ a", "12", ""]) == ["en", "si", "mixed", "si", "unknown", "unknown"]
    assert [bytes(b) if b is not None else None for b in values(spark, tx.decode_data_url, ["data:text/plain;base64,aGk=", "data:x;base64,!!", "aGk=", None])] == [b"hi", None, None, None]


def test_templates_and_fences(spark):
    assert tx.render_template("a {{x}} {{y}}", {"x": "1", "y": "2"}) == "a 1 2"
    for values_ in ({"x": "1"}, {"x": "1", "y": "2", "z": "3"}):
        with pytest.raises(ValueError):
            tx.render_template("a {{x}} {{y}}", values_)
    assert values(spark, tx.unfence, ['```json\n{"a":1}\n```', '{"a":1}']) == ['{"a":1}', '{"a":1}']


def test_two_decimals_as_python(spark):
    rows = [0.125, 0.945, 1.0, None]
    assert values(spark, tx.two_decimals, rows, "v double") == ["0.12", "0.94", "1.00", None]


def test_boxes(spark):
    df = spark.createDataFrame([([0, 0, 10, 10], [5, 5, 10, 10]), ([0, 0, 10, 10], [20, 0, 5, 5]), ([0, 0, 0, 0], [0, 0, 0, 0])], "a array<int>, b array<int>")
    a, b = F.col("a"), F.col("b")
    got = df.select(g.shared_area(a, b), F.round(g.iou(a, b), 4), g.overlap_ratio(a, b), g.union(a, b)).collect()
    assert [tuple(r) for r in got] == [(25, 0.1429, 0.5, [0, 0, 15, 15]), (0, 0.0, 0.0, [0, 0, 25, 10]), (0, 0.0, 0.0, [0, 0, 0, 0])]


def test_python_mean(spark):
    rows = [[0.9126, 0.8961, 0.8432, 0.8302], [], None, [None, 0.5], [0.1, 0.2, 0.3]]
    want = [round(sum(r) / len(r), 4) if r and None not in r else None if not r else 0.5 for r in rows]
    assert values(spark, g.python_mean, rows, "v array<double>") == want


def test_keys(spark):
    assert keys.params_hash("page", "v1", {"b": 2, "a": 1}) == keys.params_hash("page", "v1", {"a": 1, "b": 2})
    assert len(keys.prompt_checksum("a", "b", "c")) == 12 and keys.prompt_checksum("ab", "", "c") != keys.prompt_checksum("a", "b", "c")
    assert values(spark, lambda v: keys.original_key(v, F.lit("image/png")), ["abcdef"]) == ["originals/ab/cd/abcdef.png"]
    assert values(spark, lambda v: g.backoff(v), [1, 2, 5, 9], "v int") == [2.0, 4.0, 32.0, 60.0]
