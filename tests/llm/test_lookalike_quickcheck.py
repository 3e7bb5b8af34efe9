import random
import re
import unicodedata

from pressmill.llm import lookalike


def test_whatever_composition_changes_is_noticed():
    """The quick check never calls a text stable that NFC would change: all scripts, marks in any order."""
    rnd = random.Random(5)
    marks = [chr(c) for low, high in lookalike.BLOCKS for c in range(low, high) if unicodedata.combining(chr(c))]
    apart = [unicodedata.normalize("NFD", chr(c)) for low, high in (*lookalike.BLOCKS, (0xAC00, 0xAE00)) for c in range(low, high) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    texts = [*apart, *["".join([rnd.choice(apart), *rnd.sample(marks, rnd.choice((1, 2)))]) for _ in range(3000)], *["x" + "".join(rnd.sample(marks, 2)) for _ in range(2000)]]
    check = lookalike.quick_check()
    for t in texts:
        if unicodedata.normalize("NFC", t) != t:
            assert check.search(t), [hex(ord(c)) for c in t]


def test_other_scripts():
    cases = {"か\u3099": "が", "\u1112\u1161\u11ab": "한", "\u0627\u0653": "آ", "\u09c7\u09be": "ো", "\U0002f800": "丽", "가\u11a8": "각"}
    for odd, plain in cases.items():
        assert lookalike.plain_form("a " + odd + " b") == "a " + plain + " b", plain
        assert lookalike.plain_form(plain) == plain


def test_real_foreign_words_stay():
    assert lookalike.plain_form("дом сор") == "дом сор" and lookalike.plain_form("a сор b") == "a cop b"
    assert lookalike.plain_form("дом аnd") == "дом and"


def test_java_pattern_is_the_same(spark):
    texts = ["plain", "か\u3099", "\u1112\u1161", "\u0627\u0653", "\U0002f800", "ක්\u200dෂ", "é", "e\u0301", "x\u0323\u0307", "\U0001d400", "සිංහල", "தமிழ்", "ෙ\u0dcf", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(lookalike.maybe_unstable(df.t).alias("m")).collect()]
    assert got == [None if t is None else bool(lookalike.quick_check().search(t)) for t in texts]
    assert re.search("..", "ab")
