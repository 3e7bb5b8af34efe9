import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from pressmill.llm import lookalike as k

CASES = [
    ("２０１９ Tａble", "2019 Table"), ("Cafe" + chr(0x301), "Café"), ("Café", "Café"), ("a" + chr(0x200B) + "b", "ab"), ("a" + chr(0xA0) + "b" + chr(0x3000), "a b "),
    ("P" + chr(0x430) + "ge", "Page"), ("дом", "дом"), ("ﬂoor oﬃce", "floor office"), ("x²½", "x²½"), ("“quoted” – dash", "“quoted” – dash"),
    ("අවශ්‍යයි", "අවශ්‍යයි"), ("ක‍ර", "කර"), ("දො", "දො"), ("අාදර", "ආදර"), ("soft" + chr(0xAD) + "en", "soften"), ("a" + chr(0x2011) + "b", "a-b"), ("", ""), (None, None),
]


def test_forms():
    for raw, want in CASES:
        assert k.plain_form(raw) == want, (raw, want)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(st.sampled_from("ab é́ාෙදෝ‍ර２ａﬁ​ ​аｏ\n."), max_size=20))
def test_idempotent_and_local(text):
    once = k.plain_form(text)
    assert k.plain_form(once) == once
    assert unicodedata.is_normalized("NFC", once)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text(st.characters(max_codepoint=0x2FF, exclude_categories=("Cc", "Cs")), max_size=30))
def test_splice_equals_whole(text):
    """Splicing segments gives what normalising the whole text at once gives."""
    whole = k._WORDS.sub(lambda w: k.latin_word(w[0]), k.plain_segment(text))
    assert k.plain_form(text) == whole


def test_frames(spark):
    rows = [(i, t, "n") for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], "n"), (99, "x" * 200_000 + "ａ", "n")]
    df = spark.createDataFrame(rows, "id int, title string, plain_ string")
    out = k.plain_column(df, "title", "plain")
    got = {r.id: r.plain for r in out.collect()}
    assert out.count() == len(rows) and all(got[i] == w for i, (_, w) in enumerate(CASES)) and got[99].endswith("xa")
    changed = {r.id for r in k.changed(df, "title").collect()}
    assert changed == {i for i, (t, w) in enumerate(CASES) if t != w} | {99}
    assert k.changed(df.limit(0), "title").count() == 0
