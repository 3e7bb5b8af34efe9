import pytest

from pressmill.llm import ocrtext

WORDS = ["house", "for", "sale", "නිවස", "විකිණීමට", "வீடு", "விற்பனைக்கு", "extraordinarily", "comfortable", "accommodation"]
LEXICON = ocrtext.Lexicon(dict.fromkeys(WORDS, 1000))


@pytest.mark.parametrize("words", [["house", "for", "sale"], ["නිවස", "විකිණීමට"], ["வீடு", "விற்பனைக்கு"], ["extraordinarily", "comfortable", "accommodation", "for", "sale"]])
def test_run_together_words(words):
    """Three words and more, words with vowel signs and virama, and runs over 40 letters are split."""
    assert ocrtext.viterbi(["".join(words) + "."], LEXICON) == [*words[:-1], words[-1] + "."]
    assert ocrtext.viterbi(["xq" + "".join(words)], LEXICON) == ["xq" + "".join(words)]


def test_joint_reading():
    """A break, a confusion, a split and a merge are decided in one search."""
    words = {"the": 9000, "quiet": 500, "quietly": 600, "served": 700, "clay": 300, "day": 4000, "harbour": 800, "view": 900}
    lexicon = ocrtext.Lexicon(words, {("c", "e"): 0.001, ("cl", "d"): 0.003, ("1", "l"): 0.005})
    page = ocrtext.decode("the qui-\net1y\nserved clay har bour theview", lexicon, ocrtext.Heads([]), repair=True)
    assert page.noises == [(1, "hyphen_break"), (2, "misread")]
    assert page.paragraphs == ["the quietly served clay harbour the view"]
    assert ocrtext.viterbi(["theharb0urview"], lexicon) == ["theharb0urview"] and ocrtext.viterbi(["theharbcurview"], lexicon)


def test_words_of_another_script_in_place_of_native_ones():
    lexicon = ocrtext.Lexicon({"වාහනය": 500, "විකිණීමට": 500, "SITUATIONS": 90, "Pasqo": 90, "situations": 3})
    noises = lambda t: ocrtext.decode(t, lexicon, ocrtext.Heads([])).noises
    for bad in ("වාහනය QDIn විකිණීමට", "QDIn 12 විකිණීමට", "වාහනය\nCOMOJ\nවිකිණීමට", "GDuo) වාහනය"):
        assert [k for _, k in noises(bad)] == ["misread"], bad
    for good in ("SITUATIONS VACANT\nවාහනය විකිණීමට", "Pasqo වාහනය", "VACANT SITUATIONS", "වාහනය\nVACANT\nPasqo", "TV වාහනය"):
        assert noises(good) == [], good
    assert noises("වාහ-\nQDIn විකිණීමට") == [(1, "hyphen_break"), (2, "misread")]


def test_rare_words_come_from_the_whole_table(spark):
    """Words too rare to be shipped are joined from the table: the share changes where a word comes from, not the result."""
    rows = [("p", str(i), "the quiet harbour view\nwas served in Sikethota") for i in range(60)]
    rows += [("p", "a", "the qu1et harb0ur\nin 5ikethota"), ("p", "b", "COMOJ 4"), ("p", "c", "Sikethofa 12 harbour"), ("p", "d", "a viewserved quiet")]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string")
    results = []
    for share in (1e-9, 0.5):
        learned = ocrtext.learn(df, share=share)
        noise = sorted(map(tuple, ocrtext.line_noise(df, learned).collect()))
        results.append((noise, sorted((r.rec_id, r.repaired) for r in ocrtext.repaired(df, learned).collect())))
    assert results[0] == results[1]
    assert ("p", "a", 1, "misread") in results[0][0] and ("p", "c", 1, "misread") in results[0][0]
    assert dict(results[0][1])["d"] == "a view served quiet"


def test_rare_heads_come_from_the_whole_table(spark):
    rows = [("p", f"x{i}", f"{i}  LAKE SIDE HERALD\n\nthe view") for i in range(40)] + [("p", f"y{i}", f"{i}  QUIET TOWN NEWS\n\nthe view") for i in range(3)]
    rows.append(("p", "a", "QUIET COMOJ NEWS\n\nthe view"))
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string")
    for head_share in (1e-3, 0.5, 1.1):
        found = {(r.rec_id, r.line_no) for r in ocrtext.line_noise(df, ocrtext.learn(df, head_share=head_share)).collect() if r.noise == "running_header"}
        assert {("a", 1), ("y0", 1), ("x1", 1)} <= found, head_share


def test_confusion_rates():
    """A word of its own that looks like a misreading is not one."""
    words = {w: 10_000 for w in ("day", "food", "dark", "road", "land")} | {"clay": 1200, "focl": 0, "foocl": 30, "clark": 45, "roacl": 25, "lancl": 40}
    lexicon = ocrtext.Lexicon(words)
    assert 0.001 < lexicon.rates["cl", "d"] < 0.005
    assert ocrtext.judge(lexicon, "clay")[2] == () and ocrtext.judge(lexicon, "lancl")[1] == "land"
