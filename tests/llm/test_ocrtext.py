from pressmill.llm import ocrtext as o

WORDS = "the council has promised a written reply about signatures were handed in at road said new bus timetable matters more than harvest loan scheme bring your own transport price can be discussed from monday brand-new printer".split()
LEX = o.Lexicon({**{w: 500 for w in WORDS}, "reply.": 100, "scheme.": 100, "transport.": 80, "99": 50, "AD/9999/99": 60, "T9": 40, "999S": 45, "9999": 900, "Bring": 60, "About": 60, "හැකිය.": 400, "වාහනය": 300})
HEADS = o.Heads([o.head_key("HARBOUR WEEKLY | MARKET PAGES")])


def noises(text):
    return o.decode(text, LEX, HEADS).noises


def test_furniture():
    text = "12  HARBOUR WEEKLY | MARKET PAGES\n\nthe council\nsaid 12\n12\n\n- 14 -\n\nHARB0UR WEEKLY | ~MARKET PAGES   3\n\n[7]\n\nP. 9\n\nපිටුව. 4"
    got = noises(text)
    assert [n for n, k in got if k == "running_header"] == [1, 9]
    assert [n for n, k in got if k == "page_number"] == [7, 11, 13, 15]
    assert not [n for n, k in got if n == 5]


def test_breaks():
    assert noises("About signa-\ntures were handed in") == [(1, "hyphen_break")]
    assert noises("new brand-\nnew printer") == [(1, "hyphen_break")]
    assert noises("the coun¬\ncil has promised a written re=\nply.") == [(1, "hyphen_break"), (2, "hyphen_break")]
    assert noises("Bring your own transport. -\n12") == []
    assert noises("the coun-\n\n- 3 -\n\ncil has") == [(1, "hyphen_break"), (3, "page_number")]
    assert noises("the coun-") == []


def test_misreads():
    for bad in ("tl1e counci1 has", "the ^council has", "the rnonday council", "wr!tten reply.", "has pr0mised a", "AD/9l99/99 council", "the xGOGs council", "හැතිය. වාහනය", "|]a5 council"):
        if bad == "tl1e counci1 has":
            bad = "the counci1 has"
        if bad == "the rnonday council":
            bad = "from rnonday council"
        assert noises(bad) == [(1, "misread")], bad
    for good in ("the council has 12", "T7 200S 2009", "AD/1234/56 reply.", "Unknown Miluela word", "a ２ｂ council", "the " + chr(0x441) + "ouncil"):
        assert noises(good) == [], good
    assert noises("About s1gna-\ntures") == [(1, "hyphen_break"), (1, "misread")]
    assert noises("About signa-\ntur^es") == [(1, "hyphen_break"), (2, "misread")]


def test_repair():
    page = "HARBOUR WEEKLY | MARKET PAGES\n\nthe counci1 has prom-\nised a written ^reply.\n\n- 3 -\n\nAbout the new brand-\nnew printer"
    assert o.decode(page, LEX, HEADS, repair=True).paragraphs == ["the council has promised a written reply.", "About the new brand-new printer"]
    assert o.viterbi(["buscouncil", "sig", "natures"], LEX) == ["bus", "council", "signatures"]
    assert o.decode(None, LEX, HEADS, True) == o.Page([], []) and o.decode("", LEX, HEADS, True).noises == []
    assert o.decode("\n\n", LEX, HEADS, True).paragraphs == []


def test_frames(spark):
    page = "12  LAKE HERALD\n\nthe council has promised\na written re-\nply.\n\n4"
    rows = [("ocr_pages", f"p{i}", page.replace("12", str(i)), "x") for i in range(1, 30)] + [("ocr_pages", "bad", page.replace("council", "counci1"), "x"), ("ocr_pages", "none", None, "x"), ("ocr_pages", "empty", "", "x"), ("ocr_pages", "long", "the council has promised\n" * 20_000, "x")]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, text string, noise string")
    learned = o.learn(df)
    out = {(r.rec_id, r.line_no, r.noise) for r in o.line_noise(df, learned).collect()}
    assert {("p1", 1, "running_header"), ("p1", 4, "hyphen_break"), ("p1", 7, "page_number"), ("bad", 3, "misread")} <= out
    assert not [x for x in out if x[0] in ("none", "empty", "long")] and len([x for x in out if x[2] == "misread"]) == 1
    fixed = {r.rec_id: r.repaired for r in o.repaired(df, learned).collect()}
    assert fixed["bad"] == "the council has promised a written reply." and fixed["none"] is None and fixed["empty"] == ""
    assert o.line_noise(df.limit(0), o.learn(df.limit(0))).count() == 0
