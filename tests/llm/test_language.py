import random

from pressmill.llm import language as lang

EN = ["The council has promised a written reply", "Photographs can be sent this week", "No dealers please", "Water and electricity lines are in running order", "The upper floor was finished with care", "Serious buyers only", "Work begins on weekends and transport is supplied", "Can be inspected near the post office"]
SI = ["mila katha karala adu karanna puluwan", "photo oone nam ewannam", "hawasa passe enna balanna", "brokerla epa aithikaru witharak kathakaranna", "wahanaya hari hondata thiyenawa", "gedara langa kade ekakata wada karanna", "ikmanata wikunanna oone nisa ganan adui", "kamara hatharak ekka thiyenawa"]
TA = ["vandi romba nalla nilaimaiyila irukku", "vilai pesi kuraikkalam", "maalai manikku piragu vaanga", "kadaikku velaikku aal thevai", "nalla veedu onnu vikka irukku", "puthu tyre pottirukku", "kuliyal arai ellam irukku", "number thaan ezhuthunga"]
NATIVE = {"si": "මිල සාකච්ඡා කළ හැකිය.", "ta": "விலை பேசித் தீர்மானிக்கலாம்."}


def sample(rnd, wrong=0.05):
    rows = []
    for label, pool in (("en", EN * 3), ("si", SI), ("ta", TA)):
        for _ in range(len(pool) * 12):
            text = ". ".join(rnd.sample(pool, 3)) + "."
            rows.append((rnd.choice(lang.LANGUAGES) if rnd.random() < wrong else label, text))
    return rows


MODEL = lang.fit(sample(random.Random(1)))


def test_held_out_accuracy():
    rnd = random.Random(2)
    right = total = 0
    for label, pool in (("en", EN), ("si", SI), ("ta", TA)):
        for _ in range(60):
            right += lang.infer(MODEL, ". ".join(rnd.sample(pool, 2)) + ".")[0] == label
            total += 1
    assert right / total >= 0.97


def test_labels():
    cases = [
        (NATIVE["si"], "si"), (NATIVE["ta"], "ta"), (NATIVE["si"] + " " + EN[0] + ".", "mixed"), (SI[0] + ". " + EN[1] + ".", "mixed"), (NATIVE["ta"] + "\n" + SI[3] + ".", "mixed"),
        (NATIVE["si"] + " " + SI[0] + ".", "si"), ("2018 වර්ෂයේ Kobrin Nova වාහනය විකිණීමට ඇත.", "si"), (NATIVE["si"] + " a.b at post dot example dot net", "si"), (NATIVE["si"] + " zero seven nine zero five nine six five nine seven.", "si"),
        ("", None), (None, None), ("12 / 34", None), ("   ", None),
    ]
    for text, want in cases:
        assert lang.infer(MODEL, text)[0] == want, text


def test_em_is_the_best_proportion():
    ll = [(-1.0, -9.0, -9.0)] * 3 + [(-9.0, -1.0, -9.0)]
    total, pi = lang.proportions(ll, (0, 1), rounds=200)
    assert abs(pi[0] - 0.75) < 0.01
    import math

    best = max(sum(math.log(p * math.exp(a) + (1 - p) * math.exp(b)) for a, b, _ in ll) for p in [i / 100 for i in range(1, 100)])
    assert abs(total - best) < 1e-3


def test_frames(spark):
    rows = [("a", EN[0] + ".", "x"), ("b", None, "x"), ("c", "", "x"), ("d", (EN[0] + ". ") * 5000, "x"), ("a", EN[0] + ".", "x")]
    df = spark.createDataFrame(rows, "rec_id string, text string, lang_ string")
    out = lang.classify(df, MODEL, ["rec_id", "lang_"])
    assert sorted(r.rec_id for r in out.collect()) == ["a", "a", "b", "c", "d"]
    got = {r.rec_id: (r.lang, r.confidence) for r in out.collect()}
    assert got["a"][0] == "en" and got["a"][1] > 0.9 and got["b"] == (None, 0.0) and got["c"] == (None, 0.0) and got["d"][0] == "en"
    assert out.count() == 5 and lang.classify(df.limit(0), MODEL, ["rec_id"]).count() == 0


def test_fit_on_frame(spark):
    df = spark.createDataFrame([*sample(random.Random(3)), (None, "abc def"), ("mixed", "abc def"), ("en", None)], "label string, text string")
    model = lang.fit_on(df, max_rows=100)
    assert lang.infer(model, SI[0] + ". " + SI[1])[0] == "si" and lang.infer(model, EN[0] + ". " + EN[1])[0] == "en"
    empty = lang.fit_on(df.limit(0))
    assert lang.infer(empty, NATIVE["ta"])[0] == "ta"


def _fitted():
    import random

    from pressmill.llm import language

    rnd = random.Random(1)
    en = "the council has promised a written reply about new bus timetable and the price of rice in town this week".split()
    si = "නිවසක් විකිණීමට ඇත ඉඩමක් මිල ගණන් සාකච්ඡා කළ හැකිය වාහනය".split()
    ta = "வீடு விற்பனைக்கு உள்ளது காணி விலை பேசித் தீர்மானிக்கலாம் வாகனம்".split()
    rows = [(k, " ".join(rnd.choices(w, k=8)) + ".") for k, w in (("en", en), ("si", si), ("ta", ta)) for _ in range(60)]
    return language, language.fit([*rows, *[("en", t) for k, t in rows if k == "si"][:12]])


def test_native_names_in_latin_sentences():
    """A town in another script does not turn a sentence; a native sentence stays itself around brand names."""
    language, model = _fitted()
    assert language.infer(model, "the council has promised a new bus timetable for people in මිලුඇල this week.")[0] == "en"
    assert language.infer(model, "the council has promised a new bus timetable in மிலுஎல.")[0] == "en"
    assert language.infer(model, "Pasqo වාහනය විකිණීමට ඇත.")[0] == "si" and language.infer(model, "Pasqo வாகனம் விற்பனைக்கு உள்ளது.")[0] == "ta"


def test_segments_of_mixed_texts(spark):
    language, model = _fitted()
    text = "the council has promised a written reply. 12. නිවසක් විකිණීමට ඇත ඉඩමක්. මිල ගණන් සාකච්ඡා කළ හැකිය.\nவீடு விற்பனைக்கு உள்ளது காணி விலை."
    label, _, _, shares = language.infer(model, text)
    parts = language.segments(model, text, shares)
    assert label == "mixed" and [p[2] for p in parts] == ["en", "si", "ta"] and all(p[3] > 0.9 for p in parts)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    df = spark.createDataFrame([("a", text), ("b", "the council has promised a reply."), ("c", None), ("d", "")], "id string, text string")
    got = {r.id: r.parts for r in language.classify(df, model, ["id"], parts=True).collect()}
    assert [p.lang for p in got["a"]] == ["en", "si", "ta"] and got["b"] is None and got["c"] is None and got["d"] is None
