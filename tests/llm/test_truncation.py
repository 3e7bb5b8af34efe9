import random

from pressmill.llm import truncation as t

SENTENCES = ["The council has promised a written reply.", "Photographs can be sent after five in the evening.", "Water and electricity lines are in running order.", "Work begins this week with transport supplied.", "වාහනය ඉතා හොඳ තත්ත්වයේ පවතී."]
CLOSE = "Call after 5 pm"


def corpus():
    rnd = random.Random(7)
    rows = [(i, "a", " ".join(rnd.sample(SENTENCES, 3)) + ("" if i % 3 else " " + (CLOSE if i % 2 else f"07{i:08d}"))) for i in range(120)]
    cases = {
        1001: ("Work begins this week with transport supplied. Photographs can be se", True), 1002: ("The council has promised a", True), 1003: ("Water and electricity lines are in", True),
        1004: ("The council has promised a written reply...", False), 1005: ("Photographs can be sent after fi…", True), 1006: ("The council has promised a wri [more]", True), 1007: ("Work begins this >>", True),
        1008: ("Work begins this week with transport supplied. 0731234567", False), 1009: ("The council has promised a written reply. Call after 5 pm", False), 1010: ("Work begins this week with transport supplied. 07312", True),
        1011: ("", False), 1012: (None, False), 1013: ("  \n ", False), 1014: ("Serious?", False), 1015: ("වාහනය ඉතා හොඳ තත්ත්", True), 1016: ("Photographs can be sent after...", True), 1017: ("The council has promised a written reply. [more]", False),
    }
    return rows, cases


def test_judgement(spark):
    rows, cases = corpus()
    df = spark.createDataFrame([*rows, *[(i, "b", text) for i, (text, _) in cases.items()]], "doc_id bigint, source string, text string").selectExpr("*", "1 AS cut", "'x' AS ending")
    got = {r.doc_id: r.cut for r in t.judged(df).collect()}
    assert {i: got[i] for i in cases} == {i: want for i, (_, want) in cases.items()}
    assert not any(got[i] for i, *_ in rows)
    rates = {r.source: (r.n_docs, r.n_cut) for r in t.source_rates(t.judged(df)).collect()}
    assert rates == {"a": (120, 0), "b": (len(cases), sum(w for _, w in cases.values()))}


def test_copies_are_one_text(spark):
    rows, _ = corpus()
    df = spark.createDataFrame([*rows, *[(2000 + i, "b", "Odd new start of somethi") for i in range(9)]], "doc_id bigint, source string, text string")
    assert {r.cut for r in t.judged(df).where("source = 'b'").collect()} == {True}


def test_edges(spark):
    schema = "doc_id bigint, source string, text string"
    assert t.judged(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, "a", "word"), (2, None, "One."), (1, "a", "word"), (3, "a", "word " * 60_000)], schema)
    assert t.judged(one).count() == 4
