import random

import pytest

from pressmill.llm import canonical as c


def edits(a, b):
    """Plain edit distance with swaps."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_walk_finds_what_brute_force_finds():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 9))) for _ in range(150)]
    trie = c.Trie([(f"e{i}", w, "") for i, w in enumerate(words)])
    for _ in range(200):
        q = "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 10)))
        for most in (0, 1, 2, 3):
            want = {f"e{i}": edits(q, w) for i, w in enumerate(words) if edits(q, w) <= most}
            assert trie.within(q, most) == want, (q, most)


FORMS = [("location", "l1", "Hayewaawila", "Sopaledesa"), ("location", "l1", "හයෙවාවිල", "Sopaledesa"), ("location", "l2", "Nusogama", "Tasododesa"), ("location", "l3", "Miluela", "Goyorata"), ("location", "l4", "Miluola", "Hanarata"), ("category", "home_garden", "Home & Garden", ""), ("category", "home_garden", "home_garden", ""), ("category", "jobs", "job", ""), ("category", "jobs", "jobs", "")]
CASES = [
    ("location", "HAYEWAAWILA  ", "l1"), ("location", "near Nusogama town", "l2"), ("location", "Nusogama - Tasododesa District", "l2"), ("location", "(Hayewaawila)", "l1"), ("location", "Nusogama 08", "l2"),
    ("location", "Hayew.", "l1"), ("location", "Nus ogama", "l2"), ("location", "Nusog-ama", "l2"), ("location", "nussogama", "l2"), ("location", "hayevaawila", "l1"), ("location", "හයෙවාවිල", "l1"),
    ("location", "Miluula, Hanarata", "l4"), ("location", "Miluula, Goyorata", "l3"), ("location", "Gesugaovik", "unmatched"), ("location", "???", "unmatched"), ("location", "-", "unmatched"),
    ("category", "Home  & Garden ads", "home_garden"), ("category", "Jobss", "jobs"), ("category", "lost cat", "unmatched"), ("category", "", None), ("category", None, None), ("other", "x", "unmatched"),
]


def frames(spark):
    values = spark.createDataFrame([(str(i), f, v, i) for i, (f, v, _) in enumerate(CASES)], "cand_id string, fld string, value string, entry int")
    return values, spark.createDataFrame(FORMS, "fld string, entry string, form string, context string")


@pytest.mark.parametrize("shard", [1000, 3])
def test_mapping(spark, shard):
    values, forms = frames(spark)
    got = {r.cand_id: r.canonical for r in c.match_values(values, forms, max_entries=shard).collect()}
    assert {CASES[int(i)]: v for i, v in got.items()} == {case: case[2] for case in CASES}


def test_edges(spark):
    values, forms = frames(spark)
    assert c.match_values(values.limit(0), forms).count() == 0
    assert {r.canonical for r in c.match_values(values, forms.limit(0)).collect()} == {"unmatched", None}
    twice = c.match_values(values.unionByName(values), forms)
    assert twice.count() == 2 * len(CASES) and "entry" in twice.columns
    long = spark.createDataFrame([("location", "x" * 50_000)], "fld string, value string")
    assert c.match_values(long, forms).collect()[0].canonical == "unmatched"


def test_memo_is_bounded():
    memo = c.Memo(3)
    for k in "abcdab":
        memo.of(k, str.upper)
    assert len(memo) == 3 and memo.of("b", lambda k: "no") == "B"


def test_all_entries_within_the_distance(spark):
    """Every entry within the length-dependent distance is given, as brute force finds it, the chosen one first."""
    names = ["Miluela", "Milueli", "Milaela", "Goyorata", "Goyoratha", "Hayewaawila"]
    forms = spark.createDataFrame([("location", f"l{i}", n, "") for i, n in enumerate(names)], "fld string, entry string, form string, context string")
    values = [("location", v) for v in ("Miluela", "miluel", "Goyorat", "zzzzzz", "", None)]
    rows = c.all_matches(spark.createDataFrame(values, "fld string, value string"), forms).collect()
    trie = c.Trie([(f"l{i}", n, "") for i, n in enumerate(names)])
    for _, value in values[:3]:
        got = [(r.distance, r.canonical) for r in sorted(rows, key=lambda r: r.place) if r.value == value]
        query = c.readings(value)[0][0]
        near = {e: d for e, d in trie.within(query, c.allowed_distance(len(query))).items()}
        assert {e for _, e in got} == set(near) and got[0] == trie.nearest(value)[::-1]
    assert [(r.place, r.canonical, r.distance) for r in rows if r.value == "zzzzzz"] == [(1, "unmatched", None)]
    assert not [r for r in rows if not r.value]
