import random

import numpy as np
import pytest

from pressmill.llm import mixing, packing, tokens


def test_least_sum_of_squares():
    """Every placement is a best one by the definition of the method."""
    rnd = random.Random(4)
    p = packing.Packer(20)
    for _ in range(300):
        size = rnd.randint(1, 20)
        n = p.count.copy()
        options = []
        for h in [0, *[h for h in range(1, 20) if n[h]]]:
            if h + size <= 20:
                m = n.copy()
                if h:
                    m[h] -= 1
                if h + size < 20:
                    m[h + size] += 1
                options.append(int((m.astype(int) ** 2).sum()))
        p.put(size)
        assert int((p.count.astype(int) ** 2).sum()) == min(options)


def test_pack(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice((3, 50, 120, 255, 256, 257, 900))) for i in range(2000)] + [(5000, 0), (5001, 0), (7, 10)]
    sized = spark.createDataFrame(rows, "doc_id bigint, tokens int")
    packs = spark.createDataFrame([(1, 256), (2, 512), (3, None), (4, 0)], "pack_id int, capacity_tokens int")
    out = packing.pack(sized, packs, shard_docs=500).toPandas()
    for pack_id, capacity in ((1, 256), (2, 512)):
        mine = out[(out.pack_id == pack_id) & out.container_id.notna()]
        by = mine.groupby("container_id")
        assert (by.tokens.sum() <= capacity).all() and (by.tokens.sum() == by.used_tokens.first()).all()
        assert (mine.used_tokens + mine.unused_tokens == capacity).all()
        whole = mine.groupby("doc_id").tokens.sum()
        assert whole.sum() == sum(t for _, t in rows) and whole.loc[7] == dict(rows[:2000])[7] + 10
        assert (mine.groupby("doc_id").size().loc[[i for i, t in rows[:2000] if t <= capacity and i != 7]] == 1).all()
        assert mine.tokens.sum() / (by.ngroups * capacity) > 0.95
    assert len(out[out.container_id.isna()]) == 4 and set(out.pack_id) == {1, 2}
    assert packing.pack(sized.limit(0), packs).count() == 0


def test_budgets_redistribute_to_siblings_first():
    root = mixing.tree([("a", "en", "s1", 0.25, 10.0), ("a", "en", "s2", 0.25, 1000.0), ("a", "si", "s3", 0.25, 1000.0), ("b", "en", "s4", 0.25, 1000.0)])
    mixing.share_out(root, 400.0)
    got = {x.name: x.budget for x in root.leaves()}
    assert got == {"s1": 10.0, "s2": 190.0, "s3": 100.0, "s4": 100.0}
    tight = mixing.tree([("a", "en", "s1", 0.5, 10.0), ("a", "en", "s2", 0.25, 20.0), ("b", "en", "s4", 0.25, 1000.0)])
    mixing.share_out(tight, 400.0)
    assert {x.name: x.budget for x in tight.leaves()} == {"s1": 10.0, "s2": 20.0, "s4": 370.0}
    assert mixing.exact_total(tight.leaves()) == 20.0


@pytest.mark.parametrize("total", ["exact", "available", 3000.0])
def test_mix(spark, total):
    rnd = random.Random(2)
    rows = [(i, "big", rnd.randint(1, 40)) for i in range(1500)] + [(2000 + i, "small", rnd.randint(1, 9)) for i in range(60)] + [(9000, "big", 0), (9001, None, 5), (9002, "other", 5)]
    rows = [(i, s, "news" if i % 3 else None, "en" if i % 2 else "si", t) for i, s, t in rows]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, domain string, language string, tokens int")
    targets = spark.createDataFrame([(1, "big", 0.6, 2), (1, "small", 0.4, 3), (2, "small", 0.5, 1), (2, "gone", 0.5, 2)], "plan_id int, source string, target_share double, max_repeats int")
    plan = mixing.budgets(mixing.source_supply(sized), targets, total)
    assert len({(b.domain, b.language) for b in plan if b.source == "big"}) == 4
    chosen = mixing.choose(sized, plan).toPandas()
    assert not chosen.duplicated(["plan_id", "doc_id"]).any() and (chosen.repeats >= 1).all()
    assert (chosen[(chosen.plan_id == 1) & (chosen.source == "small")].repeats <= 3).all() and (chosen[chosen.source == "big"].repeats <= 2).all()
    cells = {i: (s, d or "", k or "") for i, s, d, k, _ in rows}
    used: dict = {}
    for p, doc, n, k in zip(chosen.plan_id, chosen.doc_id, chosen.tokens, chosen.repeats):
        used[p, *cells[doc]] = used.get((p, *cells[doc]), 0) + n * k
    for b in plan:
        assert abs(used.get((b.plan_id, b.source, b.domain, b.language), 0) - b.budget) <= 20, b
    report = {(r.plan_id, r.source): r for r in mixing.shares(mixing.choose(sized, plan), plan).collect()}
    if total == "exact":
        assert abs(report[1, "big"].actual_share - 0.6) < 0.02
    assert report[2, "gone"].tokens == 0
    again = mixing.choose(sized, plan).toPandas()
    assert set(map(tuple, again.values.tolist())) == set(map(tuple, chosen.values.tolist()))


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    import os

    if not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)):
        pytest.skip("no vocabulary here")
    df = spark.createDataFrame([(1, "hello there"), (2, ""), (3, None), (4, "word " * 50_000), (5, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert got[2] == got[3] == 0 and 1 <= got[1] <= 6 and got[4] >= 50_000 and got[5] > 1
    encode = tokens.encoding(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY))
    for text in ("hello there", "මිල සාකච්ඡා", "விலை"):
        assert encode.decode(encode.encode_ordinary(text)) == text
    assert isinstance(np.int64(got[1]).item(), int)
