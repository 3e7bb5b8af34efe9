import random

import pytest
from pyspark.sql import functions as F

from pressmill.llm import mixing


@pytest.mark.parametrize("seed", (3, 13))
def test_prefix_of_the_whole_order(spark, seed):
    """The chosen documents are the seeded order's prefix, whatever their sizes; only the one at the end is decided by half."""
    rnd = random.Random(8)
    rows = [(i, "s", 400 if i % 20 == 0 else rnd.randint(1, 5)) for i in range(300)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens int").withColumn("domain", F.lit("d")).withColumn("language", F.lit("en"))
    whole = sum(t for *_, t in rows)
    for budget in (whole * 0.1, whole * 1.1):
        epochs, rest = divmod(budget, whole)
        keys = sized.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), F.lit(int(epochs)).cast("long")), 11).alias("at")).collect()
        size, want, cum = {i: t for i, _, t in rows}, {}, 0
        for r in sorted(keys, key=lambda r: (r["at"], r.doc_id)):
            if n := int(epochs) + (cum + size[r.doc_id] / 2 <= rest):
                want[r.doc_id] = n
            cum += size[r.doc_id]
        for bucket_docs in (1_000, 10):
            chosen = mixing.choose(sized, [mixing.Budget(1, "s", "d", "en", 1.0, budget, whole)], seed=seed, bucket_docs=bucket_docs).collect()
            assert {r.doc_id: r.repeats for r in chosen} == want and len(chosen) == len(want)


def test_rounding_of_cells_is_settled(spark):
    """Many small cells with long documents round far apart; the source as a whole does not."""
    rnd = random.Random(3)
    rows = [(i, "s", f"d{i % 30}", "en", rnd.choice((5, 10, 400))) for i in range(300)] + [(1000 + i, "s", "big", "en", 10) for i in range(500)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, domain string, language string, tokens int")
    targets = spark.createDataFrame([(1, "s", 1.0, 2)], "plan_id int, source string, target_share double, max_repeats int")
    total = sum(r[-1] for r in rows) * 0.37
    plain = mixing.budgets(mixing.source_supply(sized), targets, total)
    used = lambda plan: sum(r.tokens * r.repeats for r in mixing.choose(sized, plan).collect())
    settled = mixing.settled(sized, plain)
    assert abs(used(settled) - total) <= 5 <= abs(used(plain) - total)
    assert max(r.repeats for r in mixing.choose(sized, settled).collect()) <= 2 and len(settled) == len(plain)
    assert mixing.settled(sized.limit(0), []) == []
