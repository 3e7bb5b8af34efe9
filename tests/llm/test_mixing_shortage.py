import os

import pytest

import __spark_entry__ as entry
from pressmill.llm import tokens


def test_documents_of_a_plan_with_shortages(spark, tmp_path):
    """A missing and a scarce source leave the plan its size; their siblings' documents are chosen in their place."""
    pytest.importorskip("tiktoken")
    if not os.path.exists(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)):
        pytest.skip("no vocabulary here")
    docs = [(i, "big", "news", "en", f"word number {i} and some more words") for i in range(200)] + [(1000 + i, "scarce", "news", "en", "few words") for i in range(3)] + [(2000, "empty", "news", "en", "")]
    spark.createDataFrame(docs, "doc_id bigint, source string, doc_kind string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    targets = [(1, "big", 0.4, 2), (1, "scarce", 0.3, 2), (1, "empty", 0.1, 2), (1, "gone", 0.2, 2)]
    spark.createDataFrame(targets, "plan_id int, source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "mix_targets.parquet"))
    chosen = entry.queries()["p9_documents"](spark, str(tmp_path)).toPandas()
    encode = tokens.encoding(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)).encode_ordinary
    size = {s: sum(len(encode(t)) for _, source, *_, t in docs if source == s) for s in ("big", "scarce")}
    used = (chosen.tokens * chosen.repeats).groupby(chosen.source).sum()
    assert set(chosen.source) == {"big", "scarce"} and len(chosen[chosen.source == "scarce"]) == 3
    assert used["scarce"] == 2 * size["scarce"] and (chosen.repeats <= 2).all()
    assert abs(used.sum() - sum(size.values())) <= chosen.tokens.max()
    shares = {r.source: r for r in entry.queries()["p9_shares"](spark, str(tmp_path)).collect()}
    assert abs(shares["big"].actual_share - used["big"] / used.sum()) < 1e-9 and shares["gone"].tokens == shares["empty"].tokens == 0
