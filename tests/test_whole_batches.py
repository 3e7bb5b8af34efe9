import datetime
import hashlib
from collections import defaultdict

import pytest

import __spark_entry__ as entry

AT = datetime.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    """A batch of 2,500 items (an import), one of three, one with null indexes."""
    folder = tmp_path_factory.mktemp("batches")
    items = [("hot", f"h{i:05d}", (i * 7919) % 2500, "completed" if i % 3 else None) for i in range(2500)]
    items += [("few", f"f{i}", 3 - i, "failed") for i in range(3)] + [("odd", f"o{i}", None if i else 5, "uploaded") for i in range(3)] + [(None, "lost", 1, "failed")]
    rows = [(i, b, n, s, f"a{i}", AT, 1) for b, i, n, s in items]
    spark.createDataFrame(rows, "id string, batch_id string, item_index int, status string, source_asset_id string, ingested_at timestamp, load_id int").write.parquet(str(folder / "ingestion_items.parquet"))
    sums = [(f"a{i}", None if i == "o1" else hashlib.sha256(i.encode()).hexdigest()) for _, i, *_ in items]
    spark.createDataFrame(sums, "id string, checksum_sha256 string").write.parquet(str(folder / "media_assets.parquet"))
    spark.createDataFrame([("hot", "legacy_import", None), ("few", "operator_upload", "ann"), ("odd", "operator_upload", "bob")], "id string, kind string, created_by string").write.parquet(str(folder / "ingestion_batches.parquet"))
    batches = defaultdict(list)
    for b, i, n, s in items:
        if b:
            batches[b].append((n is None, n or 0, i, "" if n is None else str(n), s or ""))
    return str(folder), {b: sorted(v) for b, v in batches.items()}, dict(sums)


def test_snapshot_of_every_batch(spark, big):
    folder, batches, _ = big
    got = {r.batch_id: (r.n_items, r.digest) for r in entry.queries()["view9_batch_snapshot"](spark, folder).collect()}
    assert got == {b: (len(v), hashlib.sha256(",".join(f"{n}:{i}:{s}" for _, _, i, n, s in v).encode()).hexdigest()) for b, v in batches.items()}


def test_fingerprint_of_every_batch(spark, big):
    folder, batches, sums = big
    owner = {"hot": [], "few": ["ann"], "odd": ["bob"]}
    want = {b: hashlib.sha256("|".join([*owner[b], str(len(v)), *sorted(c for _, _, i, *_ in v if (c := sums[f"a{i}"]))]).encode()).hexdigest() for b, v in batches.items()}
    rows = entry.queries()["a15_fingerprints"](spark, folder).collect()
    assert len(rows) == 3 and {r.batch_id: r.fingerprint for r in rows} == want


def test_places_in_every_batch(spark, big):
    folder, batches, _ = big
    rows = entry.queries()["l3_items_in_order"](spark, folder).collect()
    assert sorted((r.batch_id, r.place, r.id) for r in rows) == sorted((b, k, x[2]) for b, v in batches.items() for k, x in enumerate(v, 1))
