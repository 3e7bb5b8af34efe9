"""Documents packed whole into containers of fixed capacity by sum-of-squares online packing.

The packer keeps, for every fill level, the number of open containers at that level (the level array) and puts
each item where the sum of the squares of these numbers grows least. An item is split only if it is larger than the capacity: it fills containers of its own, and what is left is packed like any item.

Documents are packed in shards of about ``shard_docs`` documents, hashed so that no source or length gathers in
one shard; at the end of a shard open containers whose levels fit together are merged. What a shard wastes is a
handful of open containers, so the waste of the whole does not depend on its size.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Packer:
    """Sum-of-squares packing for one capacity; containers are numbered from 0 as they are opened."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.level: list[int] = []

    def put(self, size: int) -> int:
        """Places an item of 1..capacity tokens and returns its container.

        Moving a container from level h to h + s changes the sum of squares by 2 (N(h+s) - N(h)) + 2, a new
        container by 2 N(s) + 1; a full container is no longer counted. Ties go to the fullest container.
        """
        c, n = self.capacity, self.count
        best, at = (2 * int(n[size]) + 1 if size < c else 0), 0
        if size < c:
            last = c - size
            change = 2 * (n[1 + size : c + 1] - n[1 : last + 1]) + 2
            change[-1] = 1 - 2 * n[last]
            change[n[1 : last + 1] == 0] = 1 << 60
            k = last - 1 - int(np.argmin(change[::-1]))
            if change[k] < best:
                at = k + 1
        if at == 0:
            where = len(self.level)
            self.level.append(0)
        else:
            where = self.open[at].pop()
            n[at] -= 1
        new = at + size
        self.level[where] = new
        if new < c:
            self.open[new].append(where)
            n[new] += 1
        return where

    def merge(self) -> dict[int, int]:
        """Merges open containers that fit together, fullest first; {container: container it moved into}."""
        moved: dict[int, int] = {}
        waiting = sorted((self.level[w], w) for at in self.open for w in at)
        levels: list[int] = [lv for lv, _ in waiting]
        ids = [w for _, w in waiting]
        while levels:
            level, into = levels.pop(), ids.pop()
            while True:
                k = bisect.bisect_right(levels, self.capacity - level) - 1
                if k < 0:
                    break
                level += levels.pop(k)
                moved[ids.pop(k)] = into
            self.level[into] = level
        return moved


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """(container, doc_id, part_no, tokens, used_tokens) of the documents of one shard, in doc_id order."""
    packer = Packer(capacity)
    rows: list[tuple[int, int, int, int]] = []
    for doc, size in zip(pdf["doc_id"].tolist(), pdf["tokens"].tolist()):
        part = 0
        while size > 0:
            piece = min(size, capacity)
            rows.append((packer.put(piece), doc, part, piece))
            size -= piece
            part += 1
    moved = packer.merge()

    def final(w: int) -> int:
        while w in moved:
            w = moved[w]
        return w

    out = pd.DataFrame([(final(w), d, p, t) for w, d, p, t in rows], columns=["container", "doc_id", "part_no", "tokens"])
    out["used_tokens"] = out.groupby("container")["tokens"].transform("sum") if len(out) else pd.Series(dtype="int64")
    return out


#: Most pack sizes of one call.
MOST_PACKS = 1_000


def pack(sized: DataFrame, packs: DataFrame, shard_docs: int = 20_000) -> DataFrame:
    """Containers of every pack size for ``sized(doc_id bigint, tokens int)``.

    One row per document part: (pack_id, container_id, doc_id, part_no, tokens, used_tokens, unused_tokens).
    A document within the capacity has the single part 0; a larger one has parts of the full capacity and a
    rest. Documents without tokens (null and empty texts) take no space: container_id null, tokens 0. Repeated
    rows are packed as often as they occur; capacities below 1 or null are left out. The pack sizes are few (at most
    ``MOST_PACKS``) and each document is told all of them, so nothing is joined.
    """
    shards = max(1, math.ceil(sized.count() / shard_docs))
    keyed = sized.select("doc_id", F.col("tokens").cast("int").alias("tokens")).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int"))
    wanted = packs.where("capacity_tokens >= 1").select("pack_id", "capacity_tokens").distinct().limit(MOST_PACKS + 1).collect()
    if len(wanted) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} pack sizes")
    kinds = "array<struct<pack_id:int,capacity_tokens:int>>"
    sizes = F.array(*[F.struct(F.lit(r.pack_id).alias("pack_id"), F.lit(r.capacity_tokens).alias("capacity_tokens")) for r in wanted]).cast(kinds)
    each = keyed.select("*", F.inline(sizes))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pack_id, shard, capacity = key
        done = pack_shard(pdf.sort_values("doc_id", kind="stable"), int(capacity))
        return pd.DataFrame({
            "pack_id": pack_id,
            "container_id": [f"{pack_id}-{shard}-{c}" for c in done["container"]],
            "doc_id": done["doc_id"],
            "part_no": done["part_no"],
            "tokens": done["tokens"],
            "used_tokens": done["used_tokens"],
            "unused_tokens": int(capacity) - done["used_tokens"],
        })

    schema = "pack_id int, container_id string, doc_id bigint, part_no int, tokens int, used_tokens int, unused_tokens int"
    packed = each.where("tokens > 0").groupBy("pack_id", "shard", "capacity_tokens").applyInPandas(run, schema)
    weightless = each.where("tokens = 0").select("pack_id", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("part_no"), "tokens", F.lit(0).alias("used_tokens"), F.lit(0).alias("unused_tokens"))
    return packed.unionByName(weightless)
