"""Free-typed values mapped to a canonical list.

The reference forms (names, labels in other scripts, aliases) form one trie; a value is looked up by walking
the trie with a Levenshtein automaton whose allowed distance depends on the length of the value. The walk
returns every entry within that distance; the nearest decides. Aliases are further paths to the same entry.

Values are looked up in Arrow batches with a bounded memo. A reference list of up to ``max_entries`` forms is
shipped to the workers whole. A longer one is cut into shards of that size: the distinct values then meet every
shard in salted blocks and the nearest entry over all shards wins, so the result is the same.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.session import durable

UNMATCHED = "unmatched"

# Words around a value that do not belong to it.
FILLERS = frozenset("ads ad advert adverts advertisement advertisements category section near town city area district the at in நகரம் நகர் அருகே மாவட்டம் නගරය අසල දිස්ත්‍රික්කය".split())

_SEGMENT = re.compile(r"[,;/|()\[\]]|\s[-–—]\s")


def allowed_distance(length: int) -> int:
    """Edits allowed for a folded value of this length: none up to 4, 1 up to 7, 2 up to 14, else 3.

    >>> [allowed_distance(n) for n in (3, 4, 5, 7, 8, 14, 15)]
    [0, 0, 1, 1, 2, 2, 3]
    """
    return 0 if length <= 4 else 1 if length <= 7 else 2 if length <= 14 else 3


def fold(text: str) -> str:
    """Letters, marks and digits of a value in one case, without separators.

    >>> fold("Home & Garden") == fold("home_garden") == "homegarden"
    True
    """
    plain = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c for c in plain if unicodedata.category(c)[0] in "LMN")


def readings(value: str) -> list[tuple[str, bool]]:
    """(folded query, abbreviated) readings of a typed value, the most complete first."""
    plain = unicodedata.normalize("NFKC", value).casefold().strip()
    whole = plain.replace("_", " ")
    out: list[tuple[str, bool]] = []
    for part in [whole, *_SEGMENT.split(whole)]:
        words = [w for w in re.split(r"\s+", part.strip()) if w]
        kept = [w for w in words if w.strip(".-'\"") not in FILLERS and not w.strip(".").isdigit()]
        query = fold(" ".join(kept))
        short = bool(kept) and kept[-1].endswith(".") and len(kept) == 1
        if query and (query, short) not in out:
            out.append((query, short))
    return out


class Trie:
    """Folded forms to entries, searched with a Levenshtein automaton (swaps of neighbours count one edit)."""

    def __init__(self, forms: Iterable[tuple[str, str, str]]):
        """``forms``: (entry id, form as written, context such as a district)."""
        self.root: dict = {}
        self.context: dict[str, str] = {}
        self.longest = 0
        for entry, form, context in forms:
            key = fold(form or "")
            if not key:
                continue
            node = self.root
            for c in key:
                node = node.setdefault(c, {})
            node.setdefault("", set()).add(entry)
            self.longest = max(self.longest, len(key))
            self.context.setdefault(entry, fold(context or ""))

    def within(self, word: str, most: int) -> dict[str, int]:
        """Every entry within ``most`` edits of ``word``, with its distance.

        The automaton's state at a node is the band of the distance row around the diagonal; a branch is
        left as soon as no position of the band is within ``most``.
        """
        found: dict[str, int] = {}
        n, far = len(word), most + 1
        first = [min(i, far) for i in range(n + 1)]
        stack = [(self.root, first, None, "", 0)]
        while stack:
            node, row, older, last, depth = stack.pop()
            if "" in node and row[n] <= most:
                for entry in node[""]:
                    found[entry] = min(found.get(entry, far), row[n])
            for c, child in node.items():
                if not c:
                    continue
                d = depth + 1
                low, high = max(1, d - most), min(n, d + most)
                new = [far] * (n + 1)
                if d <= most:
                    new[0] = d
                best = new[0]
                for i in range(low, high + 1):
                    x = row[i - 1] if word[i - 1] == c else 1 + min(row[i - 1], row[i], new[i - 1])
                    if older is not None and i > 1 and c == word[i - 2] and last == word[i - 1] and older[i - 2] + 1 < x:
                        x = older[i - 2] + 1
                    if x < far:
                        new[i] = x
                        if x < best:
                            best = x
                if best <= most:
                    stack.append((child, new, row, c, d))
        return found

    def under(self, prefix: str) -> set[str]:
        """Entries with a form that begins with ``prefix``."""
        node = self.root
        for c in prefix:
            node = node.get(c)
            if node is None:
                return set()
        found, stack = set(), [node]
        while stack:
            for c, child in stack.pop().items():
                if c:
                    stack.append(child)
                else:
                    found |= child
        return found

    def nearest(self, value: str) -> tuple[str, int] | None:
        """(entry, distance) the value means, or None.

        The nearest entry of any reading wins, then the more complete reading, then the entry whose context
        (district) is also written, then the smallest id. Distances are tried upwards from 0: most values are
        exact or one edit away, and a walk with one edit visits a fraction of what the full distance does.
        """
        hit = self.ranked(value)
        return hit and (hit[3], hit[0])

    def ranked(self, value: str) -> tuple[int, int, int, str] | None:
        """(distance, reading, 0 if the context is written else 1, entry) of the best entry, or None."""
        queries = readings(value)
        for most in range(allowed_distance(max((len(q) for q, _ in queries), default=0)) + 1):
            for rank, (query, short) in enumerate(queries):
                if most > allowed_distance(len(query)) or len(query) - most > self.longest:
                    continue
                found = set() if most else self.under(query) if short and len(query) >= 3 else set()
                found = found or set(self.within(query, most))
                if found:
                    near = {e for e in found if self.context[e] and any(self.context[e] in q for q, _ in queries)}
                    return most, rank, int(not near), min(near or found)
        return None


    def everything(self, value: str) -> list[tuple[int, str]]:
        """[(distance, entry)] of all entries within the distance its length allows of some reading of a value; the entry
        of :meth:`nearest` comes first, the others by distance and id."""
        found: dict[str, int] = {}
        for query, _ in readings(value):
            most = allowed_distance(len(query))
            if len(query) - most <= self.longest:
                for entry, far in self.within(query, most).items():
                    found[entry] = min(found.get(entry, far), far)
        best = self.nearest(value)
        rest = sorted((far, entry) for entry, far in found.items() if not best or entry != best[0])
        return ([(best[1], best[0])] if best else []) + rest


class Memo(OrderedDict):
    """A least-recently-used table of bounded size, so that a worker's memory does not grow with the data."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def of(self, key, make):
        if key in self:
            self.move_to_end(key)
            return self[key]
        value = self[key] = make(key)
        if len(self) > self.most:
            self.popitem(last=False)
        return value


def match_values(values: DataFrame, forms: DataFrame, max_entries: int = 200_000) -> DataFrame:
    """Adds ``canonical`` (entry id or 'unmatched') and ``distance`` (null when unmatched) to ``values(.., fld, value)``.

    ``forms(fld, entry, form, context)`` is the reference list with aliases as further forms, several lists told
    apart by ``fld``. Rows whose value is null or empty get a null canonical. Repeated rows stay repeated;
    other columns pass through unchanged. An empty reference list leaves every value unmatched.
    """
    n = forms.count()
    if n <= max_entries:
        listed: dict[str, list] = {}
        for r in forms.select("fld", "entry", "form", "context").collect():
            listed.setdefault(r.fld, []).append((r.entry, r.form, r.context))
        shipped = values.sparkSession.sparkContext.broadcast(listed)
        schema = with_columns_ddl(values, "canonical string, distance int")

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tries = {f: Trie(rows) for f, rows in shipped.value.items()}
            memo = Memo()

            def one(key):
                fld, value = key
                hit = tries[fld].nearest(value) if fld in tries else None
                return hit or (UNMATCHED, None)

            for batch in batches:
                hits = [memo.of((f, v), one) if isinstance(v, str) and v.strip() else (None, None) for f, v in zip(batch["fld"], batch["value"])]
                yield batch.assign(canonical=[h[0] for h in hits], distance=pd.array([h[1] for h in hits], dtype="Int32"))

        return values.mapInPandas(look, schema)
    return _match_sharded(values, forms, math.ceil(n / max_entries))


def all_matches(values: DataFrame, forms: DataFrame, max_entries: int = 200_000) -> DataFrame:
    """(fld, value, place, canonical, distance) of all entries within the distance of each distinct ``values(fld, value)``,
    the best one in place 1; one row with the canonical 'unmatched' where there is none. Null and empty values have none.

    The reference list must fit a worker (``max_entries`` forms, else an error; :func:`match_values` takes longer ones).
    """
    listed: dict[str, list] = {}
    for n, r in enumerate(forms.select("fld", "entry", "form", "context").limit(max_entries + 1).collect()):
        if n == max_entries:
            raise ValueError(f"more than {max_entries} forms")
        listed.setdefault(r.fld, []).append((r.entry, r.form, r.context))
    shipped = values.sparkSession.sparkContext.broadcast(listed)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries = {f: Trie(rows) for f, rows in shipped.value.items()}
        for batch in batches:
            rows = []
            for fld, value in zip(batch["fld"], batch["value"]):
                if isinstance(value, str) and value.strip():
                    hits = tries[fld].everything(value) if fld in tries else []
                    rows += [(fld, value, k, entry, far) for k, (far, entry) in enumerate(hits, 1)] or [(fld, value, 1, UNMATCHED, None)]
            yield pd.DataFrame(rows, columns=["fld", "value", "place", "canonical", "distance"]).astype({"distance": "Int32"})

    # Distinct within an explicit number of parts: the planner would join parts of few bytes that are dear to walk.
    parts = 2 * values.sparkSession.sparkContext.defaultParallelism
    return values.select("fld", "value").repartition(parts, "fld", "value").distinct().mapInPandas(look, "fld string, value string, place int, canonical string, distance int")


def with_columns_ddl(df: DataFrame, more: str) -> str:
    """DDL of the frame's columns and ``more``."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [more])


def _match_sharded(values: DataFrame, forms: DataFrame, shards: int, block_values: int = 20_000) -> DataFrame:
    """The same over a reference list too long for one worker: distinct values in blocks meet each shard.

    A pair of block and shard is one task: a bounded shard and about ``block_values`` distinct values. The best
    of the shards' best is the best of the whole list, by the order of :meth:`Trie.ranked`.
    """
    distinct = durable(values.where("trim(value) <> ''").select("fld", "value").distinct())
    blocks = max(1, math.ceil(distinct.count() / block_values))
    left = distinct.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = forms.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def look(vals: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        tries = {f: Trie(g[["entry", "form", "context"]].itertuples(index=False)) for f, g in refs.groupby("fld")}
        hits = [(fld, value, *hit) for fld, value in zip(vals["fld"], vals["value"]) if fld in tries and (hit := tries[fld].ranked(value))]
        return pd.DataFrame(hits, columns=["fld", "value", "distance", "rank", "away", "canonical"])

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(look, "fld string, value string, distance int, rank int, away int, canonical string")
    best = hits.groupBy("fld", "value").agg(F.min(F.struct("distance", "rank", "away", "canonical")).alias("hit"))
    done = values.join(best, ["fld", "value"], "left")
    empty = F.col("value").isNull() | (F.trim("value") == "")
    return done.withColumn("canonical", F.when(~empty, F.coalesce("hit.canonical", F.lit(UNMATCHED)))).withColumn("distance", F.col("hit.distance")).select(*values.columns, "canonical", "distance")


def category_forms(categories: DataFrame) -> DataFrame:
    """Forms of ref_categories: slug, labels in three scripts and aliases."""
    forms = F.concat(F.array("slug", "label", "label_si", "label_ta"), F.coalesce("aliases", F.array().cast("array<string>")))
    return categories.select(F.lit("category").alias("fld"), F.col("slug").alias("entry"), F.explode(forms).alias("form"), F.lit("").alias("context")).where("form is not null").distinct()


def location_forms(locations: DataFrame) -> DataFrame:
    """Forms of ref_locations: the name in three scripts, with the district as context."""
    forms = F.explode(F.array("name_en", "name_si", "name_ta")).alias("form")
    return locations.select(F.lit("location").alias("fld"), F.col("location_id").alias("entry"), forms, F.col("district").alias("context")).where("form is not null").distinct()
