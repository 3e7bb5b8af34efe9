"""Sources mixed to target weights under a cap on repeats.

The weights of a plan hang on a tree domain - language - source; a source stands under every domain and language it has
documents of, with its weight spread by their tokens. A plan's total is handed down the tree; a leaf that cannot fill
its part (its tokens times the cap on repeats) leaves a shortage, which its siblings take over first, then the siblings
of its language, then those of its domain, each by weight and within what they can supply. A leaf then contributes whole
seeded epochs of its documents and a prefix of one more, up to its budget. The prefix is found from sums per hash
bucket, so no task ever sorts a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Node:
    """A node of the weight tree; leaves carry a weight and a capacity in tokens."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: list[Node] = field(default_factory=list)
    budget: float = 0.0

    def settle(self) -> None:
        for c in self.children:
            c.settle()
        if self.children:
            self.weight, self.capacity = sum(c.weight for c in self.children), sum(c.capacity for c in self.children)

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]


def share_out(node: Node, total: float) -> None:
    """Hands ``total`` (at most the node's capacity) down by weight; shortages go to the siblings first.

    Water filling: children that are full leave the round, and what they cannot take is shared out again by
    weight among the others. A child without weight takes part only when all weighted ones are full.
    """
    node.budget = min(total, node.capacity)
    if not node.children:
        return
    given = dict.fromkeys(range(len(node.children)), 0.0)
    left = node.budget
    for weighted in (True, False):
        live = [i for i, c in enumerate(node.children) if (c.weight > 0) == weighted and c.capacity > given[i]]
        while left > 1e-9 and live:
            mass = sum(node.children[i].weight for i in live) or float(len(live))
            part = {i: left * ((node.children[i].weight or 1.0) if weighted else 1.0) / mass for i in live}
            for i in live:
                take = min(part[i], node.children[i].capacity - given[i])
                given[i] += take
                left -= take
            live = [i for i in live if node.children[i].capacity - given[i] > 1e-9]
    for i, c in enumerate(node.children):
        share_out(c, given[i])


def exact_total(leaves: list[Node]) -> float:
    """The largest total at which every source can still supply exactly its share."""
    mass = sum(x.weight for x in leaves)
    return min((x.capacity * mass / x.weight for x in leaves if x.weight > 0), default=0.0)


def tree(rows: list[tuple[str, str, str, float, float]]) -> Node:
    """The tree of (domain, language, source, weight, capacity) rows."""
    root, domains, languages = Node("all"), {}, {}
    for domain, language, source, weight, capacity in sorted(rows):
        if domain not in domains:
            domains[domain] = Node(domain)
            root.children.append(domains[domain])
        if (domain, language) not in languages:
            languages[domain, language] = Node(language)
            domains[domain].children.append(languages[domain, language])
        languages[domain, language].children.append(Node(source, weight, capacity))
    root.settle()
    return root


@dataclass(frozen=True)
class Budget:
    """What a plan takes of one cell (source, domain, language): ``budget`` of its ``tokens``, each used ``most`` times at the
    most; ``share`` is the source's target."""

    plan_id: int
    source: str
    domain: str
    language: str
    share: float
    budget: float
    tokens: int
    most: int = 1_000_000


#: Most cells (sources by domain and language) and targets that are settled on the driver.
MOST_CELLS = 1_000_000


def budgets(supply: DataFrame, targets: DataFrame, total: str | float = "exact") -> list[Budget]:
    """The budget of every cell of every plan.

    ``supply(source, domain, language, tokens)`` has a row per cell, ``targets`` is the fixed table of plans; both are
    aggregates of bounded size (``MOST_CELLS``) and are settled on the driver. A source's share is spread over its cells by
    their tokens. ``total`` is 'exact' (the largest total with exact shares), 'available' (one epoch of all sources of the
    plan; shortages are redistributed) or a number of tokens.
    """
    cells: dict[str, list] = {}
    rows = supply.limit(MOST_CELLS + 1).collect()
    goals = targets.groupBy("plan_id", "source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(MOST_CELLS + 1).collect()
    if max(len(rows), len(goals)) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells or targets")
    for r in rows:
        if r.source is not None:
            cells.setdefault(r.source, []).append(r)
    plans: dict[int, list] = {}
    for r in goals:
        plans.setdefault(r.plan_id, []).append(r)
    out = []
    for plan, wanted in sorted(plans.items()):
        leaves, known = [], {}
        for r in wanted:
            mine = cells.get(r.source, [])
            whole = sum(int(c.tokens or 0) for c in mine)
            for c in mine if whole else []:
                have = int(c.tokens or 0)
                leaves.append((c.domain or "", c.language or "", r.source, float(r.share or 0.0) * have / whole, float(have * max(int(r.most or 0), 0))))
                known[c.domain or "", c.language or "", r.source] = have
            if not whole:
                leaves.append(("", "", r.source, float(r.share or 0.0), 0.0))
                known["", "", r.source] = 0
        root = tree(leaves)
        one = float(sum(known.values()))
        share_out(root, whole_total(root, total, one))
        goals_of = {r.source: (float(r.share or 0.0), max(int(r.most or 0), 0)) for r in wanted}
        for domain in root.children:
            for language in domain.children:
                out += [Budget(plan, x.name, domain.name, language.name, goals_of[x.name][0], x.budget, known[domain.name, language.name, x.name], goals_of[x.name][1]) for x in language.children]
    return out


def whole_total(root: Node, total: str | float, one: float) -> float:
    return exact_total(root.leaves()) if total == "exact" else one if total == "available" else float(total)


def cell(domain: str = "domain", language: str = "language") -> list[Column]:
    """The domain and language of a document as the tree names them: a missing one is ''."""
    return [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((domain, "domain"), (language, "language"))]


def choose(sized: DataFrame, budget_rows: list[Budget], seed: int = 13, bucket_docs: int = 1_000) -> DataFrame:
    """(plan_id, source, doc_id, tokens, repeats) of the chosen documents of ``sized(doc_id, source, domain, language, tokens)``.

    Every cell gives whole epochs of its documents and a prefix of one more in seeded order; a document comes in if at
    least half of it lies within the budget, so a cell ends within half a document of it. Where the prefix ends is found from
    sums of hash buckets of about ``bucket_docs`` documents and the order within the one bucket it ends in; then one pass takes
    what lies before it. Documents without tokens, cells without a budget and null sources are not chosen. Repeated
    rows count as documents of their own; those of the last document go together.
    """
    spark = sized.sparkSession
    fields = "plan_id int, source string, domain string, language string, epochs double, rest double"
    plan = spark.createDataFrame([(b.plan_id, b.source, b.domain, b.language, float(b.budget // b.tokens), float(b.budget % b.tokens)) for b in budget_rows if b.tokens], fields)
    keys = ["source", "domain", "language"]
    docs = sized.where("tokens > 0").select("doc_id", "source", *cell(), "tokens")
    buckets = max(1, docs.count() // bucket_docs)
    at = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed), F.col("epochs").cast("long")), 11)
    each = docs.join(plan, keys).withColumn("at", at).withColumn("bucket", F.floor(F.col("at") / F.lit(float(1 << 53)) * buckets).cast("int"))
    sums = each.groupBy("plan_id", *keys, "bucket").agg(F.sum("tokens").alias("n"), F.max("rest").alias("rest"))
    before = Window.partitionBy("plan_id", *keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The bucket the prefix ends in, if it ends before the last one does.
    edges = starts.where("start <= rest AND start + n > rest").select("plan_id", *keys, "bucket", "start")
    within = Window.partitionBy("plan_id", *keys).orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = each.join(edges, ["plan_id", *keys, "bucket"]).withColumn("cum", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    last = inside.where(F.col("cum") + F.col("tokens") / 2 <= F.col("rest")).groupBy("plan_id", *keys).agg(F.max(F.struct("at", "doc_id")).alias("last"))
    ends = edges.join(last, ["plan_id", *keys], "left").select("plan_id", *keys, F.col("bucket").alias("edge"), "last")
    placed = each.join(ends, ["plan_id", *keys], "left")
    early = F.col("edge").isNull() | (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(F.struct("at", "doc_id") <= F.col("last"), F.lit(False)))
    repeats = (F.col("epochs") + F.when((F.col("rest") > 0) & early, 1).otherwise(0)).cast("int")
    return placed.withColumn("repeats", repeats).where("repeats > 0").select("plan_id", "source", "doc_id", "tokens", "repeats")


def settled(sized: DataFrame, budget_rows: list[Budget], seed: int = 13) -> list[Budget]:
    """The budgets with what rounding to whole documents left over or took too much in the cells of a source put on its
    largest cell, so that the source as a whole ends within about half a document of that cell.

    One choice is made to see it; the totals that come to the driver are one per plan and source.
    """
    used = choose(sized, budget_rows, seed).groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).collect()
    left = {(r.plan_id, r.source): -float(r.n) for r in used}
    largest: dict[tuple[int, str], Budget] = {}
    for b in budget_rows:
        key = b.plan_id, b.source
        left[key] = left.get(key, 0.0) + b.budget
        if key not in largest or (b.tokens, b.domain, b.language) > (largest[key].tokens, largest[key].domain, largest[key].language):
            largest[key] = b
    moved = {b: replace(b, budget=min(max(b.budget + left[key], 0.0), float(b.tokens) * b.most)) for key, b in largest.items()}
    return [moved.get(b, b) for b in budget_rows]


def shares(chosen: DataFrame, budget_rows: list[Budget]) -> DataFrame:
    """(plan_id, source, target_share, actual_share, tokens, n_docs, max_repeats_used) of every source of every plan."""
    spark = chosen.sparkSession
    targets = spark.createDataFrame(sorted({(b.plan_id, b.source, b.share) for b in budget_rows}), "plan_id int, source string, target_share double")
    each = chosen.groupBy("plan_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("max_repeats_used"))
    full = targets.join(each, ["plan_id", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    plan = Window.partitionBy("plan_id")
    return full.select("plan_id", "source", "target_share", (F.col("tokens") / F.nullif(F.sum("tokens").over(plan), F.lit(0))).alias("actual_share"), "tokens", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_repeats_used", F.lit(0)).alias("max_repeats_used"))


def source_supply(sized: DataFrame) -> DataFrame:
    """(source, domain, language, tokens) of ``sized(source, domain, language, tokens)``: a row per cell."""
    return sized.where("source is not null").select("source", *cell(), "tokens").groupBy("source", "domain", "language").agg(F.sum("tokens").alias("tokens"))
