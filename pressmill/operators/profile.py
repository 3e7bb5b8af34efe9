"""Column-level data quality profile from one aggregate scan, with mergeable states and drift tests.

Constraints are declared as data (:class:`Check`); :func:`compile_state` turns a whole suite into one
``groupBy(partition).agg(...)``. The result is a *state* per partition (load): counts, sums, extremes and
HLL sketches, all of which merge by addition, so a new load costs one scan of that load only
(:func:`merge_states`). Issues of single records and drift come from one scan as well, as a state in long form
(:func:`scan_entries`). History tests hold the metrics of loads against control limits (:func:`control_limits`).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.session import durable


@dataclass(frozen=True)
class Check:
    """A declared constraint of one column.

    kind ``code``: the value is null or one of ``allowed``; ``codes``: a list without null, repeated or
    foreign elements (null and empty lists are fine); ``range``: null or within ``low``..``high``, NaN is bad;
    ``not_null``; ``any``: no constraint, the column is profiled; ``pattern``: null or the whole value matches the regular
    expression ``allowed[0]``.
    """

    column: str
    kind: str
    allowed: tuple[str, ...] = field(default=())
    low: float | None = None
    high: float | None = None

    def valid(self) -> Column:
        """True where the value is a valid non-null value."""
        c = F.col(self.column)
        if self.kind == "code":
            return F.coalesce(c.isin(*self.allowed) if self.allowed else F.lit(False), F.lit(False))
        if self.kind == "codes":
            allowed = F.array(*[F.lit(a) for a in self.allowed]).cast("array<string>")
            plain = (F.size(F.array_distinct(c)) == F.size(c)) & ~F.exists(c, lambda x: x.isNull()) & (F.size(F.array_except(c, allowed)) == 0)
            return F.coalesce(plain, F.lit(False))
        if self.kind == "range":
            return F.coalesce(~F.isnan(c.cast("double")) & c.between(self.low, self.high), F.lit(False))
        if self.kind == "pattern":
            return F.coalesce(c.rlike(f"^(?:{self.allowed[0]})$"), F.lit(False))
        if self.kind in ("not_null", "any"):
            return c.isNotNull()
        raise ValueError(f"unknown kind of check: {self.kind}")

    def carried(self) -> list[Column]:
        """For each allowed code of a code column: true where the row carries it, once however often it repeats it."""
        if self.kind not in ("code", "codes"):
            return []
        c = F.col(self.column)
        return [F.array_contains(c, a) if self.kind == "codes" else c == a for a in self.allowed]

    def bad(self) -> Column:
        """True where the constraint is broken."""
        return F.col(self.column).isNull() if self.kind == "not_null" else F.col(self.column).isNotNull() & ~self.valid()


def compile_state(df: DataFrame, checks: Sequence[Check], partition: str) -> DataFrame:
    """One row per partition value with the mergeable state of every checked column, from one scan.

    Columns: ``partition``, ``rows`` and for each column c: c__nulls, c__bad, c__valid, c__sum, c__sum2 (sums of
    valid numbers, zero for other kinds), c__low, c__high (as strings for text, doubles for numbers), c__hll, and for
    code columns c__code0, c__code1, ..: the rows that carry each allowed code.
    Rows with a null partition form a partition of their own. An empty table has no state rows.
    """
    kinds = dict(df.dtypes)
    out = [F.count(F.lit(1)).alias("rows")]
    for k in checks:
        c, ok = F.col(k.column), k.valid()
        number = kinds[k.column] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[k.column].startswith("decimal")
        value = F.when(ok, c.cast("double")) if number else F.lit(None).cast("double")
        # The mark before a hashed value lets the sketch count the empty string, which it would leave out.
        flat = F.to_json(F.struct(c)) if kinds[k.column].startswith(("array", "map", "struct")) else c.cast("string")
        shown = value if number else flat
        out += [
            F.count_if(c.isNull()).alias(f"{k.column}__nulls"),
            F.count_if(k.bad()).alias(f"{k.column}__bad"),
            F.count_if(ok).alias(f"{k.column}__valid"),
            F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{k.column}__sum"),
            F.coalesce(F.sum(value * value), F.lit(0.0)).alias(f"{k.column}__sum2"),
            F.min(shown).alias(f"{k.column}__low"),
            F.max(shown).alias(f"{k.column}__high"),
            F.hll_sketch_agg(F.concat(F.lit("="), flat)).alias(f"{k.column}__hll"),
        ]
        out += [F.count_if(x).alias(f"{k.column}__code{i}") for i, x in enumerate(k.carried())]
    return df.groupBy(F.col(partition).alias("partition")).agg(*out)


def merge_states(states: DataFrame, checks: Sequence[Check], by: Sequence[str] = ()) -> DataFrame:
    """Adds up states (of loads, or of an old profile and new loads) without touching the data again."""
    out = [F.sum("rows").alias("rows")]
    for k in checks:
        n = k.column
        out += [F.sum(f"{n}__{x}").alias(f"{n}__{x}") for x in ("nulls", "bad", "valid", "sum", "sum2", *(f"code{i}" for i in range(len(k.carried()))))]
        out += [F.min(f"{n}__low").alias(f"{n}__low"), F.max(f"{n}__high").alias(f"{n}__high"), F.hll_union_agg(f"{n}__hll").alias(f"{n}__hll")]
    return states.groupBy(*by).agg(*out)


def report(states: DataFrame, checks: Sequence[Check], keep: Sequence[str] = ()) -> DataFrame:
    """A long profile: one row per state row and column with rates, distinct estimate, range, mean and deviation."""
    rows = []
    for k in checks:
        n = k.column
        valid = F.col(f"{n}__valid")
        mean = F.when(F.lit(k.kind == "range") & (valid > 0), F.col(f"{n}__sum") / valid) if k.kind == "range" else F.lit(None).cast("double")
        spread = F.when(valid > 1, F.sqrt(F.greatest((F.col(f"{n}__sum2") - valid * mean * mean) / (valid - 1), F.lit(0.0))))
        rows.append(
            F.struct(
                F.lit(n).alias("column_name"),
                F.col("rows").alias("n_rows"),
                (F.col(f"{n}__nulls") / F.col("rows")).alias("null_rate"),
                (F.col(f"{n}__bad") / F.col("rows")).alias("bad_rate"),
                F.hll_sketch_estimate(f"{n}__hll").alias("n_distinct"),
                F.col(f"{n}__low").cast("string").alias("low"),
                F.col(f"{n}__high").cast("string").alias("high"),
                mean.alias("mean"),
                spread.alias("deviation"),
            )
        )
    return states.select(*keep, F.inline(F.array(*rows)))


def scan_entries(df: DataFrame, checks: Sequence[Check], partition: str, key: str) -> DataFrame:
    """All that the checks say of a table from one scan and one map-side aggregate: a mergeable state in long form.

    Entries (partition, column_name, entry, item): 'row' with the counts and sums of a column, 'code' for every code a load
    carries (a row counts once for a code however often its list repeats it), 'bad' for every record (``item`` is its
    ``key``) that breaks a constraint. Columns: n, nulls, bad, valid, total. States of loads or files add up.
    """
    kind = "struct<column_name:string,entry:string,item:string,nulls:int,bad:int,valid:int,value:double>"

    def entry(name: str, what: str, item: Column, *rest: Column) -> Column:
        return F.struct(F.lit(name), F.lit(what), item.cast("string"), *(rest or [F.lit(0), F.lit(0), F.lit(0), F.lit(None).cast("double")])).cast(kind)

    def carried(name: str, codes: Column) -> Column:
        return F.transform(codes, lambda x: entry(name, "code", x))

    each = []
    for k in checks:
        c, ok, bad = F.col(k.column), k.valid(), k.bad()
        value = F.when(ok, c.cast("double")) if k.kind == "range" else F.lit(None).cast("double")
        each.append(F.array(entry(k.column, "row", F.lit(None), c.isNull().cast("int"), bad.cast("int"), ok.cast("int"), value)))
        each.append(F.when(bad, F.array(entry(k.column, "bad", F.col(key)))).otherwise(F.array().cast(f"array<{kind}>")))
        if k.kind in ("code", "codes"):
            codes = F.filter(F.array_distinct(c), lambda x: x.isNotNull()) if k.kind == "codes" else F.array_compact(F.array(c))
            each.append(F.coalesce(carried(k.column, codes), F.array().cast(f"array<{kind}>")))
    flat = df.select(F.col(partition).alias("partition"), F.inline(F.concat(*each)))
    return flat.groupBy("partition", "column_name", "entry", "item").agg(
        F.count(F.lit(1)).alias("n"), F.sum("nulls").alias("nulls"), F.sum("bad").alias("bad"), F.sum("valid").alias("valid"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"),
    )


def merge_entries(entries: DataFrame) -> DataFrame:
    """Adds up long states of loads, files, or an old profile and new rows."""
    return entries.groupBy("partition", "column_name", "entry", "item").agg(*[F.sum(c).alias(c) for c in ("n", "nulls", "bad", "valid", "total")])


def entry_metrics(entries: DataFrame, checks: Sequence[Check], least_share: float = 0.0) -> DataFrame:
    """(partition, column_name, metric, value) of long states: null rates, means of valid numbers, and the shares of the codes
    that reach ``least_share`` in some load, as zero in loads without them. Null partitions are no load."""
    loads = entries.where("partition is not null")
    rows = loads.where("entry = 'row'")
    ranged = [k.column for k in checks if k.kind == "range"]
    mean = F.when(F.col("column_name").isin(*ranged) & (F.col("valid") > 0), F.col("total") / F.col("valid")) if ranged else F.lit(None).cast("double")
    plain = rows.select("partition", "column_name", F.inline(F.array(
        F.struct(F.lit("null_rate").alias("metric"), (F.col("nulls") / F.col("n")).alias("value")), F.struct(F.lit("mean").alias("metric"), mean.alias("value")),
    ))).where("value is not null")
    sizes = rows.select("partition", "column_name", F.col("n").alias("rows"))
    codes = loads.where("entry = 'code'").select("partition", "column_name", F.col("item").alias("code"), "n")
    watch = codes.join(sizes, ["partition", "column_name"]).where(F.col("n") >= least_share * F.col("rows")).select("column_name", "code").distinct()
    shares = sizes.join(watch, "column_name").join(codes, ["partition", "column_name", "code"], "left")
    return plain.unionByName(shares.select("partition", "column_name", F.concat(F.lit("share "), "code").alias("metric"), (F.coalesce("n", F.lit(0)) / F.col("rows")).alias("value")))


def drifted(entries: DataFrame, checks: Sequence[Check], limit: float = 0.25) -> DataFrame:
    """(column_name, partition): loads in which a metric of the column is outside its control limits, ``limit`` around the
    median of all loads. A code can only be so if its share reaches ``limit`` in some load."""
    tested = control_limits(entry_metrics(merge_entries(entries), checks, limit), "value", ["column_name", "metric"], "partition", width=limit)
    return tested.where("out_of_control").select("column_name", "partition").distinct()


def control_limits(history: DataFrame, value: str, by: Sequence[str], order: str, sigmas: float = 3.0, least: int = 5, width: float | None = None) -> DataFrame:
    """Adds center, spread and ``out_of_control`` to each row of a metric's history (one row per load, never table rows).

    The limits are ``sigmas`` standard deviations around the mean of the loads before it, with fewer than ``least`` of which
    there is no test; with ``width`` they are that far around the median of all loads, and the limit itself is outside.
    """
    if width is not None:
        usual = history.groupBy(*by).agg(F.percentile(value, 0.5).alias("center"))
        far = F.abs(F.col(value) - F.col("center")) >= width - 1e-12
        return history.join(usual, list(by)).withColumn("spread", F.lit(float(width))).withColumn("out_of_control", F.coalesce(far, F.lit(False)))
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = history.withColumn("center", F.avg(value).over(before)).withColumn("spread", F.stddev_samp(value).over(before)).withColumn("n_before", F.count(value).over(before))
    test = (F.col("n_before") >= least) & (F.abs(F.col(value) - F.col("center")) > sigmas * F.greatest("spread", F.lit(1e-9)))
    return rows.withColumn("out_of_control", F.coalesce(test, F.lit(False)))


def load_metrics(states: DataFrame, checks: Sequence[Check], keep: Sequence[str] = ("partition",)) -> DataFrame:
    """(keep.., column_name, metric, value): null rate, bad rate, mean of valid numbers and the share of every allowed code, from states alone."""
    rows = []
    for k in checks:
        n = k.column
        values = {"null_rate": F.col(f"{n}__nulls") / F.col("rows"), "bad_rate": F.col(f"{n}__bad") / F.col("rows")}
        if k.kind == "range":
            values["mean"] = F.when(F.col(f"{n}__valid") > 0, F.col(f"{n}__sum") / F.col(f"{n}__valid"))
        if k.kind in ("code", "codes"):
            values |= {f"share {a}": F.col(f"{n}__code{i}") / F.col("rows") for i, a in enumerate(k.allowed)}
        rows += [F.struct(F.lit(n).alias("column_name"), F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()]
    return states.select(*keep, F.inline(F.array(*rows)))


def anomalies(states: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(column_name, metric, partition, value, center, spread): loads outside the control limits of the loads before them.

    ``states`` may hold several states of a load (of files, or an old profile and new rows); they are merged first.
    Rows with a null partition are no load.
    """
    loads = merge_states(states.where("partition is not null"), checks, ["partition"])
    tested = control_limits(load_metrics(loads, checks), "value", ["column_name", "metric"], "partition")
    return tested.where("out_of_control").select("column_name", "metric", "partition", "value", "center", "spread")


def quality_issues(df: DataFrame, checks: Sequence[Check], table: str, key: str, partition: str, limit: float = 0.25) -> DataFrame:
    """(tbl, column_name, rec_key, issue): 'bad_value' once per record and broken column, 'drift' per load out of control.

    The table is scanned once; both come from its state, which is written (``durable``) since it is read several times.
    """
    entries = durable(scan_entries(df, checks, partition, key))
    bad = entries.where("entry = 'bad'").select(F.lit(table).alias("tbl"), "column_name", F.col("item").alias("rec_key"), F.lit("bad_value").alias("issue")).distinct()
    drift = drifted(entries, checks, limit).select(F.lit(table).alias("tbl"), "column_name", F.col("partition").cast("string").alias("rec_key"), F.lit("drift").alias("issue"))
    return bad.unionByName(drift)
