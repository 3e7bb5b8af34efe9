"""Quantities in different units and scales, brought to common units.

A price is printed in whatever form the page or provider uses ("Rs. 40.5 lakhs", "37k", "US$ 80",
"345.6 million per acre", "thirty two lakhs only"). The unit of a row is its *spelling*: the raw text with
its numbers replaced by ``#``. The steps are

1. split every distinct spelling into tokens,
2. map each distinct token to a unit concept: candidates from a character n-gram inverted index over the
   known aliases, verified by a weighted edit distance,
3. fold the concepts of a spelling into what each of its numbers counts for (the alias dictionary), and
4. join the dictionary back to all rows.

Sums in words and of mixed scales ("one hundred twenty five lakhs", "Rs. 1 lakh 50 thousand") are read part by part.
Only distinct spellings and tokens pass through steps 1-3, so Python never sees the rows.
Provider units (a desk that stores cents, a tablet that stores thousands) are learned from the rows that
hold both the raw text and the amount, and apply where only the amount is present.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.session import durable

# Unit concepts and the spellings they are known by. A concept is kind:value, where the value
# of a rate is a unit_code of the rates table.
ALIASES: dict[str, tuple[str, ...]] = {
    "scale:1000": ("thousand", "thousands", "k", "දහස්", "දහස", "දාහ", "ஆயிரம்"),
    "scale:100000": ("lakh", "lakhs", "lac", "lacs", "lks", "lk", "l", "ලක්ෂ", "ලක්ෂය", "லட்சம்", "இலட்சம்"),
    "scale:1000000": ("million", "millions", "mn", "mil", "mln", "m", "මිලියන", "මිලියනය", "மில்லியன்"),
    "scale:10000000": ("crore", "crores", "cr", "කෝටි", "කෝටිය", "கோடி"),
    "scale:1000000000": ("billion", "bn", "බිලියන", "பில்லியன்"),
    "rate:usd": ("usd", "us$", "$", "dollar", "dollars"),
    "rate:gbp": ("gbp", "£", "pound", "pounds", "sterling"),
    "none:lkr": ("rs", "lkr", "slr", "rupee", "rupees", "රු", "රුපියල්", "ரூ", "ரூபா", "ரூபாய்"),
    "over:12": ("p.a", "pa", "year", "yearly", "annum", "annual", "annually", "yr", "වසරකට", "අවුරුද්දකට", "ஆண்டுக்கு", "வருடத்திற்கு"),
    "over:1": ("p.m", "pm", "month", "monthly", "මසකට", "මාසිකව", "மாதத்திற்கு", "மாதம்"),
    "area:perch": ("perch", "perches", "පර්චසය", "පර්චසයට", "පර්චස්", "பேர்ச்", "பேர்ச்சுக்கு"),
    "area:rood": ("rood", "roods", "රූඩ්", "රූඩය", "ரூட்"),
    "area:acre": ("acre", "acres", "අක්කරය", "අක්කරයට", "අක්කර", "ஏக்கர்", "ஏக்கருக்கு"),
    "none:word": ("negotiable", "upwards", "only", "nett", "net", "per", "an", "a", "each", "for", "price", "best", "offer", "call", "pending", "and"),
}
UNIT_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TEN_WORDS = "twenty thirty forty fifty sixty seventy eighty ninety".split()

#: Edits that cost half: letters that are confused in print or keyed beside each other, and vowels for vowels.
CHEAP_PAIRS = {frozenset(p) for p in ("il", "1l", "o0", "mn", "uv", "vw", "ck", "sz", "ei", "ae", "ao", "ou", "gq", "5s")}

NUMBER = r"\d[\d,]*(?:\.\d+)?"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_THIN = "".join(chr(c) for c in range(0x21, 0x7F))
_INDIC = "".join(chr(z + d) for z in (0x0BE6, 0x0DE6) for d in range(10))


def alias_rows() -> list[tuple[str, str]]:
    """(alias, concept) of every known spelling, number words included."""
    rows = [(alias, concept) for concept, aliases in ALIASES.items() for alias in aliases]
    rows += [(word, f"unit:{n}") for n, word in enumerate(UNIT_WORDS)]
    rows += [(word, f"ten:{10 * (n + 2)}") for n, word in enumerate(TEN_WORDS)]
    return rows + [("hundred", "times:100")]


def weighted_distance(a: str, b: str) -> float:
    """Edit distance with swaps; doubled letters, look-alikes and vowels cost 0.5, the rest 1.

    >>> weighted_distance("lakh", "lakhh"), weighted_distance("lakh", "lekh"), weighted_distance("perch", "prech")
    (0.5, 0.5, 1.0)
    """
    vowels = set("aeiou")
    far = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        far[i][0] = far[i - 1][0] + 1
    for j in range(1, len(b) + 1):
        far[0][j] = far[0][j - 1] + 1
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            cheap = frozenset((x, y)) in CHEAP_PAIRS or (x in vowels and y in vowels)
            drop = 0.5 if i > 1 and x == a[i - 2] else 1.0
            add = 0.5 if j > 1 and y == b[j - 2] else 1.0
            best = min(far[i - 1][j - 1] + (0 if x == y else 0.5 if cheap else 1.0), far[i - 1][j] + drop, far[i][j - 1] + add)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, far[i - 2][j - 2] + 1.0)
            far[i][j] = best
    return far[len(a)][len(b)]


@F.pandas_udf(T.DoubleType())
def weighted_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x, y) for x, y in zip(a, b)], dtype="float64")


def printed(raw: Column) -> Column:
    """Raw text in lower case with plain digits; the letter O inside a number is a misread zero.

    A run of O after a digit is replaced in one pass: the lookbehind reaches back over the run to the digit.
    """
    plain = F.translate(raw, _WIDE + _INDIC, _THIN + "0123456789" * 2)
    plain = F.regexp_replace(plain, r"(?<=\d[\dOo,.]{0,24})[Oo](?![A-Za-z&&[^Oo]])", "0")
    return F.lower(F.regexp_replace(plain, r"(?<=\d,?)[lI](?=[\d,])", "1"))


def spelling(text: Column) -> Column:
    """The unit spelling of a printed price: numbers as ``#``, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, NUMBER, " # "), r"\s+", " "))


def tokens(spelled: Column) -> Column:
    """Unit tokens of a spelling in order, ``#`` for numbers; ``p.a.`` stays one token, a closing dot is dropped."""
    found = F.regexp_extract_all(spelled, F.lit(r"([\p{L}\p{M}‍]+(?:\.[\p{L}\p{M}]+)*\$?|[$£#])"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(t, r"\.$", ""))


def grams(word: Column) -> Column:
    """Distinct character bigrams of a word with end marks."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 1), lambda i: F.substring(marked, i, F.lit(2))))


def alias_dictionary(words: DataFrame, min_dice: float = 0.4, tolerance: float = 0.25) -> DataFrame:
    """``words(token)`` (distinct) to ``(token, concept)`` by the n-gram index and the weighted distance.

    Exact aliases win; a fuzzy match needs a token of four or more characters, bigram overlap (Dice) of
    ``min_dice`` and a distance of at most ``tolerance`` of the longer length. Ties: nearest, then alias.
    Tokens without a match are absent. The alias side is a fixed list; the planner broadcasts it by its size.
    """
    spark = words.sparkSession
    aliases = spark.createDataFrame(alias_rows(), "alias string, concept string")
    exact = words.join(aliases, words["token"] == aliases["alias"]).select("token", "concept", F.lit(0.0).alias("far"), "alias")
    index = aliases.where(F.length("alias") >= 4).withColumn("grams", grams(F.col("alias"))).withColumn("gram", F.explode("grams")).select("alias", "concept", F.size("grams").alias("n_alias"), "gram")
    probe = words.where(F.length("token") >= 4).withColumn("grams", grams(F.col("token"))).withColumn("gram", F.explode("grams")).select("token", F.size("grams").alias("n_token"), "gram")
    shared = probe.join(index, "gram").groupBy("token", "alias", "concept", "n_token", "n_alias").agg(F.count(F.lit(1)).alias("n"))
    near = shared.where(2 * F.col("n") >= min_dice * (F.col("n_token") + F.col("n_alias"))).withColumn("far", weighted_distance_udf("token", "alias"))
    near = near.where(F.col("far") <= tolerance * F.greatest(F.length("token"), F.length("alias"))).select("token", "concept", "far", "alias")
    return exact.unionByName(near).groupBy("token").agg(F.min_by("concept", F.struct("far", "alias")).alias("concept"))


def fold_concepts(concepts: list[tuple[str, int]]) -> tuple[list[int], int | None, int, int]:
    """(coefficient of each number, sum in words or None, times, over) of the concepts of a spelling in order.

    A sum is written as parts of falling scale (``1 lakh 50 thousand``, ``two crores five lakhs``). The first number opens
    it; a later one belongs to it if a scale came before and it has a smaller one of its own, or none and no measure
    behind it. Without numbers in digits the words are read the same way.

    >>> fold_concepts([("number", 0), ("scale", 100000), ("number", 0), ("scale", 1000)])[0]
    [100000, 1000]
    >>> fold_concepts([("unit", 1), ("times", 100), ("ten", 20), ("unit", 5), ("scale", 100000)])[1]
    12500000
    """
    rate = max((v for k, v in concepts if k == "rate"), default=1)
    over = max((v for k, v in concepts if k == "over"), default=1) * max((v for k, v in concepts if k == "area"), default=1)
    marks = [(k, v) for k, v in concepts if k != "none"]
    at = [i for i, (k, _) in enumerate(marks) if k == "number"]
    if at:
        coefficients: list[int] = []
        last = 0
        for n, i in enumerate(at):
            stop = at[n + 1] if n + 1 < len(at) else len(marks)
            behind = marks[i + 1 : stop]
            scale = next((v for k, v in behind if k == "scale"), 0)
            if n == 0:
                # A scale may stand before the number when none follows it (``ලක්ෂ 241``).
                own = scale or next((v for k, v in marks[:i] if k == "scale"), 1)
                last = scale if scale else 0
            elif last > 1 and scale and scale < last:
                own = last = scale
            elif last > 1 and not scale and not any(k in ("over", "area", "rate") for k, _ in behind):
                own, last = 1, 0
            else:
                own, last = 0, 0
            coefficients.append(own)
        return coefficients, None, rate, over
    total = part = 0
    said = False
    for kind, value in marks:
        if kind in ("unit", "ten"):
            part, said = part + value, True
        elif kind == "times":
            part, said = max(part, 1) * value, True
        elif kind == "scale" and (part or said):
            total, part = total + max(part, 1) * value, 0
    return [], (total + part if said else None), rate, over


@F.pandas_udf(T.StructType([T.StructField("coefficients", T.ArrayType(T.LongType())), *[T.StructField(n, T.LongType()) for n in ("stated", "times", "over")]]))
def _folded(concepts: pd.Series) -> pd.DataFrame:
    done = [fold_concepts([(c["kind"], int(c["value"])) for c in each]) for each in concepts]
    return pd.DataFrame(done, columns=["coefficients", "stated", "times", "over"]).astype({"stated": "Int64"})


def spelling_dictionary(spelled: DataFrame, rates: DataFrame) -> DataFrame:
    """``spelled(spelling)`` (distinct) to ``(spelling, coefficients, stated, times, over)``.

    ``coefficients`` is what each number of the spelling counts for, ``stated`` the sum given in words (null when there are
    numbers in digits or no number words), ``times`` and ``over`` the multiplier and divisor to common units.
    ``rates(unit_code, factor)`` gives the currency and area rates.
    """
    each = spelled.select("spelling", F.posexplode(tokens(F.col("spelling"))).alias("at", "token"))
    named = alias_dictionary(each.where("token <> '#'").select("token").distinct())
    concepts = each.join(named, "token", "left").withColumn("concept", F.when(F.col("token") == "#", F.lit("number:0")).otherwise(F.col("concept"))).where("concept is not null")
    parted = concepts.withColumn("kind", F.split_part("concept", F.lit(":"), F.lit(1))).withColumn("value", F.split_part("concept", F.lit(":"), F.lit(2)))
    rated = parted.join(rates.select(F.lower("unit_code").alias("value"), F.col("factor").cast("long")).distinct(), "value", "left")
    value = F.when(F.col("kind").isin("rate", "area"), F.coalesce("factor", F.lit(1))).otherwise(F.coalesce(F.expr("try_cast(value AS bigint)"), F.lit(0)))
    folded = rated.groupBy("spelling").agg(F.array_sort(F.collect_list(F.struct("at", "kind", value.alias("value")))).alias("concepts"))
    return folded.select("spelling", _folded("concepts").alias("f")).select("spelling", "f.*")


def to_common_units(prices: DataFrame, rates: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Adds ``amount_common`` (bigint, half-up) and ``basis`` ('raw', 'provider', 'amount' or null) to every row.

    Rows need ``provider``, ``raw`` and ``amount``; other columns pass through. A raw text with a sum decides.
    Without one the amount is divided by the provider's unit: the ratio of amount to the sum in the raw text
    that at least ``min_share`` of the provider's rows show (1 when there is none). Neither gives null.
    Null, empty or wordy raw texts count as stating no sum. Input columns named like the working columns
    (all start with ``_u_``) would clash and are the only reserved names. Empty input gives empty output.
    """
    amount, exact = F.col("amount").cast("decimal(24,0)"), "decimal(20,6)"
    rows = prices.withColumn("_u_text", printed(F.col("raw"))).withColumn("_u_spelling", spelling(F.col("_u_text")))
    rows = rows.withColumn("_u_numbers", F.expr(f"regexp_extract_all(_u_text, '{NUMBER.replace(chr(92), chr(92) * 2)}', 0)"))
    spelled = durable(rows.select(F.col("_u_spelling").alias("spelling")).where("spelling is not null").distinct())
    book = durable(spelling_dictionary(spelled, rates)).select(F.col("spelling").alias("_u_spelling"), *[F.col(c).alias(f"_u_{c}") for c in ("coefficients", "stated", "times", "over")])
    rows = rows.join(book, "_u_spelling", "left")
    number = F.expr(f"""CASE
        WHEN size(_u_numbers) = 0 THEN CAST(_u_stated AS {exact})
        WHEN size(_u_numbers) = 1 OR size(filter(_u_coefficients, x -> x > 0)) <= 1 THEN try_multiply(try_cast(replace(_u_numbers[0], ',', '') AS {exact}), CAST(coalesce(_u_coefficients[0], 1) AS decimal(12, 0)))
        ELSE aggregate(zip_with(_u_numbers, _u_coefficients, (n, c) -> if(c > 0, try_multiply(try_cast(replace(n, ',', '') AS {exact}), CAST(c AS decimal(12, 0))), 0)),
          CAST(0 AS decimal(38, 6)), (s, x) -> CAST(s + x AS decimal(38, 6))) END""")
    value = number.cast("decimal(32,6)") * F.coalesce("_u_times", F.lit(1)).cast("decimal(6,0)") / F.coalesce("_u_over", F.lit(1)).cast("decimal(6,0)")
    rows = rows.withColumn("_u_raw", F.round(value, 0).cast("decimal(24,0)"))

    both = rows.where((F.col("_u_raw") > 0) & (amount > 0)).select("provider", F.format_string("%.3e", amount.cast("double") / F.col("_u_raw").cast("double")).alias("ratio"))
    counted = both.groupBy("provider", "ratio").agg(F.count(F.lit(1)).alias("n"))
    usual = counted.groupBy("provider").agg(F.max_by("ratio", "n").alias("ratio"), F.max("n").alias("n"), F.sum("n").alias("all"))
    usual = usual.where(F.col("n") >= min_share * F.col("all")).select(F.col("provider").alias("_u_provider"), F.col("ratio").cast("double").alias("_u_ratio"))
    rows = rows.join(usual, F.col("provider") == F.col("_u_provider"), "left")
    by_provider = F.round(amount.cast("double") / F.coalesce("_u_ratio", F.lit(1.0)), 0).cast("decimal(24,0)")
    basis = F.when(F.col("_u_raw").isNotNull(), "raw").when(amount.isNull(), F.lit(None)).when(F.coalesce("_u_ratio", F.lit(1.0)) == 1.0, "amount").otherwise("provider")
    known = F.coalesce("_u_raw", F.when(F.col("_u_ratio").isNull() | (F.col("_u_ratio") == 1.0), amount).otherwise(by_provider))
    return rows.withColumn("amount_common", known.cast("bigint")).withColumn("basis", basis).drop("_u_text", "_u_spelling", "_u_numbers", "_u_coefficients", "_u_stated", "_u_times", "_u_over", "_u_raw", "_u_provider", "_u_ratio")


def wrong_amounts(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """(price_id, amount_lkr) of rows whose amount is missing or not the value in common units, once each."""
    done = to_common_units(prices.select("price_id", "provider", "raw", "amount"), rates)
    wrong = F.col("amount_common").isNotNull() & ~F.col("amount").eqNullSafe(F.col("amount_common"))
    return done.where(wrong).select("price_id", F.col("amount_common").alias("amount_lkr")).distinct()
