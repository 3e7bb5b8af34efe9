"""Answers of an extraction engine checked in two tiers: structure first, then evidence and meaning."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions import text as tx

# Limits and vocabularies of the answer format.
LANGUAGES = ("si", "en", "ta", "mixed", "unknown")
LIMITS = {"title": 300, "description": 4000, "location": 200}
ENVELOPE = {"schema_version", "advertisements"}
AD_FIELDS = {"source_block_ids", "language", "title", "description", "category", "price", "location", "contacts", "confidence", "warnings"}
CONFIDENCE_FIELDS = {"overall", "title", "description", "category", "price", "location", "contacts"}


class Errors(list):
    """Collected (path, message) pairs; values are never repeated in a message."""

    def add(self, path: str, message: str) -> None:
        self.append((path, message))

    def text(self, holder: dict, name: str, path: str, most: int, required: bool = False) -> None:
        value = holder.get(name)
        if value is None:
            if required:
                self.add(f"{path}.{name}", "missing")
        elif not isinstance(value, str):
            self.add(f"{path}.{name}", "not a string")
        elif len(value) > most:
            self.add(f"{path}.{name}", f"longer than {most}")

    def only(self, holder: dict, known: set[str], path: str) -> None:
        for name in sorted(set(holder) - known):
            self.add(f"{path}.{name}" if path else name, "unknown field")


def structural_errors(answer: str | None) -> list[tuple[str, str]]:
    """Every structural error of a JSON answer as (path, message); an empty list means it is well formed.

    Unknown fields, numbers that are not finite, confidences outside 0..1, negative or fractional amounts, other
    currencies and languages, wrong types and overlong texts are errors. Numbers may be written as strings, and whole
    numbers as 5.0. Null and unparsable answers are one error.
    """
    found = Errors()
    if answer is None:
        return [("", "missing")]
    try:
        data = json.loads(answer)
    except ValueError:
        return [("", "not JSON")]
    if not isinstance(data, dict):
        return [("", "not an object")]
    found.only(data, ENVELOPE, "")
    found.text(data, "schema_version", "", 16, required=True)
    ads = data.get("advertisements", [])
    if not isinstance(ads, list):
        found.add("advertisements", "not a list")
        ads = []
    for i, ad in enumerate(ads):
        path = f"advertisements[{i}]"
        if not isinstance(ad, dict):
            found.add(path, "not an object")
            continue
        found.only(ad, AD_FIELDS, path)
        ids = ad.get("source_block_ids", [])
        if not isinstance(ids, list) or any(whole_number(x) is None for x in ids):
            found.add(f"{path}.source_block_ids", "not a list of integers")
        if ad.get("language", "unknown") not in LANGUAGES:
            found.add(f"{path}.language", "unknown value")
        for name, most in LIMITS.items():
            found.text(ad, name, path, most)
        if "category" in ad:
            found.text(ad, "category", path, 64, required=True)
        _price(ad.get("price"), f"{path}.price", found)
        contacts = ad.get("contacts")
        if contacts is not None:
            if not isinstance(contacts, dict):
                found.add(f"{path}.contacts", "not an object")
            else:
                found.only(contacts, {"phones"}, f"{path}.contacts")
                phones = contacts.get("phones", [])
                if not isinstance(phones, list) or any(not isinstance(p, str) or len(p) > 40 for p in phones):
                    found.add(f"{path}.contacts.phones", "not a list of short strings")
        _confidence(ad.get("confidence"), f"{path}.confidence", found)
        warnings = ad.get("warnings", [])
        if not isinstance(warnings, list) or any(not isinstance(w, dict) for w in warnings):
            found.add(f"{path}.warnings", "not a list of objects")
        else:
            for k, w in enumerate(warnings):
                found.only(w, {"code", "field", "message"}, f"{path}.warnings[{k}]")
                found.text(w, "code", f"{path}.warnings[{k}]", 64, required=True)
                found.text(w, "field", f"{path}.warnings[{k}]", 64)
                found.text(w, "message", f"{path}.warnings[{k}]", 500, required=True)
    return list(found)


def whole_number(value: object) -> int | None:
    """An integer as JSON may hold it: 5, 5.0, "5", true.

    >>> whole_number(5.0), whole_number(" 5 "), whole_number(True), whole_number(5.5), whole_number("x")
    (5, 5, 1, None, None)
    """
    if isinstance(value, (bool, int)):
        return int(value)
    if isinstance(value, str) and re.fullmatch(r"\s*[+-]?\d+(?:\.0+)?\s*", value):
        return int(value.strip().split(".")[0])
    return int(value) if isinstance(value, float) and math.isfinite(value) and value == int(value) else None


def finite_number(value: object) -> float | None:
    """A finite number as JSON may hold it, a numeric string included."""
    try:
        number = float(value) if isinstance(value, (bool, int, float, str)) else math.nan
    except ValueError:
        return None
    return number if math.isfinite(number) else None


def _price(price: object, path: str, found: Errors) -> None:
    if price is None:
        return
    if not isinstance(price, dict):
        found.add(path, "not an object")
        return
    found.only(price, {"raw", "amount", "currency"}, path)
    found.text(price, "raw", path, 200)
    amount = price.get("amount")
    if amount is not None and ((number := whole_number(amount)) is None or number < 0):
        found.add(f"{path}.amount", "not a whole number of 0 or more")
    if price.get("currency") not in (None, "LKR"):
        found.add(f"{path}.currency", "unknown value")


def _confidence(conf: object, path: str, found: Errors) -> None:
    if not isinstance(conf, dict):
        found.add(path, "missing" if conf is None else "not an object")
        return
    found.only(conf, CONFIDENCE_FIELDS, path)
    if conf.get("overall") is None:
        found.add(f"{path}.overall", "missing")
    for name in sorted(CONFIDENCE_FIELDS & set(conf)):
        v = conf[name]
        if v is not None and ((number := finite_number(v)) is None or not 0 <= number <= 1):
            found.add(f"{path}.{name}", "not within 0 and 1")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])))
def structural_errors_udf(answer: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "message": m} for p, m in structural_errors(a if isinstance(a, str) else None)] for a in answer])


AD_SCHEMA = (
    "struct<schema_version:string,advertisements:array<struct<source_block_ids:array<int>,language:string,title:string,description:string,category:string,"
    "price:struct<raw:string,amount:bigint,currency:string>,location:string,contacts:struct<phones:array<string>>,confidence:struct<overall:double>,warnings:array<struct<code:string,field:string,message:string>>>>>"
)


def evidence(cited: Column, known: Column) -> Column:
    """The distinct cited ids that exist, in citation order."""
    return F.array_intersect(F.array_distinct(F.coalesce(cited, F.array().cast("array<int>"))), F.coalesce(known, F.array().cast("array<int>")))


def semantic_candidates(answers: DataFrame, categories: DataFrame, max_candidates: int = 50) -> DataFrame:
    """Well-formed answers to candidates: cap, evidence, category, phones, sanitising, numbering.

    ``answers(page_id, answer, known_ids)``; ``categories(key, slug)`` is the fixed lookup. One row per surviving
    candidate: (page_id, candidate_index, source_block_ids, language, title, description, location, price, category, phones,
    confidence, warning_codes). An advertisement that cites no existing block is dropped; survivors are numbered
    from 0. Answers that do not parse give no row.
    """
    parsed = answers.withColumn("a", F.from_json("answer", AD_SCHEMA))
    ads = parsed.select("page_id", "known_ids", F.posexplode("a.advertisements").alias("pos", "ad")).where(F.col("pos") < max_candidates)
    kept = evidence(F.col("ad.source_block_ids"), F.col("known_ids"))
    rows = ads.withColumn("kept", kept).where(F.size("kept") > 0).withColumn("key", tx.category_key(F.coalesce("ad.category", F.lit("other"))))
    rows = rows.join(categories.select("key", "slug"), "key", "left").withColumn("p", tx.normalize_phones(F.coalesce("ad.contacts.phones", F.array().cast("array<string>"))))
    codes = F.concat(
        F.coalesce(F.transform("ad.warnings", lambda w: w["code"]), F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(F.size("kept") < F.size(F.array_distinct("ad.source_block_ids")), "EVIDENCE_BLOCK_UNKNOWN"),
            F.when(F.col("slug").isNull(), "CATEGORY_UNMAPPED"), F.when(F.col("p.unparseable"), "PHONE_UNPARSEABLE"),
        )),
    )
    index = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return rows.select(
        "page_id", index.alias("candidate_index"), F.col("kept").alias("source_block_ids"), tx.clean(F.col("ad.title")).alias("title"), tx.clean(F.col("ad.description")).alias("description"),
        F.col("ad.language").alias("language"), tx.clean(F.col("ad.location")).alias("location"), tx.clean(F.col("ad.price.raw")).alias("price"), F.coalesce("slug", F.lit("other")).alias("category"), F.col("p.phones").alias("phones"),
        F.col("ad.confidence.overall").alias("confidence"), F.array_distinct(codes).alias("warning_codes"),
    )


def rule_based_answers(pages: DataFrame) -> DataFrame:
    """Adds ``answer`` to pages(text, known_ids, ..): what the rule-based reader says, as the JSON an engine would give.

    A page without text gives an empty envelope. The amount is the digits of the price, and the currency is named only
    with an amount. The lines and the joined text are columns of their own, so that the fields
    read from them do not compute them again.
    """
    lined = pages.withColumn("_lines", tx.joined_lines(F.col("text"))).withColumn("_joined", F.array_join("_lines", " "))
    read = lined.withColumn("_price", tx.first_price(F.col("_joined"))).withColumn("_category", F.lower(tx.keyword_category(F.col("_joined")))).withColumn("_place", tx.first_location(F.col("_joined")))
    ad = F.struct(
        F.col("known_ids").alias("source_block_ids"), tx.script_language(F.col("text")).alias("language"), tx.first_title(F.col("_lines")).alias("title"), F.substring("_joined", 1, 4000).alias("description"),
        F.col("_category").alias("category"), F.struct(F.col("_price").alias("raw"), tx.price_amount(F.col("_price")).alias("amount"), F.when(tx.price_amount(F.col("_price")).isNotNull(), "LKR").alias("currency")).alias("price"),
        F.col("_place").alias("location"), F.struct(tx.scan_phones(F.col("_joined")).alias("phones")).alias("contacts"), F.struct(F.lit(0.5).alias("overall")).alias("confidence"),
        F.array(F.struct(F.lit("HEURISTIC_EXTRACTION").alias("code"), F.lit(None).cast("string").alias("field"), F.lit("read by rules").alias("message"))).alias("warnings"),
    )
    empty = F.lit('{"schema_version":"1.0","advertisements":[]}')
    answer = F.when(F.coalesce(tx.strip(F.col("text")), F.lit("")) != "", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.array(ad).alias("advertisements")))).otherwise(empty)
    return read.withColumn("answer", answer).drop("_lines", "_joined", "_price", "_category", "_place")


def retry_outcome(attempts: list[tuple[str, int]], max_attempts: int = 3, max_repairs: int = 1, tokens: int = 4096, cap: int = 32_000, deadline_s: float = math.inf, seconds: float = 0.0) -> tuple[str, int, int]:
    """(outcome, calls used, last token limit) of recorded call results under two independent budgets and a deadline.

    Results are 'ok', 'invalid' (repairable), 'truncated' (raises the limit by half), 'retryable' or 'fatal'. Each call
    takes ``seconds`` and each retry its back-off; a call that could only begin after the deadline is not made.
    """
    retries = repairs = calls = 0
    passed = 0.0
    for result, _ in attempts:
        if calls:
            passed += min(2.0 ** (retries - 1), 20.0) if retries else 0.0
        if passed >= deadline_s:
            return "failed", calls, tokens
        passed += seconds
        calls += 1
        if result == "ok":
            return "validated", calls, tokens
        if result == "fatal":
            return "failed", calls, tokens
        if result == "truncated":
            tokens = min(int(tokens * 1.5), cap)
        if result == "invalid":
            repairs += 1
            if repairs > max_repairs:
                return "failed", calls, tokens
        else:
            retries += 1
            if retries >= max_attempts:
                return "failed", calls, tokens
    return "running", calls, tokens


def retry_outcomes(calls: DataFrame, key: str) -> DataFrame:
    """X6 over recorded calls(key, attempt, result): one row per key; a key's calls are bounded by the budgets."""
    kind = dict(calls.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("attempt")
        return pd.DataFrame([(pdf[key].iloc[0], *retry_outcome(list(zip(ordered["result"], ordered["attempt"]))))], columns=[key, "outcome", "calls", "token_limit"])

    return calls.groupBy(key).applyInPandas(run, f"`{key}` {kind}, outcome string, calls int, token_limit int")


# ---- answers of three wire formats (X11, F21) --------------------------------------------------------------

# Where each wire format keeps the answer text, the end reason and the token usage.
WIRE = {
    "messages": ("$.content[0].text", "$.stop_reason", "$.usage.output_tokens", {"end_turn": "stop", "max_tokens": "truncated"}),
    "generate": ("$.candidates[0].content.parts[0].text", "$.candidates[0].finishReason", "$.usageMetadata.candidatesTokenCount", {"STOP": "stop", "MAX_TOKENS": "truncated"}),
    "chat": ("$.choices[0].message.content", "$.choices[0].finish_reason", "$.usage.completion_tokens", {"stop": "stop", "length": "truncated"}),
}


def wire_answer(body: Column, wire: str) -> Column:
    """X11: struct(text, finish, output_tokens) of a provider's response body; unknown end reasons become 'other'."""
    text, reason, usage, ends = WIRE[wire]
    end = F.get_json_object(body, reason)
    finish = F.coalesce(*[F.when(end == k, v) for k, v in ends.items()], F.when(end.isNotNull(), "other"))
    return F.struct(tx.unfence(F.get_json_object(body, text)).alias("text"), finish.alias("finish"), F.get_json_object(body, usage).cast("int").alias("output_tokens"))


def http_class(status: Column, body: Column) -> Column:
    """The error code of an HTTP status, null for success; a success without a JSON body is a server error."""
    return (
        F.when(status.isNull(), "LLM_TRANSPORT_ERROR").when(status < 400, F.when(F.try_parse_json(body).isNull(), "LLM_SERVER_ERROR")).when(status.isin(401, 403), "LLM_AUTH_FAILED")
        .when(status == 404, "LLM_MODEL_UNAVAILABLE").when(status == 408, "LLM_TIMEOUT").when(status == 429, "LLM_RATE_LIMITED").when(status >= 500, "LLM_SERVER_ERROR").otherwise("LLM_BAD_REQUEST")
    )


def retry_after(header: Column, code: Column) -> Column:
    """The seconds a provider asks to wait, for the codes that are worth waiting for; dates are not read."""
    return F.when(code.isin("LLM_RATE_LIMITED", "LLM_SERVER_ERROR"), F.when(header.try_cast("double").isNotNull(), F.greatest(header.try_cast("double"), F.lit(0.0))))


def body_excerpt(body: Column, longest: int = 500) -> Column:
    """A short excerpt of an error body: the error's message where it has one, never the whole body."""
    return F.left(F.coalesce(F.get_json_object(body, "$.error.message"), F.get_json_object(body, "$.error"), body), F.lit(longest))


# ---- JSON schema dialects (R7, driver side) ----------------------------------------------------------------


def inline_refs(schema: dict) -> dict:
    """A JSON schema with its local references put in place and the definitions dropped."""
    defs = schema.get("$defs", {})

    def walk(x):
        if isinstance(x, dict):
            if "$ref" in x:
                return walk(defs[x["$ref"].rpartition("/")[2]])
            return {k: walk(v) for k, v in x.items() if k != "$defs"}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return walk(schema)


def strict_schema(schema: dict) -> dict:
    """Every object closed and all of its properties required."""
    x = inline_refs(schema)

    def walk(node):
        if isinstance(node, dict):
            node = {k: walk(v) for k, v in node.items()}
            if node.get("type") == "object" and "properties" in node:
                node["additionalProperties"] = False
                node["required"] = list(node["properties"])
            return node
        return [walk(v) for v in node] if isinstance(node, list) else node

    return walk(x)


def nullable_schema(schema: dict) -> dict:
    """Unions with null as ``nullable`` (the dialect without type unions); unsupported keys dropped."""
    x = inline_refs(schema)

    def walk(node):
        if isinstance(node, dict):
            if "anyOf" in node:
                rest = [v for v in node["anyOf"] if v.get("type") != "null"]
                if len(rest) == 1:
                    return {**{k: v for k, v in node.items() if k not in ("anyOf", "default", "title")}, **walk(rest[0]), "nullable": len(rest) < len(node["anyOf"])}
            return {k: walk(v) for k, v in node.items() if k not in ("additionalProperties", "default", "title")}
        return [walk(v) for v in node] if isinstance(node, list) else node

    return walk(x)


def placeholders_of(template: str) -> set[str]:
    """The placeholder names of a template."""
    return set(re.findall(r"\{\{(\w+)\}\}", template))
