"""JSON stores, engine tables and prompts as sources and sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import text as tx

AD_TYPE = "struct<id:string,title:string,description:string,category:string,price:string,location:string,status:string,asset_id:string,created_at:string>"
STORE_TYPE = f"struct<assets:map<string,struct<id:string,filename:string,content_type:string,data_url:string>>,extractions:map<string,struct<id:string,asset_id:string,text:string,language:string>>,advertisements:map<string,{AD_TYPE}>>"


def read_store(spark: SparkSession, path: str, part: str) -> DataFrame:
    """One map of a JSON store (one document of id-to-record maps) as rows with ``store_id``."""
    text = spark.read.text(path, wholetext=True)
    store = text.select(F.from_json("value", STORE_TYPE).alias("s"))
    return store.select(F.explode(F.map_entries(f"s.{part}")).alias("e")).select(F.col("e.key").alias("store_id"), "e.value.*")


#: Most records of a store: it is one document, which one task writes.
MOST_STORED = 1_000_000


def write_store(parts: dict[str, DataFrame], path: str) -> None:
    """A JSON store as ``read_store`` reads it: one document of id-to-record maps (``assets``, ``extractions``,
    ``advertisements``; each frame has ``store_id`` and the record's fields). The target is replaced as a whole; parts
    that are not given are empty. A store of more than ``MOST_STORED`` records is an error: it is no document any more."""
    spark = next(iter(parts.values())).sparkSession
    store = spark.range(1).select(F.lit(0).alias("one"))
    for name in ("assets", "extractions", "advertisements"):
        if name not in parts:
            store = store.withColumn(name, F.lit("{}"))
            continue
        rows = parts[name].where("store_id is not null")
        if rows.limit(MOST_STORED + 1).count() > MOST_STORED:
            raise ValueError(f"more than {MOST_STORED} {name}")
        record = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "store_id"]))
        entry = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("store_id").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(":"), record)
        whole = rows.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias(name), F.lit(0).alias("one"))
        store = store.join(whole, "one")
    document = F.concat(*[x for n, name in enumerate(("assets", "extractions", "advertisements")) for x in (F.lit(f'{"{" if not n else ","}"{name}":'), F.col(name))], F.lit("}"))
    store.select(document.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def import_rows(store: DataFrame, existing: DataFrame, key: str = "store_id") -> DataFrame:
    """Store rows with ``outcome``: 'imported', or 'skipped' when the id was imported before. A dry run aggregates this plan and writes nothing."""
    known = existing.select(key, F.lit("skipped").alias("outcome")).distinct()
    return store.join(known, key, "left").withColumn("outcome", F.coalesce("outcome", F.lit("imported")))


def import_report(rows: DataFrame) -> DataFrame:
    """One row of totals."""
    return rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("outcome") == "imported").alias("imported"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))


def decode_assets(assets: DataFrame) -> DataFrame:
    """F14 on stored assets: bytes, checksum and an error for those that do not decode."""
    body = tx.decode_data_url(F.col("data_url"))
    return assets.withColumn("content", body).withColumn("checksum", F.sha2("content", 256)).withColumn("error", F.when(F.col("content").isNull(), "UNDECODABLE"))


# The columns of an engine's word table.
TSV = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def read_tsv(lines: DataFrame) -> DataFrame:
    """Engine output lines(doc, value) as typed word rows; the header, short and unparsable rows are left out.

    Split at most twelve ways, so the text may hold tabs; quotes are data.
    """
    parts = F.split("value", "\t", len(TSV))
    rows = lines.select("doc", parts.alias("p")).where((F.size("p") == len(TSV)) & (F.get("p", F.lit(0)) != "level"))
    ints = [F.expr(f"try_cast(p[{i}] AS int)").alias(name) for i, name in enumerate(TSV[:10])]
    typed = rows.select("doc", *ints, F.expr("try_cast(p[10] AS double)").alias("conf"), F.get("p", F.lit(11)).alias("text"))
    return typed.dropna(subset=[*TSV[:10], "conf"])


def words_of(tsv: DataFrame) -> DataFrame:
    """Engine rows under the names of pages.blocks_of."""
    names = {"page_num": "page", "block_num": "block", "par_num": "paragraph", "line_num": "line", "word_num": "word", "conf": "confidence"}
    return tsv.select("doc", *[F.col(c).alias(names.get(c, c)) for c in TSV[1:]])


def load_prompts(spark: SparkSession, folder: str, manifest: dict[str, str]) -> dict[str, str]:
    """Prompt files whose checksums equal the manifest's; a missing or changed file is an error."""
    found = {r.path.rsplit("/", 1)[-1]: r.value for r in spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()}
    for name, checksum in manifest.items():
        if name not in found:
            raise FileNotFoundError(name)
        if hashlib.sha256(found[name].encode()).hexdigest() != checksum:
            raise ValueError(f"{name} differs from the manifest")
    return {name: found[name] for name in manifest}


#: An answer that breaks the structure in every way of repair.
INVALID_ANSWER = '{"schema_version":"1.0","advertisements":[{"unexpected":true}]}'


def fake_answers(pages: DataFrame, mode: str, recordings: list[dict] | None = None) -> DataFrame:
    """pages(page_id, text, known_ids, prompt) answered by the fake engine: by rules, with nothing, never validly, or from
    recordings. Other modes are an error."""
    if mode == "rule_based":
        from pressmill.operators.validation import rule_based_answers

        return rule_based_answers(pages).select("page_id", "answer")
    if mode == "fixture":
        return recorded_answers(pages, recordings or [])
    fixed = {"empty": '{"schema_version":"1.0","advertisements":[]}', "always_invalid": INVALID_ANSWER}
    if mode not in fixed:
        raise ValueError(f"{mode!r} is not a mode of the fake engine")
    return pages.select("page_id", F.lit(fixed[mode]).alias("answer"))


def recorded_answers(prompts: DataFrame, recordings: list[dict]) -> DataFrame:
    """prompts(page_id, prompt) answered by recordings [{name, match, response}]: the first by name whose match occurs.

    Recordings are a small fixture list, shipped as literals of one expression.
    """
    ordered = sorted(recordings, key=lambda r: r["name"])
    answer = F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains("prompt", F.lit(r["match"])), F.lit(json.dumps(r["response"]))) for r in ordered])
    return prompts.select("page_id", answer.alias("answer"))
