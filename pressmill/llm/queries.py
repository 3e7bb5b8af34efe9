"""Queries of the text problems (p1, p2, p3, p5, p7 to p10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.io import arrow_rows, table
from pressmill.llm import canonical, language, lookalike, mixing, ocrtext, oracle, packing, pii, tokens, truncation
from pressmill.session import durable


def _scanned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, text) of the captured pages and the legacy outputs."""
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col("id").alias("rec_id"), "text") for name in ("ocr_pages", "ocr_outputs")]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The noise of every line of the scanned texts."""
    texts = _scanned_texts(spark, sf_dir)
    return ocrtext.line_noise(arrow_rows(texts), ocrtext.learn(texts)).distinct()


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned text repaired into continuous paragraphs."""
    texts = _scanned_texts(spark, sf_dir)
    return ocrtext.repaired(arrow_rows(texts), ocrtext.learn(texts))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and location values that are not yet canonical, with the entry meant or 'unmatched'."""
    categories, locations = table(spark, sf_dir, "ref_categories"), table(spark, sf_dir, "ref_locations")
    forms = canonical.category_forms(categories).unionByName(canonical.location_forms(locations))
    exact = categories.select(F.lit("category").alias("fld"), F.col("slug").alias("value")).unionByName(locations.select(F.lit("location").alias("fld"), F.col("name_en").alias("value"))).distinct()
    both = F.array(*[F.struct(F.lit(f).alias("fld"), F.col(f).alias("value")) for f in ("category", "location")])
    typed = table(spark, sf_dir, "candidates").select(F.col("id").alias("cand_id"), F.inline(both)).where("value <> ''")
    odd = typed.join(exact, ["fld", "value"], "left_anti").select("cand_id", "fld", "value")
    done = canonical.match_values(arrow_rows(odd, table(spark, sf_dir, "candidates")), forms)
    return done.select("cand_id", "fld", F.coalesce("canonical", F.lit(canonical.UNMATCHED)).alias("canonical")).distinct()


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct typed value with all entries within its distance, nearest first."""
    forms = canonical.category_forms(table(spark, sf_dir, "ref_categories")).unionByName(canonical.location_forms(table(spark, sf_dir, "ref_locations")))
    both = F.array(*[F.struct(F.lit(f).alias("fld"), F.col(f).alias("value")) for f in ("category", "location")])
    typed = table(spark, sf_dir, "candidates").select(F.inline(both)).where("value <> ''")
    return canonical.all_matches(typed, forms)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and page texts that are not in the plain form."""
    titles = table(spark, sf_dir, "candidates").select(F.lit("candidates").alias("tbl"), F.col("id").alias("rec_id"), F.col("title").alias("text"))
    pages = table(spark, sf_dir, "ocr_pages").select(F.lit("ocr_pages").alias("tbl"), F.col("id").alias("rec_id"), "text")
    return lookalike.changed(titles.unionByName(pages), "text").select("tbl", "rec_id").distinct()


def p7_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate title and page text with its plain form."""
    titles = table(spark, sf_dir, "candidates").select(F.lit("candidates").alias("tbl"), F.col("id").alias("rec_id"), F.col("title").alias("text"))
    pages = table(spark, sf_dir, "ocr_pages").select(F.lit("ocr_pages").alias("tbl"), F.col("id").alias("rec_id"), "text")
    return lookalike.plain_column(titles.unionByName(pages), "text", "plain")


def _sized(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """Documents with their size in tokens, as a table of its own: counting tokens is the dear part."""
    folder = spark.conf.get("pressmill.tokenizers", tokens.TOKENIZERS)
    docs = table(spark, sf_dir, "documents").select(*keep, "text")
    return durable(tokens.token_counts(arrow_rows(docs), keep, folder=folder))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of every pack size, with used and unused tokens."""
    return packing.pack(_sized(spark, sf_dir, ["doc_id"]), table(spark, sf_dir, "pack_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of every pack size."""
    packed = p8_containers(spark, sf_dir).where("container_id is not null")
    return packed.groupBy("pack_id").agg(
        F.countDistinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_parts"), F.sum("tokens").alias("tokens"),
    ).join(table(spark, sf_dir, "pack_sizes"), "pack_id").withColumn("unused_share", 1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """A plan is as large as one epoch of its sources together, whatever its scarcest source can carry: what a source
    cannot supply of its share, its siblings take over."""
    docs = _sized(spark, sf_dir, ["doc_id", "source", "doc_kind", "lang"])
    kinds = docs.select("doc_id", "source", F.col("doc_kind").alias("domain"), F.col("lang").alias("language"), "tokens")
    rows = mixing.settled(kinds, mixing.budgets(mixing.source_supply(kinds), table(spark, sf_dir, "mix_targets"), "available"))
    return mixing.choose(kinds, rows), rows


def p9_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents of every plan with their repeats; shortages are redistributed."""
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix of p9_documents."""
    return mixing.shares(*_mixed(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.judged(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p10_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.source_rates(truncation.judged(table(spark, sf_dir, "documents")))


def _candidate_details(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """The records, the lexicon, the gazetteer and the key of surrogates; without ``pressmill.pii.key`` each run draws its own."""
    records = table(spark, sf_dir, "candidates").select(F.col("id").alias("cand_id"), "description", "phones")
    return arrow_rows(records), table(spark, sf_dir, "name_lexicon"), table(spark, sf_dir, "ref_locations"), spark.conf.get("pressmill.pii.key", None) or pii.fresh_key()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every replaced personal detail in a candidate's description and phones, numbered by type."""
    return pii.mention_records(*_candidate_details(spark, sf_dir)).select("cand_id", "fld", "pii_type", "mention_no").distinct()


def p1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with typed placeholders and with surrogates in place of personal details."""
    return pii.redact(*_candidate_details(spark, sf_dir))


def _language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    """Fitted on a bounded sample of the labelled candidates and documents (language.fit_on)."""
    labelled = table(spark, sf_dir, "candidates").select(F.col("language").alias("label"), F.col("description").alias("text"))
    return language.fit_on(labelled.unionByName(table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "text")))


def _judged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_id, label, text) of candidates and documents."""
    candidates = table(spark, sf_dir, "candidates").select(F.lit("candidates").alias("tbl"), F.col("id").alias("rec_id"), F.col("language").alias("label"), F.col("description").alias("text"))
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), F.col("lang").alias("label"), "text")
    return candidates.unionByName(documents)


def _page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec_id, seg_no, text) of the page blocks."""
    blocks = table(spark, sf_dir, "ocr_pages").select(F.col("id").alias("rec_id"), F.explode("blocks").alias("b"))
    return blocks.select("rec_id", F.col("b.id").cast("int").alias("seg_no"), F.col("b.text").alias("text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a missing or wrong language label, and the blocks of pages in more than one language."""
    model = _language_model(spark, sf_dir)
    judged = language.classify(arrow_rows(_judged_texts(spark, sf_dir)), model, ["tbl", "rec_id", "label"])
    wrong = judged.where(F.col("lang").isNotNull() & ~F.col("label").eqNullSafe(F.col("lang"))).select("tbl", "rec_id", F.lit(0).alias("seg_no"), "lang")
    lettered = _page_blocks(spark, sf_dir).where(language.letters(F.col("text")) >= 12)
    blocks = language.classify(arrow_rows(lettered), model, ["rec_id", "seg_no"]).where("dominant is not null").select("rec_id", "seg_no", F.col("dominant").alias("lang"))
    # Copies of a page collapse first; the languages of a page are aggregated map-side and joined back, so a page
    # delivered any number of times is never sorted in one task.
    judged_blocks = durable(blocks.distinct())
    pages = judged_blocks.groupBy("rec_id").agg(F.min("lang").alias("low"), F.max("lang").alias("high")).where("low <> high").select("rec_id")
    several = judged_blocks.join(pages, "rec_id", "left_semi")
    return wrong.unionByName(several.select(F.lit("ocr_pages").alias("tbl"), "rec_id", "seg_no", "lang")).distinct()


def p2_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, confidence and proportions of every candidate, document and page block (part 0), and of every segment of
    those that mix languages (parts from 1, with where they begin and end)."""
    model = _language_model(spark, sf_dir)
    records = _judged_texts(spark, sf_dir).select("tbl", "rec_id", F.lit(0).alias("seg_no"), "text")
    blocks = _page_blocks(spark, sf_dir).select(F.lit("ocr_pages").alias("tbl"), "rec_id", "seg_no", "text")
    judged = language.classify(arrow_rows(records.unionByName(blocks)), model, ["tbl", "rec_id", "seg_no"], parts=True)
    whole = F.struct(F.lit(0).alias("part"), F.lit(None).cast("int").alias("seg_start"), F.lit(None).cast("int").alias("seg_end"), "lang", "confidence")
    cut = F.transform(F.coalesce("parts", F.array().cast("array<struct<seg_start:int,seg_end:int,lang:string,confidence:double>>")), lambda p, i: F.struct((i + 1).alias("part"), p["seg_start"].alias("seg_start"), p["seg_end"].alias("seg_end"), p["lang"].alias("lang"), p["confidence"].alias("confidence")))
    rows = judged.select("tbl", "rec_id", "seg_no", "dominant", "share", F.inline(F.concat(F.array(whole), cut)))
    return rows.select("tbl", "rec_id", "seg_no", "part", "seg_start", "seg_end", "lang", "confidence", F.when(F.col("part") == 0, F.col("dominant")).alias("dominant"), F.when(F.col("part") == 0, F.col("share")).alias("share"))


QUERIES = {
    "p1_found": p1_found,
    "p1_texts": p1_texts,
    "p2_found": p2_found,
    "p2_languages": p2_languages,
    "p3_found": p3_found,
    "p3_texts": p3_texts,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p7_found": p7_found,
    "p7_forms": p7_forms,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_documents": p9_documents,
    "p9_shares": p9_shares,
    "p9_stretched_shares": p9_shares,  # the name it had while p9_shares kept to exact shares
    "p10_found": p10_found,
    "p10_sources": p10_sources,
}
SQL = oracle.SQL
