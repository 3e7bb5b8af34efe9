"""Text functions as JVM expressions; Python only where Java has no equal (NFC, Python formatting)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bidirectional controls that are dropped, and the delimiters of a rendered page.
BIDI = "‪-‮⁦-⁩‎‏"
OPEN_TAG, CLOSE_TAG = "<ocr_blocks>", "</ocr_blocks>"
# Price, place and category vocabulary of the rule-based reader.
PRICE = r"(?iU)(?:rs\.?|රු\.?)\s*[\d,]+"
CITIES = ("Colombo", "Kandy", "Galle", "Matara", "Jaffna", "Kurunegala", "Negombo", "Gampaha")
KEYWORDS = {
    "Vehicles": ("vehicle", "car", "van", "bike", "prius", "toyota", "honda", "වාහන"),
    "Property": ("house", "land", "rent", "apartment", "property", "නිවස", "ඉඩම"),
    "Electronics": ("phone", "iphone", "laptop", "tv", "electronics", "දුරකථන"),
    "Jobs": ("job", "vacancy", "executive", "driver", "රැකියා", "ඇබෑර්තු"),
}
# The header line of a block in a rendered page.
HEADER = r"^\[(\d+)\](?:\s*\([^)]*\))?(?:\s*conf=[\d.]+)?\s*$"
# Device names no file may bear.
RESERVED = ("con", "prn", "aux", "nul", *(f"{d}{n}" for d in ("com", "lpt") for n in range(1, 10)))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore").astype(object).where(text.notna(), None)


def composed(text: Column) -> Column:
    """NFC; ASCII-only text is already composed, but both branches of a UDF are evaluated, so filter before if it matters."""
    return nfc(text)


def strip(text: Column) -> Column:
    """Strips Unicode white space at both ends (Spark's trim knows the space only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def drop_controls(text: Column) -> Column:
    """No control characters but line feed and tab, no bidirectional controls."""
    return F.regexp_replace(text, rf"[\p{{Cc}}{BIDI}&&[^\n\t]]", "")


def sanitize(text: Column) -> Column:
    """composed text without controls."""
    return drop_controls(composed(text))


def clean(text: Column) -> Column:
    """sanitised and stripped; what is then empty becomes null."""
    return F.nullif(strip(sanitize(text)), F.lit(""))


def escape_delimiters(text: Column) -> Column:
    """a backslash breaks the page delimiters inside untrusted text."""
    return F.replace(F.replace(text, F.lit(CLOSE_TAG), F.lit("<\\/ocr_blocks>")), F.lit(OPEN_TAG), F.lit("<\\ocr_blocks>"))


def normalize_phone(raw: Column) -> Column:
    """the national form of a number, or null: all digits joined, 94 and eleven digits or nine digits become 0…"""
    digits = F.array_join(F.regexp_extract_all(raw, F.lit(r"(?U)(\d+)"), F.lit(1)), "")
    national = F.when(digits.startswith("94") & (F.length(digits) == 11), F.concat(F.lit("0"), F.substring(digits, 3, 20))).when(
        (F.length(digits) == 9) & ~digits.startswith("0"), F.concat(F.lit("0"), digits)
    ).otherwise(digits)
    return F.when(national.rlike(r"(?U)^0\d{8,9}$"), national)


def normalize_phones(phones: Column) -> Column:
    """struct(phones, unparseable): readable numbers in national form, others as stripped text, distinct in order."""
    read = F.transform(phones, lambda p: F.coalesce(normalize_phone(p), F.nullif(strip(drop_controls(p)), F.lit(""))))
    bad = F.exists(phones, lambda p: p.isNotNull() & normalize_phone(p).isNull())
    return F.struct(F.array_distinct(F.array_compact(read)).alias("phones"), F.coalesce(bad, F.lit(False)).alias("unparseable"))


def category_key(value: Column) -> Column:
    """lower case, hyphens and underscores as spaces, spaces collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(strip(value)), "-_", "  "), r"\s+", " "))


def safe_filename(name: Column, longest: int = 255) -> Column:
    """F8: the last path segment without unprintable characters, quotes and leading dots; a reserved stem is prefixed; null stays null."""
    last = F.element_at(F.split(F.replace(composed(name), F.lit("\\"), F.lit("/")), "/"), -1)
    shown = strip(F.regexp_replace(last, r'[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}"]|[\p{Zs}&&[^ ]]', ""))
    bare = F.coalesce(F.nullif(F.regexp_replace(shown, r"^\.+", ""), F.lit("")), F.lit("upload"))
    stem = F.lower(F.regexp_replace(bare, r"\.[^.]*$", ""))
    return F.when(name.isNotNull(), F.substring(F.when(stem.isin(*RESERVED), F.concat(F.lit("file-"), bare)).otherwise(bare), 1, longest))


def joined_lines(text: Column) -> Column:
    """The array of lines stripped of spaces, hyphens and colons, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\R"), lambda s: F.regexp_replace(s, r"^[ :\-]+|[ :\-]+$", "")), lambda s: s != "")


def first_price(text: Column) -> Column:
    """the first price as printed, 'Price pending' when there is none."""
    found = F.nullif(F.regexp_extract(text, PRICE, 0), F.lit(""))
    return F.coalesce(F.replace(found, F.lit("Rs "), F.lit("Rs. ")), F.lit("Price pending"))


def price_amount(price: Column) -> Column:
    """G-8: the digits of a price as one number, null when it has none; full-width and Indic digits count."""
    other = "".join(chr(z + d) for z in (0x0BE6, 0x0DE6, 0xFF10) for d in range(10))
    return F.regexp_replace(F.translate(price, other, "0123456789" * 3), r"[^0-9]", "").try_cast("bigint")


def first_title(lines: Column, longest: int = 120) -> Column:
    """the first line of more than three characters without a price."""
    fit = F.filter(lines, lambda s: ~s.rlike(PRICE) & (F.length(s) > 3))
    return F.substring(F.coalesce(F.get(fit, F.lit(0)), F.lit("Newspaper advertisement")), 1, longest)


def first_location(text: Column) -> Column:
    """a listed city with up to two digits as a word, else the first listed city contained anywhere."""
    found = F.nullif(F.trim(F.regexp_extract(text, rf"(?i)\b(?:{'|'.join(CITIES)})\s*\d{{0,2}}\b", 0)), F.lit(""))
    inside = F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(c.lower())), F.lit(c)) for c in CITIES])
    return F.coalesce(found, inside, F.lit("Location pending"))


def keyword_category(text: Column, unmatched: str = "Other") -> Column:
    """the first category with a keyword contained in the text."""
    low = F.lower(text)
    found = [F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in KEYWORDS.items()]
    return F.coalesce(*found, F.lit(unmatched))


def scan_phones(text: Column) -> Column:
    """phone-like runs, distinct in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:\+?94|0)\d{8,9})"), F.lit(1)))


def decode_data_url(url: Column) -> Column:
    """the bytes of a base64 data URL, null when it is none or does not decode."""
    payload = F.nullif(F.regexp_extract(url, r"(?s)^data:[^,]*;base64,(.*)$", 1), F.lit(""))
    return F.try_to_binary(payload, F.lit("base64"))


def script_language(text: Column, ratio: float = 0.25) -> Column:
    """si, en, mixed or unknown from the counts of Sinhala and ASCII letters."""
    si, en = F.regexp_count(text, F.lit("[඀-෿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    balance = F.least(si, en) / F.nullif(F.greatest(si, en), F.lit(0))
    return (
        F.when((si > 0) & (en > 0) & (balance > ratio), F.lit("mixed"))
        .when((si > 0) & (si > en), F.lit("si")).when(en > 0, F.lit("en")).when(si > 0, F.lit("si")).otherwise(F.lit("unknown"))
    )


@F.pandas_udf(T.StringType())
def two_decimals(value: pd.Series) -> pd.Series:
    """Python's %.2f (half to even on the binary value), which Java's formatter does not share."""
    return value.map(lambda v: f"{v:.2f}", na_action="ignore").astype(object).where(value.notna(), None)


def block_header(block: Column, confidence: Column) -> Column:
    """'[id] (x=,y=,w=,h=) conf=0.94' of a block; parts that are null are left out."""
    box = block["box"]
    place = F.when(box.isNotNull(), F.format_string(" (x=%d,y=%d,w=%d,h=%d)", F.get(box, F.lit(0)), F.get(box, F.lit(1)), F.get(box, F.lit(2)), F.get(box, F.lit(3))))
    sure = F.when(confidence.isNotNull(), F.concat(F.lit(" conf="), confidence))
    return F.concat(F.lit("["), block["id"].cast("string"), F.lit("]"), F.coalesce(place, F.lit("")), F.coalesce(sure, F.lit("")))


def rendered_block_ids(page: Column) -> Column:
    """F16: the ids of the block headers of a rendered page, in order."""
    heads = F.filter(F.split(page, "\n"), lambda s: s.rlike(HEADER))
    return F.transform(heads, lambda s: F.regexp_extract(s, r"^\[(\d+)\]", 1).cast("int"))


def rendered_text(page: Column) -> Column:
    """F16: the text of a rendered page without its headers."""
    return F.array_join(F.filter(F.split(page, "\n"), lambda s: ~s.rlike(HEADER)), "\n")


def source_ref(ref: Column) -> Column:
    """the name=value parts of a source reference as a map."""
    return F.str_to_map(ref, F.lit(";"), F.lit("="))


def id_prefix(identifier: Column) -> Column:
    """the part before the first underscore."""
    return F.split_part(identifier, F.lit("_"), F.lit(1))


def make_id(prefix: str, *keys: Column) -> Column:
    """a prefixed id made from keys, the same at every retry."""
    return F.concat(F.lit(f"{prefix}_"), F.upper(F.substring(F.sha2(F.concat_ws("|", *keys), 256), 1, 26)))


def unfence(answer: Column) -> Column:
    """the body of a fenced code block, or the text itself."""
    return F.trim(F.regexp_replace(F.trim(answer), r"(?s)^```[A-Za-z]*\s*\n(.*?)\n?```$", "$1"))


def line_count(text: Column) -> Column:
    """lines of a text; empty text has none, null stays null."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n")))


def render_template(template: str, values: dict[str, str]) -> str:
    """Fills ``{{name}}`` placeholders; a missing or unused name is an error."""
    import re

    wanted = set(re.findall(r"\{\{(\w+)\}\}", template))
    if missing := wanted - set(values):
        raise ValueError(f"no value for: {', '.join(sorted(missing))}")
    if unused := set(values) - wanted:
        raise ValueError(f"no placeholder for: {', '.join(sorted(unused))}")
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m[1]], template)
