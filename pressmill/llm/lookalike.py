"""One consistent form for text that looks the same but is written with different characters.

The Unicode quick-check idea: almost all text is already in its final form, and a character class tells which
positions may not be. The class runs in the JVM as one regular expression, so stable rows never reach Python.
In the others only the unstable *segments* (a match widened to its base character and marks) are normalised
and spliced into the unchanged rest.

What changes: canonical and look-preserving compatibility forms are composed (full width, ligatures, presentation
forms), unusual spaces become a space, invisible characters go, letters of another alphabet that look like Latin
ones become Latin unless their word or text is really written in that alphabet, and vowel sequences that imitate another Indic letter become that letter.
What stays: superscripts, fractions and circled forms (they do not look like their plain form), typographic
quotes and dashes, and the joiner that Sinhala spelling needs after a virama.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets and the Latin letter they look like.
LOOKALIKES = dict(
    zip("аеорсухѕіјһԁԛԝӏАВЕКМНОРСТУХЅІЈԌԚԜ", "aeopcyxsijhdqwlABEKMHOPCTYXSIJGQW", strict=True)  # Cyrillic
) | dict(
    zip("οναρυικγχϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovapuikyxjABEZHIKMNOPTYXCJ", strict=True)  # Greek
) | dict(
    zip("սօհոցզյՍՕԼ", "uohngqjUOL", strict=True)  # Armenian
) | dict(
    zip("ɑɡıɩǀꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓤꓥ", "agiilBPDTGKJCZFMNLSRAV", strict=True)  # Latin and Lisu imitations
) | dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHGZSVLCPKB", strict=True))  # Cherokee
# Sequences that look like one letter (Unicode's list of sequences not to use).
SEQUENCES = {"අා": "ආ", "අැ": "ඇ", "අෑ": "ඈ", "උෟ": "ඌ", "ඍෘ": "ඎ", "එ්": "ඒ", "එෙ": "ඓ", "ඔෟ": "ඖ", "ෙෙ": "ෛ", "அூ": "ஆ"}
HYPHENS = "‐‑"
#: Compatibility forms that look like their plain form. Others (super, sub, fraction, circle, square) stay.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>")
#: Code points scanned for unstable characters: all but unified ideographs, Hangul syllables and private use, which have none.
BLOCKS = ((0x80, 0x4DC0), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
VIRAMA, JOINER = "්", "‍"


def invisible(c: str) -> bool:
    """Characters without a glyph: format characters, fillers and variation selectors (not line ends, tabs).

    >>> invisible(chr(0x200B)), invisible(chr(0xAD)), invisible("a")
    (True, True, False)
    """
    return unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c in "͏ᅟᅠ឴឵ㅤﾠ"


def single(c: str) -> str:
    """The plain form of one character, '' if it is invisible."""
    if c == JOINER or ord(c) < 0x80:
        return c
    if invisible(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    if c in HYPHENS:
        return "-"
    how = unicodedata.decomposition(c)
    if how.startswith("<") and not how.startswith(SAME_LOOK):
        return c
    return unicodedata.normalize("NFKC", c)


@lru_cache(1)
def unstable_class() -> str:
    """Regular-expression class body of characters that never occur in the final form, built by rule."""
    runs: list[list[int]] = []
    for low, high in BLOCKS:
        for code in range(low, high):
            c = chr(code)
            if unicodedata.category(c) in ("Cn", "Cs", "Co") or not (single(c) != c or c in LOOKALIKES):
                continue
            if runs and runs[-1][1] == code - 1:
                runs[-1][1] = code
            else:
                runs.append([code, code])
    return runs


def _class(escape: str) -> str:
    return "".join((escape % a) + (f"-{escape % b}" if b > a else "") for a, b in unstable_class())


#: Characters most texts consist of. Few of them are unstable, and a class of some 200 ranges is tested range by
#: range, so a look ahead lets these pass the large class.
COMMON = " -~\u0d80-\u0dff\u0b80-\u0bff"


def _pattern(escape: str) -> str:
    """Unstable characters, joiners outside Sinhala clusters, marks that may compose, imitating sequences."""
    common = [chr(c) for low, high in ((0x0D80, 0x0E00), (0x0B80, 0x0C00)) for c in range(low, high) if unicodedata.category(chr(c)) != "Cn" and single(chr(c)) != chr(c)]
    stray = f"(?<!{VIRAMA}){JOINER}(?!{VIRAMA})|{JOINER}(?![඀-෿])"
    rare = "|".join([f"[{_class(escape)}]", stray, "[\u0300-\u036f]", *_pairs(escape, False)])
    return f"(?![{COMMON}])(?:{rare})|" + "|".join([*_pairs(escape, True), *SEQUENCES, *common])


def _ranges(codes: list[int], escape: str) -> str:
    runs: list[list[int]] = []
    for code in sorted(codes):
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join((escape % a) + (f"-{escape % b}" if b > a else "") for a, b in runs) + "]"


@lru_cache(1)
def _composing() -> tuple[dict[int, list[int]], list[int]]:
    """(second code point of a composition to its firsts, marks with a combining class), as the quick check of NFC has them:
    a second may compose with its first, and two marks in a row may be out of order or hide a first from a second."""
    firsts: dict[int, list[int]] = {}
    marks = []
    for low, high in BLOCKS:
        for code in range(low, high):
            c = chr(code)
            if unicodedata.combining(c):
                marks.append(code)
            how = unicodedata.decomposition(c)
            if how and not how.startswith("<") and " " in how and unicodedata.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in how.split(" "))
                if not 0x300 <= b <= 0x36F:
                    firsts.setdefault(b, []).append(a)
    return firsts, marks


def _is_common(code: int) -> bool:
    return 0x20 <= code < 0x7F or 0xD80 <= code <= 0xDFF or 0xB80 <= code <= 0xBFF


def _pairs(escape: str, common: bool) -> list[str]:
    """Pairs that may compose (beside the marks of Latin, Greek and Cyrillic letters, all of which are looked at), conjoining
    Hangul letters, and two marks in a row; those that begin with a common character, or the others."""
    firsts, marks = _composing()
    grouped: dict[tuple[int, ...], list[int]] = {}
    for second, before in firsts.items():
        if own := tuple(sorted(b for b in before if _is_common(b) == common)):
            grouped.setdefault(own, []).append(second)
    every = _ranges([m for m in marks if _is_common(m) == common], escape) + _ranges(marks, escape)
    if common:
        return [*[_ranges(list(a), escape) + _ranges(b, escape) for a, b in grouped.items()], every]
    hangul = [_ranges([0x1100, *range(0x1101, 0x1113)], escape) + _ranges(list(range(0x1161, 0x1176)), escape), _ranges(list(range(0xAC00, 0xD7A4)), escape) + _ranges(list(range(0x11A8, 0x11C3)), escape)]
    return [*[_ranges(list(a), escape) + _ranges(b, escape) for a, b in grouped.items()], *hangul, every]


@lru_cache(1)
def java_pattern() -> str:
    return _pattern("\\x{%x}")


@lru_cache(1)
def quick_check() -> re.Pattern:
    return re.compile(_pattern("\\U%08x"))


def is_mark(c: str) -> bool:
    """Marks, joiners, and the Hangul vowels and finals that join the letter before them."""
    return unicodedata.category(c)[0] == "M" or c == JOINER or "\u1160" <= c <= "\u11ff"


def plain_segment(segment: str) -> str:
    """The plain form of a segment that begins at a base character."""
    kept = []
    for i, c in enumerate(segment):
        if c == JOINER:
            before, after = segment[i - 1 : i], segment[i + 1 : i + 2]
            if VIRAMA in (before, after) and "඀" <= after <= "෿":
                kept.append(c)
        else:
            kept.append(single(c))
    out = unicodedata.normalize("NFC", "".join(kept))
    for odd, right in SEQUENCES.items():
        out = out.replace(odd, right)
    return unicodedata.normalize("NFC", out)


HOME = ("LATIN", "SINHALA", "TAMIL")


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The alphabet of a letter by its name, '' for other characters."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def foreign_alphabets(text: str) -> frozenset[str]:
    """Alphabets the text is really written in: they have a letter there without a Latin twin."""
    return frozenset(alphabet(c) for c in set(text) if c.isalpha() and c not in LOOKALIKES) - {"", *HOME}


def latin_word(word: str, written: frozenset[str] = frozenset()) -> str:
    """Look-alikes as Latin letters, if every letter of another alphabet in the word has a Latin twin.

    A word with a letter that has none (a truly Cyrillic word, say) stays as it is. So does a word of look-alikes alone
    in a text that is ``written`` in their alphabet; in any other text it is a Latin word in disguise.

    >>> latin_word(chr(0x0430) + "bc"), latin_word("дом"), latin_word("сор", frozenset({"CYRILLIC"})), latin_word("сор") == "cop"
    ('abc', 'дом', 'сор', True)
    """
    if any(c.isalpha() and c not in LOOKALIKES and alphabet(c) not in HOME for c in word):
        return word
    if written and not any(alphabet(c) == "LATIN" and c not in LOOKALIKES for c in word) and any(alphabet(c) in written for c in word):
        return word
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in word))


_WORDS = re.compile(r"[^\W_]+(?:[̀-ͯ][^\W_]*)*")


def plain_form(text: str | None) -> str | None:
    """The one consistent form of a text; null stays null. Unstable segments are replaced, the rest is spliced in.

    >>> plain_form("２０１９ Tａble") == "2019 Table" and plain_form("Café") == "Café"
    True
    """
    if text is None or not (check := quick_check()).search(text):
        return text
    out, done = [], 0
    for m in check.finditer(text):
        low, high = m.span()
        if high <= done:
            continue
        # The segment begins at the base before the match and ends after the marks behind it; what vanishes
        # in between is passed over, as a mark may then meet its base.
        while low > done and (low == m.start() or is_mark(text[low]) or not single(text[low])):
            low -= 1
        while high < len(text) and (is_mark(text[high]) or not single(text[high])):
            high += 1
        out += (text[done:low], plain_segment(text[low:high]))
        done = high
    spliced = "".join(out) + text[done:]
    if any(c in LOOKALIKES for c in spliced):
        written = foreign_alphabets(spliced)
        latin = _WORDS.sub(lambda w: latin_word(w[0], written), spliced)
        return latin if latin == spliced else plain_form(latin)  # a mark may now compose with its new base
    return spliced


@F.pandas_udf(T.StringType())
def plain_form_udf(text: pd.Series) -> pd.Series:
    return text.map(plain_form, na_action="ignore").astype(object).where(text.notna(), None)


def maybe_unstable(text: Column) -> Column:
    """JVM-side quick check: false means the text is in its final form."""
    return text.rlike(java_pattern())


def plain_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the plain form of ``column`` as ``out``; only rows that fail the quick check pass through Python.

    Null stays null and empty stays empty; rows keep their order and number. Texts of any length are handled
    whole. The two branches are a union, so rows that are stable are never serialised.
    """
    unsure = F.coalesce(maybe_unstable(F.col(column)), F.lit(False))
    stable = df.where(~unsure).withColumn(out, F.col(column))
    return stable.unionByName(df.where(unsure).withColumn(out, plain_form_udf(column)))


def changed(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is not in the plain form."""
    unsure = df.where(maybe_unstable(F.col(column)))
    return unsure.where(plain_form_udf(column) != F.col(column))
