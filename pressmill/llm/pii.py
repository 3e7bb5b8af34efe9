"""Personal details in free text: found, and replaced by typed placeholders or keyed surrogates.

Detection works on a folded copy of the text of the same length (full-width forms as ASCII), so spans are spans
of the original. Numbers and addresses have closed forms; person names come from a lexicon and from what the
lexicon teaches about name endings, so names that are not listed are found as well; places of the gazetteer,
streets and firms are not names.

Surrogates keep type, script, letter case, layout and name family (an ending class, which carries the gender).
Telephone and identity numbers go through a keyed permutation of their digits, so different numbers never meet
in one surrogate; names, addresses and mail addresses go through keyed one-to-one maps of their words. Equal details
of one key get equal surrogates everywhere, whatever their layout or record, so coreference survives.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "national_id", "street_address", "person_name")

_WIDE = re.compile("[\uff01-\uff5e\u3000\xa0]")
_FOLD = {code: code - 0xFEE0 for code in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0xA0: 0x20}

# Words of addresses, titles and firms in the three languages.
STREETS_EN = "Road|Rd|Street|St|Lane|Ln|Avenue|Ave|Gardens|Garden|Place|Pl|Mawatha|Drive|Terrace|Crescent|Close|Court|Path|Row"
STREETS_SI = "පාර|පටුමග|මාවත|වීදිය|මාර්ගය|පෙදෙස|උයන"
STREETS_TA = "வீதி|ஒழுங்கை|தெரு|சாலை|மாவத்தை|பாதை|தோட்டம்"
DIGIT_WORDS = "zero one two three four five six seven eight nine".split()
FIRM_AFTER = re.compile(
    r"\s*(?:&|and\s+(?:Sons|Co|Company|Bros|Brothers|Daughters|Associates)\b|Motors|Traders|Stores|Sons|Bros|Brothers|Enterprises|Holdings|Hardware|Industries|"
    r"Associates|Company|Co\b|Ltd|\(?Pvt|Group|Agency|Agencies|Printers|Press|Hotel|Pharmacy|Textiles|Jewell?ers|Furniture|Electricals|Constructions?|Bakery|Salon|Studio|Tailors|Rice\s+Mills?|"
    rf"(?:{STREETS_EN})\b|සහ\s+(?:පුත්|සමාගම)|මෝටර්ස්|ස්ටෝර්ස්|ට්‍රේඩර්ස්|සමාගම|(?:{STREETS_SI})|மோட்டர்ஸ்|ஸ்டோர்ஸ்|டிரேடர்ஸ்|நிறுவனம்|(?:{STREETS_TA}))",
)
CUES = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Rev)\.?\s+((?:[A-Z][\w']+\s?){1,2})|\b(?:Contact|Speak with|Ask for|held by|Apply to|Call)\s+((?:[A-Z]\.\s?)*(?:[A-Z][a-z]{2,}|[A-Z]{3,})(?:\s(?:[A-Z][a-z]{2,}|[A-Z]{3,}))?)(?=\s+(?:on|\(|any|after|during|this|from|by)\b|\s*\(|,)")

_D = "[0-9Oo]"
_DW = "|".join(DIGIT_WORDS)
# A mail address begins where its run of characters begins, so each run is tried once.
_RUN = r"(?<![\w.+%-])[\w.+%-]+"
EMAIL = re.compile(
    rf"{_RUN}\s?@\s?[\w-]+(?:\.[\w-]+)+"
    rf"|{_RUN}\s?[(\[{{<]\s?at\s?[)\]}}>]\s?[\w-]+(?:(?:\s?[(\[{{<]\s?dot\s?[)\]}}>]\s?|\.)[\w-]+)+"
    rf"|{_RUN}\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+",
    re.IGNORECASE,
)
_MAIL_SIGN = re.compile(r"@|[(\[{<]\s?at\s?[)\]}>]|\sat\s+[\w-]+\s+dot\s", re.IGNORECASE)
NATIONAL_ID = re.compile(rf"(?<![\w+])(?:{_D}(?:[ -]?{_D}){{8}}\s?[VvXx](?!\w)|(?:19|2[0Oo]){_D}{{2}}[ -]?{_D}{{3}}[ -]?{_D}{{5}}(?!\w))")
PHONE = re.compile(rf"(?<![A-Za-z0-9])(?<![A-Za-z]/)(?:(?:\+|[0O][0O])\s?94|\+?94(?=[ -]|\d{{9}}(?!\w))|(?:\((?=[^()\n]{{1,5}}\)))?[0Oo](?!94))(?:[ .\-/()]{{0,2}}{_D}){{9}}(?!\w)")
SPOKEN_PHONE = re.compile(rf"\b(?:plus\s+)?(?:{_DW}|oh|double|triple)(?:[ ,-]+(?:{_DW}|oh|double|triple)){{6,13}}\b", re.IGNORECASE)
_HOUSE = r"\d{1,4}(?:\s?[A-Z](?![A-Za-z]))?(?:/\d{1,4}[A-Z]?)?"
# The number comes first, since few places of a text begin with one; what may stand before it is looked for from there.
ADDRESS = re.compile(
    rf"(?<![\d/\-,.])\b{_HOUSE},?\s(?:(?:[A-Z][\w'.]*\s){{1,3}}(?:{STREETS_EN}|{STREETS_EN.upper()})\b\.?(?:,\s[A-Z][\w-]+)?"
    rf"|(?:[඀-෿‍]+\s){{1,3}}(?:{STREETS_SI})(?![඀-෿])(?:,\s[඀-෿‍]+)?"
    rf"|(?:[஀-௿‌]+\s){{1,3}}(?:{STREETS_TA})(?![஀-௿])(?:,\s[஀-௿]+)?)"
)
ADDRESS_HEAD = re.compile(r"(?:(?:Flat|Apt\.?|Unit)\s\w+,\s)?(?:\b(?:No|NO|no)\b[.:]?\s?|#\s?|(?:අංක|නො|இல|எண்)\.?\s?)?$")
_TOKEN = re.compile(r"[A-Za-z][A-Za-z']+|[඀-෿][඀-෿‍]+|[஀-௿]{2,}")
_INITIALS = re.compile(r"(?:\b[A-Z]\.\s?){1,4}$")
_DIGIT, _DIGITS3, _SPOKEN = re.compile(r"\d"), re.compile(r"\d{3}"), re.compile("zero|plus", re.IGNORECASE)


def fold(text: str) -> str:
    """Full-width characters as ASCII; the length stays."""
    return text.translate(_FOLD) if _WIDE.search(text) else text


def shortest(word: str) -> int:
    return 4 if word[:1] < "\u0b80" else 3


class Names:
    """Person names by lexicon and by endings learned from it.

    An ending of four or more letters (three characters in the Indic scripts, whose consonants carry a vowel)
    counts as a name ending of a kind (given, surname) if at least ``least`` entries of the lexicon have it and no place of the gazetteer does; the letters before the ending must occur
    before endings of the lexicon. Tokens are compared in lower case.
    """

    def __init__(self, lexicon: Iterable[tuple[str, str]], places: Iterable[str], least: int = 4):
        self.kind = {form.lower(): kind for form, kind in lexicon if form}
        self.places = {p.lower() for p in places if p}
        ends: dict[str, Counter] = defaultdict(Counter)
        for form, kind in self.kind.items():
            for n in range(shortest(form), min(8, len(form) - 1)):
                ends[form[-n:]][kind] += 1
        taken = {p[-n:] for p in self.places for n in range(3, 9)}
        held = {e: sum(c.values()) for e, c in ends.items()}
        # An ending whose every bearer also bears one longer ending says less than that one and is left out.
        longer = {e[1:] for e, n in held.items() if held.get(e[1:]) == n}
        self.ends = {e: c.most_common(1)[0][0] for e, c in ends.items() if held[e] >= least and e not in taken and e not in longer}
        self.letters = {c for form in self.kind for c in form[: -len(self.family(form)) or None]}
        self.memo: dict[str, str | None] = {}

    def of(self, token: str) -> str | None:
        """'given', 'surname' or None for one token."""
        if token in self.memo:
            return self.memo[token]
        low = token.lower()
        kind = None if low in self.places else self.kind.get(low)
        if kind is None and low not in self.places and len(low) > 4:
            end = self.family(low)
            kind = self.ends[end] if end and len(end) < len(low) - 1 and not set(low[: -len(end)]) - self.letters else None
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[token] = kind
        return kind

    def family(self, token: str) -> str:
        """The ending class of a name: names of one family share script, kind and gender."""
        low = token.lower()
        return next((low[-n:] for n in range(shortest(low), 8) if low[-n:] in self.ends), "")


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text.replace("O", "0").replace("o", "0"))


def _spoken_digits(text: str) -> str:
    out, times = "", 1
    for w in re.findall(r"[a-z]+", text.lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        elif w == "oh" or w in DIGIT_WORDS:
            out += str(0 if w == "oh" else DIGIT_WORDS.index(w)) * times
            times = 1
    return out


def mentions(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, type) of every personal detail of a text in order, without overlaps.

    Numbers win over names: what lies inside a mail address, number or street address is not a name of its own.
    Null and empty texts have none; texts are read whole.
    """
    if not text:
        return []
    flat = fold(text)
    found: list[tuple[int, int, str]] = []
    free = flat

    def take(spans: list[tuple[int, int]], kind: str) -> None:
        """Notes the spans and hides them from the searches that follow."""
        nonlocal free
        if spans:
            found.extend((a, b, kind) for a, b in spans)
            parts, done = [], 0
            for a, b in spans:
                parts += (free[done:a], "\x00" * (b - a))
                done = b
            free = "".join(parts) + free[done:]

    if _MAIL_SIGN.search(flat):
        take([m.span() for m in EMAIL.finditer(free)], "email")
    if _DIGIT.search(flat):
        take([m.span() for m in NATIONAL_ID.finditer(free) if _DIGITS3.search(m[0]) and len(_digits(m[0])) in (9, 12)], "national_id")
        take([m.span() for m in PHONE.finditer(free) if sum(c.isdigit() for c in m[0]) >= 5], "phone")
        streets, done = [], 0
        for m in ADDRESS.finditer(free):
            near = max(done, m.start() - 64)
            done = m.end()
            streets.append((near + ADDRESS_HEAD.search(free[near : m.start()]).start(), done))
        take(streets, "street_address")
    if _SPOKEN.search(flat):
        take([m.span() for m in SPOKEN_PHONE.finditer(free) if 10 <= len(_spoken_digits(m[0])) <= 13], "phone")

    run: list[re.Match] = []
    people: list[tuple[int, int]] = []

    def close() -> None:
        a, b = run[0].start(), run[-1].end()
        if not FIRM_AFTER.match(free, b):
            if m := _INITIALS.search(free[max(0, a - 16) : a]):
                a = max(0, a - 16) + m.start()
            people.append((a, b))
        run.clear()

    memo = names.memo
    for m in _TOKEN.finditer(free):
        token = m[0]
        kind = memo[token] if token in memo else names.of(token)
        if kind is None and not run:
            continue
        if run and (kind is None or free[run[-1].end() : m.start()] != " " or len(run) > 1 or not (names.of(run[-1][0]) == "given" and kind == "surname")):
            close()
        if kind is not None:
            run.append(m)
    if run:
        close()
    known = list(people)
    for m in CUES.finditer(free):
        g = 1 if m[1] else 2
        a, b = m.span(g)
        words = m[g].split()
        if not any(x < b and a < y for x, y in known) and "\x00" not in m[g] and not FIRM_AFTER.match(free, b) and not any(w.lower() in names.places or w in NOT_NAMES for w in words):
            people.append((a, a + len(m[g].rstrip())))
    found += [(a, b, "person_name") for a, b in people]
    return sorted(found)


# Capitalised words that follow the cues without being names.
NOT_NAMES = frozenset("The Any After Before During This From Monday Tuesday Wednesday Thursday Friday Saturday Sunday Flat No Office Workshop Owner Tel Phone".split())


# ---- surrogates -------------------------------------------------------------------------------------------


def _hash(key: bytes, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode(), digest_size=8, key=hashlib.sha256(key).digest()).digest(), "big")


@lru_cache(4096)
def _short_key(key: bytes, what: str) -> bytes:
    return hashlib.blake2b(what.encode(), digest_size=32, key=hashlib.sha256(key).digest()).digest()


def _scramble(x: int, size: int, key: bytes, what: str, back: bool = False) -> int:
    """A keyed permutation of 0..size-1 and, with ``back``, its inverse: a Feistel network of four rounds over a slightly
    larger rectangle, repeated until the value is inside (cycle walking)."""
    left = math.isqrt(size - 1) + 1
    right = -(-size // left)
    short, blake = _short_key(key, what), hashlib.blake2b
    while True:
        a, b = divmod(x, right)
        for turn in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            step = int.from_bytes(blake(b"%d %d" % (turn, b if turn & 1 else a), digest_size=8, key=short).digest(), "big")
            if turn & 1:
                a = (a - step if back else a + step) % left
            else:
                b = (b - step if back else b + step) % right
        x = a * right + b
        if x < size:
            return x


@lru_cache(100_000)
def another(x: int, size: int, key: bytes, what: str) -> int:
    """A keyed one-to-one map of 0..size-1 that moves every value: one cycle through all of them.

    >>> moved = [another(i, 1000, b"k", "t") for i in range(1000)]
    >>> len(set(moved)), any(i == x for i, x in enumerate(moved))
    (1000, False)
    """
    return _scramble((_scramble(x, size, key, what) + 1) % size, size, key, what, back=True) if size > 1 else x


def permute_digits(digits: str, key: bytes, what: str) -> str:
    """A keyed bijection of digit strings of one length, without fixed points.

    >>> len({permute_digits(f"{i:04d}", b"k", "t") for i in range(10000)})
    10000
    """
    return str(another(int(digits), 10 ** len(digits), key, what)).zfill(len(digits)) if digits else digits


#: Days of birth in identity numbers: a day of the year, or that and 500 for women.
DAYS, WOMEN = 366, 500


def permute_identity(digits: str, head: int, key: bytes) -> str:
    """Another identity number of the same length and gender: the year of birth within its century (of 2000 to 2029 within
    these), the day within the year and the serial number move together, one to one. Numbers without a valid day move among
    such numbers.

    >>> permute_identity("855612345", 2, b"k")[2] in "5678" and permute_identity("850012345", 2, b"k")[2:5] not in "001"
    True
    """
    year, day, serial = digits[:head], int(digits[head : head + 3]), digits[head + 3 :]
    women = day > WOMEN
    if not 1 <= day - WOMEN * women <= DAYS:
        new = digits
        while True:
            new = permute_digits(new, key, "odd id")
            if not 1 <= int(new[head : head + 3]) % WOMEN <= DAYS:
                return new
    first, years = (0, 100) if head == 2 else (2000, 30) if 2000 <= int(year) < 2030 else (int(year) // 100 * 100, 100) if not year.startswith("20") else (2030, 70)
    serials = 10 ** len(serial)
    at = ((int(year) - first) * DAYS + day - WOMEN * women - 1) * serials + int(serial)
    rest, number = divmod(another(at, years * DAYS * serials, key, f"id {women} {first}"), serials)
    back, day = divmod(rest, DAYS)
    return f"{first + back:0{head}d}{day + 1 + WOMEN * women:03d}{number:0{len(serial)}d}"


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_INDIC = tuple("".join(chr(c) for c in range(a, b + 1) if unicodedata.category(chr(c)) in kinds) for a, b, kinds in (
    (0x0D85, 0x0D96, ("Lo",)), (0x0D9A, 0x0DC6, ("Lo",)), (0x0DCF, 0x0DDF, ("Mc", "Mn")), (0x0B85, 0x0B94, ("Lo",)), (0x0B95, 0x0BB9, ("Lo",)), (0x0BBE, 0x0BCC, ("Mc", "Mn"))))


@lru_cache(8)
def _moves(letters: frozenset[str] | None) -> dict[str, tuple[str, int]]:
    """The class of every character that can move, and its place there."""
    groups = ["".join(c for c in g if letters is None or c in letters) for g in (_VOWELS, _CONSONANTS, *_INDIC, "0123456789")]
    return {c: (g, i) for g in groups if len(g) > 1 for i, c in enumerate(g)}


@lru_cache(100_000)
def permute_letters(word: str, key: bytes, what: str, letters: frozenset[str] | None = None) -> str:
    """A keyed bijection of words of one pattern (vowels, consonants, signs and digits keep their places).

    Every character moves within its class by a keyed step that depends on the characters before it, so the word can
    be read back from left to right; the first one that can move always does, so no word stays. Only ``letters`` move;
    a leading zero stays and no other digit becomes one.
    """
    out, moved, moves = [], False, _moves(letters)
    seen = hashlib.blake2b(f"{what}\x1f".encode(), digest_size=8, key=_short_key(key, "letters"))
    for i, c in enumerate(word):
        new = c
        if c in moves:
            group, at = moves[c]
            if not i and c.isdigit():
                group, at = ("123456789", int(c) - 1) if "1" in group and c != "0" else (c, 0)
            if len(group) > 1:
                step = int.from_bytes(seen.digest(), "big")
                new = group[(at + (step % len(group) if moved else 1 + step % (len(group) - 1))) % len(group)]
                moved = True
        out.append(new)
        seen.update(c.encode())
    return "".join(out)


#: The words of an address and what stands between them; words of address forms are kept.
_WORDS = re.compile(r"([\w\u0d80-\u0dff\u0b80-\u0bff\u200c\u200d]+)|[^\w\u0d80-\u0dff\u0b80-\u0bff\u200c\u200d]+")
KEPT = frozenset(f"{STREETS_EN}|{STREETS_SI}|{STREETS_TA}|No|Flat|Apt|Unit|අංක|නො|இல|எண்".lower().split("|"))


def _into(layout: str, digits: str) -> str:
    """Digits put into the places of another number: separators and full-width forms stay, a misread O becomes a digit."""
    it, out = iter(digits), []
    for c, plain in zip(layout, fold(layout)):
        if plain.isdigit() or plain in "Oo":
            new = next(it, "0")
            c = new if c == plain else chr(ord(new) + 0xFEE0)
        out.append(c)
    return "".join(out)


class Surrogates:
    """Keyed replacements for details: one to one for one key over all records, whatever else a record holds."""

    def __init__(self, key: bytes, lexicon: Iterable[tuple[str, str]], places: Iterable[str], names: Names):
        self.key, self.names = key, names
        self.letters = frozenset(names.letters)
        listed: dict[tuple[str, ...], set[str]] = defaultdict(set)
        for form, kind in names.kind.items():
            if not self._stem(form):
                listed["name", script(form), kind, form[-1]].add(form)
        for p in names.places:
            if re.fullmatch(r"[\w\u0d80-\u0dff\u0b80-\u0bff\u200d]+", p) and p not in KEPT:
                listed["town", script(p)].add(p)
        # A keyed cycle through each list: another entry for every entry, and no two get the same.
        self.next: dict[str, dict[str, str]] = {"name": {}, "town": {}}
        for (what, *_), forms in listed.items():
            ring = sorted(forms, key=lambda f: (_hash(key, what, f), f))
            if len(ring) > 1:
                self.next[what].update(zip(ring, ring[1:] + ring[:1]))

    def _stem(self, word: str) -> str:
        """What stands before the family ending of a name, if it is long enough to be changed and still be a name."""
        stem = word[: len(word) - len(self.names.family(word))]
        return stem if len(stem) >= 2 and len(stem) < len(word) and len(word) > 4 and permute_letters(stem, self.key, "name", self.letters) != stem else ""

    def identity(self, kind: str, raw: str) -> str:
        """What makes two mentions the same detail, whatever their layout or case."""
        flat = fold(raw)
        if kind == "phone":
            digits = _digits(flat) if re.search(r"\d", flat) else _spoken_digits(flat)
            return re.sub(r"^(?:00)?94", "0", digits) if len(digits) > 10 else digits
        if kind == "national_id":
            return _digits(flat) + ("" if flat[-1].isdigit() else flat[-1].upper())
        if kind == "email":
            mail = re.sub(r"\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\s+dot\s+", ".", re.sub(r"\s?[(\[{<]\s?at\s?[)\]}>]\s?|\s+at\s+|\s?@\s?", "@", flat.lower()))
            return mail
        return re.sub(r"\s+", " ", flat).strip().lower()

    def draw(self, kind: str, identity: str) -> str:
        if kind == "phone":
            return identity[:3] + permute_digits(identity[3:], self.key, "phone")
        if kind == "national_id":
            body, letter = (identity[:-1], identity[-1]) if identity[-1] in "VX" else (identity, "")
            return permute_identity(body, 2 if len(body) == 9 else 4, self.key) + letter
        if kind == "email":
            return permute_letters(identity, self.key, "email") + ".invalid"
        if kind == "street_address":
            return self.address(identity)
        return " ".join(self.name(w) for w in identity.split(" "))

    def address(self, identity: str) -> str:
        """House, street and town replaced word by word; words of address forms stay. The step of a word depends on the
        words before it, so the address can be read back from left to right: no two addresses meet."""
        out, towns = "", self.next["town"]
        for m in _WORDS.finditer(identity):
            word, what = m[0], "address" + identity[: m.start()]
            if word in towns:
                word = towns[word]
            elif m[1] and word not in KEPT:
                word = permute_letters(word, self.key, what)
                while word in KEPT or word in towns:
                    word = permute_letters(word, self.key, what)
            out += word
        return out

    def name(self, word: str) -> str:
        """Another name of the same script and family, else of the same script and kind; an initial gives another initial.

        Names with a family change before its ending, listed names without one go round their list, all others change
        everywhere; each of the three is mapped one to one onto itself.
        """
        if re.fullmatch(r"(?:[a-z]\.)+", word):
            return "".join(chr(97 + (ord(c) - 97 + 1 + _hash(self.key, "initial", str(i)) % 25) % 26) if c != "." else c for i, c in enumerate(word))
        if stem := self._stem(word):
            end = word[len(stem) :]
            new = permute_letters(stem, self.key, "name" + end, self.letters)
            while new != stem and new + end in self.names.places:
                new = permute_letters(new, self.key, "name" + end, self.letters)
            return new + end
        if word in self.next["name"]:
            return self.next["name"][word]
        new = permute_letters(word, self.key, "other")
        while new != word and (new in self.names.places or new in self.next["name"] or self._stem(new) or re.fullmatch(r"(?:[a-z]\.)+", new)):
            new = permute_letters(new, self.key, "other")
        return new

    def shape(self, kind: str, raw: str, new: str) -> str:
        """The surrogate in the layout and case of the mention."""
        if kind in ("phone", "national_id"):
            flat = fold(raw)
            if kind == "phone" and not re.search(r"\d", flat):
                said = " ".join(DIGIT_WORDS[int(d)] for d in new)
                return said.capitalize() if raw[0].isupper() else said
            digits, mine = _digits(flat), new
            if kind == "phone" and len(digits) > 10:
                mine = digits[: len(digits) - 9] + new[1:]
            shaped = _into(raw, mine)
            return shaped
        if kind == "person_name":
            return " ".join(w.upper() if o.isupper() and len(o) > 2 else w if o.islower() else w.title() if script(w) == "latin" else w for w, o in zip(new.split(" "), re.sub(r"\s+", " ", raw).split(" ")))
        if kind == "street_address":
            pairs = zip((m[0] for m in _WORDS.finditer(new)), (m[0] for m in _WORDS.finditer(re.sub(r"\s+", " ", fold(raw)).strip())))
            return "".join(n.upper() if o.isupper() else n[:1].upper() + n[1:] if o[:1].isupper() else n for n, o in pairs)
        return new.upper() if raw.isupper() else new


@lru_cache(4096)
def script(text: str) -> str:
    return "sinhala" if re.search("[඀-෿]", text) else "tamil" if re.search("[஀-௿]", text) else "latin"


@dataclass
class Replacement:
    """One mention with what stands for it; mentions of one detail share ``entity_no``, the placeholder and the surrogate."""

    start: int
    end: int
    pii_type: str
    entity_no: int
    surrogate: str

    @property
    def placeholder(self) -> str:
        return f"[{self.pii_type.upper()}_{self.entity_no}]"


def spliced(text: str, found: list[Replacement], surrogates: bool) -> str:
    """The text with the surrogates or the placeholders of its mentions, built in one pass."""
    out, done = [], 0
    for r in found:
        out += (text[done : r.start], r.surrogate if surrogates else r.placeholder)
        done = r.end
    return "".join(out) + text[done:]


def replacements(text: str | None, names: Names, make: Surrogates, entities: dict[tuple[str, str], tuple[int, str]]) -> list[Replacement]:
    """Every mention of a text with its surrogate. ``entities`` holds (type, detail) to (number, surrogate) of the record
    and is extended, so a detail is one entity in all texts of its record; by the key its surrogate is the same everywhere."""
    out = []
    for a, b, kind in mentions(text, names):
        what = kind, make.identity(kind, text[a:b])
        if what not in entities:
            entities[what] = (1 + sum(k == kind for k, _ in entities), make.draw(*what))
        number, drawn = entities[what]
        out.append(Replacement(a, b, kind, number, make.shape(kind, text[a:b], drawn)))
    return out


# ---- on frames --------------------------------------------------------------------------------------------


#: Most rows of the lexicon or the gazetteer a worker is sent; both are fixed tables of a few hundred.
MOST_ENTRIES = 200_000


def knowledge(lexicon: DataFrame, locations: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """(name forms with their kind, place names) of the fixed tables, for the workers, once their size is checked."""
    forms = lexicon.select("name_en", "name_si", "name_ta", "name_type").distinct().limit(MOST_ENTRIES + 1).collect()
    places = locations.select("name_en", "name_si", "name_ta", "district").distinct().limit(MOST_ENTRIES + 1).collect()
    if max(len(forms), len(places)) > MOST_ENTRIES:
        raise ValueError(f"a lexicon or gazetteer of more than {MOST_ENTRIES} entries is no fixed table")
    return sorted({(f, r.name_type) for r in forms for f in r[:3] if f}), sorted({p for r in places for p in r if p})


def fresh_key() -> str:
    """A key for runs that are given none: surrogates then agree within the run and cannot be reversed by anyone."""
    return secrets.token_hex(32)


def _tools(shipped) -> tuple[Names, Surrogates]:
    forms, places, secret = shipped.value
    names = Names(forms, places)
    return names, Surrogates(secret, forms, places, names)


def mention_records(records: DataFrame, lexicon: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """(cand_id, fld, pii_type, mention_no, entity_no, placeholder, surrogate) for every replaced mention of
    ``records(cand_id, description, phones)``; mentions are numbered per type and field, over the whole list of phones.

    Records without details give no row; null and empty texts, lists and entries have none; repeated rows repeat theirs.
    """
    forms, places = knowledge(lexicon, locations)
    shipped = records.sparkSession.sparkContext.broadcast((forms, places, key.encode()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, make = _tools(shipped)
        for batch in batches:
            rows = []
            for cand, text, phones in zip(batch["cand_id"], batch["description"], batch["phones"]):
                entities: dict = {}
                for fld, texts in (("description", [text]), ("phones", [] if phones is None else phones)):
                    count: Counter = Counter()
                    for t in texts:
                        for r in replacements(t, names, make, entities) if isinstance(t, str) else ():
                            count[r.pii_type] += 1
                            rows.append((cand, fld, r.pii_type, count[r.pii_type], r.entity_no, r.placeholder, r.surrogate))
            yield pd.DataFrame(rows, columns=["cand_id", "fld", "pii_type", "mention_no", "entity_no", "placeholder", "surrogate"])

    return records.select("cand_id", "description", "phones").mapInPandas(run, "cand_id string, fld string, pii_type string, mention_no int, entity_no int, placeholder string, surrogate string")


def redact(records: DataFrame, lexicon: DataFrame, locations: DataFrame, key: str) -> DataFrame:
    """(cand_id, placeholder_text, surrogate_text, placeholder_phones, surrogate_phones) of ``records(cand_id, description, phones)``.

    Details are consistent between the text and the phones of a record and, by the key, over all records.
    Null texts and lists stay null, null entries stay null.
    """
    forms, places = knowledge(lexicon, locations)
    shipped = records.sparkSession.sparkContext.broadcast((forms, places, key.encode()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, make = _tools(shipped)
        for batch in batches:
            rows = []
            for cand, text, phones in zip(batch["cand_id"], batch["description"], batch["phones"]):
                entities: dict = {}
                text = text if isinstance(text, str) else None
                here = replacements(text, names, make, entities)
                listed = None if phones is None else [(p, replacements(p, names, make, entities)) for p in phones]
                rows.append((
                    cand, text and spliced(text, here, False), text and spliced(text, here, True),
                    None if listed is None else [p and spliced(p, found, False) for p, found in listed],
                    None if listed is None else [p and spliced(p, found, True) for p, found in listed],
                ))
            yield pd.DataFrame(rows, columns=["cand_id", "placeholder_text", "surrogate_text", "placeholder_phones", "surrogate_phones"])

    return records.select("cand_id", "description", "phones").mapInPandas(run, "cand_id string, placeholder_text string, surrogate_text string, placeholder_phones array<string>, surrogate_phones array<string>")
