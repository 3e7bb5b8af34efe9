"""Text of scanned pages repaired into continuous paragraphs, with the noise of every line named.

Learned from all texts first: how often every word occurs, how often each character confusion happens, and the
papers' running heads (single lines with page numbers or dates beside them). Each text is then decoded on its own:

* furniture (running heads, page numbers) is taken out of the stream of lines,
* the remaining lines form one stream. One Viterbi search over it joins words broken at line ends, undoes confusions
  and stray marks, and splits and merges words, all in one lattice at the cost of word and channel probabilities;
  the noise of a line is what the best path did there,
* paragraph boundaries are chosen by dynamic programming over line ends.

Frequent words and heads are shipped to the workers (bounded by their relative frequency). A text asks for the
others it needs, which come from the whole tables by equality joins, so no word is too rare to be known.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.llm.lookalike import plain_form, quick_check
from pressmill.session import durable

NOISES = ("hyphen_break", "misread", "running_header", "page_number")

# What is read, and what was printed, by script. Digits stand for letters inside words only.
CONFUSIONS: tuple[tuple[str, str], ...] = (
    ("!", "i"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "B"), ("0", "O"), ("5", "S"), ("1", "I"), ("4", "A"),
    ("|", "l"), ("l", "i"), ("c", "e"), ("cl", "d"), ("u", "a"), ("ri", "n"), ("f", "t"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("b", "h"),
    ("ච", "ව"), ("ත", "ක"), ("ස", "ය"), ("ඔ", "ම"), ("ත", "න"), ("ඛ", "බ"), ("ඵ", "එ"),
    ("சு", "க"), ("ய", "ப"), ("L", "ட"), ("வ", "ல"), ("ள", "ன"),
)
IN_NUMBERS = frozenset("OoDlISBZ")
#: Marks that scanning leaves on the page and printing does not.
STRAY = re.compile(r"'`|`|_\.|[|^~_¦¬•■□▪◦¤§]")
BREAK = re.compile(r"(?:(?<=[^\W\d_])|(?<=[ං-෿஀-௿‍]))(?:-|¬|=|­|‐)$")
#: Letters no print mixes like this: capitals inside a word that begins small, or next to digits (eBay and iPod apart).
GARBLED = re.compile(r"(?<![\w-])(?!(?:[ie][A-Z][a-z]+)\b)(?:[a-z]+[A-Z]+[a-z]\w*|[a-z]+[A-Z]\w*\d\w*|\d+[a-z]+[A-Z]\w*)")
DATE = r"\d{1,2}(?:st|nd|rd|th)?\s+[A-Z][a-z]+\s+\d{4}"
PAGE_NUMBER = re.compile(r"[\[({|\-–—~.\s]*(?:(?:Page|PAGE|page|Pg|P|p|පිටුව|පිටු|பக்கம்|பக்)\.?\s*(?:No\.?\s*)?)?[\dOIl|]{0,3}\d[\dOIl]{0,3}[\])}|\-–—~.\sJ^¦_'`]*")
#: What an ask begins with if it is for the pieces of a run, or for heads.
RUN, HEAD = "\x02", "\x01"
_NATIVE = re.compile(r"[\u0b80-\u0dff]")
_EDGES = re.compile(r"^[^\w඀-෿஀-௿]+|[^\w඀-෿஀-௿‍]+$")
_DIGIT = re.compile(r"\d")
_STOPS = (".", "!", "?", ".\"", ".'", ":")


def core(token: str) -> str:
    """A token without punctuation at its edges."""
    return _EDGES.sub("", token)


#: A misread form must stay below this many times what the learned rate of its confusion lets expect.
SLACK = 12.0
#: Shapes of numbers stand for many numbers each, so a letter in one (model 200S) is told from a misread digit by this ratio.
NUMBER_RATIO = 200
#: Costs in nats beside the words' own: a break at a line end, a lost or an added space, a stray mark, a compound never seen unbroken.
PRINTED_HYPHEN = 30.0
BREAK_COST, SPACE_COST, STRAY_COST, COMPOUND_COST = 1.0, 4.0, 6.0, 10.0
#: Rate of a confusion the texts say nothing about.
DEFAULT_RATE, LEAST_RATE = 4e-3, 2e-4
_RUN = re.compile(r"(?<=\d)\d|\d(?=\d)")
_SMALL = re.compile(r"[a-z\u0b80-\u0dff]")
#: Latin words as print writes them; codes hold digits and are no words.
_ORDINARY = re.compile(r"(?:[a-z]+|[A-Z][a-z]*|[A-Z]{1,3}s?)(?:['’][A-Za-z]+)?")
_LATIN_ONLY = re.compile(r"[A-Za-z]+")


def shape(c: str) -> str:
    """A word as it is counted: digits as 9, except a single digit among small letters, which may be a misread letter."""
    return _RUN.sub("9", c) if _SMALL.search(c) else _DIGIT.sub("9", c)


class Lexicon:
    """Counts of words (cores of tokens, in ``shape``) and what they say about misreadings.

    ``raw`` holds the frequent tokens or words; ``local`` the counts of rarer ones that answer what the text at hand
    asked for (``told``). What the lexicon is asked for and does not hold is noted in ``asks``.
    """

    def __init__(self, raw: dict[str, int], rates: dict[tuple[str, str], float] | None = None, total: int = 0, longest: int = 0):
        self.cores: dict[str, int] = {}
        for token, n in raw.items():
            c = shape(core(token))
            self.cores[c] = self.cores.get(c, 0) + n
        self.total = max(total, sum(raw.values()), 1)
        self.by_read: dict[str, list[tuple[str, str]]] = {}
        for read, printed in CONFUSIONS:
            self.by_read.setdefault(read[0], []).append((read, printed))
        self.longest = longest or max(map(len, self.cores), default=0)
        self.local: dict[str, int] = {}
        self.told: set[str] = set()
        self.asks: set[str] = set()
        self.memo: dict[str, tuple[tuple[float, str, tuple[int, ...]], frozenset[str]]] = {}
        self.clear: set[str] = set()
        self.rates = learn_rates(misreadings(self.cores), self.cores) if rates is None else rates

    def count(self, c: str) -> int:
        """How often a word occurs, as written or, if never, with a small first letter."""
        n = self.cores.get(c) or self.local.get(c, 0)
        if n or not c:
            return n
        small = c[0].lower() + c[1:]
        return self.cores.get(small) or self.local.get(small, 0)

    def wanted(self, c: str) -> None:
        """Notes a word whose count and neighbours the frequent words do not give."""
        if len(c) > 1 and shape(c) not in self.cores:
            self.asks.add(c)

    def variants(self, c: str) -> Iterator[tuple[str, int, float]]:
        """(printed form, position, rate) for one confusion undone at one place."""
        for i, ch in enumerate(c):
            for read, printed in self.by_read.get(ch, ()):
                if c.startswith(read, i):
                    if ch.isdigit() and not (c[i - 1 : i].isalpha() or c[i + 1 : i + 2].isalpha()):
                        continue
                    yield c[:i] + printed + c[i + len(read) :], i, self.rates.get((read, printed), DEFAULT_RATE)
            if ch in IN_NUMBERS and (c[i - 1 : i].isdigit() or c[i + 1 : i + 2].isdigit() or (i and c[i - 1] in IN_NUMBERS)):
                yield c[:i] + "9" + c[i + 1 :], i, self.rates.get((ch, "9"), DEFAULT_RATE)

    def forms(self, c: str) -> Iterator[tuple[str, tuple[int, ...], float]]:
        """Printed forms of a word with one confusion undone, or two in a longer one that never occurs itself."""
        first = list(self.variants(c))
        yield from ((form, (at,), rate) for form, at, rate in first)
        if len(c) >= 4 and self.count(shape(c)) <= 2:
            for form, at, rate in first:
                yield from ((again, (at, other), rate * more) for again, other, more in self.variants(form) if again != c)

    def readings(self, c: str) -> list[tuple[float, str, tuple[int, ...]]]:
        """[(cost, printed form, misread positions)] of a word; the word itself comes with no positions.

        A form explains as many occurrences as its own number times the rate of the confusion. What of a word's
        occurrences its forms do not explain, with slack, speaks for the word itself; a character that no print has
        at its place leaves nothing.
        """
        n = self.count(shape(c))
        self.wanted(c)
        out, own = [], float(n)
        if len(c) > 1:
            for form, at, rate in self.forms(c):
                k = self.count(shape(form))
                if not k:
                    continue
                odd = len(at) == 1 and impossible(c, at[0])
                expected = k * max(rate, LEAST_RATE ** len(at))
                out.append((math.log(self.total / expected), form, at))
                number = len(at) == 1 and c[at[0]] in IN_NUMBERS and "9" in shape(c) and _DIGIT.search(form)
                if odd or (n <= 2 and k >= 3) or (k >= NUMBER_RATIO * n if number else n <= SLACK * expected and k >= 10 * n):
                    own = 0.0
        keep = self.cost(c) if own or not out else 60.0
        return [(keep, c, ()), *out]

    def known(self, c: str) -> bool:
        """Whether a word occurs oftener than by the token at hand and one copy of it."""
        return self.count(shape(c)) > 2

    def cost(self, c: str) -> float:
        """Negative log probability of a word; one that is not known pays by its length."""
        n = self.count(shape(c))
        return math.log(self.total / n) if n > 2 else max(math.log(self.total / n) if n else 0.0, 12.0 + 1.5 * len(c))

    def judged(self, token: str) -> tuple[float, str, tuple[int, ...]]:
        """(cost, printed form, misread positions) of one whole token by itself; remembered unless the answers of
        this text bear on it."""
        found = self.memo.get(token)
        if found is None or not self.told.isdisjoint(found[1]):
            before, self.asks = self.asks, set()
            best = judge(self, token)
            found, self.asks = (best, frozenset(self.asks)), before
            if self.told.isdisjoint(found[1]):
                if len(self.memo) > 200_000:
                    self.memo.clear()
                self.memo[token] = found
        self.asks |= found[1]
        return found[0]

    def doubtful(self, token: str) -> bool:
        """Whether a token may be anything but a known word as it stands. Tokens that no text can make doubtful are
        remembered in ``clear``."""
        _, _, at = self.judged(token)
        c = core(token)
        sure = not at and (not c or self.known(c)) and not odd_word(self, token)
        if sure and not self.memo.get(token, ((), True))[1]:
            if len(self.clear) > 200_000:
                self.clear.clear()
            self.clear.add(token)
        return not sure


def misreadings(words: dict[str, int], most: int = 2_000, least: int = 50) -> list[tuple[tuple[str, str], int, str]]:
    """[((read, printed), n, misread form)] of the ``most`` most frequent words, of those seen ``least`` times."""
    out = []
    for word, n in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:most]:
        for read, printed in [*CONFUSIONS, *((ch, "9") for ch in sorted(IN_NUMBERS))] if n >= least else ():
            at = word.find(printed)
            while at >= 0:
                out.append(((read, printed), n, word[:at] + read + word[at + len(printed) :]))
                at = word.find(printed, at + 1)
    return out


def learn_rates(forms: list[tuple[tuple[str, str], int, str]], counts: dict[str, int]) -> dict[tuple[str, str], float]:
    """How often each printed form is misread as each read form, over ``misreadings`` with the ``counts`` of the forms.

    Words of their own that merely look like a misreading (``clay`` and ``day``) stand out from the rate of the others
    and are left out of it, in a few rounds.
    """
    seen: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for pair, n, form in forms:
        seen.setdefault(pair, []).append((counts.get(form, 0), n))
    rates = {}
    for pair, each in seen.items():
        rate = max(sorted(k / n for k, n in each)[len(each) // 2], 0.001)
        for _ in range(4):
            kept = [(k, n) for k, n in each if k <= 8.0 * rate * n + 8.0]
            rate = sum(k for k, _ in kept) / max(sum(n for _, n in kept), 1)
        rates[pair] = max(rate, LEAST_RATE)
    return rates


def impossible(c: str, at: int) -> bool:
    """A character no print has inside a word: an exclamation mark or digit between letters, a Latin letter in another script."""
    ch, rest = c[at], c[:at] + c[at + 1 :]
    if ch == "!":
        return True
    if ch.isdigit():
        return sum(x.isalpha() for x in rest) >= 3 and not any(x.isdigit() for x in rest)
    return ch.isascii() and ch.isalpha() and any("\u0b80" <= x <= "\u0dff" for x in rest)


def lookalike_free(token: str) -> str:
    return plain_form(token) if quick_check().search(token) else token


def judge(lexicon: Lexicon, token: str) -> tuple[float, str, tuple[int, ...]]:
    """(cost, printed form, misread positions) of one token: the cheapest reading of its core, its marks kept."""
    plain = lookalike_free(token)
    if m := STRAY.search(plain):
        bare = STRAY.sub("", plain)
        return (STRAY_COST + (lexicon.cost(core(bare)) if bare else 0.0), bare, (m.start(),))
    c = core(plain)
    if GARBLED.match(plain) and lexicon.count(shape(c)) <= SLACK * lexicon.total * 1e-4:
        return (STRAY_COST + lexicon.cost(c), plain, (0,))
    if plain.endswith("!") and not plain.startswith(c + "!"):
        c = c or plain
    if not c:
        return (0.0, token, ())
    options = [(cost, form, at, c) for cost, form, at in lexicon.readings(c)]
    if "!" in plain[:-1] and (inner := plain.strip(".,;:()\"'")) != c and not any(o[2] for o in options):
        options = [(cost, form, at, inner) for cost, form, at in lexicon.readings(inner) if at] or options
    cost, form, at, part = min(options, key=lambda o: (o[0], o[1]))
    if not at:
        return (cost, token, ())
    offset = plain.index(part)
    return (cost, plain[:offset] + form + plain[offset + len(part) :], tuple(p + offset for p in at))


def odd_word(lexicon: Lexicon, token: str) -> bool:
    """Letters no Latin word has together: capitals before small ones, or a longer word in capitals that is never
    written small. Beside words of another script these are what the scanner made of one of those."""
    c = core(token)
    if not _LATIN_ONLY.fullmatch(c) or _ORDINARY.fullmatch(c):
        return False
    return not (c.isupper() and (lexicon.count(c.lower()) or lexicon.count(c.title())))


_NUMBER_BEFORE, _AFTER = re.compile(r"^\S{1,4}\s{2,}(?=\D)"), re.compile(rf"\s{{2,}}(?:{DATE}|\S{{1,4}}|.{{6,20}}\d{{4}})$")


def head_key(line: str) -> str:
    """A head line without page number, date, case and punctuation."""
    bare = _AFTER.sub("", _NUMBER_BEFORE.sub("", line.strip()))
    return re.sub(r"[^\w඀-෿஀-௿ ]+|_", "", bare).casefold().strip()


def bounded_distance(a: str, b: str, most: int) -> int:
    """Edit distance, given up beyond ``most``."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def masks(key: str) -> Iterator[str]:
    """A head key and its forms with one word left out, or two of four and more: one of them survives damage there."""
    words = key.split()
    n = len(words)
    yield " ".join(words)
    if n > 1:
        for i in range(n):
            yield " ".join([*words[:i], "*", *words[i + 1 :]])
    if n > 3:
        for i in range(n):
            for j in range(i + 1, n):
                if 2 * (len(words[i]) + len(words[j])) <= sum(map(len, words)):
                    yield " ".join("*" if k in (i, j) else w for k, w in enumerate(words))


class Heads:
    """Running heads by their masks; ``local`` holds rarer ones the text at hand asks for."""

    def __init__(self, keys: Iterable[str], rest: int = 0):
        self.masks: dict[str, str] = {}
        for key in keys:
            for m in masks(key):
                self.masks.setdefault(m, " ".join(key.split()))
        self.lengths = {len(m.split()) for m in self.masks}
        self.rest = rest  # most words of a head that is not among ``keys``
        self.local: dict[str, str] = {}

    def near(self, line: str, asks: set[str] | None = None) -> bool:
        """A line that is a paper's head, up to damage within a word or two."""
        key = head_key(line)
        if not key:
            return False
        words = key.split()
        if len(words) > self.rest and len(words) not in self.lengths:
            return False
        for m in masks(key):
            head = self.masks.get(m) or self.local.get(m)
            if head and (len(words) > 2 or all(bounded_distance(x, y, max(1, len(y) // 3)) <= max(1, len(y) // 3) for x, y in zip(words, head.split()))):
                return True
        if asks is not None and len(words) <= self.rest:
            asks.update(HEAD + m for m in masks(key))
        return False


@dataclass
class Page:
    """A decoded text: the noises as (line number from 1, noise), and the repaired paragraphs."""

    noises: list[tuple[int, str]]
    paragraphs: list[str]


@dataclass
class Step:
    """One edge of the best path: tokens [start, stop) are read as ``words``; ``misread`` are tokens with damage."""

    cost: float
    start: int
    stop: int
    words: list[str]
    misread: tuple[int, ...] = ()


def segments(c: str, lexicon: Lexicon) -> tuple[float, list[str]] | None:
    """The cheapest reading of a run of letters as two or more known words, or None; a word may be
    misread itself. Words of any script (vowel signs and virama are marks, not letters), runs of any length; no piece
    is longer than the longest known word."""
    n, asks = len(c), {*lexicon.asks, RUN + c}  # the ask of the whole run covers its pieces
    best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
    for j in range(2, n + 1):
        for i in range(max(0, j - lexicon.longest - 2), j - 1):
            if best[i][0] == math.inf or (not i and j == n):
                continue
            w = c[i:j]
            if lexicon.known(w):
                cost, form = lexicon.cost(w), w
            elif len(w) >= 4 and (fixed := min(((x, f) for x, f, at in lexicon.readings(w) if len(at) == 1), default=None)):
                cost, form = fixed
            else:
                continue
            best[j] = min(best[j], (best[i][0] + cost + (SPACE_COST if i else 0.0), i, form))
    lexicon.asks = asks
    if best[n][0] == math.inf:
        return None
    words, j = [], n
    while j:
        words.append(best[j][2])
        j = best[j][1]
    return best[n][0], words[::-1]


def edges(lexicon: Lexicon, tokens: list[str], broken: set[int], j: int) -> Iterator[Step]:
    """All readings of the stream that end after token ``j``: kept or corrected, split, merged with the token before,
    or joined over one or two line breaks; joined and merged words may be misread as well."""
    token = tokens[j]
    cost, form, at = lexicon.judged(token)
    yield Step(cost, j, j + 1, [form] if form else [], (j,) if at else ())
    c = core(token)
    unknown = not at and c and not lexicon.known(c)
    if unknown and len(c) >= 5 and j not in broken and all(unicodedata.category(x)[0] in "LM" or x == "\u200d" for x in c) and (parts := segments(c, lexicon)):
        yield Step(parts[0], j, j + 1, token.replace(c, " ".join(parts[1]), 1).split(" "))
    if j and j - 1 not in broken and j not in broken and (unknown or not lexicon.known(core(tokens[j - 1]))):
        joined = tokens[j - 1] + token
        lexicon.wanted(core(joined))
        if lexicon.known(core(joined)):
            yield Step(lexicon.cost(core(joined)) + SPACE_COST, j - 1, j + 1, [joined])
    start = j
    while start and start - 1 in broken:
        start -= 1
    if start < j:
        yield from joints(lexicon, tokens, start, j)


def joints(lexicon: Lexicon, tokens: list[str], start: int, j: int) -> Iterator[Step]:
    """A word broken over line ends put together: without its break marks, or with one that is its own hyphen."""
    parts, marks = [], []
    for k in range(start, j + 1):
        end = BREAK.search(tokens[k]) if k < j else None
        parts.append(tokens[k][: end.start()] if end else tokens[k])
        marks.append(end[0] if end else "")
    bare = [STRAY.sub("", lookalike_free(p)) for p in parts]
    stray = tuple(start + k for k, p in enumerate(parts) if STRAY.search(lookalike_free(p)))
    for own in (False, True):
        # A compound oftener printed than a frequent word is frequent itself.
        if own and ("-" not in marks or shape(core("".join(bare))) in lexicon.cores and shape(core("-".join(bare))) not in lexicon.cores):
            continue
        whole, owners = "", []
        for k, p in enumerate(bare):
            piece = p + ("-" if own and marks[k] == "-" else "")
            whole += piece
            owners += [start + k] * len(piece)
        cost, form, at = lexicon.judged(whole)
        if own and not lexicon.count(shape(core(whole))) and not at:
            cost = sum(lexicon.cost(core(p)) for p in bare) + COMPOUND_COST
        hit = {owners[min(p, len(owners) - 1)] for p in at} | set(stray)
        yield Step(cost + BREAK_COST * (j - start) + STRAY_COST * len(stray), start, j + 1, [form], tuple(sorted(hit)))


def among_native(tokens: list[str], home: list[int], k: int) -> bool:
    """Whether a token stands among words in native letters: next to one on its line, numbers passed over, or, with no other
    word on its line, between such words."""
    sides: list[str | None] = []
    for step in (-1, 1):
        j = k + step
        while 0 <= j < len(tokens) and home[j] == home[k] and not any(c.isalpha() for c in tokens[j]):
            j += step
        sides.append(tokens[j] if 0 <= j < len(tokens) and home[j] == home[k] else None)
    if any(sides):
        return any(s and _NATIVE.search(s) for s in sides)
    ends = [next((tokens[j] for j in way if home[j] != home[k] and any(c.isalpha() for c in tokens[j])), None) for way in (range(k - 1, -1, -1), range(k + 1, len(tokens)))]
    return any(ends) and all(e is None or _NATIVE.search(e) for e in ends)


def best_path(tokens: list[str], broken: set[int], lexicon: Lexicon) -> list[Step]:
    """The steps of the cheapest reading of a de-lined stream; tokens without a step stand as they are.

    Known tokens without a doubtful neighbour are their own reading in every path, so the search runs over the
    stretches between them. A token in ``broken`` ends its line inside a word and is joined to the next, unless both
    ends are cheaper as words apart.
    """
    n, clear = len(tokens), lexicon.clear
    doubt = {k for k, t in enumerate(tokens) if t not in clear and k not in broken and k - 1 not in broken and lexicon.doubtful(t)}
    doubt |= broken | {k + 1 for k in broken if k + 1 < n}
    out: list[Step] = []
    done = 0
    for first in sorted(doubt):
        if first < done:
            continue
        k, end = max(first - 1, done), first + 1
        while end < n and (end in doubt or end - 1 in doubt):
            end += 1
        best: list[tuple[float, Step | None]] = [(0.0, None)] + [(math.inf, None)] * (end - k)
        for j in range(k, end):
            for e in edges(lexicon, tokens, broken, j):
                if e.start >= k and (cost := best[e.start - k][0] + e.cost + (PRINTED_HYPHEN if e.stop - 1 in broken else 0.0)) < best[j + 1 - k][0]:
                    best[j + 1 - k] = (cost, e)
        at, steps = end, []
        while at > k:
            step = best[at - k][1]
            steps.append(step)
            at = step.start
        out += reversed(steps)
        done = end
    return out


def viterbi(tokens: list[str], lexicon: Lexicon) -> list[str]:
    """The words of the best reading of a stream without line breaks."""
    out, done = [], 0
    for step in best_path(tokens, set(), lexicon):
        out += tokens[done : step.start] + step.words
        done = step.stop
    return out + tokens[done:]


def decode(text: str | None, lexicon: Lexicon, heads: Heads, repair: bool = False) -> Page:
    """Names the noise of every line of a text and, if asked, repairs it. Null and empty texts have neither.

    Furniture is taken out first; the content lines then form one stream of tokens, and the noise of their lines is
    read off the best path through it.
    """
    if not text:
        return Page([], [])
    lines = text.split("\n")
    noises: list[tuple[int, str]] = []
    content: list[int] = []
    blank = [not s.strip() for s in lines]
    for i, line in enumerate(lines):
        if blank[i]:
            continue
        alone = (i == 0 or blank[i - 1]) and (i + 1 == len(lines) or blank[i + 1])
        if alone and PAGE_NUMBER.fullmatch(line if line.isascii() else lookalike_free(line)):
            noises.append((i + 1, "page_number"))
        elif alone and heads.near(lookalike_free(line), lexicon.asks):
            noises.append((i + 1, "running_header"))
        else:
            content.append(i)
    tokens: list[str] = []
    home: list[int] = []
    broken: set[int] = set()
    for at, i in enumerate(content):
        words = lines[i].split()
        tokens += words
        home += [i] * len(words)
        if at + 1 < len(content) and BREAK.search(words[-1]):
            broken.add(len(tokens) - 1)
    steps = best_path(tokens, broken, lexicon)
    for step in steps:
        noises += [(home[k] + 1, "misread") for k in step.misread]
        noises += [(home[k] + 1, "hyphen_break") for k in range(step.start, step.stop - 1) if k in broken]
        for k in range(step.start, step.stop):
            if tokens[k].isascii() and odd_word(lexicon, tokens[k]) and among_native(tokens, home, k):
                noises.append((home[k] + 1, "misread"))
    noises = sorted(set(noises))
    if not repair:
        return Page(noises, [])
    rows: dict[int, list[str]] = {i: [] for i in content}
    joins: set[int] = set()
    done = 0
    for step in [*steps, Step(0.0, len(tokens), len(tokens), [])]:
        for k in range(done, step.start):
            rows[home[k]].append(tokens[k])
        if step.words:
            rows[home[step.start]] += step.words
        joins |= {home[k] for k in range(step.start, step.stop - 1) if home[k] != home[k + 1]}
        done = step.stop
    return Page(noises, rebuild(content, rows, joins, blank))


def rebuild(content: list[int], fixed: dict[int, list[str]], joins: set[int], blank: list[bool]) -> list[str]:
    """Continuous paragraphs: boundaries by dynamic programming over the ends of content lines.

    A boundary is cheap after a short line that ends a sentence and before a blank line, dear inside a broken
    word, before a small letter or after a line without a stop; every paragraph costs a little.
    """
    rows = [fixed[i] for i in content]
    widths = [sum(map(len, r)) + len(r) for r in rows]
    usual = sorted(widths)[len(widths) * 3 // 4] if widths else 0
    n = len(rows)
    cost = [0.0] + [math.inf] * n
    back = [0] * (n + 1)

    def boundary(k: int) -> float:
        """The cost of a paragraph end after row k."""
        if k == n - 1:
            return 0.0
        if content[k] in joins:
            return 50.0
        gap = any(blank[content[k] + 1 : content[k + 1]])
        last = rows[k][-1] if rows[k] else ""
        following = next((w for r in rows[k + 1 :] for w in r), "")
        ends = last.endswith(_STOPS)
        return 1.0 + (-1.5 if gap else 2.0) + (-0.5 if ends else 1.5) + (-0.5 if widths[k] < 0.7 * usual else 0.5) + (2.0 if following[:1].islower() else 0.0)

    def inside(k: int) -> float:
        """The cost of going on after row k."""
        gap = any(blank[content[k] + 1 : content[k + 1]])
        ends = bool(rows[k]) and rows[k][-1].endswith(_STOPS)
        return (2.0 if gap else 0.0) + (0.5 if ends and gap else 0.0)

    # The cost of going on is a prefix sum, so the best start of a paragraph that ends at j is the least of
    # cost[i] - before[i] over all earlier i: one running minimum, linear in the lines.
    before = [0.0] * (n + 1)
    for i in range(1, n):
        before[i] = before[i - 1] + inside(i - 1)
    least, start = cost[0] - before[0], 0
    for j in range(1, n + 1):
        cost[j], back[j] = least + before[j - 1] + boundary(j - 1), start
        if j < n and cost[j] - before[j] < least:
            least, start = cost[j] - before[j], j
    out: list[str] = []
    j = n
    while j:
        out.append(" ".join(w for r in rows[back[j] : j] for w in r))
        j = back[j]
    return [p for p in reversed(out) if p]


# ---- on frames --------------------------------------------------------------------------------------------

_EDGES_SQL = r"^[^\p{L}\p{N}_஀-෿]+|[^\p{L}\p{N}_஀-෿‍]+$"


@dataclass
class Learned:
    """What all texts say: the frequent words and heads for every worker, the whole tables for what is rarer."""

    words: dict[str, int]
    total: int
    rates: dict[tuple[str, str], float]
    longest: int
    heads: list[str]
    rest: int
    all_words: DataFrame
    rare_heads: DataFrame


def learn(texts: DataFrame, share: float = 2e-6, least: int = 3, head_share: float = 1e-3) -> Learned:
    """Words with their counts and running heads of all texts.

    Words of a relative frequency of ``share`` and heads of ``head_share`` go to every worker, so at most 1/share
    words and 1/head_share heads do; all others stay in tables and are joined to the texts that ask for them. A head
    is a line by itself seen at least ``least`` times with a number or a date beside it. Counts combine map-side. The
    rates of confusions are fitted on the 2,000 most frequent words (``misreadings``).
    """
    spark = texts.sparkSession
    tokens = texts.select(F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''").groupBy("token").count()
    bare = F.regexp_replace("token", _EDGES_SQL, "")
    folded = F.when(bare.rlike("[a-z\u0b80-\u0dff]"), F.regexp_replace(bare, r"(?<=\d)\d|\d(?=\d)", "9")).otherwise(F.regexp_replace(bare, r"\d", "9"))
    words = durable(tokens.select(folded.alias("word"), "count").groupBy("word").agg(F.sum("count").alias("n")))
    total, longest = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(F.when(F.col("n") > 2, F.length("word"))), F.lit(1))).first()
    frequent = {r.word: r.n for r in words.where(F.col("n") >= max(1.0, share * total)).collect()}
    lone = texts.select(F.explode(F.split("text", r"\n[ \t]*\n")).alias("line")).where("NOT contains(line, '\n')")
    beside = rf"^\d{{1,3}}\s{{2,}}(\D+)$|^(\D+?)\s{{2,}}\d{{1,3}}$|^(\D+?)\s{{2,}}{DATE}$"
    found = lone.where(F.col("line").rlike(beside)).select(F.concat(*[F.coalesce(F.regexp_extract("line", beside, k), F.lit("")) for k in (1, 2, 3)]).alias("head")).groupBy("head").count()
    seen = durable(found.select(_keys("head").alias("key"), "count").where("key <> ''").groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") >= least))
    floor = head_share * (seen.agg(F.sum("n")).first()[0] or 0)
    rare = seen.where(F.col("n") < floor).select("key")
    rest = rare.agg(F.max(F.size(F.split("key", r"\s+")))).first()[0] or 0
    forms = misreadings(frequent)
    wanted = spark.createDataFrame([(f,) for f in sorted({f for _, _, f in forms})], "word string")
    counts = {r.word: r.n for r in words.join(wanted, "word").collect()}
    return Learned(frequent, total, learn_rates(forms, counts), longest, sorted(r.key for r in seen.where(F.col("n") >= floor).collect()), rest, words, rare)


@F.pandas_udf(T.StringType())
def _keys(lines: pd.Series) -> pd.Series:
    return lines.map(head_key)


def answers(asks: DataFrame, learned: Learned) -> DataFrame:
    """(ask, found, n) for every distinct ``ask``: rarer words that it is or may be a misreading or a run of, and rarer
    heads. Candidates are generated per distinct ask and meet the whole tables in equality joins."""
    lexicon = Lexicon({}, learned.rates, learned.total, learned.longest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, f) for a in batch["ask"] for f in candidates(a, lexicon)]
            yield pd.DataFrame(rows, columns=["ask", "found"])

    # Distinct within an explicit number of parts, since the candidates are made by a row-wise stage.
    distinct = asks.repartition(2 * asks.sparkSession.sparkContext.defaultParallelism, "ask").distinct()
    words = distinct.where(~F.col("ask").startswith(HEAD)).mapInPandas(run, "ask string, found string").join(learned.all_words.withColumnRenamed("word", "found"), "found").select("ask", "found", "n")
    heads = learned.rare_heads.mapInPandas(_masked, "ask string, found string").join(distinct, "ask").select("ask", "found", F.lit(0).cast("long").alias("n"))
    return words.unionByName(heads)


def _masked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame([(HEAD + m, " ".join(k.split())) for k in batch["key"] for m in masks(k)], columns=["ask", "found"])


def candidates(ask: str, lexicon: Lexicon) -> set[str]:
    """Everything a lexicon may be asked for while it reads a word: itself and its forms, or the pieces of a run."""
    if ask[0] == RUN:
        run = ask[1:]
        out = {run[i:j] for i in range(len(run)) for j in range(i + 2, min(len(run), i + lexicon.longest + 2) + 1) if j - i < len(run)}
        out |= {form for p in out if len(p) >= 4 for form, _, _ in lexicon.variants(p)}
    else:
        out = {ask, *(form for form, _, _ in lexicon.forms(ask))}
    return {shape(w) for w in out if w} | {shape(w[0].lower() + w[1:]) for w in out if w}


def _stage(texts: DataFrame, learned: Learned, columns: str, emit) -> DataFrame:
    """Two passes: the first notes what each text asks of the rarer words and heads, the second decodes with the answers."""
    shipped = texts.sparkSession.sparkContext.broadcast((learned.words, learned.rates, learned.total, learned.longest, learned.heads, learned.rest))

    def tools() -> tuple[Lexicon, Heads]:
        words, rates, total, longest, heads, rest = shipped.value
        return Lexicon(words, rates, total, longest), Heads(heads, rest)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, heads = tools()
        for batch in batches:
            rows = []
            for tbl, rec, text in zip(batch["tbl"], batch["rec_id"], batch["text"]):
                lexicon.asks = set()
                decode(text if isinstance(text, str) else None, lexicon, heads)
                rows += [(tbl, rec, a) for a in lexicon.asks]
            yield pd.DataFrame(rows, columns=["tbl", "rec_id", "ask"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, heads = tools()
        names = [c.split(" ")[0] for c in columns.split(", ")]
        for batch in batches:
            rows = []
            for tbl, rec, text, told in zip(batch["tbl"], batch["rec_id"], batch["text"], batch["told"]):
                told = [] if told is None else told
                lexicon.local = {t["found"]: t["n"] for t in told if t["ask"][0] != HEAD}
                lexicon.told, lexicon.asks = {t["ask"] for t in told}, set()
                heads.local = {t["ask"][1:]: t["found"] for t in told if t["ask"][0] == HEAD}
                rows += emit(tbl, rec, text if isinstance(text, str) else None, lexicon, heads)
            yield pd.DataFrame(rows, columns=names)

    rows = texts.select("tbl", "rec_id", "text")
    asked = durable(rows.where("text <> ''").mapInPandas(ask, "tbl string, rec_id string, ask string").distinct())
    told = answers(asked.select("ask"), learned)
    local = asked.join(told, "ask").groupBy("tbl", "rec_id").agg(F.collect_list(F.struct("ask", "found", "n")).alias("told"))
    return rows.join(local, ["tbl", "rec_id"], "left").mapInPandas(run, columns)


def line_noise(texts: DataFrame, learned: Learned) -> DataFrame:
    """(tbl, rec_id, line_no, noise) of ``texts(tbl, rec_id, text)``; clean lines give no row."""
    return _stage(texts, learned, "tbl string, rec_id string, line_no int, noise string", lambda tbl, rec, text, lexicon, heads: [(tbl, rec, n, noise) for n, noise in decode(text, lexicon, heads).noises])


def repaired(texts: DataFrame, learned: Learned) -> DataFrame:
    """(tbl, rec_id, paragraphs, repaired) of every text; null texts have no paragraphs and stay null."""

    def emit(tbl, rec, text, lexicon, heads):
        paragraphs = decode(text, lexicon, heads, repair=True).paragraphs
        return [(tbl, rec, paragraphs, None if text is None else "\n\n".join(paragraphs))]

    return _stage(texts, learned, "tbl string, rec_id string, paragraphs array<string>, repaired string", emit)
