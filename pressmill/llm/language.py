"""Language of documents and of segments, by mixture inference over n-gram likelihoods.

A text is a sequence of sentences. Each sentence has a likelihood under every language by the character trigrams of its
words, whatever their script, so English and Sinhala or Tamil typed in Latin letters are told apart, and an English
sentence stays English around a town's name in Sinhala letters. A word in another script may be a name, so it
speaks against a language with a bounded weight. Expectation-maximisation estimates the proportions of
the languages of a text, and the set of languages is the one with the best penalised likelihood; two or more
make the text 'mixed'. Brand, place and mail names, codes and spelled-out numbers carry no language.

The trigram models are fitted on a bounded sample of labelled rows (``max_rows`` of each label). As labels are
often wrong, fitting is itself an EM: a sentence counts for each language by its posterior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("si", "en", "ta")
MIXED = "mixed"
#: What a word in native letters can cost a language at most (nats a letter): it may be a name in any of them.
BORROWED = 3.0
#: Likelihood a further language must gain (nats), as the penalty of the language set.
PENALTY = 6.0

# Abbreviations whose dot ends no sentence.
_SENTENCE = re.compile(r"(?<=[.!?])(?<!\bNo\.)(?<!\bno\.)(?<!\bMr\.)(?<!\bMrs\.)(?<!\bDr\.)(?<!\bSt\.)(?<!\bRd\.)(?<!\b[A-Z]\.)(?<!இல\.)\s+|\n+")
_SI, _TA, _LATIN = re.compile("[අ-ෆ]"), re.compile("[அ-ஹ]"), re.compile("[A-Za-z]")
_NATIVE_WORD = re.compile("[\u0d80-\u0dff\u200d]+|[\u0b80-\u0bff]+")
# Digits spelled out, as in telephone numbers.
_DIGIT_WORD = "zero|one|two|three|four|five|six|seven|eight|nine"
_NEUTRAL = re.compile(
    r"\S+@\S+|\S+\s?@\s?\S+|\S+\s?[(\[]at[)\]]\s?\S+(?:\s[(\[]dot[)\]]\s\S+)*|\S+\sat\s\w+(?:\sdot\s\w+)+"
    rf"|\b(?:{_DIGIT_WORD})(?:\s(?:{_DIGIT_WORD})){{2,}}\b|\S*[\d/]\S*",
    re.IGNORECASE,
)
_MAYBE_NEUTRAL = re.compile(r"[\d@]|\bdot\b|\(at\)|\[at\]|\b(?:zero|seven)\b", re.IGNORECASE)
_WORD = re.compile(r"[A-Za-z]+(?:'[a-z]+)?")


def sentences(text: str) -> list[str]:
    """Pieces between sentence ends and line ends.

    >>> sentences("One. Two!\\nThree")
    ['One.', 'Two!', 'Three']
    """
    return [s for s in _SENTENCE.split(text) if s]


def latin_words(sentence: str, common: set[str] | frozenset[str] = frozenset()) -> list[str]:
    """Words of a sentence in Latin letters that carry a language, in lower case.

    Capitalised words are names, except the first of a sentence if it is in ``common``; a sentence in capitals
    keeps its words. One-letter words, mail addresses, codes and spelled-out numbers are left out.
    """
    plain = _NEUTRAL.sub(" ", sentence) if _MAYBE_NEUTRAL.search(sentence) else sentence
    words = _WORD.findall(plain)
    kept = [w for w in words if len(w) > 1 and w.islower()]
    if words and not words[0].islower() and sentence.startswith(words[0]) and words[0].lower() in common:
        kept.insert(0, words[0].lower())
    elif not kept and len(words) > 1 and all(w.isupper() for w in words):
        kept = [w.lower() for w in words if len(w) > 1]
    return kept


def common_words(texts: Iterable[str]) -> set[str]:
    """Words that also open sentences: written small or first in a sentence, and rarely capital elsewhere."""
    plain, names = Counter(), Counter()
    for text in texts:
        for s in sentences(text):
            for i, w in enumerate(_WORD.findall(_NEUTRAL.sub(" ", s))):
                if i == 0 and s.startswith(w) or w.islower():
                    plain[w.lower()] += 1
                else:
                    names[w.lower()] += 1
    return {w for w, n in plain.items() if n >= 2 and n > 3 * names[w]}


def trigrams(word: str) -> Iterable[str]:
    marked = f"^{word}$"
    return (marked[i : i + 3] for i in range(len(marked) - 2))


class Model:
    """Character-trigram models of the languages, given the script of a word (Latin or native); additive smoothing."""

    def __init__(self, counts: dict[str, Counter], common: set[str], alpha: float = 0.1, space: int = 18_000):
        self.common = common
        self.logs: dict[str, tuple[float, ...]] = {}
        grams = set().union(*counts.values())
        native = {g for g in grams if _NATIVE_WORD.search(g)}
        totals = [[sum(n for g, n in counts[k].items() if (g in native) == own) + alpha * space for k in LANGUAGES] for own in (False, True)]
        # A language that has no words in a script must not gain by its unseen trigrams being cheaper.
        totals[True] = [max(totals[True])] * len(LANGUAGES)
        self.unseen = tuple(tuple(math.log(alpha / t) for t in each) for each in totals)
        for gram in grams:
            self.logs[gram] = tuple(math.log((counts[k][gram] + alpha) / t) for k, t in zip(LANGUAGES, totals[gram in native]))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, tuple[float, ...]] = {}
        self.names: dict[str, tuple[float, float, float, int]] = {}

    def word(self, word: str) -> tuple[float, ...]:
        """Log-likelihood of a word in each language; the memo is bounded by starting over."""
        known = self.memo.get(word)
        if known is None:
            unseen = self.unseen[bool(_NATIVE_WORD.match(word))]
            a = b = c = 0.0
            for g in trigrams(word):
                x, y, z = self.logs.get(g, unseen)
                a, b, c = a + x, b + y, c + z
            if len(self.memo) > 300_000:
                self.memo.clear()
            known = self.memo[word] = (a, b, c)
        return known

    def native(self, word: str) -> tuple[float, float, float, int]:
        """Log-likelihoods of a word in native letters relative to its best language, each down to its bound, and its letters."""
        known = self.names.get(word)
        if known is None:
            n_si, n_ta = len(_SI.findall(word)), len(_TA.findall(word))
            letters = n_si + n_ta
            # A word none of whose trigrams was ever seen is told by its script alone.
            each = self.word(word) if any(g in self.logs for g in trigrams(word)) else (-BORROWED * n_ta, -BORROWED * letters, -BORROWED * n_si)
            best = max(each)
            if len(self.names) > 300_000:
                self.names.clear()
            known = self.names[word] = (*[max(x - best, -BORROWED * letters) for x in each], letters)
        return known

    def sentence(self, sentence: str) -> tuple[tuple[float, ...], int] | None:
        """(log-likelihoods, letters) of a sentence, or None if it carries no language."""
        a = b = c = 0.0
        total = 0
        if not sentence.isascii():
            for w in _NATIVE_WORD.findall(sentence):
                x, y, z, n = self.native(w)
                a, b, c, total = a + x, b + y, c + z, total + n
            if total < 2:
                a = b = c = 0.0
                total = 0
        words = latin_words(sentence, self.common)
        letters = sum(map(len, words))
        if len(words) >= 2 and letters >= 6:
            for w in words:
                x, y, z = self.word(w)
                a, b, c = a + x, b + y, c + z
            total += letters
        return ((a, b, c), total) if total else None


def fit(rows: Iterable[tuple[str, str]], rounds: int = 6, trust: float = 0.8) -> Model:
    """Models from (label, text) rows with doubtful labels; texts with other labels are left out.

    The first round takes the labels as they are; in the later ones the label is a prior of ``trust`` against
    the likelihood of all sentences of the text, so a wrongly labelled text moves over as a whole.
    """
    rows = [(label, text) for label, text in rows if label in LANGUAGES and text]
    common = common_words(text for _, text in rows)
    texts: Counter = Counter()
    spoken: dict[str, Counter] = {"si": Counter(), "ta": Counter()}
    for label, text in rows:
        if not text.isascii():
            for script, words in spoken.items():
                words.update((label, w) for w in _NATIVE_WORD.findall(text) if ("\u0d80" <= w[-1] or w[0] >= "\u0d80") == (script == "si"))
        latin = [w for s in sentences(text) if not (_SI.search(s) or _TA.search(s)) and len(w := latin_words(s, common)) >= 2]
        if latin:
            texts[label, tuple(" ".join(w) for w in latin)] += 1
    # The words of a native script teach the language most of whose labelled texts are written in it; labels are too
    # often wrong to let them teach the others.
    native: dict[str, Counter] = {k: Counter() for k in LANGUAGES}
    for words in spoken.values():
        if words:
            home = Counter()
            for (label, _), n in words.items():
                home[label] += n
            for (_, w), n in words.items():
                for g in trigrams(w):
                    native[max(sorted(home), key=home.__getitem__)][g] += n
    model, three = None, range(3)
    for turn in range(rounds):
        words: dict[str, list[float]] = {}
        for (label, latin), n in texts.items():
            doubt = (1 - trust) / 2 if model else 1e-9
            logs = [math.log(1 - 2 * doubt if k == label else doubt) for k in LANGUAGES]
            if model:
                each = [model.word(w) for s in latin for w in s.split(" ")]
                logs = [x + sum(e[i] for e in each) for i, x in enumerate(logs)]
            odds = [math.exp(x - max(logs)) for x in logs]
            for s in latin:
                for w in s.split(" "):
                    at = words.setdefault(w, [0.0, 0.0, 0.0])
                    for i in three:
                        at[i] += n * odds[i] / sum(odds)
        counts = {k: Counter(native[k]) for k in LANGUAGES}
        for w, weights in words.items():
            for g in trigrams(w):
                for k, x in zip(LANGUAGES, weights):
                    counts[k][g] += x
        model = Model(counts, common)
    return model


def proportions(likelihoods: list[tuple[float, ...]], langs: tuple[int, ...], rounds: int = 12) -> tuple[float, dict[int, float]]:
    """(log-likelihood, proportions) of a set of languages by EM over the sentences of a text."""
    if len(langs) == 1:
        return sum(ll[langs[0]] for ll in likelihoods), {langs[0]: 1.0}
    pi = {k: 1.0 / len(langs) for k in langs}
    total = 0.0
    for _ in range(rounds):
        mass, total = dict.fromkeys(langs, 0.0), 0.0
        for ll in likelihoods:
            top = max(ll[k] for k in langs)
            odds = {k: pi[k] * math.exp(max(ll[k] - top, -60.0)) for k in langs}
            whole = sum(odds.values())
            total += top + math.log(whole)
            for k, o in odds.items():
                mass[k] += o / whole
        pi = {k: max(m / len(likelihoods), 1e-6) for k, m in mass.items()}
    return total, pi


def infer(model: Model, text: str | None) -> tuple[str | None, float, str | None, dict[str, float]]:
    """(label, confidence, dominant language, proportions) of a text; (None, 0, None, {}) if nothing is language.

    Sentences that all prefer one language need no EM: no larger set can have a higher likelihood.
    """
    if not text:
        return None, 0.0, None, {}
    scored = [x for s in sentences(text) if (x := model.sentence(s))]
    if not scored:
        if (n := len(_SI.findall(text))) != (m := len(_TA.findall(text))) and n * m == 0:
            return ("si" if n else "ta"), 0.6, ("si" if n else "ta"), {("si" if n else "ta"): 1.0}
        words = _WORD.findall(_NEUTRAL.sub(" ", text))
        if not words:
            return None, 0.0, None, {}
        each = [model.word(w.lower()) for w in words]
        best = max(range(3), key=lambda i: sum(e[i] for e in each))
        return LANGUAGES[best], 0.5, LANGUAGES[best], {LANGUAGES[best]: 1.0}
    likelihoods = [ll for ll, _ in scored]
    preferred = [max(range(3), key=ll.__getitem__) for ll in likelihoods]
    wanted = sorted(set(preferred))
    if len(wanted) == 1:
        k = wanted[0]
        margin = sum(ll[k] for ll in likelihoods) - max(sum(ll[j] for ll in likelihoods) for j in range(3) if j != k)
        return LANGUAGES[k], 1.0 - 1.0 / (2.0 + math.exp(min(margin, 30.0))), LANGUAGES[k], {LANGUAGES[k]: 1.0}
    sets = [(k,) for k in wanted] + [(a, b) for i, a in enumerate(wanted) for b in wanted[i + 1 :]] + ([tuple(wanted)] if len(wanted) == 3 else [])
    results = sorted(((total - PENALTY * len(langs), langs, pi) for langs in sets for total, pi in [proportions(likelihoods, langs)]), reverse=True, key=lambda r: r[0])
    score, langs, pi = results[0]
    confidence = 1.0 - 1.0 / (2.0 + math.exp(min(score - results[1][0], 30.0)))
    letters = Counter()
    for (ll, n), k in zip(scored, preferred):
        letters[max(langs, key=ll.__getitem__)] += n
    label = MIXED if len(langs) > 1 else LANGUAGES[langs[0]]
    return label, confidence, LANGUAGES[letters.most_common(1)[0][0]], {LANGUAGES[k]: round(v, 4) for k, v in pi.items()}


def segments(model: Model, text: str | None, shares: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """[(start, end, language, confidence)] of the runs of sentences in one language of a mixed text.

    A sentence goes to the language with the greatest posterior under the text's proportions; one that carries no language
    goes with the sentence before it. The confidence of a run is the mean of its sentences'. The runs cover the text.
    """
    if not text or not shares:
        return []
    bounds, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            bounds.append((at, m.end()))
            at = m.end()
    if at < len(text):
        bounds.append((at, len(text)))
    langs = [i for i, k in enumerate(LANGUAGES) if shares.get(k)]
    out: list[list] = []
    for start, end in bounds:
        scored = model.sentence(text[start:end].rstrip())
        if scored:
            logs = {i: scored[0][i] + math.log(shares[LANGUAGES[i]]) for i in langs}
            best = max(logs, key=logs.__getitem__)
            sure = 1.0 / sum(math.exp(max(x - logs[best], -60.0)) for x in logs.values())
            if not out or out[-1][2] not in (None, LANGUAGES[best]):
                out.append([start, end, LANGUAGES[best], [sure]])
                continue
            out[-1][2] = LANGUAGES[best]
            out[-1][3].append(sure)
        elif not out:
            out.append([start, end, None, []])
        out[-1][1] = end
    if out:
        out[0][0] = 0
    return [(a, b, lang or max(shares, key=shares.__getitem__), sum(c) / len(c) if c else 0.0) for a, b, lang, c in out]


def fit_on(labelled: DataFrame, max_rows: int = 2_000) -> Model:
    """Fits on at most ``max_rows`` rows of each label of ``labelled(label, text)``, drawn by the hash of the text.

    Rows whose hash is below the share that ``max_rows`` is of the label's rows are drawn, so the draw is the
    same on every cluster and the driver receives about three times ``max_rows`` short rows at any size.
    """
    latin = labelled.where(F.col("label").isin(*LANGUAGES) & F.col("text").rlike("[A-Za-z]{2}"))
    counts = {r.label: r.n for r in latin.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    below = F.lit(False)
    for label, n in counts.items():
        below |= (F.col("label") == label) & (F.shiftrightunsigned(F.xxhash64("text"), 11) <= int(min(1.0, max_rows / n) * (1 << 53)))
    rows = sorted((r.label, r.text) for r in latin.where(below).select("label", "text").collect())
    kept: list[tuple[str, str]] = []
    for label in LANGUAGES:
        kept += [r for r in rows if r[0] == label][:max_rows]
    return fit(kept)


def classify(texts: DataFrame, model: Model, keep: list[str], parts: bool = False) -> DataFrame:
    """(keep.., lang, confidence, dominant, share) for every row of ``texts(keep.., text)``.

    With ``parts`` also the segments of mixed texts, array<struct<seg_start, seg_end, lang, confidence>> (null for others).
    ``share`` maps languages to proportions. Null, empty and letterless texts get a null language and confidence 0.
    Rows stay as many as they were.
    """
    shipped = texts.sparkSession.sparkContext.broadcast((model.logs, model.unseen, model.common))
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keep) + ", lang string, confidence double, dominant string, share map<string,double>"
    if parts:
        schema += ", parts array<struct<seg_start:int,seg_end:int,lang:string,confidence:double>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        local = Model.__new__(Model)
        local.logs, local.unseen, local.common = shipped.value
        local.forget()
        for batch in batches:
            got = [infer(local, t if isinstance(t, str) else None) for t in batch["text"]]
            out = batch[keep].copy()
            for i, name in enumerate(("lang", "confidence", "dominant", "share")):
                out[name] = pd.Series([g[i] for g in got], index=out.index, dtype="float64" if name == "confidence" else "object")
            if parts:
                cut = [segments(local, t, g[3]) if g[0] == MIXED else None for t, g in zip(batch["text"], got)]
                out["parts"] = pd.Series([None if c is None else [dict(zip(("seg_start", "seg_end", "lang", "confidence"), x)) for x in c] for c in cut], index=out.index, dtype="object")
            yield out

    return texts.select(*keep, "text").mapInPandas(run, schema)


def letters(text: Column) -> Column:
    """Unicode letters (category L) of a text."""
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))
