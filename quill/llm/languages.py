"""Language of documents and of their segments by cross-parsing entropy.

For each language a suffix automaton is built over words of labelled text. A text is cut greedily into the longest
substrings that an automaton knows; the language that needs the fewest such phrases, weighed by the words, wins. Words
are parsed one by one with their borders, so that a word's phrase counts are computed once and looked up after that.

Labels are dirty, so the training sample is cleaned first: each word votes for the language in which it is relatively
most frequent, and documents whose words outvote their label are left out. Names are told from words by being
capitalised and about as frequent in every language.

Every language with labelled text is told by its automaton, whatever its letters; a range of letters stands in only for a
language without any. Letters that an automaton doesn't know are phrases of their own, so runs of foreign letters cost their
length. Runs written without spaces are parsed like words.

Training: at most SAMPLE_DOCUMENTS labelled documents and SAMPLE_BYTES a language, the first by hash, whole texts; these
bounds don't grow with the corpus. Everything else covers all rows.

Defined results: null, empty and letterless texts have language null and confidence 0; segments too short to decide
inherit the language of their text; rows sent twice give equal rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quill.llm.markup import READERS, language as markup_language
from quill.llm.visual import FOLD, LIGATURES, WIDE
from quill.operators.joins import join_checked

SAMPLE_DOCUMENTS, SAMPLE_BYTES = 250, 8 << 20
LANGUAGES = ("es", "en", "pt", "fr", "de", "ru", "zh", "ja", "ar", "hi", "th")
#: Phrases by which another language must do better, and the share of phrases it may need, to hold a segment.
MARGIN, SHARE = 2.0, 0.7
MIN_POINTS = 60
#: Words of weight that a segment of another language must hold; one is enough in letters of its own.
MIN_WORDS = 3
#: Words kept in a worker's cache before it starts afresh; results don't depend on it.
CACHE_WORDS = 1_000_000
#: Letters that only one language here uses, for languages without labelled text.
SCRIPTS = {"ru": "а-яА-ЯёЁ", "ja": "぀-ヿ", "zh": "一-鿿", "ar": "؀-ۿ", "hi": "ऀ-ॿ", "th": "฀-๿"}

#: Letters from here on are written without spaces, but for Hangul, which no language here uses.
UNSPACED = "\u2e80"
OWN_LETTERS = np.array([lang in SCRIPTS for lang in LANGUAGES])
HAN = np.array([lang in ("zh", "ja") for lang in LANGUAGES])
HAN_MARGIN = 4.0

_word = re.compile(r"[^\W\d_]+")
_cut = re.compile(r"[\n|]+|(?<=[.!?…؟।])(?:[\"”»’)\]]*)\s+|(?<=[。！？])")
_noise = re.compile(r"https?://\S+|www\.\S+|\S+@\S+\.\w+|\S*[/\\_=]\S*")
_code = re.compile(r"\b(?=\w*\d)\w+\b")
_spaced = re.compile(r"(?<!\S)(?:\S\s{1,3}){6,}")
_key = re.compile(r"\A\s*[^\W\d_]+:\s")
_hidden = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_fold = FOLD | {ord(a): b for a, b in (LIGATURES | WIDE).items()}
_han = re.compile("[\u4e00-\u9fff]")
_foreign = re.compile(r"[Ͱ-ԯ＀-｠ﬀ-ﬆ]")


def folded(text: str) -> str:
    """Words with look-alike letters, full-width forms and hidden characters in plain letters; words of real Cyrillic
    or Greek, which keep letters without a twin, stay as they are."""
    if text.isascii():
        return text
    if _hidden.search(text):
        text = _hidden.sub("", text)
    if not _foreign.search(text):
        return text

    def fold(m):
        w = m.group(0)
        if not _foreign.search(w):
            return w
        f = w.translate(_fold)
        return w if re.search(r"[Ͱ-ԯ]", f) else f

    return _word.sub(fold, text)


class Automaton:
    """Suffix automaton over words; phrases() counts the longest matches that cover a word."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.alphabet: set[str] = set()
        link, length = [-1], [0]
        last = 0
        nxt = self.next
        for word in words:
            last = 0  # no match runs over a word's border
            for ch in f" {word} ":
                self.alphabet.add(ch)
                if (q := nxt[last].get(ch)) is not None and length[q] == length[last] + 1:
                    last = q
                    continue
                p, cur = last, len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                clone_made = None
                if q is not None:  # generalised: the state exists with another length
                    nxt.pop()
                    link.pop()
                    length.pop()
                    clone_made = self._clone(p, ch, q, link, length)
                    last = clone_made
                    continue
                while p != -1 and ch not in nxt[p]:
                    nxt[p][ch] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][ch]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, ch, q, link, length)
                last = cur
        self.alphabet.discard(" ")

    def _clone(self, p, ch, q, link, length):
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and self.next[p].get(ch) == q:
            self.next[p][ch] = c
            p = link[p]
        return c

    def phrases(self, word: str) -> int:
        if self.alphabet.isdisjoint(word):
            return len(word) + 1
        nxt, n, state, inside = self.next, 1, 0, False
        for ch in f" {word} ":
            to = nxt[state].get(ch)
            if to is None:
                if inside:
                    n += 1
                to = nxt[0].get(ch, 0)
                inside = to != 0
                state = to
            else:
                state, inside = to, True
        return n


def training_words(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Words of each language from its labelled texts, mislabelled texts and names left out."""
    docs: list[tuple[str, set[str], set[str]]] = []
    for lang, own in sorted(texts.items()):
        for t in own:
            ws = set(_word.findall(folded(t)))
            # a run of letters without spaces seldom recurs, its letters do
            docs.append((lang, ws, {x for w in ws for x in (w if w[0] > UNSPACED else (w.lower(),))}))
    for _ in range(2):
        size = Counter(lang for lang, _, _ in docs)
        rate: dict[str, dict[str, float]] = defaultdict(dict)
        counts: dict[tuple[str, str], int] = Counter((lang, x) for lang, _, units in docs for x in units)
        for (lang, w), n in counts.items():
            rate[w][lang] = n / size[lang]
        kept = []
        for lang, ws, units in docs:
            votes: Counter = Counter()
            for x in sorted(units):
                r = rate[x]
                best = max(r.values())
                home = [x for x, v in r.items() if v == best]
                if len(home) == 1 and best > 1.5 * max((v for x, v in r.items() if x != home[0]), default=0):
                    votes[home[0]] += min(1.0, best * 10)
            if not votes or votes.most_common(1)[0][0] == lang:
                kept.append((lang, ws, units))
        docs = kept
    size = Counter(lang for lang, _, _ in docs)
    seen: dict[str, Counter] = defaultdict(Counter)
    as_name: Counter = Counter()
    for lang, ws, _ in docs:
        own = {w.lower() for w in ws}
        seen[lang].update(own)
        as_name.update(own - {w for w in ws if not w[0].isupper()})
    out = {}
    for lang, counter in seen.items():
        words = []
        for w, n in counter.items():
            own = n / size[lang]
            other = max((seen[x][w] / size[x] for x in seen if x != lang), default=0.0)
            name = as_name[w] * 5 > 4 * sum(c[w] for c in seen.values()) and (n * 25 < size[lang] or own < 4 * other)
            if lang in ("zh", "ja"):  # written without spaces: a run of letters seldom recurs, its parts do
                if _han.search(w):
                    words.append(w)
                continue
            if (n >= 2 or size[lang] < 8) and own * 12 > other and not name:
                words.append(w)
        out[lang] = sorted(words)
    return out


class Model:
    """Automata of all languages, and the weighted phrase counts of words met so far."""

    def __init__(self, words: tuple[tuple[str, tuple[str, ...]], ...]):
        self.automata = [Automaton(list(dict(words).get(lang, ()))) for lang in LANGUAGES]
        self.scripts = [re.compile(f"[{SCRIPTS[lang]}]") if lang in SCRIPTS else None for lang in LANGUAGES]
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[list[float]] = []
        self.table = np.zeros((0, len(LANGUAGES)), np.float32)

    def learn(self, word: str) -> None:
        low = word.lower()
        n = []
        for i, a in enumerate(self.automata):
            if len(a.next) > 1:
                n.append(float(a.phrases(low)))
            else:  # no labelled text: by its letters alone
                n.append(1.0 + len(low) // 8 if self.scripts[i] and self.scripts[i].search(low) else len(low) + 1.0)
        best = min(n)
        # languages that know any of its letters, and letters written without spaces, whose runs seldom recur
        knowing, run = sum(x <= len(low) for x in n), low[0] > UNSPACED
        if best > 1 and knowing > 1 and not run:
            # known to no language as a whole: a name, or a misread or rare word
            weight = 0.0 if word[0].isupper() else 0.25
        else:
            weight = 0.25 if len(low) == 1 and not run else 1.0
        self.at[word] = len(self.rows)
        self.rows.append([min(3.0 + len(low) / 4, x - best) * weight if weight else 0.0 for x in n] + [weight])

    def vectors(self, words: list[str]) -> np.ndarray:
        """For each word: surplus phrases in each language, and whether it counts."""
        if len(self.at) > CACHE_WORDS:
            self.reset()
        for w in {w for w in words if w not in self.at}:
            self.learn(w)
        if len(self.table) != len(self.rows):
            self.table = np.array(self.rows, np.float32).reshape(-1, len(LANGUAGES) + 1)
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]

    def judge(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """For each text its segments: (language, begin, end, confidence); adjoining ones of one language are one."""
        which, begins, stops, words, counts = [], [], [], [], []
        find = _word.findall
        for i, t in enumerate(texts):
            plain = t.isascii() or not (_foreign.search(t) or _hidden.search(t))
            record = "|" in t
            signs = record or "/" in t or "_" in t or "=" in t or "\\" in t or "@" in t
            if "   " in t and _spaced.search(t):  # letters set apart
                t = _spaced.sub(lambda m: " " * len(m.group()), t)
            at = 0
            for end in [*(m.end() for m in _cut.finditer(t)), len(t)]:
                if end == at:
                    continue
                if plain and not signs:
                    own = find(t, at, end)
                else:
                    s = t[at:end]
                    if signs:
                        if "/" in s or "_" in s or "=" in s or "\\" in s or "@" in s:
                            s = _noise.sub(" ", s)
                        if record:
                            s = _key.sub("", _code.sub(" ", s))
                    own = find(s if plain else folded(s))
                which.append(i)
                begins.append(at)
                stops.append(end)
                words += own
                counts.append(len(own))
                at = end
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if not words:
            return out
        v = self.vectors(words)
        which, n = np.array(which), np.array(counts)
        ends = np.cumsum(n)
        total = np.concatenate((np.zeros((1, v.shape[1])), np.cumsum(v, axis=0, dtype=np.float64)))
        sums = total[ends] - total[ends - n]
        weight, surplus = sums[:, -1], sums[:, :-1]
        best = surplus.argmin(1)
        two = np.partition(surplus, 1, axis=1)[:, :2]
        gap = two[:, 1] - two[:, 0]
        # a text's main language: most weight over its clear pieces, else fewest phrases in all
        mass = np.zeros((len(texts), len(LANGUAGES)))
        np.add.at(mass, (which, best), np.minimum(gap, weight))
        whole = np.zeros_like(mass)
        np.add.at(whole, which, surplus)
        main = np.where(mass.max(1) > 0, mass.argmax(1), whole.argmin(1))[which]
        row = np.arange(len(which))
        at_main, at_best = surplus[row, main], two[:, 0]
        # Han letters are common to two languages, of which both then need more to tell them apart
        margin = np.where(HAN[best] & HAN[main], HAN_MARGIN, MARGIN)
        other = (best != main) & (weight >= np.where(OWN_LETTERS[best], 1, MIN_WORDS)) & (at_main - at_best >= margin) & (weight + at_best <= SHARE * (weight + at_main))
        lang = np.where(other, best, main)
        certain = np.where(lang == best, 2 * gap, 0.0)
        starts = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (lang[1:] != lang[:-1]))))
        w, c = np.add.reduceat(weight, starts), np.add.reduceat(certain, starts)
        sure = np.divide(c, w + c, out=np.zeros_like(c), where=w + c > 0)
        natural_text = np.bincount(which, weight, len(texts)) > 0
        last = np.concatenate((starts[1:], [len(which)])) - 1
        for k, e, x in zip(starts.tolist(), last.tolist(), sure.tolist()):
            if natural_text[which[k]]:
                out[which[k]].append((LANGUAGES[lang[k]], begins[k], stops[e], x))
        return out


@lru_cache(maxsize=2)
def model(words: tuple) -> Model:
    """One a worker."""
    return Model(words)


def label_table(names: DataFrame) -> dict[str, str]:
    """label -> language, of the table of language names (its size is fixed)."""
    return {r.label: r.lang for r in names.select("label", "lang").collect()}


def trained(docs: DataFrame, names: DataFrame, text: str = "text", label: str = "label", key: str = "item", sample: int = SAMPLE_DOCUMENTS) -> tuple:
    """Training words of each language, from at most ``sample`` labelled texts of each."""
    labelled = docs.select(F.lower(F.trim(label)).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h"), F.col(key).alias("k")).filter(F.length("text") >= MIN_POINTS)
    known = join_checked(labelled, names.select("label", "lang"), ["label"])
    order = Window.partitionBy("lang").orderBy("h", "k")
    first = known.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    first = first.withColumn("b", F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("b") <= SAMPLE_BYTES)
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sorted(first.select("lang", "h", "text").collect(), key=lambda r: (r.lang, r.h)):
        texts[r.lang].append(natural(r.text))
    return tuple((lang, tuple(words)) for lang, words in sorted(training_words(texts).items()))


def natural(text: str) -> str:
    """The text without markup, code and formulas."""
    kind = markup_language(text)
    if kind is None:
        return text
    return "\n".join(b.content for b in READERS[kind](text) if b.kind not in ("code_block", "formula"))


SEGMENTS = "tab string, item string, label string, n int, lang string, begin int, end int, confidence double"


def segments(texts: DataFrame, words: tuple, marked: tuple[str, ...] = ("documents",)) -> DataFrame:
    """texts: (tab, item, text, label); those of the tables ``marked`` may hold markup. One row for each segment in order: (tab, item, label, n, lang, begin, end,
    confidence); begin and end are offsets in the text without markup. Texts without language give no rows."""

    def run(batches):
        own = model(words)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                raw = part.column(2).to_pylist()
                found = own.judge([natural(t) if tab in marked else t for tab, t in zip(part.column(0).to_pylist(), raw)])
                rows = [k for k, f in enumerate(found) for _ in f]
                flat = [(n, *s) for f in found for n, s in enumerate(f)]
                n, lang, begin, end, sure = zip(*flat) if flat else ((),) * 5
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(3).take(at), pa.array(n, pa.int32()), pa.array(lang, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(sure, pa.float64())], ["tab", "item", "label", "n", "lang", "begin", "end", "confidence"])

    return texts.select("tab", "item", "text", "label").filter(F.length("text") > 0).mapInArrow(run, SEGMENTS)


def other_languages(texts: DataFrame, names: DataFrame, words: tuple) -> DataFrame:
    """(tab, item, lang), distinct: languages that a text of MIN_POINTS or more code points holds besides its label's."""
    labels = names.select(F.col("label").alias("name"), F.col("lang").alias("named")).distinct()
    return (
        join_checked(segments(texts.filter(F.length("text") >= MIN_POINTS), words).withColumn("name", F.lower(F.trim("label"))), labels, ["name"], "left")
        .filter(F.col("named").isNull() | (F.col("named") != F.col("lang")))
        .select("tab", "item", "lang")
        .distinct()
    )


def main_language(texts: DataFrame, words: tuple, marked: tuple[str, ...] = ("documents",)) -> DataFrame:
    """(tab, item, lang, confidence), one row for each text: the language of most of its letters."""

    def run(batches):
        own = model(words)
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                tabs, raw = part.column(0).to_pylist(), part.column(2).to_pylist()
                langs, sure = [], []
                for found in own.judge([natural(t) if t and tab in marked else t or "" for tab, t in zip(tabs, raw)]):
                    size: Counter = Counter()
                    certain: Counter = Counter()
                    for lang, begin, end, x in found:
                        size[lang] += end - begin
                        certain[lang] += (end - begin) * x
                    best = max(size, key=lambda x: (size[x], x)) if size else None
                    langs.append(best)
                    sure.append(round(certain[best] / sum(size.values()), 4) if best else 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(sure, pa.float64())], ["tab", "item", "lang", "confidence"])

    return texts.select("tab", "item", "text").mapInArrow(run, "tab string, item string, lang string, confidence double")
