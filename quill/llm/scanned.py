"""Repair of text from scanned pages.

Furniture (running headers, footers, page numbers) is found by page-position features: the numbering style of the
document, lines that recur page by page (compared fuzzily, as they hold misread characters too), lines beside a page
number, form feed or text end, and lines that end before the column is full without ending a sentence. The rest is
decided by a character editor, an averaged perceptron: at each place of a doubtful word it weighs keep, replace, delete
and insert, at each line end with a hyphen or dash it weighs keep, join, and join with the hyphen kept. What the corpus
knows of the word before and after the edit is one of its features. Lines are reported as it decides: with no training it
keeps everything.

Candidates: every single confusion, every two that don't overlap, and, where a sign stands in a word, every letter of
the script around it, however many it has: the place is left blank and met with the words of the lexicon blanked at the
same places. Words that need more edits are not repaired.

Scale: one Python pass over the documents yields flagged lines, line ends, the words of the other documents (added up
within the partition) and the doubtful words of scanned ones. Lexicon, doubtful words and candidates meet in shuffled
joins; nothing of corpus size is broadcast. Words of the lexicon are blanked only at places that a candidate of their
length asks for. The editor is trained on at most SAMPLE_WORDS words of the lexicon.

Defined results: null and empty texts, and texts not from scanned pages, have no findings and come out unchanged.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quill.llm.markup import language
from quill.llm.visual import FOLD
from quill.session import cut, written

SAMPLE_WORDS = 4000
#: Words that a task keeps in plain form before it starts afresh.
MEMO = 500_000
EPOCHS = 3
#: Documents in which a word must stand to be proposed as a repair; one is enough to be no misreading.
REPAIR_FROM = 2

#: What scanners read (left) for what was printed (right).
CONFUSIONS = [
    ("rn", "m"), ("ri", "n"), ("ii", "u"), ("c", "e"), ("e", "c"), ("cl", "d"), ("li", "h"), ("h", "li"), ("vv", "w"), ("rri", "m"), ("m", "rn"), ("tl", "d"),
    ("l", "i"), ("i", "l"), ("l", "t"), ("t", "f"), ("f", "t"), ("u", "n"), ("n", "u"), ("o", "e"), ("q", "g"), ("g", "q"), ("v", "y"), ("nn", "m"), ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("@", "a"), ("!", "i"), ("!", "l"), ("†", "t"), ("$", "s"), ("€", "e"), ("£", "e"),
]
#: Formats whose text may come from scanned pages.
SCANNED_FORMATS = ("pdf", "image")
HYPHEN = "-‐­¬‑"
DASHES = "–—"
LINE_ENDS = frozenset(HYPHEN + DASHES)
#: What the editor predicts at a line end.
KEEP, JOIN, JOIN_HYPHEN = "keep", "join", "join with hyphen"

_word = re.compile(r"[^\W\d_]+")
_ends_in_hyphen = re.compile(rf"[^\W\d_][{HYPHEN}]\s*\Z")
_signs = re.compile(r"[0-9@!|†$€£#*=<>{}~^]")
_finished = re.compile(r"[.!?:;…。！？।؟][\"”»“’)\]]*\Z")
_odd = re.compile(r"(?<=[^\W\d_])[0-9@!|†$€£#*=<>{}~^](?=[^\W\d_])|(?<!\S)[\"“«(¿¡]*[0-9@|†$€£](?=[^\W\d_]{3})|(?<=[^\W\d_]{3})[0-9@|†€£](?=[\s.,;:?!)\"”»]|\Z)")
_of_words = re.compile(r"[^\W\d_]|[\u0307-]")
_web = re.compile(r"www|://|\.example|[/\\]|@[\w.]+\.\w")
_roman = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\Z", re.I)
_numbers = {
    "dash": re.compile(r"[-–—]\s*\d{1,5}\s*[-–—]\Z"),
    "bracket": re.compile(r"[\[(]\s*\d{1,5}\s*[\])]\Z"),
    "of": re.compile(r"\d{1,5}\s*/\s*\d{1,5}\Z"),
    "word": re.compile(r"(?:p|pp|pg|pág|pag|página|pagina|page|seite|s|стр|страница|صفحة|पृष्ठ|หน้า|第)\.?\s*\d{1,5}(?:\s*(?:/|de|of|von|sur|из)\s*\d{1,5})?\s*[页頁ページ]*\Z", re.I),
    "plain": re.compile(r"\d{1,4}\Z"),
    "roman": re.compile(r"(?=[ivxlcdm])[ivxlcdm]{1,9}\Z", re.I),
}
_number_and_title = re.compile(r"\d{1,4}\s{2,}(?=\D)(\S.*)\Z|(\S.*?\D)\s{2,}\d{1,4}\Z")
_prose = re.compile(r"[.,;:»«\"“”?!…](?=\s|\Z)|[«“\"(¿¡]|(?<!\S)\d+(?!\S)")
_spaced = re.compile(r"(?:\S\s){6}")


def _letter_by_letter(line: str) -> bool:
    return bool(_spaced.search(line)) and sum(len(x) == 1 for x in line.split()) > 0.8 * len(line.split())


def _shows_pages(text: str, lines: list[str]) -> bool:
    """A form feed, a line that is only a marked page number, or repeated words cut at line ends."""
    if "\x0c" in text or any(len(s) <= 24 and _numbers[style].match(s) for s in lines for style in ("dash", "bracket", "of", "word")):
        return True
    return sum(bool(_ends_in_hyphen.search(s)) for s in lines[:-1]) > 1


def is_scanned(text: str, formato: str | None = None) -> bool:
    """Whether the text is set in lines cut by the width of a page; a label of another format raises the bar.

    Sentences that run on are told from lines that begin with a small letter or, where those are few (nouns with capitals,
    scripts without letter case), in texts labelled as pages from the marks of pages.
    """
    lines = [s for line in text.split("\n") if (s := line.strip())]
    if len(lines) < 3 or "•" in text:
        return False
    sizes = sorted(len(s) for s in lines if not _letter_by_letter(s))
    if not sizes or sizes[-1] > 125:
        return False
    width = sizes[int(0.95 * (len(sizes) - 1))]
    labelled = formato is None or formato in SCANNED_FORMATS
    pairs = cut_lines = lower = 0
    for a, b in zip(lines, lines[1:]):
        if len(a) < 0.6 * width:
            continue
        pairs += 1
        if not _finished.search(a):
            cut_lines += 1
            lower += b[:1].islower()
    if not pairs or cut_lines < (0.4 if labelled else 0.6) * pairs:
        return False
    if lower < (0.15 if labelled else 0.4) * pairs and not (formato in SCANNED_FORMATS and _shows_pages(text, lines)):
        return False
    return language(text) is None


def _key(line: str) -> str:
    return "".join(_word.findall(line)).lower()


def _alike(a: str, b: str) -> bool:
    """Equal but for one place of up to three characters, or for up to three single ones."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 3 or min(len(a), len(b)) < 8:
        return False
    if len(a) == len(b) and sum(x != y for x, y in zip(a, b)) <= 3:
        return True
    short = min(len(a), len(b))
    i = 0
    while i < short and a[i] == b[i]:
        i += 1
    j = 0
    while j < short - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return i + j >= max(len(a), len(b)) - 3


def furniture(lines: list[str]) -> dict[int, str]:
    """'header' or 'page_no' of each line of a scanned text that is page furniture."""
    bare = [line.strip() for line in lines]
    out: dict[int, str] = {}
    styles: dict[str, list[int]] = defaultdict(list)
    for i, s in enumerate(bare):
        if 0 < len(s) <= 24:
            for style, pattern in _numbers.items():
                if pattern.match(s) and (style != "roman" or _roman.match(s)):
                    styles[style].append(i)
                    break
    if styles:  # a document numbers its pages in one style
        best = max(styles, key=lambda x: (len(styles[x]), x not in ("plain", "roman")))
        out.update(dict.fromkeys(styles[best], "page_no"))
    filled = [i for i, s in enumerate(bare) if s]
    letter_by_letter = {i for i in filled if _letter_by_letter(bare[i])}
    running = sorted(len(bare[i]) for i in filled if i not in out and i not in letter_by_letter)
    width = running[int(0.95 * (len(running) - 1))] if running else 0
    rank = {i: n for n, i in enumerate(filled)}

    def at_edge(i: int) -> bool:
        """Beside a page number, a form feed or an end of the text."""
        n = rank[i]
        if n == 0 or n == len(filled) - 1:
            return True
        before, after = filled[n - 1], filled[n + 1]
        return out.get(before) == "page_no" or out.get(after) == "page_no" or any("\x0c" in x for x in lines[before + 1 : i + 1]) or any("\x0c" in x for x in lines[i + 1 : after + 1])

    shaped: dict[int, bool] = {}
    for i in filled:
        s = bare[i]
        letters = list(filter(str.isalpha, s))
        capitals = len(letters) >= 8 and sum(map(str.isupper, letters)) >= 0.8 * len(letters)
        shaped[i] = i not in out and (capitals or i in letter_by_letter or (bool(_number_and_title.match(s)) and not _finished.search(s)))

    def unfilled(i: int) -> bool:
        """The next word of the text would still have fitted in the line."""
        n = rank[i] + 1
        while n < len(filled) and (filled[n] in out or shaped[filled[n]]):
            n += 1
        return n >= len(filled) or len(bare[i]) + 1 + len(bare[filled[n]].split()[0]) <= width - 3

    groups: list[tuple[str, list[int]]] = []
    considered = set()
    for i in filled:
        s = bare[i]
        if i in out or len(_key(s)) < 5:
            continue
        considered.add(i)
        if not shaped[i] and (s[0].islower() or _finished.search(s) or _ends_in_hyphen.search(s) or _prose.search(s) or not (at_edge(i) or unfilled(i))):
            continue
        key = _key(s)
        for known, members in groups:
            if _alike(known, key):
                members.append(i)
                break
        else:
            groups.append((key, [i]))
    repeated = []
    for key, members in groups:
        if len(members) > 1 or shaped[members[0]]:
            repeated.append(key)
            out.update(dict.fromkeys(members, "header"))
    body = [i for i in filled if i not in out]
    for n, i in enumerate(body):  # single ones: a title at a page's edge or in the midst of a sentence
        s = bare[i]
        if i in considered and not s[0].islower() and not _finished.search(s) and not _ends_in_hyphen.search(s):
            if any(_alike(key, _key(s)) for key in repeated):
                out[i] = "header"
                continue
            after = bare[body[n + 1]] if n + 1 < len(body) else ""
            inside = n > 0 and not _finished.search(bare[body[n - 1]])
            words = _word.findall(s)
            if 2 <= len(words) <= 9 and not _prose.search(s) and unfilled(i) and (inside or not after[:1].islower()) and not s[0].isdigit():
                out[i] = "header"
    return out


def odd_words(line: str) -> list[str]:
    """Words in which a digit or sign stands among letters."""
    return [t for t in line.split() if _odd.search(t) and not _web.search(t)] if _signs.search(line) and _odd.search(line) else []


def plain(word: str) -> str:
    """The word in small plain letters."""
    return word.lower() if word.isascii() else word.translate(FOLD).lower()


def joined_words(lines: list[str], skip: dict[int, str]) -> list[tuple[int, str]]:
    """(line, word) of the body; a word cut at a line end is joined and counted to the line in which it ends."""
    out: list[tuple[int, str]] = []
    head = ""
    for i, line in enumerate(lines):
        if i in skip or not line.strip():
            continue
        s = line.strip()
        if _signs.search(s) and _odd.search(s):
            s = " ".join(t for t in s.split() if not _odd.search(t))
        cut_end = s[-1:] in HYPHEN and _ends_in_hyphen.search(s)
        words = _word.findall(s)
        if head and words:
            words[0] = head + words[0]
            head = ""
        if cut_end and words:
            head = words.pop()
        out += [(i, w) for w in words]
    return out


def line_ends(lines: list[str], skip: dict[int, str]) -> list[tuple[int, str]]:
    """(line, key) of each line of the body that ends in a hyphen or dash and has a next line; see end_key."""
    body = [i for i, line in enumerate(lines) if i not in skip and line.strip()]
    return [(i, key) for i, after in zip(body, body[1:]) if (key := end_key(lines[i], lines[after]))]


def end_key(line: str, after: str) -> str | None:
    """Letters before the hyphen or dash at the end, space between, the sign, and the letters that open the next line."""
    s = line.rstrip()
    if not s or s[-1] not in LINE_ENDS:
        return None
    before = s[:-1].rstrip()
    at = len(before)
    while at and before[at - 1].isalpha():
        at -= 1
    head, after, n = before[at:], after.lstrip(), 0
    while n < len(after) and after[n].isalpha():
        n += 1
    return "\x1f".join((head, " " if len(before) < len(s) - 1 or not head else "", s[-1], after[:n]))


def compounds(text: str) -> set[str]:
    """Words of two parts with a hyphen between."""
    out = set()
    at = text.find("-", 1)
    while at > 0:
        a, b = at, at + 1
        while a and text[a - 1].isalpha():
            a -= 1
        while b < len(text) and text[b].isalpha():
            b += 1
        if at - a > 1 and b - at > 2 and text[a - 1 : a] != "-" and text[b : b + 1] != "-":
            out.add(text[a:b])
        at = text.find("-", b)
    return out


def operations(read: str, printed: str) -> list[str]:
    """The operation at each place of what was read: '=' keep, 'r' replace, 'd' delete; '+' inserts after the place."""
    out = ["=" if k < len(printed) and c == printed[k] else "r" + printed[k] if k < len(printed) else "d" for k, c in enumerate(read)]
    if len(printed) > len(read):
        out[-1] += "+" + printed[len(read) :]
    return out


EDITS = [(read, printed, operations(read, printed)) for read, printed in CONFUSIONS]
#: The operation on a sign that stands for some letter, and what stands for the letter (a character that no word holds).
UNREADABLE, BLANK = "r?", "\ufdd0"


def level(n: int) -> str:
    """How well the corpus knows a word that stands in n documents."""
    return "none" if n < 1 else "one" if n < 2 else "few" if n < 10 else "many"


class Editor:
    """Averaged perceptron over operations at the places of a word and at line ends."""

    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}
        self._total: dict[tuple[str, str], float] = defaultdict(float)
        self._stamp: dict[tuple[str, str], int] = defaultdict(int)
        self._now = 0

    # what speaks for an operation

    @staticmethod
    def around(word: str, i: int) -> list[str]:
        w = f"^^{word}$$$"
        j = i + 2
        return [w[j], w[j - 1 : j + 1], w[j : j + 2], w[j - 1 : j + 2], w[j : j + 3], w[j - 2 : j + 1], w[j - 2 : j + 3], f"<{w[j - 1]}", f">{w[j + 1]}", f"{i == 0}"]

    @staticmethod
    def edits(word: str) -> list[tuple[int, str, str, list[str]]]:
        """(place, read, printed, operations): every confusion that the word may hold, and signs that may be any letter."""
        out = [(i, read, printed, ops) for read, printed, ops in EDITS for i in _places(word, read)]
        return out + [(i, c, "?", [UNREADABLE]) for i, c in enumerate(word) if not c.isalpha()]

    def features_of(self, word: str, edit, cache: dict[int, list[str]]) -> list[tuple[str, str]]:
        out = []
        for k, op in enumerate(edit[3], edit[0]):
            if k not in cache:
                cache[k] = self.around(word, k)
            out += [(f, op) for f in cache[k]]
        return out

    def score(self, features: list[tuple[str, str]]) -> float:
        weights = self.weights
        return sum(r.get(label, 0.0) for f, label in features if (r := weights.get(f)))

    def of_fix(self, n: int) -> float:
        """What the number of documents that hold the fix adds."""
        return self.score([("fix", level(n))])

    @staticmethod
    def end_features(head: str, space: str, sign: str, tail: str, joined: int, compound: int, head_n: int, tail_n: int) -> list[str]:
        case = lambda c: "" if not c else "A" if c.isupper() else "a"
        whole = head.isupper() and tail.isupper() and len(tail) > 1
        return [
            f"sign {sign} {space}", f"space {space}", f"open {case(tail[:1])} {whole}", f"tail {bool(tail)}", f"joined {level(joined)}", f"compound {level(compound)}",
            f"more {(joined > compound) - (joined < compound)}", f"parts {level(head_n)} {level(tail_n)}", f"joined {level(joined)} {case(tail[:1])}", f"chars {head[-1:].lower()}{tail[:1].lower()}",
        ]

    def line_end(self, *features) -> str:
        """KEEP, JOIN or JOIN_HYPHEN of a line end; arguments as of end_features."""
        own = self.end_features(*features)
        return max((KEEP, JOIN, JOIN_HYPHEN), key=lambda label: self.score([(f, label) for f in own]))

    # learning

    def _move(self, gold: list[tuple[str, str]], said: list[tuple[str, str]]) -> None:
        for features, by in ((gold, 1.0), (said, -1.0)):
            for f, label in features:
                row = self.weights.setdefault(f, {})
                at = f, label
                self._total[at] += (self._now - self._stamp[at]) * row.get(label, 0.0)
                self._stamp[at] = self._now
                row[label] = row.get(label, 0.0) + by

    def _learn_word(self, word: str, gold: tuple | None, known: bool, n: int) -> None:
        """gold: the edit that mends the word, None for keep; known: whether the corpus has the mended word, in n documents."""
        self._now += 1
        cache: dict[int, list[str]] = {}
        best, best_features, gold_features = 0.0, [], []
        for edit in self.edits(word):
            right = edit == gold
            features = [*self.features_of(word, edit, cache), ("fix", level(n) if right and known else "none")]
            if right:
                gold_features = features
            s = self.score(features)
            if s > best:
                best, best_features = s, features
        if best_features != gold_features:
            self._move(gold_features, best_features)

    def _learn_end(self, gold: str, *features) -> None:
        self._now += 1
        own = self.end_features(*features)
        said = self.line_end(*features)
        if said != gold:
            self._move([(f, gold) for f in own], [(f, said) for f in own])

    def train(self, words: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> Editor:
        """words: (word, documents). Noise of CONFUSIONS and signs is put into them, a part is taken for unknown; line
        ends are made by cutting them."""
        rng = random.Random(seed)
        whole = [(w, n) for w, n in words if "-" not in w]
        for _ in range(epochs):
            for word, n in whole:
                draw = rng.random()
                if draw < 0.2:
                    self._learn_word(word, None, False, n)  # a right word that the corpus doesn't have
                elif draw < 0.35:
                    i, sign = rng.randrange(len(word)), rng.choice("0123456789@!|†$€£#*=")
                    noisy = word[:i] + sign + word[i + 1 :]
                    edit = next((e for e in self.edits(noisy) if e[0] == i and e[2] == word[i] and len(e[1]) == 1), (i, sign, "?", [UNREADABLE]))
                    self._learn_word(noisy, edit, edit[2] != "?" and rng.random() < 0.7, n)
                elif places := [(i, e) for e in EDITS for i in _places(word, e[1])]:
                    i, (read, printed, ops) = rng.choice(places)
                    self._learn_word(word[:i] + read + word[i + len(printed) :], (i, read, printed, ops), True, n)
            for (word, n), (other, m) in zip(whole, whole[1:] + whole[:1]):
                if len(word) < 4:
                    continue
                i, sign, draw = rng.randint(2, len(word) - 2), rng.choice(HYPHEN), rng.random()
                head, tail = word[:i], word[i:]
                if draw < 0.1:
                    self._learn_end(KEEP, word, " ", rng.choice(HYPHEN + DASHES), rng.choice((other, other.capitalize())), 0, 0, n, m)
                elif draw < 0.15:
                    self._learn_end(KEEP, word, "", rng.choice(DASHES), other, 0, 0, n, m)
                elif draw < 0.2:
                    self._learn_end(KEEP, "", " ", sign, rng.choice((other, "")), 0, 0, 0, m)
                elif draw < 0.3:
                    self._learn_end(JOIN_HYPHEN, word, "", sign, other, 0, n, n, m)
                elif draw < 0.35:
                    self._learn_end(JOIN_HYPHEN, word.capitalize(), "", sign, other.capitalize(), 0, rng.choice((0, n)), n, m)
                elif draw < 0.45:
                    self._learn_end(JOIN, head.upper(), "", sign, tail.upper(), n, 0, 0, 0)
                else:
                    unknown, parts = rng.random() < 0.3, [rng.choice((0, 0, n)) for _ in "ab"]
                    self._learn_end(JOIN, rng.choice((head, head.capitalize())), "", sign, tail, 0 if unknown else n, 0, *parts)
        for f, row in self.weights.items():
            for label in row:
                row[label] = (self._total[f, label] + (self._now - self._stamp[f, label]) * row[label]) / max(1, self._now)
        return self

    # candidates

    def candidates(self, word: str) -> list[tuple[str, int, float]]:
        """(fix, ease, score) of every edit and every two that don't overlap, with BLANK where a sign may be any letter; a
        fix in which a sign is left is none, as no word holds one. One confusion is easier than a letter guessed, and that
        easier than two edits."""
        signs = [] if word.isalpha() else [i for i, c in enumerate(word) if not _of_words.match(c)]
        if len(signs) > 2:  # an edit mends one sign
            return []
        cache: dict[int, list[str]] = {}
        one = []
        for e in self.edits(word):
            s = self.score(self.features_of(word, e, cache))
            mended = sum(e[0] <= i < e[0] + len(e[1]) for i in signs)
            one.append((e[0], e[1], BLANK if e[2] == "?" else e[2], 2 if e[2] == "?" else 3, s, mended))
        out: dict[str, tuple[int, float]] = {}

        def offer(fix, ease, s):
            out[fix] = max((ease, s), out.get(fix, (0, s)))

        for n, (i, read, printed, ease, s, mended) in enumerate(one):
            if mended == len(signs):
                offer(word[:i] + printed + word[i + len(read) :], ease, s)
            for j, read2, printed2, _, s2, mended2 in one[n + 1 :]:
                if mended + mended2 < len(signs):
                    continue
                if j >= i + len(read):
                    offer(word[:i] + printed + word[i + len(read) : j] + printed2 + word[j + len(read2) :], 1, s + s2)
                elif i >= j + len(read2):
                    offer(word[:j] + printed2 + word[j + len(read2) : i] + printed + word[i + len(read) :], 1, s + s2)
        return [(fix, *x) for fix, x in out.items()]

    def by_signs(self, word: str) -> tuple[str | None, float]:
        """The word with each sign replaced as its place alone says, and how sure that is; None if one stays unreadable."""
        cache: dict[int, list[str]] = {}
        edits, none = self.edits(word), self.of_fix(0)
        fixed, sure, readable = word, 0.0, True
        for i in [i for i, c in enumerate(word) if not c.isalpha()]:
            scored = [(self.score(self.features_of(word, e, cache)) + none, e) for e in edits if e[0] == i and len(e[1]) == 1]
            s, e = max(scored, key=lambda x: x[0], default=(0.0, None))
            if s > 0:
                sure = max(sure, s)
                if e[2] == "?":
                    readable = False
                elif len(e[2]) == 1:
                    fixed = fixed[:i] + e[2] + fixed[i + 1 :]
        return (fixed if readable and fixed != word else None), sure


def _places(word: str, part: str) -> list[int]:
    out, i = [], word.find(part)
    while i >= 0:
        out.append(i)
        i = word.find(part, i + 1)
    return out


STAGE = "kind string, key {kind}, line_no int, word string, n bigint"


def _survey(docs: DataFrame, key: str, text: str, formato: str | None, texts_too: bool = False) -> DataFrame:
    """One pass: flagged lines ('header', 'page_no'), line ends ('end'), words with signs ('odd'), known words ('known'),
    doubtful words ('word'), and with texts_too the scanned texts ('text')."""
    kind = docs.schema[key].dataType.simpleString()
    schema = pa.schema([("kind", pa.string()), ("key", pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), ("line_no", pa.int32()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        known: Counter = Counter()
        memo: dict[str, str] = {}

        def folded(words: set[str]) -> set[str]:
            if len(memo) > MEMO:
                memo.clear()
            out = set()
            for w in words:
                if (low := memo.get(w)) is None:
                    low = memo[w] = plain(w)
                out.add(low)
            return out

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            forms = batch.column(2).to_pylist()
            rows: list[tuple] = []
            scanned = []
            for k, t, f in zip(keys, texts, forms):
                if not t:
                    continue
                if is_scanned(t, f):
                    scanned.append((k, t))
                elif f not in SCANNED_FORMATS:
                    words = set(_word.findall(t))
                    if "-" in t:
                        words |= compounds(t)
                    known.update(folded(words))
            for k, t in scanned:
                if texts_too:
                    rows.append(("text", k, None, t, None))
                lines = t.split("\n")
                found: dict[int, str] = furniture(lines)
                rows += [(name, k, i, None, None) for i, name in found.items()]
                rows += [("end", k, i, key, None) for i, key in line_ends(lines, found)]
                for i, line in enumerate(lines):
                    if i not in found:
                        rows += [("odd", k, i, w, None) for w in odd_words(line)]
                rows += [("word", k, i, low, None) for i, w in set(joined_words(lines, found)) if len(w) > 2 and (low := plain(w)) not in known]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if known:
            words = list(known)
            for i in range(0, len(words), 50_000):
                part = words[i : i + 50_000]
                none = pa.nulls(len(part))
                yield pa.RecordBatch.from_arrays([pa.array(["known"] * len(part)), none.cast(schema.field(1).type), none.cast(pa.int32()), pa.array(part), pa.array([known[w] for w in part], pa.int64())], schema=schema)

    columns = [F.col(key).alias("key"), F.col(text).alias("text"), (F.col(formato) if formato else F.lit(None).cast("string")).alias("formato")]
    return docs.select(*columns).filter(F.length("text") > 0).mapInArrow(run, STAGE.format(kind=kind))


def trained_editor(known: DataFrame, sample: int = SAMPLE_WORDS) -> Editor:
    """The editor, trained on the ``sample`` words of known first by hash: a bound that doesn't grow with the corpus."""
    return Editor().train([(r.word, r.n) for r in known.filter(F.length("word") > 3).orderBy(F.xxhash64("word"), "word").limit(sample).select("word", "n").collect()])


def script(letter: str) -> str:
    return unicodedata.name(letter, "?").split()[0]


_edge = re.compile(r"\A[^\w@|†$€£]+|[^\w@|†$€£]+\Z")


def bared(word: str) -> str:
    """The word in small letters, without the marks around it."""
    return _edge.sub("", word).lower()


def _met(proposed: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, fix, ease, score, n): the proposed fixes that are words of the lexicon (fix, n), and for those with blanks all
    words that fill them with letters of the word's script, that of its first letter."""
    blank = F.lit(BLANK)
    asked = proposed.withColumnRenamed("fix", "blanked")
    size = F.length("blanked")
    places = F.struct(F.locate(BLANK, "blanked").alias("first"), (size + 1 - F.locate(BLANK, F.reverse("blanked"))).alias("last"))
    # one row for a length, and the lines of scanned texts are at most as long as a page is wide
    of_size = asked.groupBy(size.alias("size")).agg(F.collect_set(places).alias("at"))
    whole = lexicon.withColumn("size", F.length("fix")).join(F.broadcast(of_size), "size").select("fix", "n", F.explode("at").alias("at"))
    blanked = F.when(F.col("at.first") == 0, F.col("fix")).otherwise(F.overlay(F.overlay("fix", blank, F.col("at.first")), blank, F.col("at.last")))
    met = whole.select("fix", "n", F.xxhash64(blanked).alias("hash")).join(asked.withColumn("hash", F.xxhash64("blanked")), "hash")

    def fills(fix: str, blanked: str, word: str) -> bool:
        if fix == blanked or BLANK not in blanked or len(fix) != len(blanked):
            return fix == blanked
        own = next((script(c) for c in bared(word) if c.isalpha()), "")
        return all(c == b or (b == BLANK and c.isalpha() and script(c) == own) for c, b in zip(fix, blanked))

    def filled(frames):
        for frame in frames:
            yield frame.loc[list(map(fills, frame["fix"], frame["blanked"], frame["word"])), ["word", "fix", "ease", "score", "n"]]

    return met.select("word", "fix", "blanked", "ease", "score", "n").mapInPandas(filled, "word string, fix string, ease int, score double, n bigint")


def _decided(stage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, fix) of the words that the editor mends, fix null where it sees a misread letter only; and (end, label) of
    all line ends."""
    known = cut(stage.filter("kind = 'known'").groupBy("word").agg(F.sum("n").alias("n")))
    editor = trained_editor(known)
    doubtful = stage.filter("kind = 'word'").select("word").distinct().join(known, "word", "left_anti")
    odd = stage.filter("kind = 'odd'").select("word").distinct()

    def propose(frames):
        for frame in frames:
            rows = []
            for w in frame["word"]:
                bare = bared(w)
                rows += [(w, *x) for x in editor.candidates(bare)]
                if not bare.isalpha():
                    fix, sure = editor.by_signs(bare)
                    rows.append((w, fix, 0, sure))
            yield pd.DataFrame(rows, columns=["word", "fix", "ease", "score"])

    proposed = written(doubtful.unionByName(odd).distinct().mapInPandas(propose, "word string, fix string, ease int, score double"), "proposed")
    weight = F.when(F.col("ease") == 0, F.lit(0.0)).when(F.col("n") < 2, F.lit(editor.of_fix(1))).when(F.col("n") < 10, F.lit(editor.of_fix(2))).otherwise(F.lit(editor.of_fix(10)))
    met = _met(proposed.filter("ease > 0"), known.filter(F.col("n") >= REPAIR_FROM).withColumnRenamed("word", "fix"))
    rows = met.unionByName(proposed.filter("ease = 0").withColumn("n", F.lit(0).cast("bigint"))).repartition("word")
    easiest = rows.groupBy("word", "fix", F.col("ease") > 0).agg(F.max(F.struct("ease", "score", "n")).alias("x")).select("word", "fix", "x.*")
    scored = easiest.select("word", "fix", "ease", (F.col("score") + weight).alias("score")).filter("score > 0")
    fixes = scored.groupBy("word").agg(F.max_by("fix", F.struct("ease", "score", "fix")).alias("fix"))

    ends = stage.filter("kind = 'end'").select(F.col("word").alias("end")).distinct()
    part = F.split("end", "\x1f")
    head, tail = F.lower(part[0]), F.lower(part[3])
    looked = ends.select("end", F.explode(F.array(*[F.struct(F.lit(name).alias("as"), c.alias("word")) for name, c in (("joined", F.concat(head, tail)), ("compound", F.concat(head, F.lit("-"), tail)), ("head", head), ("tail", tail))])).alias("x")).select("end", "x.*")
    counts = looked.join(known, "word", "left").groupBy("end").agg(*[F.max(F.when(F.col("as") == name, F.coalesce("n", F.lit(0)))).alias(name) for name in ("joined", "compound", "head", "tail")])

    def label(frames):
        for frame in frames:
            said = [editor.line_end(*end.split("\x1f"), *n) for end, *n in zip(frame["end"], frame["joined"], frame["compound"], frame["head"], frame["tail"])]
            yield pd.DataFrame({"end": frame["end"], "label": said})

    return fixes, counts.mapInPandas(label, "end string, label string")


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", formato: str | None = "formato") -> DataFrame:
    """(key, line_no int, kind): running headers, page numbers, cut words and, on other lines, misread words."""
    stage = written(_survey(docs, key, text, formato), "scanned")
    fixes, ends = _decided(stage)
    cut_words = stage.filter("kind = 'end'").select("key", "line_no", F.col("word").alias("end")).join(ends.filter(F.col("label") != KEEP), "end", "left_semi").select("key", "line_no", F.lit("hyphen").alias("kind"))
    misread = stage.filter("kind IN ('odd', 'word')").select("key", "line_no", "word").join(fixes.select("word"), "word", "left_semi").select("key", "line_no", F.lit("misread").alias("kind"))
    flagged = stage.filter("kind IN ('header', 'page_no')").select("key", "line_no", "kind")
    # a line has one kind; cut words come before misread ones, furniture holds neither
    rows = flagged.unionByName(cut_words).unionByName(misread)
    return rows.groupBy(F.col("key").alias(key), "line_no").agg(F.min("kind").alias("kind"))


def repaired_text(text: str, fixes: dict[str, str]) -> str:
    """Continuous paragraphs of a scanned text, without furniture, cut words joined and fixes applied."""
    lines = text.split("\n")
    skip = furniture(lines)
    width = int(np.percentile([len(s.strip()) for s in lines if s.strip()], 90)) if text.strip() else 0
    paragraphs: list[str] = []
    now = ""
    gap = False
    for i, line in enumerate(lines):
        s = line.replace("\x0c", "").strip()
        if i in skip:
            continue
        if not s:
            gap = True
            continue
        starts = (gap or line[:1] in " \t") and (not now or _finished.search(now))
        if now and (starts or (_finished.search(now) and last < 0.6 * width)):
            paragraphs.append(now)
            now = ""
        said = fixes.get(f"\x1e{key}", KEEP) if now and (key := end_key(now, s)) else KEEP
        if said == KEEP:
            now = f"{now} {s}" if now else s
        else:
            now = now.rstrip().rstrip(HYPHEN) + ("-" if said == JOIN_HYPHEN else "") + s
        gap, last = False, len(s)
    if now:
        paragraphs.append(now)
    out = "\n\n".join(paragraphs)
    if fixes:

        def fix(m):
            w = m.group(0)
            f = fixes.get(w) or fixes.get(w.lower())
            if not f:
                core = _edge.sub("", w)
                f = fixes.get(core.lower())
                w_core = core
            else:
                w_core = _edge.sub("", w)
            if not f or not w_core:
                return w
            f = f.upper() if w_core.isupper() else f.capitalize() if w_core[:1].isupper() else f
            return w.replace(w_core, f)

        out = re.sub(r"\S+", fix, out)
    return out


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", formato: str | None = "formato") -> DataFrame:
    """(key, scanned boolean, text): scanned texts repaired, others as they are. Only scanned texts are shuffled."""
    kind = docs.schema[key].dataType.simpleString()
    stage = written(_survey(docs, key, text, formato, True), "scanned")
    fixes, ends = _decided(stage)
    of_word = stage.filter("kind IN ('word', 'odd')").select("key", "word").distinct().join(fixes.filter("fix IS NOT NULL"), "word").select("key", "word", "fix")
    of_end = stage.filter("kind = 'end'").select("key", F.col("word").alias("end")).distinct().join(ends, "end").select("key", F.concat(F.lit("\x1e"), "end").alias("word"), F.col("label").alias("fix"))
    of_doc = of_word.unionByName(of_end).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("word", "fix"))).alias("fixes"))

    def others(batches):
        for batch in batches:
            at = [i for i, (t, f) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if not t or not is_scanned(t, f)]
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([False] * len(at)), part.column(1)], ["key", "scanned", "text"])

    def mended(batches):
        for batch in batches:
            new = [repaired_text(t, dict(f or ())) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * len(new)), pa.array(new, pa.string())], ["key", "scanned", "text"])

    out = f"key {kind}, scanned boolean, text string"
    plain_ = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(formato) if formato else F.lit(None).cast("string")).alias("formato")).mapInArrow(others, out)
    scanned = stage.filter("kind = 'text'").select("key", F.col("word").alias("text")).join(of_doc, "key", "left").select("key", "text", "fixes").mapInArrow(mended, out)
    return plain_.unionByName(scanned).withColumnRenamed("key", key)
