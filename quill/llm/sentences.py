"""Sentence boundaries by a finite transducer over character classes.

Characters are mapped to classes, dots that end no sentence (abbreviations, initials, ordinals) are masked, and the
rest is a transducer of 13 states whose output marks sentence starts. A long text needs no sequential pass: it is cut
into blocks, each block becomes a function from state to state, the functions are composed by a parallel prefix scan
(doubling), and every block is then replayed from its now known start state. All steps are array operations over the
texts of a whole batch, which are laid end to end.

Defined results: null, empty and blank texts have no sentences; a line end always ends a sentence.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quill.llm.visual import FOLD, LIGATURES

BLOCK = 64
#: Code points laid end to end at once.
BATCH_CHARS = 1 << 20

OTHER, SPACE, NEWLINE, TERM, CJK_TERM, OPEN, CLOSE, QUOTE, LOW_QUOTE, LOWER, KANA, CJK, PAUSE, THAI_SPACE, DIGIT, HIDDEN = range(16)
CLASSES = 16
(LINE, IN, ENDED, GAP, CJK_END, INNER, INNER_END, QUOTED, QUOTED_END, LOW, LOW_END, CLOSED, THAI_GAP) = range(13)
STATES = 13

#: Abbreviations after which a sentence goes on, whatever follows.
ABBREVIATIONS = frozenset(
    "ej ex dr dra sr sra srta mr mrs ms prof profa lic ing mme mlle st sto sta gral gen cap col ee uu vs cf núm num fig figs art arts "
    "sec abschn abb nr bzw ca vgl hrsg tel av ed eds vol pág pag págs pp inc ltd cía jr prov depto dept др проф рис стр гл "
    "ст им ул тов".split()
)

#: Abbreviations only before a number.
BEFORE_NUMBERS = frozenset("no nos nº n.º p t cap sect ch chap kap bd ziff nro".split())
#: German month names, which turn a number with a dot before them into a day.
MONTHS = ("Januar", "Jänner", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember")


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x30000):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Ll":
            table[cp] = LOWER
        elif kind == "Nd":
            table[cp] = DIGIT
        elif kind == "Ps" or kind == "Pi":
            table[cp] = OPEN
        elif kind == "Pe" or kind == "Pf":
            table[cp] = CLOSE
        elif ch.isspace():
            table[cp] = SPACE
        elif kind == "Cf":
            table[cp] = HIDDEN
    for ch in "\n\u2028\u2029":
        table[ord(ch)] = NEWLINE
    for ch in ".!?…؟۔।॥‽":
        table[ord(ch)] = TERM
    for ch in "。！？｡":
        table[ord(ch)] = CJK_TERM
    for ch in ",;:、，；：–—-،؛":
        table[ord(ch)] = PAUSE
    for ch in "'’‘‚‛":
        table[ord(ch)] = OTHER
    table[ord('"')] = QUOTE
    table[ord("„")] = LOW_QUOTE
    table[0x3041:0x30A0] = KANA
    table[0x30A0:0x3100] = CJK
    table[0x3400:0xA000] = CJK
    table[0x20000:0x30000] = CJK
    return table


@lru_cache(maxsize=1)
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the character starts a sentence), both indexed by class * STATES + state."""
    nxt = np.zeros((CLASSES, STATES), np.uint8)
    out = np.zeros((CLASSES, STATES), bool)
    entered = {OPEN: INNER, QUOTE: QUOTED, LOW_QUOTE: LOW, TERM: ENDED, CJK_TERM: CJK_END}
    for c in range(CLASSES):
        for s in range(STATES):
            begun = entered.get(c, IN)
            if c == NEWLINE:
                to, starts = LINE, False
            elif c == HIDDEN and s not in (LINE, GAP, THAI_GAP):
                to, starts = s, False
            elif s in (INNER, INNER_END, QUOTED, QUOTED_END, LOW, LOW_END):
                base = {INNER_END: INNER, QUOTED_END: QUOTED, LOW_END: LOW}.get(s, s)
                over = s != base
                closes = {INNER: (CLOSE,), QUOTED: (QUOTE,), LOW: (CLOSE, OPEN)}[base]
                starts = False
                if c in closes:
                    to = CLOSED if over else IN
                elif c in (TERM, CJK_TERM):
                    to = base + 1
                elif c in (SPACE, THAI_SPACE):
                    to = s
                else:
                    to = base
            elif c in (SPACE, THAI_SPACE):
                starts = False
                to = {LINE: LINE, ENDED: GAP, GAP: GAP, CJK_END: GAP, CLOSED: GAP, THAI_GAP: THAI_GAP}.get(s, IN)
                if c == THAI_SPACE and s in (IN, ENDED, CLOSED):
                    to = THAI_GAP
            elif s in (LINE, THAI_GAP):
                to, starts = begun, True
            elif s == IN:
                to, starts = begun, False
            elif s == ENDED:
                starts = False
                to = ENDED if c in (TERM, CLOSE) else CJK_END if c == CJK_TERM else begun
            elif s == GAP:
                if c in (CLOSE, TERM):
                    to, starts = ENDED, False
                elif c in (LOWER, PAUSE):
                    to, starts = IN, False
                else:
                    to, starts = begun, True
            elif s == CJK_END:
                if c in (CLOSE, TERM, CJK_TERM):
                    to, starts = CJK_END, False
                elif c == PAUSE:
                    to, starts = IN, False
                else:
                    to, starts = begun, True
            else:  # CLOSED: a quotation or bracket that held a sentence end has just closed
                if c in (CLOSE, TERM):
                    to, starts = ENDED if c == TERM else CLOSED, False
                elif c in (CJK, CJK_TERM, DIGIT, OPEN):
                    to, starts = begun, c != CJK_TERM
                else:
                    to, starts = begun, False
            nxt[c, s], out[c, s] = to, starts
    return nxt.reshape(-1), out.reshape(-1)


def states_before(classes: np.ndarray) -> np.ndarray:
    """State of the transducer before each character, starting in LINE."""
    nxt, _ = transducer()
    n = len(classes)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, NEWLINE, np.int32)
    padded[:n] = classes
    rows = np.ascontiguousarray((padded * STATES).reshape(blocks, BLOCK).T)  # step by step over all blocks
    function = np.tile(np.arange(STATES, dtype=np.int32), (blocks, 1))
    for step in rows:
        function = nxt[step[:, None] + function].astype(np.int32)
    reach = 1
    while reach < blocks:  # inclusive scan: each block's function after those of the blocks before it
        function[reach:] = np.take_along_axis(function[reach:], function[:-reach], 1)
        reach *= 2
    state = np.concatenate(([LINE], function[:-1, LINE])).astype(np.int32)
    before = np.empty((BLOCK, blocks), np.uint8)
    for k, step in enumerate(rows):
        before[k] = state
        state = nxt[step + state].astype(np.int32)
    return before.T.reshape(-1)[:n]


_token = re.compile(r"[\w.]*\Z")
_hidden = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
FOLD_ALL = FOLD | {ord(a): b for a, b in LIGATURES.items()}


def soft_dot(text: str, at: int) -> bool:
    """Whether the dot at this place, which white space follows, ends no sentence."""
    last = text[at - 1 : at]
    if "ऀ" <= last <= "ॿ" or "฀" <= last <= "๿":
        return True
    token = _token.search(_hidden.sub("", text[max(0, at - 12) : at])).group()
    if not token:
        return False
    last = token[-1]
    if last == ".":
        return False
    low = token.translate(FOLD_ALL).lower().strip("._") if not token.isascii() else token.lower().strip("._")
    if low in ABBREVIATIONS or token.lower().strip("._") in ABBREVIATIONS:
        return True
    tail = low.rsplit(".", 1)[-1]
    if len(tail) == 1 and tail.isalpha():
        return True
    after = text[at + 1 : at + 14].lstrip()
    if low in BEFORE_NUMBERS:
        return after[:1].isdigit()
    if low.isdigit():
        if len(low) <= 2 and after.startswith(MONTHS):
            return True
        head = text[max(0, at - 12) : at]
        return len(low) <= 3 and not head[: len(head) - len(token)].rpartition("\n")[2].strip() and (at - len(token) == 0 or "\n" in head)
    return False


def batch_starts(joined: str) -> np.ndarray:
    """Code point offsets of sentence starts in texts laid end to end, each ended by a line end."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = class_table()[points]
    spaces = (classes == SPACE) | (classes == NEWLINE)
    dots = np.flatnonzero((points[:-1] == 46) & spaces[1:])
    if len(dots):
        known: dict[str, bool] = {}
        soft = []
        for at in dots.tolist():
            key = joined[max(0, at - 13) : at + 14]
            if (v := known.get(key)) is None:
                v = known[key] = soft_dot(joined, at)
            if v:
                soft.append(at)
        classes[soft] = OTHER
    thai = (points >= 0x0E01) & (points <= 0x0E5B)
    if thai.any():
        space = np.flatnonzero(classes == SPACE)
        near = thai[np.maximum(space - 1, 0)] | thai[np.minimum(space + 1, len(points) - 1)]
        classes[space[near]] = THAI_SPACE
    _, out = transducer()
    return np.flatnonzero(out[classes.astype(np.int32) * STATES + states_before(classes)])


def batches_of(texts: list[str | None]):
    """Ranges of texts of about BATCH_CHARS, laid end to end: (first, after last, joined, offsets of their starts)."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") < BATCH_CHARS):
            size += len(texts[j] or "") + 1
            j += 1
        part = [t or "" for t in texts[i:j]]
        yield i, j, "\n".join(part) + "\n", np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        i = j


def starts_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, offset of a sentence start in it), in order."""
    rows, offsets = [], []
    for i, _, joined, at in batches_of(texts):
        found = batch_starts(joined)
        which = np.searchsorted(at, found, "right") - 1
        rows.append(which + i)
        offsets.append(found - at[which])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(offsets)


def sentence_starts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos int): 0-based code point offset of each sentence's first character that isn't white space."""
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            which, offset = starts_of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(offset.astype(np.int32))], ["key", "pos"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text") != "").mapInArrow(run, f"key {kind.simpleString()}, pos int").withColumnRenamed("key", key)


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, idx int, pos int, sentence string): whole sentences in order, trimmed."""
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            which, offset = starts_of(texts)
            first = np.searchsorted(which, np.arange(len(texts) + 1))
            parts, index = [], []
            for i, t in enumerate(texts):
                at = offset[first[i] : first[i + 1]].tolist()
                parts += [t[a:b].rstrip() for a, b in zip(at, [*at[1:], len(t)])] if at else []
                index += range(len(at))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(which)), pa.array(index, pa.int32()), pa.array(offset.astype(np.int32)), pa.array(parts, pa.string())], ["key", "idx", "pos", "sentence"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("text") != "").mapInArrow(run, f"key {kind.simpleString()}, idx int, pos int, sentence string").withColumnRenamed("key", key)
