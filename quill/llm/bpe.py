"""Byte-level BPE by a prefix-sharing walk over the trie of distinct words.

For byte-pair encodings, the encoding of a prefix ends in one token, and what stands before that token is itself the
encoding of a shorter prefix. One state per trie node (the last token of the node's prefix) therefore holds every
encoding. Distinct words are visited in sorted order, which is the depth-first order of their trie, and only nodes
below the common prefix with the word before are computed.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

DEFAULT_FOLDER = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
#: The published splitting pattern of this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cached pieces at which a worker starts its cache afresh; results don't depend on it.
CACHE_PIECES = 1_000_000
INFINITE = 1 << 60
#: A lone surrogate: decoded text can't hold it.
MARK = "\ud800"


class Vocabulary:
    """Ranks of a tiktoken file, and which tokens may stand side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        #: Every ending of a token: a longer ending can't be a token once this set lacks one.
        self.endings = {t[i:] for t in self.rank for i in range(len(t))}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.beside: dict[tuple[bytes, bytes], bool] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge made this one; None for a byte."""
        if len(token) == 1:
            return None
        if token not in self.halves:
            parts, top = [token[i : i + 1] for i in range(len(token))], self.rank[token]
            while len(parts) > 2:
                ranks = [self.rank.get(a + b, INFINITE) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best >= top:
                    break
                i = ranks.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token[:-1], token[-1:])
        return self.halves[token]

    def spine(self, token: bytes, side: int) -> list[tuple[bytes, int]]:
        """Tokens along one edge of token's merge tree, each with the rank at which it is merged away."""
        out, above = [(token, INFINITE)], self.rank[token]
        while (pair := self.split(token)) is not None:
            token = pair[side]
            out.append((token, above))
            above = self.rank[token]
        return out

    def adjoin(self, left: bytes, right: bytes) -> bool:
        """Whether left followed by right stays so: no merge across the border comes first."""
        key = (left, right)
        if (known := self.beside.get(key)) is not None:
            return known
        ok, rank = True, self.rank
        inner = self.spine(right, 0)
        for a, gone_a in self.spine(left, 1):
            for b, gone_b in inner:
                r = rank.get(a + b)
                if r is not None and r < gone_a and r <= gone_b:
                    ok = False
                    break
            if not ok:
                break
        self.beside[key] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Token ids of each distinct word, computing shared prefixes once."""
        rank, endings, adjoin = self.rank, self.endings, self.adjoin
        out: dict[bytes, list[int]] = {}
        last: list[bytes] = [b""]  # last[i]: last token of the encoding of the first i bytes
        before = b""
        for word in sorted(words):
            if (whole := rank.get(word)) is not None:
                out[word] = [whole]
                continue
            n = min(len(word), len(before), len(last) - 1)
            same = 0
            while same < n and word[same] == before[same]:
                same += 1
            del last[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                j = i - 1
                while j and word[j - 1 : i] in endings:
                    j -= 1
                while True:  # the longest fitting token that ends here
                    token = word[j:i]
                    if token in rank and (j == 0 or adjoin(last[j], token)):
                        last.append(token)
                        break
                    j += 1
            before = word
            ids, i = [], len(word)
            while i:
                token = last[i]
                ids.append(rank[token])
                i -= len(token)
            out[word] = ids[::-1]
        return out


class Encoder:
    """Encodes batches of texts; keeps the encodings of pieces between spaces."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN)
        # runs of white space in which the pattern looks further than one character
        self.uneven = re.compile(r"\s\s\s|[^\S\n]\s|\s[^\S\n]|\s\s\Z")
        self.border = re.compile(r"(?<=\S)(?=[ \n]\S)")
        self.reset()

    def reset(self) -> None:
        self.at: dict[str, int] = {}
        self.of_word: dict[str, list[int]] = {}
        self.starts, self.sizes, self.pending = [], [], []
        self.flat = np.zeros(0, np.int32)
        self.used = 0
        self.arrays = None

    def _learn(self, pieces: list[str]) -> None:
        found = [(p, self.words.findall(p)) for p in pieces]
        fresh = {w for _, ws in found for w in ws if w not in self.of_word}
        if fresh:
            by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in fresh}
            for b, ids in self.vocabulary.encode_words(list(by_bytes)).items():
                self.of_word[by_bytes[b]] = ids
        for p, ws in found:
            ids = [i for w in ws for i in self.of_word[w]]
            self.at[p] = len(self.starts)
            self.starts.append(self.used)
            self.sizes.append(len(ids))
            self.pending.append(ids)
            self.used += len(ids)
        self.arrays = None

    def pieces(self, text: str) -> list[str]:
        """Parts between which the pattern never joins characters: each begins at a space or line end."""
        if self.uneven.search(text):
            return self.border.split(text)
        return text.replace(" ", MARK + " ").replace("\n", MARK + "\n").split(MARK)

    def _positions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of all pieces in order, and how many each text has."""
        if len(self.at) > CACHE_PIECES:
            self.reset()
        split = [self.pieces(t) if t else [] for t in texts]
        flat = [p for ps in split for p in ps]
        if fresh := list({p for p in flat if p not in self.at}):
            self._learn(fresh)
        if self.arrays is None:
            self.arrays = (np.array(self.starts, np.int64), np.array(self.sizes, np.int64))
        get = self.at.__getitem__
        return np.fromiter(map(get, flat), np.int64, len(flat)), np.fromiter(map(len, split), np.int64, len(split))

    def sizes_of(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        index, counts = self._positions(texts)
        total = np.concatenate(([0], np.cumsum(self.arrays[1][index] if len(index) else np.zeros(0, np.int64))))
        ends = np.cumsum(counts)
        return total[ends] - total[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        index, counts = self._positions(texts)
        starts, sizes = self.arrays
        ids_flat = self._ids()
        n = sizes[index] if len(index) else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        where = np.arange(total[-1]) + np.repeat(starts[index] - total[:-1], n) if len(index) else np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        return np.concatenate(([0], total[ends])) if len(texts) else np.zeros(1, np.int64), ids_flat[where]

    def _ids(self) -> np.ndarray:
        """All known pieces' ids on end; what was learned since the last call is appended."""
        if self.pending:
            new = np.fromiter((i for ids in self.pending for i in ids), np.int32)
            self.flat = np.concatenate([self.flat, new])
            self.pending = []
        return self.flat


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)


def vocabulary_path(folder: str | None = None, file: str = DEFAULT_FILE) -> str:
    return os.path.join(folder or os.environ.get("QUILL_TOKENIZERS", DEFAULT_FOLDER), file)
