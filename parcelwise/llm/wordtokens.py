"""Token ids of whole texts, word by word.

The tokenizer's own pre-tokenizer never joins what ASCII white space parts, so a
text's ids are its words' ids in a row. Each task keeps the ids of the words it has
met and asks the tokenizer only for new ones. A word of ASCII letters is one
pre-token, so its ids come straight from the tokenizer's model.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

#: Words kept by a Python worker; beyond it the memory starts anew.
KEPT_WORDS = 400_000
# A run of these after a letter is a pre-token of its own.
_TAIL = re.compile(rb"(?<=[A-Za-z])[.,!?*$#%&|:;)]+$")


class _Codes(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class WordTokens:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        letters = normalizer.normalize_str(string.ascii_letters) if normalizer else string.ascii_letters
        lowers = letters == string.ascii_letters.lower()
        # Whether letters are only lowered, if anything, and stay one pre-token.
        self.by_model = (lowers or letters == string.ascii_letters) and (not cutter or [t for t, _ in cutter.pre_tokenize_str(letters)] == [letters])
        self.written = bytes.lower if lowers else bytes
        self._forget()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.parts: dict[bytes, bytes] = {}  # ids as 32-bit numbers: a list of ints takes several times as much
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        cut = [w if w.isalpha() or not (m := _TAIL.search(w)) else w[: m.start()] for w in new]
        tails = [w[len(c) :] for w, c in zip(new, cut)]
        unknown = {p for p in (*cut, *tails) if p and p not in self.parts}
        if self.by_model:
            cut_up = self.tokenizer.model.tokenize
            for p in filter(bytes.isalpha, unknown):
                self.parts[p] = array("I", [t.id for t in cut_up(self.written(p).decode())]).tobytes()
            unknown = {p for p in unknown if not p.isalpha()}
        unknown = list(unknown)
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for p, e in zip(unknown, encode([p.decode() for p in unknown], add_special_tokens=False)):
            self.parts[p] = array("I", e.ids).tobytes()
        ids = [self.parts[c] + self.parts[t] if t else self.parts[c] for c, t in zip(cut, tails)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        base, total = self.starts[-1], int(sizes.sum())
        while base + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[base : base + total] = np.frombuffer(b"".join(ids), np.uint32)
        self.starts = np.concatenate((self.starts, base + np.cumsum(sizes)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and each row's start."""
        if len(self.codes) > KEPT_WORDS:
            self._forget()
        raw = data.tobytes()
        rows = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        code = self.codes.__getitem__
        codes = np.fromiter(map(code, chain.from_iterable(rows)), np.int64, int(counts.sum()))
        if self.codes.new:
            self._learn()
        first, size = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]


_SHARED: dict[str, WordTokens] = {}


def shared(path: str) -> WordTokens:
    """One memory for each Python worker, kept across tasks."""
    if path not in _SHARED:
        _SHARED[path] = WordTokens(path)
    return _SHARED[path]
