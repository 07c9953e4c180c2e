"""Token ids by a public tokenizer file, with a bounded memo of words.

The tokenizer lower-cases, drops white space and never joins text across it,
so the ids of a text are the ids of its space-separated chunks in order. Each
chunk not met before is encoded by the library, many in one call with a
special token between them; chunks met before come from the memo.
"""

from __future__ import annotations

import sys
from itertools import repeat

import numpy as np

TOKENIZER = "word_bpe_49k.json"
FOLDER = "/opt/tokenizers"
_MEMO_WORDS = 1_000_000
_LONG_CHUNK = 2_000
_BREAK = "<|endoftext|>"


_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123)]] = True
_MARK = np.zeros(256, bool)  # ASCII that is neither a letter nor white space
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalpha()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[[*range(65, 91)]] = True


def loosened(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts for the tokenizer, with fewer distinct chunks.

    Lower-cases ASCII letters that an ASCII byte follows (a letter before a
    combining mark is left to the library, which composes first) and puts a
    space between an ASCII letter and an ASCII mark or digit, where the
    tokenizer always cuts. Texts with the opening of a special token are left
    as they are.
    """
    if len(data) < 2 or b"<|" in data.tobytes():
        return data, offsets
    low = data.copy()
    at = np.flatnonzero(_UPPER[data[:-1]] & (data[1:] < 128))
    low[at] += 32
    cut = np.flatnonzero(_LETTER[low[:-1]] & _MARK[low[1:]]) + 1
    shift = np.searchsorted(cut, offsets, side="left")
    return np.insert(low, cut, 32), offsets + shift


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary's place on this machine; it is never copied."""
    try:
        import public_tokenizers
    except ImportError:
        return f"{FOLDER}/{name}"
    return public_tokenizers.path(name)


class Encoder:
    """Encodes UTF-8 byte strings to arrays of ids, exactly as the library does whole texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.stop = self.library.token_to_id(_BREAK)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.uint16 if self.library.get_vocab_size() <= 65536 else np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)

    def _append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.index) - len(sizes), len(sizes)
        while len(self.first) < at + n:
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, self.pool])
        self.pool[self.used: self.used + len(ids)] = ids
        self.first[at: at + n] = self.used + np.cumsum(sizes) - sizes
        self.size[at: at + n] = sizes
        self.used += len(ids)

    def _learn(self, fresh: list[bytes]) -> None:
        plain = [w for w in fresh if len(w) <= _LONG_CHUNK and b"<|" not in w]
        other = [w for w in fresh if len(w) > _LONG_CHUNK or b"<|" in w]
        for i in range(0, len(plain), 20_000):
            part = plain[i: i + 20_000]
            self.index.update(zip(part, range(len(self.index), len(self.index) + len(part))))
            text = _BREAK.encode().join(part).decode("utf-8", "replace")
            ids = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
            stops = np.concatenate([[-1], np.flatnonzero(ids == self.stop), [len(ids)]])
            self._append(ids[ids != self.stop], np.diff(stops) - 1)
        for w in other:
            self.index[w] = len(self.index)
            ids = np.array(self.library.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)
            self._append(ids, np.array([len(ids)]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        if len(self.index) > _MEMO_WORDS:
            self.clear()
        chunks, counts = [], []
        for t in texts:
            parts = t.split()
            chunks += parts
            counts.append(len(parts))
        if not chunks:
            return self.pool[:0], np.zeros(len(texts), np.int64)
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int32, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [chunks[i] for i in new.tolist()]
            self._learn(list(dict.fromkeys(fresh)))
            at[new] = np.fromiter(map(self.index.__getitem__, fresh), np.int32, len(fresh))
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        where = np.repeat((self.first[at] - (ends - sizes)).astype(np.int32), sizes)
        where += np.arange(total, dtype=np.int32)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        upto = np.concatenate([[0], ends])[bounds]
        return self.pool[where], np.diff(upto)


def encoder(path: str) -> Encoder:
    """One encoder per worker process and path."""
    kept = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def encoded(batches, path: str, limit: int = 2 << 20, column: str = "text"):
    """Yield (rows, ids, counts) for slices of record batches; a null text has no ids."""
    from tidewright.llm.textunits import slices

    enc = encoder(path)
    for rows, data, off in slices(batches, column, limit):
        data, off = loosened(data, off)
        raw = data.tobytes()
        ids, counts = enc.encode([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
        yield rows, ids, counts
