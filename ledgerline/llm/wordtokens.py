"""Exact word-level memoisation of a lower-casing word BPE tokenizer.

No token of such a tokenizer crosses white space, so the ids of a text are
those of its white-space chunks in a row. Chunks repeat, so each worker
encodes a chunk once and keeps the answer in a bounded memo.

What the memo relies on, and what falls back to the library:

* texts with ``<|`` may hold special strings, which the library cuts out of
  the raw text first: the library encodes the whole text;
* texts outside Latin-1 keep their case in the memo's keys, as their lower
  case and composition are the library's own matter;
* within Latin-1 every character is already composed and lowers by itself,
  so keys are lowered first and more of them coincide.
"""

from __future__ import annotations

import re

#: str.split() also splits at these four, which the tokenizer holds for text.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \\t\\n\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def chunks(text: str) -> list[str] | None:
    """White-space chunks of a text as memo keys; None if it may hold special strings."""
    if "<|" in text:
        return None
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.split() if not _CONTROL.search(text) else [x for x in _SPACE.split(text) if x]
    text = text.lower()
    return text.split() if not _CONTROL.search(text) else [x for x in _SPACE.split(text) if x]


class Memo(dict):
    """chunk -> value; of at most ``limit`` entries, then it starts anew.

    ``compute(chunk)`` gives a chunk's value. Values add up: a purely
    alphabetic word before a run of full stops and commas is looked up
    without them, as the pre-tokenizer parts letters from signs.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, chunk: str):
        core = chunk.rstrip(".,")
        if core and len(core) < len(chunk) and core.isalpha():
            value = self[core] + self[chunk[len(core):]]
        else:
            value = self.compute(chunk)
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = value
        return value


def slices(batches, rows: int = 500):
    """The batches in parts of few rows, so that a worker holds few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


_WORKER: dict = {}


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    import contextlib
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(key, build):
    """What ``build()`` makes, once in each Python worker for as long as it is asked for no other: workers outlive stages."""
    if key not in _WORKER:
        if _WORKER:
            _WORKER.clear()
            _give_back()
        _WORKER[key] = build()
    return _WORKER[key]
