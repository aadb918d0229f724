"""One memo per Python worker: workers live on from one operator to the next."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_ACTIVE: dict[str, Callable[[], None]] = {}


def claim(owner: str, clear: Callable[[], None]) -> None:
    """Tell that ``owner``'s memo is in use now; the memo of any other owner is cleared, and what
    the process no longer needs goes back to the system."""
    if owner not in _ACTIVE:
        for drop in _ACTIVE.values():
            drop()
        _ACTIVE.clear()
        _ACTIVE[owner] = clear
        give_back()


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


class Memo:
    """Values by word, the first that come until their bytes reach a bound.

    With ``marks`` (a power of two), a word is kept from its second appearance on: most distinct
    words of a corpus come once, and then leave a byte in a table of so many marks and nothing
    else. That makes more of a small memo, but every word is worked out twice. Words that share a
    mark are kept at their first appearance.
    """

    def __init__(self, most_bytes: int, marks: int = 0):
        self.most, self.used = most_bytes, 0
        self.words: dict[str, object] = {}
        self.seen = bytearray(marks)

    def get_all(self, words: list[str]) -> list:
        return list(map(self.words.get, words))

    def add(self, values: dict[str, bytes]) -> None:
        """Keep values; 190 bytes are what Python itself takes for an entry."""
        if self.used >= self.most:
            return
        if self.seen:
            seen, mask = self.seen, len(self.seen) - 1
            kept = {}
            for word, value in values.items():
                at = hash(word) & mask
                if seen[at]:
                    kept[word] = value
                else:
                    seen[at] = 1
            values = kept
        self.words.update(values)
        self.used += sum(map(len, values)) + sum(map(len, values.values())) + 190 * len(values)
