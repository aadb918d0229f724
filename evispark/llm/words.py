"""Hashes of the distinct words of many lines at once, without a Python object per word.

Texts are lower-cased and joined; words are found and hashed as arrays over their bytes. White
space is what ``str.split`` takes for it.
"""

from __future__ import annotations

import numpy as np

PAD = 8
_WIDE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_TWO = np.array([int.from_bytes(w, "big") for w in _WIDE if len(w) == 2])
_THREE = np.array([int.from_bytes(w, "big") for w in _WIDE if len(w) == 3])
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Lower case of characters of two bytes in UTF-8, or 0 where it has another length or hangs on its
#: neighbours (capital sigma); characters of three bytes that have a lower case; from LEAST_UNCASED
#: on none has.
_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 and 0x80 <= ord(c.lower()) < 0x800 and c != "\u03a3" else 0 for c in map(chr, range(0x800))], np.uint16)
_CASED = np.array([c.lower() != c for c in map(chr, range(0x10000))])
LEAST_UNCASED = 0x1F000


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        z = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        z = (z ^ (z >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return z ^ (z >> np.uint64(33))


def lower_utf8(text: str) -> bytes:
    """``text.lower()`` in UTF-8."""
    return lower_bytes(text.encode("utf-8", "surrogatepass"))


def lower_bytes(text: bytes) -> bytes:
    """A text's lower case, both in UTF-8. Only characters of one and two bytes are changed as arrays;
    a text with others to change goes to ``str.lower``."""
    raw = text.lower()  # A-Z
    if raw.isascii():
        return raw
    b = np.frombuffer(bytearray(raw), np.uint8)
    at = np.flatnonzero(b >= 0xC2)
    lead = b[at]
    two, more = at[lead < 0xE0], at[lead >= 0xE0]
    code = (b[two].astype(np.uint16) & 0x1F) << 6 | b[two + 1] & 0x3F
    low = _LOWER[code]
    if len(more):
        wide = b[more] >= 0xF0
        three, four = more[~wide], more[wide]
        whole = _CASED[(b[three].astype(np.int32) & 0xF) << 12 | (b[three + 1].astype(np.int32) & 0x3F) << 6 | b[three + 2] & 0x3F].any()
        whole |= (((b[four].astype(np.int32) & 7) << 18 | (b[four + 1].astype(np.int32) & 0x3F) << 12) < LEAST_UNCASED).any()
    else:
        whole = False
    if whole or not low.all():
        return text.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass")
    new = np.flatnonzero(low != code)
    b[two[new]], b[two[new] + 1] = 0xC0 | low[new] >> 6, 0x80 | low[new] & 0x3F
    return b.tobytes()


def _spaces(b: np.ndarray) -> np.ndarray:
    space = (b - np.uint8(9) < 5) | (b - np.uint8(28) < 5)  # 9 to 13 and 28 to 32; less than 0 wraps
    at = np.flatnonzero((b == 0xC2) | (b - np.uint8(0xE1) < 3))  # first bytes of _WIDE
    if len(at):
        two = b[at].astype(np.int64) << 8 | b[at + 1]
        for width, hit in ((2, np.isin(two, _TWO)), (3, np.isin(two << 8 | b[at + 2], _THREE))):
            for d in range(width):
                space[at[hit] + d] = True
    return space


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word in ``raw``, which begins and ends with white space."""
    space = _spaces(np.frombuffer(raw, np.uint8))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    return edges[0::2], edges[1::2] - edges[0::2]


def word_hashes(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time; words of one size up to eight bytes never
    share one. ``raw`` is padded with PAD bytes."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))
    h = mix(size.astype(np.uint64) ^ mix(eight[start] & _MASK[np.minimum(size, 8)]))
    live, off = np.flatnonzero(size > 8), 8
    while len(live):
        h[live] = mix(h[live] ^ (eight[start[live] + off] & _MASK[np.minimum(size[live] - off, 8)]))
        off += 8
        live = live[size[live] > off]
    return h


class Lines:
    """Word sets of all lines of some texts (UTF-8) that have words, as flat arrays: ``row`` and ``line``
    of each line, its ``size`` (distinct words) and ``start`` in ``words`` (their hashes), and its
    class (``cls``, an order-free hash, and ``bitmap``, the parity of its words' last six bits).
    With ``level`` a line's words come rarest first by the level of their counters, then by hash."""

    def __init__(self, texts: list[bytes | None], level: np.ndarray | None = None):
        full = [i for i, t in enumerate(texts) if t]
        self.raw = raw = lower_bytes(b"\n" + b"\n".join([texts[i] for i in full]) + b"\n") + b" " * PAD
        many = np.array([texts[i].count(b"\n") + 1 for i in full], np.int64)
        start, size = word_bounds(raw)
        self.breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        n_words = np.diff(np.searchsorted(start, self.breaks)) if len(full) else np.zeros(0, np.int64)
        self.kept = np.flatnonzero(n_words)  # lines with words, among all
        first = np.cumsum(many) - many
        self.row = np.repeat(np.array(full, np.int64), many)[self.kept]
        self.line = (np.arange(len(n_words)) - np.repeat(first, many))[self.kept].astype(np.int32)
        owner = np.repeat(np.arange(len(self.kept)), n_words[self.kept])
        words = word_hashes(raw, start, size) if len(start) else np.zeros(0, np.uint64)
        rank = words if level is None else level[counter(words, len(level))].astype(np.uint64) << np.uint64(56) | words >> np.uint64(8)
        words = words[self._by_line(owner, rank)]
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        self.words, self.owner = words[~again], owner[~again]
        self.size = np.bincount(self.owner, minlength=len(self.kept)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        if len(self.kept):
            self.cls = np.add.reduceat(mix(self.words), self.start).view(np.int64)
            self.bitmap = np.bitwise_xor.reduceat(np.uint64(1) << (self.words & np.uint64(63)), self.start).view(np.int64)
        else:
            self.cls = self.bitmap = np.zeros(0, np.int64)

    @staticmethod
    def _by_line(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Order by line, then by the high bits of ``value``."""
        bits = np.uint64(int(owner[-1]).bit_length() if len(owner) else 1)
        if not bits:
            return np.argsort(value)
        return np.argsort(owner.astype(np.uint64) << (np.uint64(64) - bits) | value >> bits)

    def text_of(self, i: int) -> list[str]:
        """Distinct words of a line, sorted."""
        at = self.kept[i]
        return sorted(set(self.raw[self.breaks[at] + 1 : self.breaks[at + 1]].decode("utf-8", "surrogatepass").split()))

    def wide(self) -> np.ndarray:
        """256 parity bits of each line's words, as four integers."""
        if not len(self.kept):
            return np.zeros((0, 4), np.uint64)
        bit = np.uint64(1) << (self.words >> np.uint64(6) & np.uint64(63))
        lane = self.words >> np.uint64(12) & np.uint64(3)
        out = np.zeros((len(self.kept), 4), np.uint64)
        for w in range(4):
            at = np.flatnonzero(lane == np.uint64(w))
            mine = self.owner[at]
            if len(at):
                first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                out[mine[first], w] = np.bitwise_xor.reduceat(bit[at], first)
        return out

    def new(self, seen: set[int], limit: int) -> np.ndarray:
        """Which lines' classes are not in ``seen``, to which they are added up to ``limit``."""
        out = np.zeros(len(self.kept), bool)
        for i, c in enumerate(self.cls.tolist()):
            if c not in seen:
                out[i] = True
                if len(seen) < limit:
                    seen.add(c)
        return out

    def prefixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, word, place, word before or 0) of the prefix words of the chosen lines, whose words
        were ordered by ``level``."""
        place = np.arange(len(self.owner)) - self.start[self.owner]
        most = np.where(chosen, self.size - (4 * self.size + 4) // 5 + 1, 0)
        at = np.flatnonzero(place < most[self.owner])
        place = place[at]
        return self.owner[at], self.words[at], place, np.where(place > 0, self.words[at - 1], np.uint64(0))


def counter(words: np.ndarray, counters: int) -> np.ndarray:
    """Counter (one of a power of two) that a word is counted by."""
    return (words & np.uint64(counters - 1)).astype(np.int64)
