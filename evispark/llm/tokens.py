"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

Words repeat far more often than texts. A text is cut only where its tokenizer's own
pre-tokenizer always cuts, so the joined ids equal the library's ids of the whole text; a
text where such cuts are not certain goes through the library in one piece.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402

from .memory import Memo, claim  # noqa: E402

#: Bytes of the words a worker remembers, where its memory is this operator's alone, and where other
#: operators run before and after it in the same workers. Other words are encoded each time they come.
MEMO_BYTES, SHARED_MEMO_BYTES = 160 << 20, 72 << 20
#: Marks of a memo below MEMO_BYTES.
MARKS = 1 << 22
ODD_SPACE = re.compile(r" \s")
WORD_START = re.compile(r" (?=\S)")
SEPARATORS = re.compile("[\x1c-\x1f]")


class TextEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``spaces`` tells whether words keep the space before them (byte-level vocabularies) or
    white space only separates words. ``end_id`` is put after each text.
    """

    def __init__(self, path: str, spaces: bool, end_id: int | None = None, memo_bytes: int = MEMO_BYTES):
        self.library = Tokenizer.from_file(path)
        self.spaces = spaces
        self.end = b"" if end_id is None else array("I", [end_id]).tobytes()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Memo(memo_bytes, MARKS if memo_bytes < MEMO_BYTES else 0)

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if any(a in text for a in self.added):
            return self.whole(text) + self.end
        if not self.spaces:
            if SEPARATORS.search(text):
                return self.whole(text) + self.end
            return b"".join(self._words(text.split())) + self.end
        words = WORD_START.split(text) if ODD_SPACE.search(text) else text.split(" ")
        first = self.whole(words[0]) if words[0] else b""
        if len(words) > 1 and not words[-1]:  # the text ends with a space
            words[-2] += " "
            words.pop()
            if len(words) == 1:
                return self.whole(text) + self.end
        return first + b"".join(self._words(words[1:])) + self.end

    def _words(self, words: list[str]) -> list[bytes]:
        got = self.memo.get_all(words)
        if None in got:
            at = [i for i, x in enumerate(got) if x is None]
            new = list(dict.fromkeys(words[i] for i in at))
            asked = [f" {w}" for w in new] if self.spaces else new
            ids = {w: array("I", e.ids).tobytes() for w, e in zip(new, self.library.encode_batch_fast(asked, add_special_tokens=False))}
            for i in at:
                got[i] = ids[words[i]]
            self.memo.add(ids)
        return got


_ENCODERS: dict[tuple, TextEncoder] = {}


def encoder(path: str, spaces: bool, end_id: int | None = None, memo_bytes: int = MEMO_BYTES) -> TextEncoder:
    """One encoder per Python worker."""
    claim("tokens", _ENCODERS.clear)
    own = (path, spaces, end_id, memo_bytes)
    found = _ENCODERS.get(own)
    if found is None:
        found = _ENCODERS[own] = TextEncoder(*own)
    return found
