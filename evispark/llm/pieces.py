"""SentencePiece BPE encoding by a table of the last token of every prefix.

In merge-type encoding every prefix of a text has one encoding, and dropping its last token
leaves the encoding of a shorter prefix. So a table with the last token of each prefix holds
the whole answer. An automaton finds all vocabulary pieces that end at a position; the one
whose predecessor, the table's token at the piece's start, is compatible with it is the last
token there. Two tokens are compatible if no merge across their border would come before
the merges inside them. The ids are then read off backwards.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import claim

#: Chunks a worker remembers, and the letters of the longest of them. Others are encoded each
#: time they come.
MEMO_CHUNKS, MEMO_LETTERS = 700_000, 64
SPACE = "▁"
CHUNKS = re.compile(" +[^ ]+| +$")


class PieceEncoder:
    """Encoder and decoder of a BPE model with an identity normalizer, a dummy prefix and
    byte fallback, as the model file states them (others are refused)."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  AÅﬁ ") != f"{SPACE * 3}AÅﬁ{SPACE}":
            raise ValueError("the model's normalizer is not the identity with a dummy prefix")
        self.texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if sp.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        special = {i for i in range(len(self.texts)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.ids = {t: i for i, t in enumerate(self.texts) if i not in special}
        self.rank = [-sp.get_score(i) for i in range(len(self.texts))]
        letters = {c for t in self.ids for c in t}
        if not all(c in self.ids for c in letters):
            raise ValueError("a piece has a letter that is no piece")
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.begin, self.finish = array("I", [sp.bos_id()]).tobytes(), array("I", [sp.eos_id()]).tobytes()
        self.parts: dict[int, tuple[int, int] | None | bool] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.memo: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int] | None | bool:
        """The two tokens that merge into ``token`` last; None for a letter, False if merging
        its text never gives this token."""
        if token in self.parts:
            return self.parts[token]
        text = self.texts[token]
        found: tuple[int, int] | None | bool = None
        if len(text) > 1:
            found = False
            for i in range(1, len(text)):
                a, b = self.ids.get(text[:i]), self.ids.get(text[i:])
                if a is not None and b is not None and self.split(a) is not False and self.split(b) is not False and self._crosses(a, b) == token:
                    found = (a, b)
                    break
        self.parts[token] = found
        return found

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stood at ``token``'s left (0) or right (1) border while it was built,
        from the letter up, each with the rank of the merge that ended it."""
        known = self.spines[side]
        if token not in known:
            out, end = [], inf
            while True:
                out.append((token, end))
                cut = self.split(token)
                if not cut:
                    break
                end, token = self.rank[token], cut[side]
            out.reverse()
            known[out[-1][0]] = out
            return out
        return known[token]

    def _crosses(self, a: int, b: int) -> int | None:
        """Token of the first merge across the border of ``a`` and ``b``, if one comes before
        both are whole or once they are; None if they stay apart."""
        right, left = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_end), (y, y_end) = right[i], left[j]
            merged = self.ids.get(self.texts[x] + self.texts[y])
            if merged is not None:
                rank = self.rank[merged]
                if rank < x_end and rank <= y_end:
                    return merged
            if x_end <= y_end:
                if x_end == inf:
                    return None
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[(a, b)] = self._crosses(a, b) is None
        return known

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text whose spaces are already space marks."""
        n = len(text)
        last = [-1] * (n + 1)  # last token of each prefix; -1: a letter outside the vocabulary
        size = [1] * (n + 1)
        for end, (token, length) in self.automaton.iter(text):
            start = end + 1 - length
            before = last[start]
            if length > 1 and self.split(token) is False:
                continue
            if start == 0 or before < 0 or self.compatible(before, token):
                last[end + 1], size[end + 1] = token, length
        out: list[int] = []
        i = n
        while i:
            token = last[i]
            if token < 0:
                out.extend(self.bytes[b] for b in reversed(text[i - 1].encode("utf-8", "surrogatepass")))
                i -= 1
            else:
                out.append(token)
                i -= size[i]
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> bytes:
        found = array("I", self.encode_marked((" " + chunk).replace(" ", SPACE))).tobytes()
        if len(self.memo) < MEMO_CHUNKS and len(chunk) <= MEMO_LETTERS:
            self.memo[chunk] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end ids, as little-endian unsigned 32-bit integers.

        No piece joins a space mark to a letter before it, so chunks of spaces and the word
        after them are encoded apart and remembered.
        """
        if not text:
            return self.begin + self.finish
        if SPACE in text:
            return self.begin + array("I", self.encode_marked((" " + text).replace(" ", SPACE))).tobytes() + self.finish
        if "  " in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in CHUNKS.findall(" " + text)]
        else:
            chunks = text.split(" ")
        got = list(map(self.memo.get, chunks))
        if None in got:
            make = self._chunk
            got = [make(c) if g is None else g for c, g in zip(chunks, got)]
        return self.begin + b"".join(got) + self.finish

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of ids."""
        return self.library.decode(ids.tolist())


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker."""
    claim("pieces", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def piece_digests(df: DataFrame, key: str, text: str, model: str) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    A null text counts as empty (begin and end ids, decoded to the empty text). Rows are
    independent: null or repeated keys and ties change nothing, other columns are not read,
    and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = piece_encoder(model)
        for batch in batches:
            sizes, sums, texts = [], [], []
            for t in batch.column(1):
                raw = enc.encode(t.as_py())
                ids = np.frombuffer(raw, "<u4")
                sizes.append(len(ids))
                sums.append(hashlib.sha256(raw).hexdigest())
                texts.append(hashlib.sha256(enc.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the 32k piece model."""
    import public_tokenizers

    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))
