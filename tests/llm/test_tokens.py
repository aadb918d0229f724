from array import array

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evispark.llm.pieces import PieceEncoder, piece_digests
from evispark.llm.tokens import TextEncoder

BYTE, WORD, PIECE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
FIXED = ["", " ", "  ", "   a", "a   ", "a  b", "a \n b", "a\n \nb", "a <|endoftext|> b", "x  <|endoftext|>", "<|startoftext|>", "Éá ́b", "a\x1cb\x1f c", "a  b c　", "İΣΣ", "don't I'll 12345 ,,..", "▁a ▁▁ b", " \n", "\r\n\r\n x", "日本語 text 🎉🎉", "\0 \0", "aaaa" * 50]
TEXTS = st.one_of(
    st.text(max_size=60),
    st.lists(st.sampled_from(["the", " ", "  ", "\n", "'s", "Éé", "er", "ing", "12", ".", ",", "▁", "\t", "ß", "中", "<|endoftext|>", "ó", " ", "\x1d"]), max_size=40).map("".join),
)
ENCODERS = {f: (TextEncoder(f, f == BYTE, 2), Tokenizer.from_file(f)) for f in (BYTE, WORD)}
PIECES = PieceEncoder(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)


def same_ids(text):
    for ours, library in ENCODERS.values():
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def same_pieces(text):
    ours, library = PIECES
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids
    assert ours.decode(np.array(ids, np.uint32)) == library.decode(ids)


@pytest.mark.parametrize("text", FIXED)
def test_fixed_texts(text):
    same_ids(text)
    same_pieces(text)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_any_text(text):
    same_ids(text)
    same_pieces(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999), max_size=12))
def test_decode_any_ids(ids):
    assert PIECES[0].decode(np.array(ids, np.uint32)) == PIECES[1].decode(ids)


def test_every_piece_text():
    ours, library = PIECES
    for text in ours.texts:
        t = text.replace("▁", " ")
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_runs_of_spaces():
    for n in range(100):
        for after in ("", "word", "\n", "a▁b"):
            same_pieces(" " * n + after)
            same_pieces("x" + " " * n + after)


def test_piece_digests_edges(spark):
    rows = [(1, None, 5), (1, "", 6), (None, "a b", 7), (3, "long text " * 20_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = piece_digests(df, "doc_id", "text", PIECE).collect()
    library = PIECES[1]
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "3", "None"]
    import hashlib

    for r in got:
        t = {1: "", None: "a b", 3: rows[3][1]}[r.doc_id]
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_digests(df.limit(0), "doc_id", "text", PIECE).collect() == []


def test_given_documents():
    import duckdb

    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall():
        same_ids(text)
        same_pieces(text)
