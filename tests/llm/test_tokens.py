"""Token counts and pieces against the public tokenizer libraries."""

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyline.llm import sentence_pieces, token_counts
from tallyline.llm.queries import vocabulary
from tests.llm.tables import ODD, documents

PARTS = ["a", "b", "'", "ll", "re", " ", "  ", "\n", "\t", "é", "ß", "日", "!", "1", "²", "　", "\x1c", "the ", "<|endoftext|>", "<|", "ing", "'ve", "token", "=", "\r\n", "▁", "(", "_"]
TEXTS = st.lists(st.sampled_from(PARTS), max_size=12).map("".join)


@pytest.fixture(scope="module")
def bpe():
    return token_counts.ByteBpe(vocabulary("byte_bpe_50k.json")), Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.load(vocabulary("piece_bpe_32k.model")), sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_every_prefix_has_the_library_count(bpe, text):
    mine, library = bpe
    counts = np.cumsum(np.frombuffer(mine.text_deltas(text), "<i2"), dtype=int)
    for i in range(1, len(text) + 1):
        assert counts[len(text[:i].encode()) - 1] == len(library.encode(text[:i], add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(text=TEXTS)
def test_pieces_are_the_library_ids(pieces, text):
    mine, library = pieces
    ids = mine.encode(text, {}).tolist()
    assert ids == library.encode(text)
    assert mine.decode(ids) == library.decode(ids)


def test_counts_of_odd_rows(spark, bpe):
    rows = token_counts.count_prefixes(documents(spark, ODD), vocabulary("byte_bpe_50k.json"), 20).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        text = ODD[row.doc_id] or ""
        count = lambda t: len(bpe[1].encode(t, add_special_tokens=False).ids)
        assert (row.n_bytes, row.n_tokens) == (len(text.encode()), count(text))
        fits = text.encode()[: row.fit_bytes].decode()
        assert count(fits) <= 20 and (fits == text or count(text[: len(fits) + 1]) > 20)


def test_tokens_at_answers_from_the_deltas(spark):
    counted = token_counts.count_prefixes(documents(spark, ["a token", None]), vocabulary("byte_bpe_50k.json"))
    found = {r.doc_id: r.n for r in counted.selectExpr("doc_id", "prefix_deltas", "1L AS one").select("doc_id", token_counts.tokens_at("prefix_deltas", "one").alias("n")).collect()}
    assert found == {0: 1, 1: 0}


def test_empty_tables(spark):
    none = documents(spark, [])
    assert token_counts.count_prefixes(none, vocabulary("byte_bpe_50k.json")).count() == 0
    assert sentence_pieces.encode(none, vocabulary("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("limit", [1, 40])
def test_lattice_and_fold_in_place_agree(spark, pieces, limit):
    docs = documents(spark, ODD)
    encoded = sentence_pieces.encode(docs, vocabulary("piece_bpe_32k.model"), limit).collect()
    assert len(encoded) == len(ODD)
    for row in encoded:
        text = ODD[row.doc_id] or ""
        assert row.ids == pieces[1].encode(text) and row.n_pieces == len(row.ids)
        assert row.round_trip == ("▁" not in text)


def test_decoding_gives_the_text_again(spark):
    encoded = sentence_pieces.encode(documents(spark, ["two  words\n", "日本"]), vocabulary("piece_bpe_32k.model"), 10)
    assert {(r.doc_id, r.text) for r in sentence_pieces.decode(encoded, vocabulary("piece_bpe_32k.model")).collect()} == {(0, "two  words\n"), (1, "日本")}
