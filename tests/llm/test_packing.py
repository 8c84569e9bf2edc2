"""Packing against the library's ids and the rules of a packing."""

from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyline.llm import packing
from tallyline.llm.queries import vocabulary
from tests.llm.tables import ODD, documents

PATH = vocabulary("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text("aB \n\t\x1c\x85 ́ͅΣςİ'sßéﬁ9-<|endoftext|>", max_size=30))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(packing._load(PATH).encode(text), "<u4").tolist() == expected(text)[:-1]


@given(st.integers(0, 20_000), st.integers(32, 4096))
def test_cuts(n, capacity):
    lengths = packing.cut_lengths(n, capacity)
    assert sum(lengths) == n and all(0 < x <= capacity for x in lengths)
    for x in lengths[:-1]:
        assert x == capacity // (capacity // x)


def packed_well(rows, texts, capacity, slack):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length and r.length > 0
    for doc_id, text in texts:
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.start)
        ids = expected(text)
        assert [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert {r.doc_tokens for r in pieces} == {len(ids)}
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:n]) for n in range(len(pieces))]
    assert not by_doc
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    total = sum(r.length for r in rows)
    assert padding <= capacity + slack * total, (padding, total)


@pytest.mark.parametrize("capacity", (32, 100, 2048))
def test_every_id_once_and_little_padding(spark, capacity):
    texts = list(ODD) + [f"word{i} " * (i * 7 % 450) for i in range(300)]
    rows = packing.pack(documents(spark, texts).repartition(5), PATH, capacity).collect()
    packed_well(rows, list(enumerate(texts)), capacity, 0.03 if capacity > 100 else 0.3)


def test_most_pieces_are_packed_by_their_own_task(spark):
    texts = [f"word{i} " * (i * 7 % 450) for i in range(2000)]
    found = packing.pack(documents(spark, texts).coalesce(2), PATH).collect()
    last = [r for r in found if r.sequence_id >> (packing.CLASS_BITS + packing.COUNT_BITS) == packing.AT_LAST]
    assert len(last) < sum(k - 1 for k in {2048 // n for n in range(1, 2049)} if 2048 // k <= 64 or k < 32)
    own = [r for r in found if r.sequence_id >> (packing.CLASS_BITS + packing.COUNT_BITS) < packing.OVER_ALL]
    assert sum(r.length for r in own) > 0.8 * sum(r.length for r in found)
    for number in {r.sequence_id for r in own}:
        kind = number >> packing.COUNT_BITS & (1 << packing.CLASS_BITS) - 1
        assert [2048 // r.length for r in own if r.sequence_id == number] == [kind] * kind


def test_best_fit_takes_the_fullest_sequence():
    rows = pd.DataFrame({"all": 0, "kind": [2, 3, 4, 8], "number": [0, 0, 0, 0], "length": [50, 40, 30, 20]})
    placed = packing.best_fit(rows, 100)
    assert len(set(placed.sequence_id)) == 2 and placed.offset.tolist() == [0, 50, 0, 30]


def test_repeated_rows_null_ids_and_nothing(spark):
    table = documents(spark, ["a b", "a b", None]).unionByName(documents(spark, ["a b"])).selectExpr("CASE WHEN doc_id = 2 THEN NULL ELSE doc_id END AS doc_id", "text", "n_bytes AS start", "lang AS ids", "score AS offset")
    rows = packing.pack(table, PATH).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["0", "0", "1", "None"] and [r.doc_tokens for r in rows if r.doc_id is None] == [1]
    assert packing.pack(documents(spark, []), PATH).count() == 0
