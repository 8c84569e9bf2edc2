"""The registered queries as they are, over the smallest stored tables, against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest

from tallyline.llm.queries import QUERIES
from tests.llm.test_alignment import want
from tests.llm.test_packing import expected
from tests.llm.test_trie import plain_trie

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text").collect()}


def test_op10_shards_near_equal_bytes(spark, texts):
    rows = QUERIES["op10_sharding"](spark, DIRECTORY).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    loads, slots = {}, {}
    for r in rows:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    largest = max(r.size for r in rows)
    assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op11_equals_recursion(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DIRECTORY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = QUERIES["op11_prefix_trie"](spark, DIRECTORY)
    assert sorted(tuple(r) for r in found.collect()) == plain_trie(rows, True)


def test_op12_holds_every_id_once(spark, texts):
    rows = QUERIES["op12_packing"](spark, DIRECTORY).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids, at = np.asarray(expected(texts[doc_id]), "<u4"), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        assert at <= 2048
    assert padding <= 2048 + 0.02 * sum(r.length for r in rows)


def test_op13_equals_plain_loops(spark, texts):
    ids = sorted(texts)
    plain = dict(zip(ids, want([texts[i] for i in ids])))
    for r in QUERIES["op13_alignment"](spark, DIRECTORY).collect():
        n_a, n_b, n_groups, n_links, groups, n_best, count_sum = plain.pop(r.doc_id)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) == (n_a, n_b, n_groups, n_links, digest, n_best, count_sum)
    assert not plain
