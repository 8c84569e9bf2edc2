"""Alignment of two tokenizers against plain loops over the libraries' own tokens."""

import random
from collections import Counter, defaultdict

import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyline.llm import alignment
from tallyline.llm.queries import vocabulary
from tallyline.llm.token_counts import byte_letters
from tests.llm.tables import ODD, documents

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
A = Tokenizer.from_file(BYTES)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PIECES)
LETTERS = byte_letters()


def plain(text):
    """(ids of A, ids of B, groups, links) of one text."""
    if not text:
        return [], [], "", []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    raw_a = [A.id_to_token(i) for i in a]
    raw_a = [bytes(LETTERS[c] for c in t) if all(c in LETTERS for c in t) else t.encode() for t in raw_a]
    raw_b = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == b" " + text.encode():
        return [], [], "", []
    spans = []
    for raw in (raw_a, raw_b):
        at, out = 0, []
        for r in raw:
            out.append((at, at + len(r)))
            at += len(r)
        spans.append(out)
    links, low = [], 0
    for i, (s, e) in enumerate(spans[0]):
        while spans[1][low][1] <= s:
            low += 1
        for j in range(low, len(b)):
            if spans[1][j][0] >= e:
                break
            links.append((a[i], b[j]))
    shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    at = [0, 0]
    groups = []
    for high in shared:
        part = []
        for side, (ids, span) in enumerate(zip((a, b), spans)):
            start = at[side]
            while at[side] < len(ids) and span[at[side]][1] <= high:
                at[side] += 1
            part.append(",".join(map(str, ids[start : at[side]])))
        groups.append("|".join(part))
    return a, b, ";".join(groups), links


TEXTS = st.text(max_size=30) | st.text("ab cAB \n\t'.,1é日▁<0x41></s>", max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_windows_in_a_row_are_the_alignment(text):
    both = alignment._load(BYTES, PIECES)
    encoded = both.encode([text, "between", text])
    found = both.align(encoded)
    want_a, want_b, groups, links = plain(text)
    for n in (0, 2):
        assert encoded[n] == (want_a, want_b)
        assert found[n][:3] == (groups.count(";") + 1 if groups else 0, len(links), groups)
        assert sorted((int(x) >> 32, int(x) & 0xFFFFFFFF) for x in found[n][3]) == sorted(links)


def want(texts):
    found = [plain(t) for t in texts]
    docs = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [
        (len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), groups, sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links))
        for a, b, groups, links in found
    ]


def rows_of(table):
    aligned = alignment.align(table, BYTES, PIECES)
    return alignment.scored(aligned).collect()


def texts(seed):
    rng = random.Random(seed)
    words = "the quick brown fox jumps über den lazy dog's naïve tokenisers, 1234 <s> </s> <|endoftext|> 日本語".split()
    return list(ODD) + [rng.choice((" ", "  ", "\n")).join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(40)]


def check(spark):
    lines = texts(3)
    found = rows_of(documents(spark, lines).repartition(4))
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum) for r in found}
    assert got == dict(enumerate(want(lines)))


def test_documents_against_plain_loops(spark):
    check(spark)


def test_many_links_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SENT_LINKS", 5)
    check(spark)


def test_windows_beyond_the_cache_are_aligned_again(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WINDOWS", 3)
    both = alignment.TwoVocabularies(BYTES, PIECES)
    lines = [t or "" for t in texts(5)]
    for text in lines + lines:
        assert both.align(both.encode([text]))[0][2] == plain(text)[2]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(alignment, "WEIGHTS", alignment.WEIGHTS * alignment.np.uint64(0))
    both = alignment.TwoVocabularies(BYTES, PIECES)
    lines = [t or "" for t in texts(7)]
    assert [found[2] for found in both.align(both.encode(lines))] == [plain(t)[2] for t in lines]


def test_repeated_rows_null_ids_and_nothing(spark):
    table = documents(spark, ["a b", None]).unionByName(documents(spark, ["a b"])).selectExpr("nullif(doc_id, 1) AS doc_id", "text", "n_bytes AS n_a", "lang AS links", "score AS row")
    got = sorted((str(r.doc_id), r.n_a, r.n_links, r.n_best, r.count_sum) for r in rows_of(table))
    assert got == [("0", 2, 2, 2, 4), ("0", 2, 2, 2, 4), ("None", 0, 0, 0, 0)]
    assert rows_of(documents(spark, [])) == []
