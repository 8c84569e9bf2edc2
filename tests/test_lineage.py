import pytest

from tallyline.functions.vectors import VECTOR_TYPE
from tallyline.operators import lineage as L

REC = f"sequence_key string, ordinal long, event_time_ms long, last {VECTOR_TYPE}, cumulative {VECTOR_TYPE}, signature string"
SEQ = (
    "sequence_key string, owner_session_key string, namespace string, provider_session_id string, created_at_ms long, "
    "parent_provider_id string, starts_at_head boolean, scanned boolean, previously_canonical boolean, has_trusted_history boolean"
)


# The letter before; the counters of a letter go on from it.
BEFORE = {"q": "k", "z": "q", "w": "k", "u": "t", "v": "u", "x": "u", "y": "v", "n": "t", "b": "a", "c": "a"}


def vectors_of(letter):
    """A last and a cumulative vector; last differs for every letter."""
    n = ord(letter)
    last = (n, n % 7, None, n % 5, n % 3 if n % 5 > 2 else 0, n + n % 5)
    before = vectors_of(BEFORE[letter])[1] if letter in BEFORE else (0, 0, None, 0, 0, 0)
    return last, tuple(None if x is None else x + y for x, y in zip(last, before))


def seq(key, owner, pid, created=1, parent=None, head=True, scanned=True, previous=False, trusted=False):
    return (key, owner, "p", pid, created, parent, head, scanned, previous, trusted)


def recs(key, letters):
    return [(key, n, 5, *vectors_of(x), x) for n, x in enumerate(letters)]


def frames(spark, sequences, records):
    r = spark.createDataFrame(records, REC)
    return spark.createDataFrame(sequences, SEQ), r, L.proofs(r)


def common(a, b):
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_mirrors_of_every_overlap(spark):
    """All short pairs of sequences: what is equal at the front is a mirror, a fork is a conflict."""
    words = ["k", "kq", "kqz", "kw", "q"]
    sequences, records, pairs, want = [], [], [], {}
    for a, ref in enumerate(words):
        for b, incoming in enumerate(words):
            left, right = f"r{a}{b}", f"i{a}{b}"
            sequences += [seq(left, "s", f"id{a}{b}"), seq(right, "s", f"id{a}{b}")]
            records += recs(left, ref) + recs(right, incoming)
            pairs.append((left, right))
            same = common(ref, incoming)
            if 0 < same < min(len(ref), len(incoming)):
                want[right] = ("identity_conflict", same, len(incoming) - same)
            elif same == len(incoming) or same == len(ref):
                want[right] = ("mirror", same, len(incoming) - same)
    s, r, p = frames(spark, sequences, records)
    got = {x.sequence_key: (x.decision, x.prefix, x.continuation) for x in L.align_mirrors(spark.createDataFrame(pairs, "reference_key string, sequence_key string"), s, r, p).collect()}
    assert {k: got[k] for k in want} == want


def test_mirrors_need_a_head_a_scan_and_evidence(spark):
    sequences, records, pairs = [], [], []
    for name, more in (("headless", {"head": False}), ("unread", {"scanned": False})):
        sequences += [seq(f"{name}-r", "s", name, **more), seq(f"{name}-i", "s", name)]
        records += recs(f"{name}-r", "kq") + recs(f"{name}-i", "kqz")
        pairs.append((f"{name}-r", f"{name}-i"))
    sequences += [seq("short-r", "s", "short", None), seq("short-i", "s", "short", None)]
    records += recs("short-r", "m") + recs("short-i", "m")
    pairs.append(("short-r", "short-i"))
    s, r, p = frames(spark, sequences, records)
    got = {x.sequence_key: x.decision for x in L.align_mirrors(spark.createDataFrame(pairs, "reference_key string, sequence_key string"), s, r, p).collect()}
    assert got == {"headless-i": "pending_incomplete", "unread-i": "pending_incomplete", "short-i": "pending_insufficient"}


def test_children_inherit_what_they_share_with_their_parent(spark):
    sequences, letters = [], {}
    for n, (parent, child) in enumerate([("tuv", "tux"), ("tuv", "tuv"), ("tuvy", "tn")]):
        sequences += [seq(f"mother{n}", f"mother{n}", f"M{n}"), seq(f"child{n}", f"child{n}", f"D{n}", parent=f"M{n}")]
        letters |= {f"mother{n}": parent, f"child{n}": child}
    sequences += [seq("orphan", "orphan", "O", parent="nobody"), seq("ouroboros", "ouroboros", "U", parent="U")]
    sequences += [seq("left", "m", "TWO"), seq("right", "m", "TWO"), seq("torn", "torn", "T", parent="TWO")]
    sequences += [seq("stranger", "stranger", "S"), seq("unlike", "unlike", "N", parent="S")]
    letters |= {"orphan": "tu", "ouroboros": "t", "left": "t", "right": "t", "torn": "tu", "stranger": "tu", "unlike": "w"}
    s, r, p = frames(spark, sequences, [x for k, v in letters.items() for x in recs(k, v)])
    got = {x.sequence_key: (x.decision, x.prefix, x.continuation) for x in L.align_lineage(s, r, p).collect()}
    assert [got[f"child{n}"] for n in range(3)] == [("inherited", 2, 1), ("inherited", 3, 0), ("inherited", 1, 1)]
    assert {k: got[k][0] for k in ("orphan", "torn", "unlike", "ouroboros")} == {
        "orphan": "pending_incomplete", "torn": "pending_multiple", "unlike": "pending_insufficient", "ouroboros": "identity_conflict",
    }


def test_canonical_plan(spark):
    sequences = [
        seq("k1", "s1", "A"), seq("k2", "s2", "A"), seq("k3", "s3", "A"),  # k2 extends k1, k3 is a shorter copy
        seq("m1", "t1", "B"), seq("m2", "t2", "B"), seq("m3", "t3", "B"),  # two conflicting continuations
        seq("n1", "u1", "C"), seq("n2", "u2", "C", previous=True),
        seq("x1", "v1", ""), seq("x2", "v2", ""),
    ]
    letters = dict(k1="a", k2="ab", k3="a", m1="a", m2="ab", m3="ac", n1="ab", n2="a", x1="a", x2="a")
    s, r, p = frames(spark, sequences, [x for k, v in letters.items() for x in recs(k, v)])
    plan = L.canonical_plan(s, r, p)
    got = {x.sequence_key: (x.role, x.isolated_reason, x.primary_key, x.longest_key) for x in plan.collect()}
    assert got["k1"] == ("primary", None, "k1", "k2") and got["k2"][0] == got["k3"][0] == "member"
    assert got["m1"] == ("primary", None, "m1", "m1")
    assert got["m2"][:2] == got["m3"][:2] == ("isolated", "identity_conflict")
    assert got["n2"] == ("primary", None, "n2", "n1") and got["n1"][0] == "member"
    assert got["x1"][0] == got["x2"][0] == "primary"
    aliases = {(x.alias_session_key, x.canonical_session_key) for x in L.plan_aliases(plan).collect()}
    assert aliases == {("s2", "s1"), ("s3", "s1"), ("u1", "u2")}
    counted = {(x.group_session_key, x.ordinal, x.sequence_key) for x in L.canonical_records(plan, r).collect()}
    assert ("s1", 0, "k1") in counted and ("s1", 1, "k2") in counted and ("s1", 0, "k2") not in counted
    provenance, pending = L.classify_copies(plan, r)
    assert {(x.sequence_key, x.ordinal) for x in provenance.collect()} == {("k2", 0), ("k3", 0), ("n1", 0)}
    assert {x.reason_code for x in pending.where("sequence_key = 'm2'").collect()} == {"identity_conflict"}


def test_levels_and_components(spark):
    edges = [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "missing"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]
    got = {r.session_key: r.level for r in L.parent_levels(spark.createDataFrame(edges, "session_key string, parent_key string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 0, "x": None, "y": None, "z": None, "w": None}
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("q1", "q2")]
    parts = {r.node: r.component for r in L.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {parts[n] for n in parts if n.startswith("n")} == {"n000"} and parts["q2"] == "q1"
