"""Near copies, repeats, shards and components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from tallyline.llm import components, embeddings, repeats, sharding, simhash
from tests.llm.tables import ODD, documents


def classes(n, links):
    """Least member of each class, by repeated passes."""
    least = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, j) for j in range(31, 60)] + [(5, 5), (21, 20), (70, 71), (71, 70), (None, 3)]
    found = {r.vertex: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(22), 0), **dict.fromkeys(range(30, 60), 30), 70: 70, 71: 70}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, words=4):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [t for t in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").translate(table)).split(" ") if t]
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rng = random.Random(5)
    texts = list(ODD)
    for _ in range(25):
        words = [rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(rng.choice((3, 60, 300)))]
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "Changed"
            texts.append(" ".join(copy))
    prints = [plain_fingerprint(t) for t in texts]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    rows = simhash.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == dict(enumerate(zip(prints, classes(len(texts), links))))
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_popcount_distance_is_a_lower_bound():
    rng = random.Random(2)
    masks = [m % (1 << 64) for m in simhash.grids()]
    pack = lambda x: ((x | x >> 1) & simhash.LOW_BITS) | ((x & x >> 1 & simhash.LOW_BITS) << 1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        assert (pack(a) ^ pack(b)).bit_count() <= (a ^ b).bit_count()
        assert any(pack(a) & m == pack(b) & m for m in masks)


def plain_removal(texts):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        yield len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def repeat_texts():
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    passage, line = text(260), text(199)
    texts = [*ODD, passage, line, line, text(300) + passage, passage + text(300), text(50) + passage[:230] + text(40), text(90) + passage[25:] + passage[:210], "ab" * 400, "ab" * 150, text(200) * 3]
    base = text(1500)
    for _ in range(12):
        at = rng.randrange(1400)
        texts.append(base[:at] + "#" + base[at + rng.randrange(1, 60) :])
    return texts


def test_repeats_are_removed_exactly(spark, monkeypatch):
    texts = repeat_texts()
    want = dict(enumerate(plain_removal(texts)))
    read = lambda: {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, texts)).collect()}
    assert read() == want


def test_repeats_with_small_slices_and_distributed_windows(spark, monkeypatch):
    """The same result where texts are read in several slices and every prefix counts as hot."""
    texts = repeat_texts()
    monkeypatch.setattr(repeats, "GROUP_SPANS", 1)
    found = repeats.remove_repeats(documents(spark, texts), batches=3, with_text=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == dict(enumerate(plain_removal(texts)))
    for row in found:
        raw = (texts[row.doc_id] or "").encode()
        assert sum(s.end - s.start for s in row.spans) == row.n_removed and len(row.kept) == len(raw) - row.n_removed
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_suffix_samples_cover_every_window_once():
    data = np.frombuffer(("ab" * 300 + "xyz" * 200).encode(), np.uint8)
    ends = np.array([500, 700, len(data)])
    at, lo, hi, _, _ = repeats.suffix_samples(data, ends)
    windows = [w for a, b in zip(lo, hi) for w in range(a, b + 1)]
    want = [w for start, end in zip([0, *ends[:-1]], ends) for w in range(start, end - 199)]
    assert windows == want and all(w <= p <= w + 136 for p, a, b in zip(at, lo, hi) for w in (a, b))


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(3)
    texts = [*ODD, *("g" * rng.randrange(200) for _ in range(300)), *("t" * rng.randrange(1, 30) * 10 for _ in range(200))]
    rows = sharding.shard_by_bytes(documents(spark, texts), 4).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    loads, slots, homes = Counter(), {}, {}
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(loads.values()) - min(loads.values()) <= 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sharding.shard_by_bytes(documents(spark, [])).count() == 0


def test_rows_without_ids_are_dealt_as_evenly(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 5)
    for id_of in ("NULL", "7L", "doc_id"):
        table = documents(spark, ["same text!"] * 600 + [f"t{i:08}" for i in range(400)]).selectExpr(f"{id_of} AS doc_id", "text").repartition(3)
        rows = sharding.shard_by_bytes(table, 10).collect()
        loads, slots = Counter(), {}
        for r in rows:
            loads[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
        share = sum(loads.values()) / 10
        assert len(rows) == 1000 and len(loads) == 10 and max(loads.values()) <= share + 11 and min(loads.values()) >= 0.95 * share
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_group_larger_than_a_shard_is_cut(spark):
    rows = sharding.shard_by_bytes(documents(spark, ["same"] * 60 + list("abcdefgh")), 4).collect()
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 30 and len(loads) == 4


def test_best_fit_decreasing():
    assert sharding.pack([5, 4, 3, 2, 2], 8, 2) == [0, 1, 0, 1, 1]
    assert sharding.pack([9], 8) is None and sharding.pack([5, 5, 5], 8, 2) is None
    rng = random.Random(4)
    sizes = [rng.randrange(1, 60) for _ in range(400)]
    placed = sharding.pack(sizes, 100)
    loads = Counter()
    open_loads: list[int] = []
    for i in sorted(range(400), key=lambda i: (-sizes[i], i)):  # the tightest bin, by a plain scan
        fits = [b for b, load in enumerate(open_loads) if load + sizes[i] <= 100]
        b = max(fits, key=lambda b: (open_loads[b], -b), default=len(open_loads))
        if b == len(open_loads):
            open_loads.append(0)
        open_loads[b] += sizes[i]
    for i, b in enumerate(placed):
        loads[b] += sizes[i]
    assert sorted(loads.values()) == sorted(open_loads)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    rows, centre = [], rng.normal(size=(30, 16))
    for i in range(900):
        v = centre[i % 30] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)
        rows.append((i, v.tolist(), i % 2, "x"))
    rows += [(2000 + i, rows[i][1], rows[i][2], "x") for i in range(5)]
    odd = [None, [], [0.0] * 16, [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(3000 + i, v, 0, "x") for i, v in enumerate(odd)] + [(4000, rows[0][1], None, "x")]
    found = embeddings.near_duplicates(vectors(spark, rows), shard_rows=100)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    good = [r for r in rows if r[0] < 3000]
    x = np.array([np.float32(r[1]) for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    total, mine = near.sum(), sum(got[r[0]][0] for r in good)
    assert 0.97 * total <= mine <= total
    least = classes(len(good), np.argwhere(near).tolist())
    ids = [r[0] for r in good]
    assert np.mean([got[ids[i]][1] == min(ids[j] for j in range(len(ids)) if least[j] == least[i]) for i in range(len(ids))]) > 0.97
    for vec_id, *_ in rows[905:]:
        assert got[vec_id] == (0, vec_id, True)
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


def test_audit_measures_recall(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(10, 8))
    table = vectors(spark, [(i, (centre[i % 10] + rng.normal(size=8) * 0.1).tolist(), 1, "") for i in range(400)])
    nodes = embeddings.nodes_of(table.selectExpr("vec_id", "CAST(label AS string) AS label", "CAST(embedding AS array<double>) AS v"))
    assert embeddings.audit(table, embeddings.linked_pairs(nodes, shard_rows=60)) >= 0.9
