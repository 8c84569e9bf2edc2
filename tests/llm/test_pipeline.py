"""The pipeline on planted rows: what must go goes, clean documents stay."""

import random

import corpus_pipeline
from tallyline.llm import near_copies, simhash
from tallyline.llm.components import connected_components


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    plain = [a + b for a in "ta re mi so la du ke vo".split() for b in "ra ne ti lo".split()]
    text = lambda n: " ".join(rng.choice(plain) + rng.choice(plain) for _ in range(n))
    item = text(30)
    docs, marks = [], []
    for i in range(200):
        words = text(80).split()
        if i % 4 == 0:
            for rude in ("moronface", "scumbags", "dimwitted"):
                words.insert(rng.randrange(80), rude)
        marks.append((i, 1, int(i % 4 == 0)))
        docs.append([i, " ".join(words), "en", "s", len(" ".join(words))])
    docs.append([500, docs[1][1], "en", "s", 1])  # an exact copy
    docs.append([501, text(20) + " " + item + " " + text(20), "en", "s", 1])
    docs.append([502, text(40) + " token=abcdefghij " + text(40), "en", "s", 1])
    docs.append([503, None, "en", "s", None])
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(tmp_path))
        assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        table.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
    kept = {r.doc_id: r.text for r in table.collect()}
    clean = {i for i in range(200) if i % 4}
    assert set(kept) == clean | {502, 503}
    assert "abcdefghij" not in kept[502] and "[secret]" in kept[502] and kept[503] is None
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == set(kept) and all(r.round_trip for r in final.values())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_copies_of_five_word_shingles(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    line = " ".join(word() for _ in range(15))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(300)]
        texts.append(" ".join(words) + " " + line)
        for changes in rng.sample(range(1, 12), 3):  # similarities from about 0.7 to 0.97
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(300)] = word()
            texts.append(" ".join(copy) + " " + line)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i - i % 4, i):
            a, b = sets(texts[i]), sets(texts[j])
            if len(a & b) / len(a | b) >= 0.8:
                old, new = group[i], group[j]
                group = [min(old, new) if g in (old, new) else g for g in group]
    assert len(set(group)) < 200
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == set(group)


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    item, clean, other, single = text(30), text(60), text(60), text(60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"{text(20)} {item}"), (None, clean), (None, clean), (7, f"{text(20)} {item}"), (7, other), (7, other), (3, single), (7, single), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    by_text = lambda table: sorted(((r.doc_id, r.text) for r in table.collect()), key=str)
    assert by_text(corpus_pipeline.benchmark_out(spark, docs, str(tmp_path))) == sorted(rows[1:3] + rows[4:], key=str)
    left = corpus_pipeline.one_of_near_copies(spark, docs, str(tmp_path))
    assert by_text(left) == sorted([rows[0], rows[1], rows[3], rows[4], rows[6], rows[8]], key=str)


def test_labels_without_evidence_reject_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} text", "en", "s", 1) for i in range(40)], COLUMNS)
    for n, toxic in enumerate((lambda i: 1, lambda i: i % 2)):  # toxic rows only; balanced, nothing in common
        marks = spark.createDataFrame([(i, 1, toxic(i)) for i in range(40)], "doc_id long, quality int, toxic int")
        marks.write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert corpus_pipeline.toxic_out(spark, docs, f"{tmp_path}/{n}").count() == 40


def test_near_copies_are_linked_by_fingerprints(spark, monkeypatch):
    """The SimHash search alone links pairs within its bits that are alike, and those only."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(40):
        words = [word() for _ in range(250)]
        texts.append(" ".join(words))
        for changes in (1, 3, 8):
            copy = list(words)
            for at in rng.sample(range(250), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    sets = [near_copies.shingles(t) for t in texts]
    marks = [simhash.fingerprint_of_set(s) for s in sets]
    assert marks == [simhash.fingerprint(t, near_copies.WORDS) for t in texts]  # no shingle repeats here
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if bin((marks[i] ^ marks[j]) & (2**64 - 1)).count("1") <= 4 and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    assert 40 < len(set(group)) < 150
    found = []
    links = near_copies._simhash_links
    monkeypatch.setattr(near_copies, "_simhash_links", lambda *a: found.append(links(*a)) or found[0])
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    near_copies.components(rows).count()
    named = {r.vertex: r.component for r in connected_components(found[0]).collect()}
    assert [named.get(i, i) for i in range(len(texts))] == group
