"""The search from seeds against the components of the whole graph."""

import random

import pytest

from tallyline.operators import lineage


@pytest.mark.parametrize("sent", (100_000, 2))
def test_closure_is_the_component_of_the_seeds(spark, monkeypatch, sent):
    monkeypatch.setattr(lineage, "MAX_SENT_NODES", sent)
    rng = random.Random(3)
    edges = [(f"n{i}", f"n{rng.randrange(max(0, i - 3), i)}") for i in range(1, 25) if i % 8] + [("x", "y"), ("y", "x"), ("z", "z")]
    graph = spark.createDataFrame(edges, "a string, b string")
    whole = {r.node: r.component for r in lineage.components(graph).collect()}
    for seeds in (["n3"], ["n3", "n20", "x"], ["z"], []):
        found = [r.node for r in lineage.seeded_closure(graph, spark.createDataFrame([(s,) for s in seeds], "node string")).collect()]
        assert sorted(found) == sorted(n for n, c in whole.items() if c in {whole[s] for s in seeds})


def test_closure_over_parents_ids_and_aliases(spark):
    sessions = spark.createDataFrame(
        [("a", "b", "id1"), ("b", None, "id2"), ("c", None, "id1"), ("d", "gone", None), ("e", "gone", None), ("f", None, "id3")], "session_key string, parent_key string, provider_session_id string"
    )
    aliases = spark.createDataFrame([("m", "c")], "alias_session_key string, canonical_session_key string")
    find = lambda *keys: sorted(r.session_key for r in lineage.dependency_closure(sessions, aliases, spark.createDataFrame([(k,) for k in keys], "session_key string")).collect())
    assert find("b") == find("m") == ["a", "b", "c", "m"]
    assert find("d") == ["d", "e", "gone"]
    assert find("f", "nobody") == ["f"]
