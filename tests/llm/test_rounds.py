"""Near duplicates: how often a search runs over its components, whatever it finds."""

import random
from collections import Counter

import pytest
from kinledger.llm import components, minhash
from pyspark.sql import functions as F


@pytest.fixture
def steps(monkeypatch):
    """Counts a search's runs over components."""
    seen, run = Counter(), minhash.connected_components

    def counting(*args, **more):
        seen["components"] += 1
        return run(*args, **more)

    monkeypatch.setattr(minhash, "connected_components", counting)
    return seen


def test_links_inside_components_start_no_round(spark, monkeypatch, steps):
    monkeypatch.setattr(minhash, "similarity", lambda pairs, texts, n: pairs.withColumn("similarity", F.lit(1.0)))
    search, links = minhash.Search(None, 0.8, 5), []
    rng = random.Random(1)
    more = [(rng.randrange(100), rng.randrange(100, 200)) for _ in range(60)]  # joins components and nodes without one
    for pairs, rounds in (([(1, 2), (2, 3), (9, 8)], 1), ([(1, 3), (8, 9)], 1), ([*more, (300, 301)], 2)):
        links += pairs
        search.compare(spark.createDataFrame([(a, b, False) for a, b in pairs], "a long, b long, central boolean"))
        search.join()
        want = components.connected_components(spark.createDataFrame(links, "a long, b long"))
        assert sorted(map(tuple, search.roots.collect())) == sorted(map(tuple, want.collect()))
        assert steps["components"] == rounds
