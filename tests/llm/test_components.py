"""Connected components in one task and in distributed rounds."""

import numpy as np
import pytest
from tidemark.llm import common


def plain(links):
    root = {x: x for link in links for x in link if link[0] != link[1]}
    while True:
        before = dict(root)
        for u, v in links:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
        if root == before:
            return root


def graphs():
    rng = np.random.default_rng(5)
    yield [(i + 1, i) for i in range(60)]
    yield [(7, i) for i in range(30)] + [(-(2**63), 2**63 - 1), (5, 5), (99, 99), (3, 7), (7, 3)]
    yield [tuple(x) for x in rng.integers(-(10**12), 10**12, 120)[rng.integers(0, 120, (90, 2))].tolist()]


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_equals_plain_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_LINKS", few)
    for links in graphs():
        got = [tuple(r) for r in common.connected_components(spark.createDataFrame([*links, (1, None)], "u long, v long")).collect()]
        assert len(got) == len(dict(got)) and dict(got) == plain(links)
    assert common.connected_components(spark.createDataFrame([(4, 4)], "u long, v long")).collect() == []


def test_few_links_take_few_jobs(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)], "u long, v long")
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        assert {r["root"] for r in common.connected_components(links).collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")) <= 8


def test_many_links_in_one_task():
    n = 200_000
    order = np.random.default_rng(1).permutation(n)
    nodes, roots = common.components(order[1:], order[:-1])
    assert len(nodes) == n and not roots.any()
