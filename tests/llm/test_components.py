"""Components by star steps against a search, with rounds of one task and of several."""

import random

import pytest

from tickframe.llm import simhash


def least_of(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for start in sorted(near):
        todo = [start] if start not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = start
                todo += near[x]
    return out


@pytest.mark.parametrize("edges_a_task", [1 << 18, 100])
def test_rounds_take_the_tasks_that_their_edges_need(spark, edges_a_task):
    rng = random.Random(5)
    nodes = rng.sample(range(10**6), 400)
    edges = [(nodes[i], nodes[i + 1]) for i in range(200)] + [(rng.choice(nodes[:300]), rng.choice(nodes[:300])) for _ in range(60)] + [(nodes[350], x) for x in nodes[351:]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(4), edges_a_task)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = {r["node"]: r["root"] for r in out.collect()}
    assert made == least_of([(a, b) for a, b in edges if a != b])
    files = len(out.inputFiles())
    assert (files == 1) == (edges_a_task > 1000)
