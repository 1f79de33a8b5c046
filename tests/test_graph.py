"""The link graph and table spans on small crafted inputs."""

from dqspark.operators import graph


def test_reachable_follows_long_chains(spark):
    edges = spark.createDataFrame([(f"p{k}", f"p{k + 1}") for k in range(70)] + [("p70", "p3"), ("q0", "q1")], "src string, target string").coalesce(1)
    out = [r["name"] for r in graph.reachable(edges, spark.createDataFrame([("p0",)], "name string")).collect()]
    assert sorted(out) == sorted(f"p{k}" for k in range(71))
