"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame) -> DataFrame:
    """node, root for every node that has a link; root is the smallest node of its component.

    ``links``: columns a, b of one orderable type. Rounds of hooking and pointer jumping, every round written to the
    shared folder: each node takes the smallest label among its neighbours, then the label of its label, until
    nothing changes. Labels move along the links in both directions and distances halve each round, so long
    chains take a logarithmic number of rounds. Joins on a hub's label are skewed and left to adaptive execution;
    minima are summed up before the shuffle.
    """
    both = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut(both, "edges")
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["a"] == labels["node"]).groupBy(F.col("b").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # Whatever a node learns, its old root learns too: components hook as wholes and not a step at a time.
        told = hooked.where("root < old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("told"))
        hooked = hooked.join(told, "node", "left").select("node", "old", F.least("root", "told").alias("root"))
        hooked = cut(hooked, "hooked")
        up = hooked.select(F.col("node").alias("up"), F.col("root").alias("above"))
        jumped = cut(hooked.join(up, hooked["root"] == up["up"]).select("node", "old", F.least("root", "above").alias("root")), "jumped")
        changed = jumped.where("root <> old").limit(1).count()
        drop_cut(hooked)
        drop_cut(labels)
        labels = jumped.select("node", "root")
        if not changed:
            drop_cut(edges)
            return labels
