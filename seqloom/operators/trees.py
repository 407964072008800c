"""Trees as rows of merges (family, a, b, c): members, splits, distances between trees, weights of leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.shared import cut


def members(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """family, node, leaf for every node of the tree; leaves: family, leaf.

    The way up doubles its length a round (a node's 2^k-th ancestor from two of its 2^(k-1)-th), so rounds go with the
    logarithm of the tree's height.
    """
    up = cut(tree.select("family", F.explode(F.array("a", "b")).alias("node"), F.col("c").alias("up")))
    out = cut(leaves.select("family", F.col("leaf").alias("node"), "leaf"))
    while not up.isEmpty():
        # out holds the first 2^k nodes of each leaf's way, up leads 2^k nodes further
        ahead = out.join(up, ["family", "node"]).select("family", F.col("up").alias("node"), "leaf")
        out = cut(out.union(ahead))
        up = cut(up.join(up.select("family", F.col("node").alias("up"), F.col("up").alias("far")), ["family", "up"]).select("family", "node", F.col("far").alias("up")))
    return out


def splits(reach: DataFrame) -> DataFrame:
    """family, split: the inner nodes' leaf sets, each as the side without the family's least leaf."""
    sides = reach.groupBy("family", "node").agg(F.array_sort(F.collect_set("leaf")).alias("side"))
    whole = reach.groupBy("family").agg(F.array_sort(F.collect_set("leaf")).alias("whole"))
    got = sides.join(whole, "family")
    low = F.array_contains("side", F.get("whole", F.lit(0)))
    side = F.when(low, F.array_sort(F.array_except("whole", "side"))).otherwise(F.col("side"))
    return got.select("family", side.alias("split"), F.size("whole").alias("n")).filter((F.size("split") > 1) & (F.size("split") < F.col("n") - 1)).select("family", "split").distinct()


def robinson_foulds(x: DataFrame, y: DataFrame) -> DataFrame:
    """family, distance: splits of one tree alone over splits of both (0 where neither has any)."""
    both = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), ["family", "split"], "full")
    alone = F.count_if(F.col("x").isNull() | F.col("y").isNull())
    total = F.sum(F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0)))
    return both.groupBy("family").agg((alone / total).alias("distance"))


def newick_splits(trees: DataFrame) -> DataFrame:
    """family, split, length, n of every edge of the trees (family, newick)."""
    import pandas as pd

    from seqloom.functions import newick

    def run(batches):
        for b in batches:
            rows = [(f, side, length, n) for f, text in zip(b["family"], b["newick"], strict=True) for got, n in [newick.splits(text)] for side, length in got]
            yield pd.DataFrame(rows, columns=["family", "split", "length", "n"])

    return trees.select("family", "newick").mapInPandas(run, "family string, split array<string>, length double, n int")


def tree_distances(x: DataFrame, y: DataFrame) -> DataFrame:
    """family, nrf, euclidean, weighted from splits with lengths (family, split, length) of two trees; n: leaves of a family.

    nrf is the number of splits of one tree alone over 2 (n - 3); the others compare lengths, 0 for a split that is not there.
    """
    both = x.select("family", "split", F.col("length").alias("x"), F.col("n").alias("nx")).join(y.select("family", "split", F.col("length").alias("y"), F.col("n").alias("ny")), ["family", "split"], "full")
    off = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    inner = F.coalesce("nx", "ny")
    alone = F.count_if((F.col("x").isNull() | F.col("y").isNull()) & (F.size("split") > 1))
    out = both.groupBy("family").agg(alone.alias("alone"), F.max(inner).alias("n"), F.sqrt(F.sum(off * off)).alias("euclidean"), F.sum(F.abs(off)).alias("weighted"))
    return out.select("family", F.when(F.col("n") > 3, F.col("alone") / (2 * (F.col("n") - 3))).otherwise(0.0).alias("nrf"), "euclidean", "weighted")


def tasks(tree: DataFrame, by: str = "tree") -> DataFrame:
    """Merges with their turn: in the order of the tree (c), or of priority (p, then c)."""
    order = Window.partitionBy("family").orderBy(*(["c"] if by == "tree" else ["p", "c"]))
    return tree.withColumn("turn", F.row_number().over(order) - 1)


def leaf_weights(tree: DataFrame, reach: DataFrame) -> DataFrame:
    """family, leaf, weight: N at the root, shared on the way down in proportion to the sibling's size."""
    size = reach.groupBy("family", "node").agg(F.count("*").alias("n"))
    edges = tree.select("family", "c", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("family", "c", "e.node", "e.other")
    own = edges.join(size, ["family", "node"]).join(size.select("family", F.col("node").alias("other"), F.col("n").alias("m")), ["family", "other"])
    share = own.select("family", "node", F.log(F.col("m") / (F.col("n") + F.col("m"))).alias("share"))
    total = reach.groupBy("family").agg(F.countDistinct("leaf").alias("total"))
    down = reach.join(share, ["family", "node"]).groupBy("family", "leaf").agg(F.sum("share").alias("s"))
    return down.join(total, "family").select("family", "leaf", (F.exp("s") * F.col("total")).alias("weight"))
