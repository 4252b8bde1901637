"""Connected components of an edge table by least labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm import common


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` -> ``node, root``: every node of an edge with the least node it is connected to.

    A round takes the least label among the neighbours and then the label of that label; both are joins on node
    whose rows were pre-aggregated, so a node with many neighbours costs one row for each task. Ends when no
    label changes. No edge, no row.
    """
    both = common.settle(
        edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b").distinct()
    )
    labels = common.settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("heard"))
        least = common.settle(
            labels.join(heard, F.col("node") == F.col("a")).select(
                "node", F.least("root", "heard").alias("root"), F.col("root").alias("was")
            )
        )
        jumped = least.select(F.col("node").alias("at"), F.col("root").alias("further"))
        moved = common.settle(
            least.join(jumped, F.col("root") == F.col("at")).select("node", F.least("root", "further").alias("root"), "was")
        )
        if moved.where("root <> was").isEmpty():
            return moved.select("node", "root")
        labels = moved.select("node", "root")
