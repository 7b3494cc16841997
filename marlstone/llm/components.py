"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import checkpointed

#: Every so many rounds labels also take their own labels, which shortens long chains.
JUMP_EVERY = 4


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for every node of ``links`` (columns ``a``, ``b``, of one type).

    Every round, nodes send their labels along their links and keep the least they have; each task sends a node one message at most.  Links
    are checkpointed as they come and shuffled by node for every round, so that those of a node with very many are split under the join.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = checkpointed(both.dropDuplicates(["a", "b"]))
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels, edges["a"] == labels["node"]).groupBy(F.col("b").alias("to")).agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["to"]).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        if turn % JUMP_EVERY == 0:
            far = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
            step = step.join(far, step["new"] == far["at"]).select("node", F.least("new", "far").alias("new"), "old")
        moved = checkpointed(step.select("node", F.col("new").alias("label"), (F.col("new") != F.col("old")).alias("moved")))
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
