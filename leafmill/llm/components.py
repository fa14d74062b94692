"""Connected components by hooking and pointer jumping, on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the least node that each linked node reaches.

    ``links`` has columns ``a`` and ``b``; repeated links, loops and an empty
    table are allowed; nodes without a link to another are left out.  A label
    points at a node, and labels make trees.  In each round a node looks at the
    least grandparent of its neighbours: it hooks itself there, hooks its
    parent there, and takes its own grandparent, whichever is least.  So trees
    merge by their roots and grow flat at once, and the rounds grow with the
    logarithm of the longest path.  Hooks are combined before they are
    shuffled; of the joins only a label that many nodes share is uneven, and
    the other side has it once, so Spark may split it.
    """
    most = 2 * links.count()
    both = saved(links.select("a", "b").union(links.select("b", "a")).where("a <> b").toDF("node", "other").distinct(), "links", rows=most)
    labels = saved(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels", rows=most)
    while True:
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        high = labels.join(own, "label")
        near = both.join(high.select(F.col("node").alias("other"), "up"), "other").groupBy("node").agg(F.min("up").alias("near"))
        seen = high.join(near, "node")
        hooks = seen.select("node", F.least("near", "up").alias("to"), F.col("label").alias("was")).union(seen.select("label", "near", F.lit(None).cast("long")))
        step = saved(hooks.groupBy("node").agg(F.max("was").alias("was"), F.least(F.max("was"), F.min("to")).alias("label")), "labels", rows=most)
        labels = step.select("node", "label")
        if step.where("was <> label").isEmpty():
            return labels
