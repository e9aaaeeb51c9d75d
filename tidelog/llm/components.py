"""Connected components by hooking labels to labels and pointer jumping, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of ``links`` (a, b) the smallest node it reaches.

    A round gives each node the least label among itself, its neighbours and its label's label, and each label the least
    label that a node of it has for a neighbour: whole trees hook to each other, so rounds grow with the logarithm of the
    nodes, whatever their order (18 for a chain of 5,000 shuffled nodes, 29 for one of a million).  Labels only fall, so it
    ends by itself.  Rows stay those of ``links`` (both ways) and twice those of its nodes; aggregation combines before
    shuffles.  A link with a null end joins nothing.  Earlier rounds' tables are deleted.
    """
    links = links.where("a is not null and b is not null")
    both = frames.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = frames.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    before = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        step = labels.join(near, "node").join(jump, "label", "left")
        mine = F.struct("node", F.least("label", "near", F.coalesce("jump", "label")).alias("new"), F.col("label").alias("was"))
        hook = F.struct(F.col("label").alias("node"), F.col("near").alias("new"), F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        new = step.select(F.explode(F.array(mine, hook)).alias("x")).select("x.*").groupBy("node").agg(F.min("new").alias("label"), F.max("was").alias("was"))
        new = frames.written(new)
        done = new.where("label <> was").isEmpty()
        frames.discard(before)
        before, labels = new, new.select("node", "label")
        if done:
            frames.discard(both)
            return labels
