"""Connected components of links between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeloom.scale import few_files, find_hot, materialize, skew_join


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its component), for links a, b.

    Each round every node takes the least label around it and then the label of
    its label, so chains shrink by a factor. Rounds are written to the shared
    folder; the driver sees one count a round. Nodes with very many links are
    spread over tasks.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = materialize(both, "links")
    rows = both.count()  # there are no more nodes than that
    both = few_files(both, rows)
    store = lambda df, label: materialize(few_files(df, rows), label)
    hot = find_hot(both, ["b"], rows=rows)
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        around = skew_join(both, labels.select(F.col("node").alias("b"), F.col("label").alias("seen")), ["b"], hot_left=hot)
        least = around.groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("least"))
        nearer = labels.join(least, "node").select("node", "label", F.least("label", "least").alias("new"))
        nearer = store(nearer, "nearer")
        of_label = nearer.select(F.col("node").alias("new"), F.col("new").alias("further"))
        jumped = skew_join(nearer, of_label, ["new"], "left", hot_left=find_hot(nearer, ["new"], rows=rows)).select(
            "node", F.coalesce("further", "new").alias("label"), (F.coalesce("further", "new") != F.col("label")).alias("moved")
        )
        jumped = store(jumped, "labels")
        labels = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return labels
