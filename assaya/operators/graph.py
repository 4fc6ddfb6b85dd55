"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaya.shared import cut

#: Links to a task, about. A round has half a dozen stages, each with files for every task: few links in many tasks cost
#: more disk in files than in links.
TASK_ROWS = 1 << 14


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (a, b): root is the least node reachable.

    Each round a node takes the least root that its neighbours know, then its root's root, until nothing changes. Nodes
    are those in edges; a self-edge makes a component of one. Stages have as many tasks as the links need, or as the
    session's shuffles give if those are fewer.
    """
    both_ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(edges.select(F.explode(both_ways).alias("x")).select("x.*").distinct())
    tasks = max(2, -(-links.count() // TASK_ROWS))
    links = links.coalesce(tasks)
    first = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
    roots = cut(first.coalesce(tasks))
    while True:
        offers = links.join(roots, links.b == roots.node).select("a", "root").coalesce(tasks)
        near = offers.groupBy("a").agg(F.min("root").alias("offer"))
        heard = roots.join(near, roots.node == near.a).select("node", "root", F.least("root", "offer").alias("low")).coalesce(tasks)
        up = heard.select(F.col("node").alias("p"), F.col("low").alias("p_low"))
        halved = heard.join(up, heard.low == up.p, "left").select("node", F.col("root").alias("old"), F.coalesce("p_low", "low").alias("root"))
        halved = cut(halved.coalesce(tasks))
        roots = halved.select("node", "root")
        if not halved.filter("old <> root").limit(1).count():
            return roots
