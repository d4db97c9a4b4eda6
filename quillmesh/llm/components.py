"""Connected components of an edge table, without gathering them on the driver.

Every node points at the smallest node it has seen. A round joins the edges with the
pointers of their ends, lets the larger pointer follow the smaller one, and then lets each
pointer follow its pointer's pointer, so chains shorten to half in a round. Each round is a
table in the shared folder; only the number of changed pointers reaches the driver. A node of
very many edges and a root of very many nodes are dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Table, hot_join


def components(edges: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Rows (node, root) of all ends of the edges (a, b); root is the component's smallest node.

    The result is a table that the caller's ``scratch``, if there is one, deletes.
    """
    links = Table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    both = links.df.select("a", "b").union(links.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    state = Table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).select(F.col("a").alias("node"), "root"), "roots")
    n_links, n_nodes = links.df.count(), state.df.count()
    for _ in range(rounds):
        now = state.df
        first = hot_join(links.df, now.select(F.col("node").alias("a"), F.col("root").alias("ra")), ["a"], ["b"], n_links)
        ends = hot_join(first, now.select(F.col("node").alias("b"), F.col("root").alias("rb")), ["b"], ["a"], n_links).where("ra <> rb")
        hooks = ends.groupBy(F.greatest("ra", "rb").alias("node")).agg(F.min(F.least("ra", "rb")).alias("hook"))
        hooked = now.join(hooks, "node", "left").select("node", F.coalesce(F.least("root", "hook"), "root").alias("root"))
        hooked = Table(hooked, "hooked")
        jump = hooked.df.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = Table(hot_join(hooked.df, jump, ["root"], ["node"], n_nodes, "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        changed = after.df.join(now.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        hooked.drop()
        state.drop()
        state = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    links.drop()
    if scratch is not None:
        scratch.tables.append(state)
    return state.df
