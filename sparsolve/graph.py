"""Adjacency, neighbours at distance two, greedy colouring, and blocks from colours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import Matrix, Unsupported

#: Longest graph that is coloured, in index order, by one task.
GREEDY_MOST = 2_000_000


def adjacency(a: Matrix) -> DataFrame:
    """Edges (src, dst), both ways, where a_ij or a_ji isn't zero and i isn't j."""
    one = a.df.where("i <> j and v <> 0")
    return one.selectExpr("i src", "j dst").union(one.selectExpr("j", "i")).distinct()


def distance2(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst): neighbours, their neighbours, and each node itself."""
    two = edges.join(edges.selectExpr("src dst", "dst far"), "dst").selectExpr("src", "far dst")
    return edges.union(two).union(edges.sparkSession.range(n).selectExpr("id src", "id dst")).distinct()


def greedy_coloring(near: DataFrame, n: int) -> DataFrame:
    """(i, color): in index order the smallest colour that no neighbour has; the order makes it one task's work."""
    if n > GREEDY_MOST:
        raise Unsupported(f"{GREEDY_MOST} nodes at most")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        color: dict[int, int] = {}
        for src, own in pdf.sort_values("src").groupby("src", sort=True)["dst"]:
            taken = {color[d] for d in own if d in color}
            color[src] = next(c for c in range(len(taken) + 1) if c not in taken)
        return pd.DataFrame({"i": list(color), "color": list(color.values())})

    return near.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "i long, color long")


def color_graph(a: Matrix) -> DataFrame:
    """A distance-2 colouring (i, color) of A's graph."""
    return greedy_coloring(distance2(adjacency(a), a.nrows), a.nrows)


def blocks_from_colors(colors: DataFrame) -> DataFrame:
    """(color, members), members ascending."""
    return colors.groupBy("color").agg(F.sort_array(F.collect_list("i")).alias("members"))
