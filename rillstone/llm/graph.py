"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _starred(links: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours on the smallest member of a node's neighbourhood.

    Links are (a, b) with a < b.  A large star moves the larger neighbours of every node, a small star the
    smaller ones and the node itself.  The minimum per node is a partial aggregate and the rest a join, so a
    node with very many neighbours is split like any other skewed join key.
    """
    if small:
        around = links.select(F.col("b").alias("node"), F.col("a").alias("other"))
    else:
        around = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
    least = around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    joined = around.join(least, "node")
    if small:
        moved = joined.select(F.col("least").alias("a"), F.col("other").alias("b")).unionByName(
            least.select(F.col("least").alias("a"), F.col("node").alias("b"))
        )
    else:
        moved = joined.where("other > node").select(F.col("least").alias("a"), F.col("other").alias("b"))
    return moved.where("a < b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node it can reach.

    Links may repeat, run either way or join a node with itself (such nodes keep themselves as root only if
    they have another link; otherwise they are left out, as are nodes without links).  Each round is written
    to the shared folder; only a count and a checksum per round reach the driver.
    """
    links = stored(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links"
    )
    mark = _mark(links)
    while mark[0]:
        links = stored(_starred(_starred(links, small=False), small=True), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
