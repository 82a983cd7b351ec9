"""Subtree totals of a forest by parallel tree contraction.

Rounds of two joins shrink the forest. *Rake*: every leaf adds what it has
gathered to its parent (summed before the shuffle, so a parent of very many
leaves is no hot group) and goes; a node that goes as a leaf knows its total.
*Compress*: in chains of nodes with one child, an independent set of nodes is
cut out by a coin a node and round (heads, below tails); a child of such a node
is linked to the grandparent and its edge carries what was cut out. So chains
halve again and again while bushes lose their leaves: the rounds grow with the
logarithm of the nodes, however deep the forest is.

*Expansion*: a node that was cut out knows its total as that of a later node
plus a constant. These links are joined with one another until each ends at a
raked node (logarithm of the rounds), whose total is known.

Defined results: an empty table gives an empty table; a node whose parent is
null is a root; repeated nodes, parents that are no nodes and cycles are errors
of the caller (the last two leave nodes that never go: ValueError).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .util import save


def _coin(node: Column, r: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(r)), F.lit(2)) == 1


def subtree_totals(tree: DataFrame, values: list[str], node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, one column for each of ``values``): sums over the node and all below it."""
    acc, edge = [f"acc_{i}" for i in range(len(values))], [f"edge_{i}" for i in range(len(values))]
    own = tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"), *[F.col(v).cast("long").alias(a) for v, a in zip(values, acc)])
    below = own.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("kids"))
    live = save(own.join(below, own.node == below.of, "left")
                .select("node", "parent", F.coalesce("kids", F.lit(0)).alias("kids"), *acc, *[F.lit(0).cast("long").alias(e) for e in edge]))
    left, raked, cut = live.count(), [], []
    while left:
        r = len(raked)
        leaves = live.filter("kids = 0")
        raked.append(leaves.select("node", *acc))
        up = (leaves.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("of"))
              .agg(F.count("*").alias("gone"), *[F.sum(F.col(a) + F.col(e)).alias(f"up_{a}") for a, e in zip(acc, edge)]))
        rest = live.filter("kids > 0").join(up, F.col("node") == F.col("of"), "left")
        rest = rest.select("node", "parent", (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"),
                           *[(F.col(a) + F.coalesce(f"up_{a}", F.lit(0))).alias(a) for a in acc], *edge)
        out = F.expr("kids = 1 AND parent IS NOT NULL") & _coin(F.col("node"), r) & ~_coin(F.col("parent"), r)
        out = F.coalesce(out, F.lit(False))
        gone = rest.filter(out).select(F.col("node").alias("top"), F.col("parent").alias("above"),
                                       *[F.col(a).alias(f"top_{a}") for a in acc], *[F.col(e).alias(f"top_{e}") for e in edge])
        stay = rest.filter(~out)
        may = F.coalesce(_coin(F.col("parent"), r), F.lit(False))      # only below heads is a node cut out
        moved = stay.filter(may).join(gone, F.col("parent") == F.col("top"), "left")
        live = save(moved.unionByName(stay.filter(~may), allowMissingColumns=True))
        cut.append(live.filter("top IS NOT NULL").select(F.col("top").alias("node"), F.col("node").alias("via"),
                                                         *[(F.col(f"top_{a}") + F.col(e)).alias(a) for a, e in zip(acc, edge)]))
        live = live.select("node", F.expr("CASE WHEN top IS NULL THEN parent ELSE above END").alias("parent"), "kids", *acc,
                           *[(F.col(e) + F.coalesce(f"top_{a}", F.lit(0)) + F.coalesce(f"top_{e}", F.lit(0))).alias(e) for a, e in zip(acc, edge)])
        now = live.count()
        if now == left:
            raise ValueError("the table is no forest: parents are missing or run in a circle")
        left = now
    if not raked:
        return own.select("node", *[F.col(a).alias(v) for a, v in zip(acc, values)])
    known = reduce(DataFrame.unionByName, raked)
    if cut:
        links = save(reduce(DataFrame.unionByName, cut))
        for _ in range((len(raked) - 1).bit_length()):
            on = links.select(F.col("node").alias("via"), F.col("via").alias("next"), *[F.col(a).alias(f"on_{a}") for a in acc])
            links = save(links.join(on, "via", "left").select("node", F.coalesce("next", "via").alias("via"),
                                                              *[(F.col(a) + F.coalesce(f"on_{a}", F.lit(0))).alias(a) for a in acc]))
        ends = known.select(F.col("node").alias("via"), *[F.col(a).alias(f"on_{a}") for a in acc])
        known = known.unionByName(links.join(ends, "via").select("node", *[(F.col(a) + F.col(f"on_{a}")).alias(a) for a in acc]))
    return known.select("node", *[F.col(a).alias(v) for a, v in zip(acc, values)])
