"""Trie of the prefixes that conversations share.

``turns`` numbers the turns of every conversation, ``shared_heads`` rebuilds
conversations on the first turns of their group's first one, ``prefix_trie``
returns one row for each distinct prefix with counts over its subtree, which
parallel tree contraction sums (:mod:`contraction`).

A prefix is known by a running SHA-256 over its turns (cut to 128 bits), so no
text is shuffled and nodes of different conversations meet by equal keys. Long
conversations are never in one task: turns are numbered in a range-partitioned
order, and the running digest is a scan over blocks of ``BLOCK`` turns, whose
digests are scanned in the same way. Nodes are counted with partial
aggregation. The ids of the conversations that end at a node are hashed in
pieces of at most ``SPAN`` ids that are put together before the last, streaming pass.

Defined results: turns are ordered by turn (null first), then role, then the
SHA-256 of the text, so ties and repeated rows keep a fixed order and each
counts as a turn; null role or text is empty; rows without a conversation id
belong to no conversation and are left out; an empty table has no conversation,
hence no root and no rows; texts of any length are read once; extra columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .contraction import subtree_totals
from .util import save

BLOCK = 1024            # turns of one step of the scan
SPAN = 1 << 16          # conversation ids of one piece of text
KEY = 16                # bytes of a prefix's key
ROOT = bytes(KEY)


def _number(batches):
    """Number the rows of each conversation within the task; the rows come in order."""
    part, conv, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        pos = []
        for c in b.column("conv_id").to_pylist():
            n = n + 1 if c == conv else 0
            conv = c
            pos.append(n)
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(pos, pa.int64()), b.column("unit"), b.column("bytes"),
                                          pa.array([part] * len(pos), pa.int32())], ["conv_id", "pos", "unit", "bytes", "part"])


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, unit, bytes): place of every turn from 0, digest of its
    role and text, UTF-8 bytes of its text."""
    r, t = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = (rows.filter(F.col(f"`{conv}`").isNotNull())
            .select(F.col(f"`{conv}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), r.alias("role"),
                    F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), F.octet_length(t).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")))
    unit = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"), F.col("digest")), 256))
    order = ["conv_id", "turn", "role", "digest", "row"]            # the row number parts equal rows among tasks
    numbered = save(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                    .select("conv_id", unit.alias("unit"), "bytes")
                    .mapInArrow(_number, "conv_id long, pos long, unit binary, bytes long, part int"))
    # a conversation that goes on in a later partition: at most one a partition
    own = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = own.select("conv_id", "part", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return (numbered.join(F.broadcast(before.filter("before > 0")), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "unit", "bytes"))


def shared_heads(turned: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) rebuilt: conversation c becomes the first h turns of
    conversation c - c % group, then its own turns after its first h, where h is
    the CRC-32 of c in decimal digits modulo ``heads``."""
    c = F.col("conv_id")
    plan = (turned.groupBy("conv_id").agg(F.count("*").alias("n"))
            .select("conv_id", "n", (c - c % group).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h")))
    plan = save(plan)
    size = plan.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(size, "base", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    first = turned.filter((c % group == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    borrowed = plan.filter("taken > 0").select("conv_id", "base", "taken").join(first, "base").filter("pos < taken").select("conv_id", "pos", "unit", "bytes")
    own = (turned.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "unit", "bytes"))
    return borrowed.unionByName(own), plan.select("conv_id")


def _chain(block: int):
    """Running digests of the rows of each (key, block), which come in order."""
    def run(batches):
        at, now = None, ROOT
        for b in batches:
            ids, above = [], []
            for k, pos, unit, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "pos", "unit", "start", "end"))):
                if (k, pos // block) != at:
                    at, now = (k, pos // block), start or ROOT
                above.append(now)
                now = hashlib.sha256(now + unit).digest()[:KEY]
                if end is not None and pos % block == block - 1:
                    now = end
                ids.append(now)
            cols = {"conv_id": b.column("conv_id"), "pos": b.column("pos"), "bytes": b.column("bytes"),
                    "id": pa.array(ids, pa.binary()), "above": pa.array(above, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return run


_CHAINED = "conv_id long, pos long, bytes long, id binary, above binary"


def prefix_keys(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, pos, bytes, id, above) for rows (conv_id, pos, unit, bytes): the
    key of the prefix that ends with each turn and of the one before it."""
    no = F.expr(f"pos div {block}").alias("block")
    rows = rows.select("conv_id", "pos", "unit", "bytes", no)
    dealt = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos").drop("block").mapInArrow(_chain(block), _CHAINED)
    nothing = F.lit(None).cast("binary")
    if rows.filter(F.col("pos") >= block - 1).limit(1).count() == 0:
        return dealt(rows.withColumns({"start": nothing, "end": nothing}))
    # conversations of a block and more: digests of whole blocks, scanned in their turn
    full = (rows.filter(F.col("pos") % block == block - 1).select("conv_id", "block"))
    inner = dealt(rows.join(full, ["conv_id", "block"], "left_semi").withColumns({"start": nothing, "end": nothing}))
    steps = save(inner.filter(F.col("pos") % block == block - 1).select("conv_id", no.alias("pos"), F.col("id").alias("unit"), F.lit(0).cast("long").alias("bytes")))
    ends = save(prefix_keys(steps, block))
    start = ends.select("conv_id", (F.col("pos") + 1).alias("block"), F.col("id").alias("start"))
    end = ends.select("conv_id", F.col("pos").alias("block"), F.col("id").alias("end"))
    return dealt(rows.join(start, ["conv_id", "block"], "left").join(end, ["conv_id", "block"], "left").select("conv_id", "pos", "unit", "bytes", "block", "start", "end"))


def _hash_pieces(batches):
    """SHA-256 of the pieces of each node, joined by commas; the pieces come in order."""
    at, h = None, None
    for b in batches:
        ids, sums = [], []
        for k, piece in zip(b.column("id").to_pylist(), b.column("piece").to_pylist()):
            if k != at:
                if at is not None:
                    ids.append(at)
                    sums.append(h.hexdigest())
                at, h = k, hashlib.sha256(piece.encode())
            else:
                h.update(b",")
                h.update(piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sums, pa.string())], ["id", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([h.hexdigest()], pa.string())], ["id", "ends_sha256"])


def prefix_trie(turned: DataFrame, convs: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """One row for each distinct prefix of the conversations ``convs`` (conv_id)
    with the turns ``turned`` (conv_id, pos, unit, bytes): conv_id (smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    root = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("bytes"), F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("above"))
    member = save(prefix_keys(save(turned), block).unionByName(root))
    nodes = save(member.groupBy("id").agg(F.min("conv_id").alias("conv_id"), (F.min("pos") + 1).alias("depth"), F.count("*").alias("n_convs"),
                                          F.min("bytes").alias("bytes"), F.min("above").alias("above")))
    kids = nodes.filter("above IS NOT NULL").groupBy(F.col("above").alias("id")).agg(F.count("*").alias("n_children"))
    tree = save(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                .withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}))
    totals = subtree_totals(tree, ["leaf", "saved"], node="id", parent="above").select(F.col("node").alias("id"), F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    last = member.groupBy("conv_id").agg(F.max_by("id", "pos").alias("id"))
    pieces = (last.groupBy("id", F.floor(F.col("conv_id") / span).alias("no"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece")))
    ends = pieces.repartition("id").sortWithinPartitions("id", "no").select("id", "piece").mapInArrow(_hash_pieces, "id binary, ends_sha256 string")
    parent = nodes.select(F.col("id").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return (tree.join(totals, "id").join(ends, "id", "left").join(parent, "above", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
