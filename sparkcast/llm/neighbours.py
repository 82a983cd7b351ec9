"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph has a node per distinct vector (equal vectors share one, so a vector
that a third of all rows hold is one node) and ``degree`` edges per node.
NN-descent builds it by iterative Spark joins: a node's neighbours in both
directions meet at it, all pairs of that bounded set are compared, and pairs
nearer than an end's farthest neighbour go back to that end. The first graph
comes from brute force in blocks of at most about ``BLOCK`` nodes that random
hyperplanes cut.

A query walks the graph greedily. Its beam holds the ``beam`` nearest nodes
found; each round expands up to ``EXPAND`` unexpanded ones (a join of the
frontier with the graph, whose rows carry the neighbours' codes) and what is
nearer than the beam's farthest is merged in, until all of the beam is
expanded. Queries that are rows of the index start at their own node, others at
``PIVOTS`` fixed nodes. They run in blocks of ``QUERIES`` (fewer as the beam
grows), which bounds the frontier that is broadcast.

NN-descent runs until at most ``SETTLED`` of the edges change (after ``ROUNDS``
without that it is an error); ``settings`` lets the beam follow the number of nodes.

Graph and walk compare vectors by 8-bit codes with a scale per vector. Near
copies, whose codes say little about their order, carry the vector itself behind
the code (the first blocks find them): pairs of them with a code distance of at
most ``CLOSE`` error bounds are measured on the vectors. Of a beam, the nearest
``RERANK`` and all whose code distance is within the error bounds of the k-th
are measured in double precision on the vectors as given, with equal vectors
listed by id.

Defined results: vectors that are null, zero, hold a null or non-finite
component or don't have the commonest length (ties: the longer) take no part,
neither as query nor as candidate; a row is never its own neighbour, rows that
repeat an id and vector are one; fewer candidates than k: all that are found;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .util import save

DEGREE = 24
ROUNDS = 60             # of NN-descent: a safety bound, it stops when settled
SETTLED = 0.01          # share of edges that changed, below which it stops
TREES = 2
BLOCK = 256
BEAM = 400
EXPAND = 48
PIVOTS = 16
RERANK = 64             # of a beam, at least
CLOSE = 4               # code distances up to so many error bounds are measured on the vectors where both ends carry them
QUERIES = 20_000
SMALL = 25_000          # nodes up to which BEAM holds as it is


def settings(count: int) -> dict[str, int]:
    """Beam and expansions for a graph of ``count`` nodes: both grow with the
    square root of ``count / SMALL``; degree and trees don't change, so that the
    rows of every step grow with the nodes."""
    beam = int(np.ceil(BEAM * max(1.0, count / SMALL) ** 0.5))
    return {"beam": beam, "expand": -(-EXPAND * beam // BEAM)}


# --- vectors ---------------------------------------------------------------

def vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, node): the rows that take part, vectors in double precision."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size("v") == (length[0]["n"] if length else 0))
    # 0.0 and -0.0 are one value
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("node", F.xxhash64("v")).dropDuplicates(["id", "node"])


def _codes(v: pa.Array) -> pa.Array:
    """8-bit code of each vector with the vector behind it, the scale that gives
    the code back, and a bound of its error (with that of single precision)."""
    x = v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.empty((0, 1))
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    q = np.round(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - q * scale.astype(np.float32).astype(float)[:, None]) ** 2).sum(1)) + 5e-4 * np.sqrt((x * x).sum(1))
    return pa.StructArray.from_arrays([pa.array([c.tobytes() + r.tobytes() for c, r in zip(q, x)], pa.binary()), pa.array(scale.astype(np.float32)), pa.array(err)],
                                      ["code", "scale", "err"])


def _code(vector: str) -> Column:
    return F.arrow_udf(_codes, "code binary, scale float, err double")(vector)


class Points:
    """Vectors of codes, one a row, in single precision, and the vectors that some carry."""

    def __init__(self, codes: list, scales, dim: int):
        s = np.asarray(scales, np.float32)
        self.x = np.frombuffer(b"".join(c[:dim] for c in codes), np.int8).reshape(len(codes), dim).astype(np.float32) * s[:, None]
        self.bound = s * (0.5 * dim ** 0.5)
        self.has = np.array([len(c) > dim for c in codes], bool)
        self.at = np.cumsum(self.has) - 1
        self.v = np.frombuffer(b"".join(c[dim:] for c in codes), np.float64).reshape(-1, dim)

    def __getitem__(self, rows):
        out = object.__new__(Points)
        out.x, out.bound, out.has, out.at, out.v = self.x[rows], self.bound[rows], self.has[rows], self.at[rows], self.v
        return out


def _between(x: Points, y: Points) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of x and y; whether the codes are near copies'."""
    d = (x.x * x.x).sum(1)[:, None] + (y.x * y.x).sum(1)[None] - 2 * x.x @ y.x.T
    d = np.maximum(d, 0)
    close = d <= (CLOSE * (x.bound[:, None] + y.bound[None])) ** 2
    a, b = np.nonzero(close & x.has[:, None] & y.has[None])
    for lo in range(0, len(a), 1 << 16):        # bounded memory
        i, j = a[lo:lo + (1 << 16)], b[lo:lo + (1 << 16)]
        d[i, j] = ((x.v[x.at[i]] - y.v[y.at[j]]) ** 2).sum(1)
    return d, close


# --- graph -----------------------------------------------------------------

def _gathered(key: str, solve, out: list[str], types: list):
    """Stream groups of rows by ``key`` (they come together) through ``solve``,
    which gives columns; a group is bounded by what made it."""
    def run(batches):
        rest = None

        def batch(groups):
            cols = [np.concatenate([g[i] for g in groups]) if groups else np.empty(0) for i in range(len(out))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], out)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            k = t[key].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
            groups = [solve(t.slice(a, z - a)) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist())]
            rest = t.slice(int(edges[-1])) if len(edges) else t
            yield batch(groups)
        if rest is not None and len(rest):
            yield batch([solve(rest)])
    return run


def _nearest_in_block(degree: int, dim: int):
    def solve(t: pa.Table):
        n = t["node"].to_numpy()
        d, close = _between(*(2 * [Points(t["code"].to_pylist(), t["scale"].to_numpy(), dim)]))
        np.fill_diagonal(d, np.inf)
        k = min(degree, len(n) - 1)
        best = np.argpartition(d, k - 1, axis=1)[:, :k] if 0 < k < len(n) - 1 else np.argsort(d, 1)[:, :k]
        return np.repeat(n, k), n[best.ravel()], np.take_along_axis(d, best, 1).ravel(), np.take_along_axis(close, best, 1).ravel()
    return _gathered("block", solve, ["a", "b", "d", "close"], [pa.int64(), pa.int64(), pa.float32(), pa.bool_()])


def _local_join(dim: int):
    """Pairs of the neighbours that meet at a node, as far as nearer than an end's
    farthest; of two old edges both ends were compared when the later was fresh."""
    def solve(t: pa.Table):
        n, far, new = t["u"].to_numpy(), t["far"].to_numpy(), t["new"].to_numpy()
        d, _ = _between(*(2 * [Points(t["code"].to_pylist(), t["scale"].to_numpy(), dim)]))
        a, b = np.nonzero((d < far[:, None]) & (new[:, None] | new[None]))
        ok = n[a] != n[b]
        a, b = a[ok], b[ok]
        return n[a], n[b], d[a, b]
    return _gathered("m", solve, ["a", "b", "d"], [pa.int64(), pa.int64(), pa.float32()])


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest of each node, every pair once; an edge that was there is no fresh one."""
    w = Window.partitionBy("a").orderBy("d", "b")
    once = edges.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return once.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= degree).drop("r")


def _meetings(edges: DataFrame, degree: int) -> DataFrame:
    """(m, u, new): each node m with its neighbours and the ``degree`` nearest of
    those whose neighbour it is; new where the edge is fresh."""
    both = (edges.select(F.col("a").alias("m"), F.col("b").alias("u"), "d", "fresh", F.lit(0).alias("back"))
            .unionByName(edges.select(F.col("b").alias("m"), F.col("a").alias("u"), "d", "fresh", F.lit(1).alias("back"))).repartition("m"))
    w = Window.partitionBy("m", "back").orderBy("d", "u")
    return (both.withColumn("r", F.row_number().over(w)).filter((F.col("back") == 0) | (F.col("r") <= degree))
            .groupBy("m", "u").agg(F.max("fresh").alias("new")))


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """(a, b, d): edges of the neighbour graph over nodes (node, code, scale),
    whose codes come with the vector; and the nodes, where only near copies keep it."""
    count = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, count / BLOCK)))))
    first = nodes.limit(1).collect()
    dim = len(first[0]["code"]) // 9 if first else 1
    planes = np.random.default_rng(11).standard_normal((trees, bits, dim)).astype(np.float32)

    def leaves(batches):
        for b in batches:
            x = Points(b.column("code").to_pylist(), b.column("scale").to_numpy(), dim).x
            for t in range(trees):
                leaf = ((x @ planes[t].T > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * trees + t), *(b.column(c) for c in ("node", "code", "scale"))], ["leaf", "node", "code", "scale"])

    cut = save(nodes.mapInArrow(leaves, "leaf long, node long, code binary, scale float"))
    # a leaf that holds more than its share (near copies) is dealt to several blocks
    sizes = cut.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(2 * BLOCK)).alias("parts"))
    blocks = cut.join(sizes, "leaf").withColumn("block", F.xxhash64("leaf", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))))
    start = save(blocks.select("block", "node", "code", "scale").repartition("block").sortWithinPartitions("block")
                 .mapInArrow(_nearest_in_block(degree, dim), "a long, b long, d float, close boolean"))
    near = start.filter("close")
    near = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct().withColumn("near", F.lit(True))
    nodes = save(nodes.join(near, "node", "left").withColumn("code", F.when(F.col("near"), F.col("code")).otherwise(F.substring("code", 1, dim))).drop("near"))
    edges = save(_nearest(start.drop("close").withColumn("fresh", F.lit(True)), degree))
    for _ in range(rounds):
        far = edges.groupBy("a").agg(F.when(F.count("*") >= degree, F.max("d")).otherwise(F.lit(float("inf"))).cast("float").alias("far"))
        known = nodes.join(far, nodes.node == far.a, "left").select(F.col("node").alias("u"), "code", "scale", F.coalesce("far", F.lit(float("inf")).cast("float")).alias("far"))
        found = (_meetings(edges, degree).join(known, "u").repartition("m").sortWithinPartitions("m")
                 .mapInArrow(_local_join(dim), "a long, b long, d float").withColumn("fresh", F.lit(True)))
        edges = save(_nearest(edges.withColumn("fresh", F.lit(False)).unionByName(found), degree))
        total, fresh = edges.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= SETTLED * total:
            return edges.drop("fresh"), nodes
    raise RuntimeError(f"the neighbour graph is not settled after {rounds} rounds")


# --- search ----------------------------------------------------------------

def _adjacency(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """(node, near, codes, scales): neighbours in both directions, with their codes."""
    back = edges.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("d", "a"))).filter(F.col("r") <= degree)
    both = edges.select("a", "b").unionByName(back.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return (both.join(nodes, both.b == nodes.node).groupBy(F.col("a").alias("node"))
            .agg(F.collect_list(F.struct("b", "code", "scale")).alias("x"))
            .select("node", F.col("x.b").alias("near"), F.col("x.code").alias("codes"), F.col("x.scale").alias("scales")))


def _expand(shared, dim: int):
    """Frontier rows with their neighbours -> (q, node, d) of those near enough, each once a task batch."""
    def run(batches):
        at, x = shared.value
        for b in batches:
            q, near, d = [], [], []
            for qs, fars, n, codes, scales in zip(*(b.column(c).to_pylist() for c in ("qs", "fars", "near", "codes", "scales"))):
                i = [at[k] for k in qs]
                dist, _ = _between(x[i], Points(codes, scales, dim))
                r, c = np.nonzero(dist < np.array(fars)[:, None])
                q.append(np.array(qs)[r]), near.append(np.array(n)[c]), d.append(dist[r, c])
            cat = lambda y, k: np.concatenate(y) if y else np.empty(0, k)
            q, near, d = cat(q, np.int64), cat(near, np.int64), cat(d, np.float32)
            o = np.lexsort((near, q))
            keep = np.concatenate([[True], (q[o][1:] != q[o][:-1]) | (near[o][1:] != near[o][:-1])]) if len(q) else np.empty(0, bool)
            o = o[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q[o]), pa.array(near[o]), pa.array(d[o].astype(np.float32))], ["q", "node", "d"])
    return run


def _walk(queries: list, graph: DataFrame, nodes: DataFrame, pivots: list, beam: int, expand: int, dim: int) -> DataFrame:
    """(q, node, d) of the beams of a block of queries (q, code, scale)."""
    spark = nodes.sparkSession
    x = Points([bytes(r["code"]) for r in queries], [r["scale"] for r in queries], dim)
    shared = spark.sparkContext.broadcast(({r["q"]: i for i, r in enumerate(queries)}, x))
    start, _ = _between(x, Points([bytes(r["code"]) for r in pivots], [r["scale"] for r in pivots], dim))
    rows = [(r["q"], p["node"], float(start[i, j])) for i, r in enumerate(queries) for j, p in enumerate(pivots) if p["node"] != r["q"]]
    own = nodes.join(F.broadcast(spark.createDataFrame([(r["q"],) for r in queries], "q long")), F.col("node") == F.col("q"))
    begin = spark.createDataFrame(rows, "q long, node long, d float").unionByName(own.select("q", "node", F.lit(0.0).cast("float").alias("d")))
    order, query = Window.partitionBy("q").orderBy("d", "node"), Window.partitionBy("q")

    def step(found: DataFrame) -> DataFrame:
        """The beams after what was found, all by one shuffle; ``now`` marks what is expanded next."""
        once = found.repartition("q").groupBy("q", "node").agg(F.min("d").alias("d"), F.max("done").alias("done"))
        once = once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= beam)
        open_ = F.sum((~F.col("done")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        far = F.when(F.count("*").over(query) >= beam, F.max("d").over(query)).otherwise(F.lit(float("inf"))).cast("float")
        once = once.withColumns({"far": far, "now": ~F.col("done") & (open_ <= expand)})
        return save(once.select("q", "node", "d", (F.col("done") | F.col("now")).alias("done"), "now", "far"))

    state = step(begin.withColumn("done", F.lit(False)))
    while True:
        frontier = state.filter("now")
        if not frontier.take(1):
            return state.select("q", "node", "d")
        # bounded: QUERIES * EXPAND rows at most, as there are fewer queries the more are expanded
        at = frontier.groupBy("node").agg(F.collect_list("q").alias("qs"), F.collect_list("far").alias("fars"))
        found = graph.join(F.broadcast(at), "node").select("qs", "fars", "near", "codes", "scales").mapInArrow(_expand(shared, dim), "q long, node long, d float")
        state = step(state.select("q", "node", "d", "done").unionByName(found.withColumn("done", F.lit(False))))


def _exact(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, degree: int | None = None, beam: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of ``df`` found for
    each row of ``queries`` (same columns), by Euclidean distance. The beam
    follows the number of distinct vectors (``settings``) unless given."""
    rows = save(vectors(df, id_col, vector))
    asked = save(vectors(queries, id_col, vector).withColumnRenamed("node", "q"))
    if not rows.take(1) or not asked.take(1):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the k + 1 least ids of each vector are all that an answer can need
    ids = save(rows.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1)
               .select("node", "id", "r", F.when(F.col("r") == 1, F.col("v")).alias("v")))
    distinct = ids.filter("r = 1").select("node", "v")
    nodes = save(distinct.withColumn("c", _code("v")).select("node", "c.code", "c.scale", "c.err"))
    rule = settings(nodes.count())
    degree, beam = degree or DEGREE, beam or rule["beam"]
    dim = len(nodes.first()["code"]) // 9
    errors = nodes.select("node", "err")
    edges, nodes = build_graph(nodes.drop("err"), degree)
    graph = save(_adjacency(edges, nodes, degree))
    pivots = nodes.orderBy(F.xxhash64("node")).limit(PIVOTS).collect()
    ask = asked.groupBy("q").agg(F.first("v").alias("v")).withColumn("c", _code("v")).select("q", "c.code", "c.scale", "c.err")
    ask = save(ask)
    blocks = max(1, -(-ask.count() * rule["expand"] // (QUERIES * EXPAND)))
    beams = None
    for i in range(blocks):
        block = ask.filter(F.pmod(F.xxhash64("q", F.lit(2)), F.lit(blocks)) == i).orderBy("q").collect()
        if not block:
            continue
        part = _walk(block, graph, nodes, pivots, beam, rule["expand"], dim)
        beams = part if beams is None else beams.unionByName(part)
    # the k-th nearest besides the query's own vector is at most ``reach`` away
    found = (beams.join(errors, "node").join(ask.select("q", F.col("err").alias("q_err")), "q").withColumn("s", F.sqrt(F.col("d").cast("double")))
             .withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "node")))
             .withColumn("reach", F.max(F.when(F.col("r") <= k + 1, F.col("s") + F.col("err") + F.col("q_err"))).over(Window.partitionBy("q"))))
    top = found.filter((F.col("r") <= max(RERANK, k + 1)) | (F.col("s") - F.col("err") - F.col("q_err") <= F.col("reach"))).select("q", "node")
    # a query's own vector is a candidate for its other holders
    own = asked.select("q").distinct().join(distinct.select("node"), F.col("q") == F.col("node"))
    top = top.unionByName(own.select("q", "node")).distinct()
    near = (top.join(distinct, "node").join(asked.select("q", F.col("id").alias("query_id"), F.col("v").alias("w")), "q")
            .select("query_id", "node", _exact("v", "w").alias("score")))
    answer = near.join(ids.select("node", "id"), "node").filter("id <> query_id")
    w = Window.partitionBy("query_id").orderBy("score", "id")
    return (answer.groupBy("query_id", "id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias("vec_id"), "score"))
