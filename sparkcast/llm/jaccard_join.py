"""Similarity self-join of word n-gram sets by signature trees.

Every text becomes its set of distinct n-word shingles (64-bit hashes). Equal
sets form one class; the work is on classes.

Two sets of Jaccard similarity t share a token among the first
``n - ceil(t * n) + 1`` of each in any common order, so classes are dealt to
blocks by those tokens, rarest first. Rarity comes from counts over all
documents in a table of fixed size (hash buckets, 16 MB), which any token has
the same rank in, so the order is common however coarse it is. Blocks with the
same members, and blocks contained in the largest block of all their members,
are dropped: their pairs meet elsewhere.

In a block a signature tree is built: leaves are members, sorted by set size
and smallest bits; a node holds the OR of the token bitmaps below it and
the range of set sizes. The tree is traversed against itself, and a pair of
nodes is dropped when even the maximum possible overlap (bits both have, plus
tokens that share a bit) or the size ranges can't reach the threshold. This is
done twice: with the members' own bitmaps (under a byte a token), which leaves
nearly only true groups, then with whole sets, where pairs of leaves left are
compared exactly, except members that verified links already join. A block of more than two chunks' ``TOKENS`` is cut into chunks of
neighbouring sizes: each chunk is joined with itself and the block's pivots
first; pairs of chunks then only need the members outside the component that
holds the pivots' majority. No cap, no sampling.

Defined results: null text, no words: empty set, linked with nothing; fewer
words than n: the whole sequence is the one shingle; repeated rows and ids
keep their rows, a row's component is the least id among the rows reachable; ids
null count as larger than any other; an empty table gives an empty result;
other columns pass through, input columns named like the outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import textbytes as tb
from .components import components
from .util import maybe_flag, maybe_in, save

BUCKETS = 1 << 24       # of the table of token counts
PARTS = 64              # rows it is aggregated in
TOKENS = 4_000_000      # of a chunk of a block; one task handles two
MEMBERS = 2_000         # of a chunk, at most
PIVOTS = 8
LEAF = 16               # members below a lowest node
FANOUT = 8
BITMAP = 1 << 16        # bits of a node's bitmap, at least


# --- sets ------------------------------------------------------------------

def _sets(col, k: int):
    """(first row, rows, hashes, row of each hash): distinct shingles, ordered by row and hash."""
    for first, buf, offs in tb.slices(col):
        h, t = tb.distinct_by_text(*tb.shingles(*tb.word_hashes(buf, offs), k))
        yield first, len(offs) - 1, h, t


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _count_tokens(k: int):
    """Bucket counts of a partition's shingles, as PARTS compressed rows."""
    def run(batches):
        import zstandard
        tb.begin()
        total = np.zeros(BUCKETS, np.uint32)
        for b in batches:
            for _, buf, offs in tb.slices(b.column(0), 4 * tb.SLICE):
                h, _ = tb.shingles(*tb.word_hashes(buf, offs), k)
                np.add.at(total, _bucket(h), 1)
        z = zstandard.ZstdCompressor(level=1)
        # byte planes: the high ones are nearly all zero
        parts = [z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()) for x in np.split(total, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])
    return run


def _rank(n: np.ndarray) -> np.ndarray:
    return np.minimum(255, np.round(8 * np.log2(1.0 + n))).astype(np.uint8)


def _sum_counts(batches):
    import zstandard
    z = zstandard.ZstdDecompressor()
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for p, x in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
            n = np.ascontiguousarray(np.frombuffer(z.decompress(x), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            sums[p] = sums[p] + n if p in sums else n.astype(np.uint64)
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([_rank(x).tobytes() for x in sums.values()], pa.binary())], ["part", "ranks"])


def token_ranks(texts: DataFrame, k: int) -> bytes:
    """One byte a bucket, growing with how often its shingles occur in all
    texts. ``BUCKETS`` bytes whatever the size of the table."""
    rows = (texts.mapInArrow(_count_tokens(k), "part int, counts binary").repartition(PARTS, "part")
            .mapInArrow(_sum_counts, "part int, ranks binary").collect())
    size = BUCKETS // PARTS
    got = {r["part"]: bytes(r["ranks"]) for r in rows}
    return b"".join(got.get(p, bytes(size)) for p in range(PARTS))


def _need(n: np.ndarray, m, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of n and m elements with den * |both| >= num * |either|."""
    return -(-num * (n + m) // (den + num))


def _width(n: np.ndarray) -> np.ndarray:
    """Bits of a set's own bitmap: four to eight a token, a power of two."""
    return 1 << np.ceil(np.log2(np.maximum(4 * n, 64))).astype(np.int64)


def _bitmaps(h: np.ndarray, at: np.ndarray, rows: np.ndarray) -> list[bytes]:
    """Token bitmap of each of the rows, whose hashes are h[at[row]:at[row + 1]]."""
    out = []
    for i, w in zip(rows.tolist(), _width(np.diff(at)[rows]).tolist()):
        bits = np.zeros(w, np.uint8)
        bits[(h[at[i]:at[i + 1]] & np.uint64(w - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def _describe(k: int, num: int, den: int, ranks):
    """Per row: set size, class key and, once per class and partition, the
    tokens to be dealt by and the token bitmap."""
    def run(batches):
        tb.begin()
        table = np.frombuffer(ranks.value, np.uint8)
        seen: set[bytes] = set()
        for b in batches:
            sizes, keys, pre, ends, maps = [], [], [], [0], []
            for _, rows, h, t in _sets(b.column("_text"), k):
                n = np.bincount(t, minlength=rows)
                at = np.concatenate([[0], np.cumsum(n)])
                own = _class_keys(h, at)
                order = np.argsort(t << 8 | table[_bucket(h)], kind="stable")      # h grows within a text
                place = np.arange(len(h)) - at[t]
                length = n - -(-num * n // den) + 1
                fresh = np.zeros(rows, bool)
                for i, x in enumerate(own):
                    if n[i] and x not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(x)
                        fresh[i] = True
                use = (place < length[t]) & fresh[t]
                sizes.append(n), pre.append(h[order][use])
                own_maps = np.full(rows, None, object)
                own_maps[fresh] = _bitmaps(h, at, np.flatnonzero(fresh))
                maps += own_maps.tolist()
                keys += own
                ends += (ends[-1] + np.cumsum(np.where(fresh, np.minimum(length, n), 0))).tolist()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(pre).view(np.int64) if pre else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array(np.concatenate(sizes) if sizes else np.empty(0, np.int64)),
                                              pa.array(keys, pa.binary()), lists, pa.array(maps, pa.binary())], ["_id", "_th", "n", "key", "deal", "bitmap"])
    return run


def _class_keys(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128-bit key of each row's set, whatever the order of its hashes."""
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[at])
    key = np.stack([tb.mix(total(tb.mix(h)) + np.diff(at).astype(np.uint64)), total(tb.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))], 1)
    raw = key.tobytes()
    return [raw[i:i + 16] for i in range(0, len(raw), 16)]


def _whole_sets(k: int):
    """Class key and whole set of texts, once per class and partition."""
    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            out, ends, keys = [], [0], []
            for _, rows, h, t in _sets(b.column("_text"), k):
                at = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=rows))])
                for i, x in enumerate(_class_keys(h, at)):
                    if x not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(x)
                        keys.append(x), out.append(h[at[i]:at[i + 1]]), ends.append(ends[-1] + len(out[-1]))
            flat = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["key", "tokens"])
    return run


# --- signature tree --------------------------------------------------------

class Tree:
    """Signature tree over members given by the places of their bits in a
    bitmap of ``bits`` bits and their set sizes, in the order given."""

    def __init__(self, at: list[np.ndarray], size: np.ndarray, bits: int):
        self.at, self.size, self.bits = at, size, bits
        self.levels = [[self._node(range(a, min(a + LEAF, len(at)))) for a in range(0, len(at), LEAF)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._join(below, a, min(a + FANOUT, len(below))) for a in range(0, len(below), FANOUT)])

    def _node(self, members):
        members = list(members)
        n = self.size[members]
        return dict(members=members, least=int(n.min()), most=int(n.max()), slack=max(int(self.size[i]) - len(self.at[i]) for i in members),
                    on=np.unique(np.concatenate([self.at[i] for i in members])))

    def _join(self, below, a, b):
        part = below[a:b]
        return dict(children=(a, b), least=min(x["least"] for x in part), most=max(x["most"] for x in part),
                    slack=max(x["slack"] for x in part), on=np.unique(np.concatenate([x["on"] for x in part])))


def _possible(x: dict, y: dict, num: int, den: int, flags: np.ndarray) -> bool:
    """Can a set below x and one below y be similar enough?"""
    if num * x["least"] > den * y["most"] or num * y["least"] > den * x["most"]:
        return False
    need = _need(x["least"], y["least"], num, den)
    both = int(np.count_nonzero(flags[y["on"]]))        # flags: the OR bitmap of x
    return both + min(x["slack"], y["slack"]) >= need


class Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int):
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def links(at: list[np.ndarray], size: np.ndarray, bits: int, num: int, den: int, sets: list[np.ndarray] | None = None,
          side: np.ndarray | None = None, skip: tuple = (0, 1)) -> np.ndarray:
    """Root of each member under all links. With ``sets`` links are exact, else
    pairs whose bitmaps allow the threshold are links. ``side``: pairs within a
    side of ``skip`` aren't compared (they are elsewhere)."""
    order = sorted(range(len(at)), key=lambda i: (int(size[i]), int(at[i][0]), int(at[i][-1])))
    tree = Tree([at[i] for i in order], size[order], bits)
    side = None if side is None else side[order].tolist()
    u = Union(len(at))
    flags = np.zeros(bits, bool)
    top = len(tree.levels) - 1

    def leaves(x, y):
        for i in x["members"]:
            n = int(tree.size[i])
            for j in y["members"]:
                if (j <= i and x is y) or u.find(i) == u.find(j) or (side is not None and side[i] == side[j] and side[i] in skip):
                    continue
                m = int(tree.size[j])
                if num * max(n, m) > den * min(n, m):
                    continue
                need = _need(n, m, num, den)
                if np.count_nonzero(flags_of(i)[tree.at[j]]) + min(n - len(tree.at[i]), m - len(tree.at[j])) < need:
                    continue
                if sets is None:
                    u.join(i, j)
                    continue
                a, b = sets[order[i]], sets[order[j]]
                if int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), n - 1)] == b)) >= need:
                    u.join(i, j)

    leaf_flags = np.zeros(bits, bool)
    lit = [-1]

    def flags_of(i):
        if lit[0] != i:
            if lit[0] >= 0:
                leaf_flags[tree.at[lit[0]]] = False
            leaf_flags[tree.at[i]] = True
            lit[0] = i
        return leaf_flags

    def whole(x, level):
        """All members below a node are one component."""
        lo, hi = span(x, level)
        r = {u.find(i) for i in range(lo, hi)}
        return r.pop() if len(r) == 1 else -1

    def span(x, level):
        while level:
            a, b = x["children"]
            return span(tree.levels[level - 1][a], level - 1)[0], span(tree.levels[level - 1][b - 1], level - 1)[1]
        return x["members"][0], x["members"][-1] + 1

    # dual traversal, one level after another; within a level the OR bitmap of
    # the left node is set once
    pairs = [(i, j) for i in range(len(tree.levels[top])) for j in range(i, len(tree.levels[top]))]
    for level in range(top, -1, -1):
        nodes = tree.levels[level]
        if level < top:
            upper = tree.levels[level + 1]
            pairs = [(i, j) for p, q in pairs for i in range(*upper[p]["children"]) for j in range(*upper[q]["children"]) if i <= j]
        if level == 0:
            pairs.sort(key=lambda p: (p[1] - p[0], p[0]))     # near sizes first: most links
        flags[:] = False
        left, keep = -1, []
        for i, j in pairs:
            if level == 0 and i != j and (r := whole(nodes[i], 0)) >= 0 and whole(nodes[j], 0) == r:
                continue
            if i == j:
                if level == 0:
                    leaves(nodes[i], nodes[i])
                else:
                    keep.append((i, j))
                continue
            if i != left:
                if left >= 0:
                    flags[nodes[left]["on"]] = False
                flags[nodes[i]["on"]] = True
                left = i
            if _possible(nodes[i], nodes[j], num, den, flags):
                if level == 0:
                    leaves(nodes[i], nodes[j])
                else:
                    keep.append((i, j))
        pairs = keep
    out = np.empty(len(at), np.int64)
    out[order] = np.array(order)[u.roots()]
    return out


def exact_links(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    size = np.array([len(x) for x in sets], np.int64)
    # a lowest node must stay sparse: eight bits a token and more
    bits = min(max(BITMAP, 1 << int(8 * size.max()).bit_length()), 1 << 22)
    return links([np.unique((x & np.uint64(bits - 1)).astype(np.int64)) for x in sets], size, bits, num, den, sets, side)


def possible_links(maps: list[bytes], size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Root of each member when every pair that its bitmaps don't rule out is a
    link. Similar sets have bitmaps of one width or of two neighbouring ones;
    the wider is folded."""
    width = _width(size)
    u = Union(len(maps))
    for w in np.unique(width).tolist():
        own = np.flatnonzero((width == w) | (width == 2 * w))
        if len(own) < 2:
            continue
        at = [np.unique(np.flatnonzero(np.unpackbits(np.frombuffer(maps[i], np.uint8))) & (w - 1)) for i in own]
        wide = (width[own] > w).astype(np.int64)
        for i, r in enumerate(links(at, size[own], w, num, den, None, wide if wide.any() else None, (1,))):
            u.join(int(own[i]), int(own[r]))
    return u.roots()


def _stream(columns: tuple, solve, out: tuple):
    """Gather rows by their first two columns, which come in order, and solve each group."""
    def run(batches):
        now, rows, found = None, [], []

        def close():
            if len(rows) > 1:
                found.extend(solve(now, rows))

        for batch in batches:
            for r in zip(*(_values(batch.column(c)) for c in columns)):
                if r[:2] != now:
                    close()
                    now, rows = r[:2], []
                rows.append(r[2:])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(out)], [c for c, _ in out])
            found = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(out)], [c for c, _ in out])
    return run


def _values(col):
    if not pa.types.is_list(col.type):
        return col.to_pylist()
    flat, offs = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
    return [flat[a:b].copy() for a, b in zip(offs, offs[1:])]


def _narrow_blocks(num: int, den: int):
    """(block, part, key, n, bitmap) -> links (a, b) that join members which may be linked."""
    def solve(now, rows):
        keys = [r[0] for r in rows]
        root = possible_links([r[2] for r in rows], np.array([r[1] for r in rows], np.int64), num, den)
        return [(keys[i], keys[r]) for i, r in enumerate(root) if r != i]
    return _stream(("block", "part", "key", "n", "bitmap"), solve, (("a", pa.binary()), ("b", pa.binary())))


def _join_blocks(num: int, den: int):
    """(block, part, side, key, tokens) -> links (a, b)."""
    def solve(now, rows):
        keys = [r[1] for r in rows]
        side = np.array([r[0] for r in rows])
        root = exact_links([r[2] for r in rows], num, den, side if side.any() else None)
        return [(keys[i], keys[r]) for i, r in enumerate(root) if r != i]
    return _stream(("block", "part", "side", "key", "tokens"), solve, (("a", pa.binary()), ("b", pa.binary())))


# --- the join --------------------------------------------------------------

def _prune(shared: DataFrame) -> DataFrame:
    """(block, k): the blocks without those whose pairs meet in another one."""
    same = shared.groupBy("block").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("k")).alias("x"), F.sum(F.hash("k").cast("long")).alias("s"))
    one = same.groupBy("c", "x", "s").agg(F.min("block").alias("block"))
    distinct = save(shared.join(one.select("block", "c"), "block"))
    largest = distinct.groupBy("k").agg(F.max(F.struct("c", "block")).alias("top"))
    inside = (distinct.join(largest, "k").groupBy("block")
              .agg(F.min("top.block").alias("lo"), F.max("top.block").alias("hi")).filter("lo = hi and lo <> block"))
    return distinct.join(inside, "block", "left_anti").select("block", "k")


def _blocks(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(block, key, n): groups of classes between which the bitmaps allow links.

    Classes that share a token they are dealt by meet in blocks; what the
    bitmaps leave of them forms components, one block each."""
    by_token = Window.partitionBy("block")
    short = F.xxhash64("key").alias("k")
    dealt = sets.select(F.explode("deal").alias("block"), short)
    shared = save(dealt.withColumns({"lo": F.min("k").over(by_token), "hi": F.max("k").over(by_token)})
                  .filter("lo <> hi").select("block", "k").distinct())
    fresh = sets.filter("size(deal) > 0")
    keys = fresh.select(short, "key", "n").distinct()
    # a class can only link to one of a size within the ratio: if the next
    # smaller and the next larger of a block aren't, none is
    by_size = Window.partitionBy("block").orderBy("n", "k")
    near = (F.col("n") * num <= F.lag("n").over(by_size) * den) | (F.lead("n").over(by_size) * num <= F.col("n") * den)
    sized = shared.join(keys.select("k", "n"), "k").withColumn("near", F.coalesce(near, F.lit(False)))
    shared = save(sized.filter("near").select("block", "k").distinct())
    blocks = save(_prune(shared).join(keys, "k").select("block", "key", "n"))
    small, large = _parts(blocks)
    bitmaps = maybe_in(fresh.select("key", "n", "bitmap"), F.col("key"), blocks, "key").groupBy("key", "n").agg(F.first("bitmap").alias("bitmap"))
    found = save(small.join(bitmaps, "key").select("block", "part", "key", "n", "bitmap")
                 .repartition("block").sortWithinPartitions("block", "key")
                 .mapInArrow(_narrow_blocks(num, den), "a binary, b binary"))
    narrow = components(found).join(keys.drop("k"), F.col("key") == F.col("node")).select(F.xxhash64("root").alias("block"), "key", "n")
    return save(narrow.unionByName(large.select("block", "key", "n")))


def _parts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (block, key, n) as they are, and the chunks of those that are too
    large for a task."""
    block = Window.partitionBy("block")
    w = blocks.withColumn("w", F.greatest(F.col("n"), F.lit(TOKENS // MEMBERS))).withColumn("all", F.sum("w").over(block))
    before = F.sum("w").over(block.orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1))
    large = w.filter(F.col("all") > 2 * TOKENS).withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / F.lit(TOKENS)).cast("int"))
    return (w.filter(F.col("all") <= 2 * TOKENS).select("block", F.lit(0).alias("part"), F.lit(0).alias("side"), "key"),
            large.select("block", "key", "n", "w", "chunk"))


def similar_links(df_sets: DataFrame, blocks: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links (a, b) that join all classes of a component."""
    def solve(members: DataFrame) -> DataFrame:
        whole = df_sets.groupBy("key").agg(F.first("tokens").alias("tokens"))
        rows = members.join(whole, "key").select("block", "part", "side", "key", "tokens")
        return (rows.repartition("block", "part").sortWithinPartitions("block", "part", "side", "key")
                .mapInArrow(_join_blocks(num, den), "a binary, b binary"))

    small, large = _parts(blocks)
    found = save(solve(small))
    if not large.take(1):
        return found
    large = save(large)
    # each chunk with itself and the pivots: the block's members next to every k-th size
    pivots = (large.withColumn("r", F.row_number().over(Window.partitionBy("block", "chunk").orderBy("n", "key")))
              .filter("r = 1").withColumn("q", F.row_number().over(Window.partitionBy("block").orderBy("n", "key")))
              .filter(F.col("q") <= PIVOTS).select("block", "key"))
    chunks = large.select("block", "chunk").distinct()
    first = (large.select("block", F.col("chunk").alias("part"), F.lit(0).alias("side"), "key")
             .unionByName(pivots.join(chunks, "block").select("block", F.col("chunk").alias("part"), F.lit(0).alias("side"), "key")).distinct())
    found = save(found.unionByName(solve(first)))
    roots = components(found)
    labelled = save(large.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    main = (labelled.groupBy("block", "root").agg(F.count("*").alias("m")).groupBy("block")
            .agg(F.max(F.struct("m", "root")).alias("best")).select("block", F.col("best.root").alias("main")))
    rest = labelled.join(main, "block").withColumn("odd", F.col("root") != F.col("main"))
    # the others against every chunk whose sizes can match
    before = F.sum("w").over(Window.partitionBy("block").orderBy("n", "key").rowsBetween(Window.unboundedPreceding, -1))
    odd = save(rest.filter("odd").withColumn("piece", F.floor(F.coalesce(before, F.lit(0)) / F.lit(TOKENS)).cast("int")))
    span = large.groupBy("block", "chunk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    odd_span = odd.groupBy("block", "piece").agg(F.min("n").alias("o_lo"), F.max("n").alias("o_hi"))
    tasks = save(span.join(odd_span, "block").filter((F.col("lo") * num <= F.col("o_hi") * den) & (F.col("o_lo") * num <= F.col("hi") * den))
                 .select("block", "chunk", "piece", F.xxhash64("chunk", "piece").alias("part")))
    second = (tasks.join(large, ["block", "chunk"]).select("block", "part", F.lit(0).alias("side"), "key")
              .unionByName(tasks.join(odd, ["block", "piece"]).select("block", "part", F.lit(1).alias("side"), "key"))
              .groupBy("block", "part", "key").agg(F.min("side").alias("side")))
    return save(found.unionByName(solve(second)))


_NO_ID = (1 << 63) - 1


def _keyed(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """With _id (null ids last) and _th, which tells rows of one id apart."""
    return df.withColumns({"_id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)),
                           "_th": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))})


def _groups(df: DataFrame, id_col: str, text: str, k: int, num: int, den: int) -> DataFrame:
    """(_id, _th, _n, _c, _root, _m): set size, least id of the component, the
    component's class (null for empty sets) and how many rows there are of it."""
    if 2 * num < den:
        raise ValueError("num / den is at least 1/2: bitmaps are compared with those of the neighbouring widths only")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = _keyed(df, id_col, text).select("_id", "_th", raw.alias("_text"))
    ranks = df.sparkSession.sparkContext.broadcast(token_ranks(docs.select("_text"), k))
    sets = save(docs.mapInArrow(_describe(k, num, den, ranks), "_id long, _th long, n long, key binary, deal array<long>, bitmap binary"))

    blocks = _blocks(sets, num, den)
    classes = blocks.select("key").distinct()
    holders = (sets.filter("size(deal) > 0").join(classes, "key", "left_semi")
               .groupBy("key").agg(F.min(F.struct("_id", "_th")).alias("h")).select("key", "h._id", "h._th"))
    holders = save(holders)
    # texts that hash like a holder's; whole sets of other classes find no block
    whole = save(maybe_in(docs.select("_th", "_text"), F.col("_th"), holders, "_th").mapInArrow(_whole_sets(k), "key binary, tokens array<long>"))
    roots = components(similar_links(whole, blocks, num, den))

    # least id of each component; only classes with copies or links have to be looked up
    least = save(sets.filter("n > 0").groupBy("key").agg(F.min("_id").alias("low"), F.count("*").alias("c")))
    linked = least.join(roots, least.key == roots.node)
    low = linked.groupBy("root").agg(F.min("low").alias("component"))
    of = save(linked.select("key", "root").join(low, "root").select("key", "component", "root")
              .unionByName(least.filter("c > 1").join(roots, least.key == roots.node, "left_anti")
                           .select("key", F.col("low").alias("component"), F.col("key").alias("root"))))
    rows = sets.select("_id", "_th", "n", "key").join(of, "key", "left")
    return save(rows.groupBy("_id", "_th").agg(F.first("n").alias("_n"), F.min(F.coalesce("component", "_id")).alias("_c"),
                                               F.first(F.when(F.col("n") > 0, F.coalesce("root", "key"))).alias("_root"), F.count("*").alias("_m")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Add n_shingles and component_id: the least id reachable by links between
    texts with ``den`` * |shared shingles| >= ``num`` * |all shingles|."""
    made = ("n_shingles", "component_id")
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c in (id_col, text) or c not in made])
    groups = _groups(df, id_col, text, k, num, den).select("_id", "_th", "_n", "_c")
    keep = [F.col(f"`{c}`") for c in df.columns if c not in made]
    return (_keyed(df, id_col, text).join(groups, ["_id", "_th"])
            .select(*keep, F.col("_n").alias("n_shingles"), F.when(F.col("_c") != _NO_ID, F.col("_c")).alias("component_id")))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component: the one of least id; of rows with one id the
    one of least hash over all columns. Rows with empty sets all stay."""
    groups = _groups(df, id_col, text, k, num, den)
    kept = groups.filter("_id = _c")
    gone = groups.filter("_id <> _c").select("_id", "_th")
    several = kept.filter("_root is not null").groupBy("_root").agg(F.sum("_m").alias("m")).filter("m > 1").select("_root")
    twice = save(kept.join(several, "_root").select("_id", "_th", "_root"))
    keyed = maybe_flag(_keyed(df, id_col, text), F.col("_th"), gone.select("_th").unionByName(twice.select("_th")), "_th")
    columns = [F.col(f"`{c}`") for c in df.columns]
    rest = keyed.filter("_maybe").join(gone, ["_id", "_th"], "left_anti").join(twice, ["_id", "_th"], "left")
    first = (rest.filter("_root is not null")
             .withColumn("_r", F.row_number().over(Window.partitionBy("_root").orderBy("_th", F.xxhash64(*columns)))).filter("_r = 1"))
    return (keyed.filter("not _maybe").select(*columns).unionByName(rest.filter("_root is null").select(*columns))
            .unionByName(first.select(*columns)))
