"""Trie of the shared beginnings of conversations.

A conversation is the row of its turns' digests. Conversations are sorted by these rows over
range partitions, so those that begin alike stand together, and the length of what two
neighbours have in common (the LCP) is the depth at which their paths part. In a partition
the edges between neighbours are taken in descending depth through a union-find: every merge
makes a branching node or extends one of that depth.

What the last conversation of a partition has in common with the first of the next stays
open: a node so far up may reach over the boundary. Partitions contract their forest to the
open nodes on their two outer paths, with what hangs closed below each. The LCPs at and
between the boundaries say in which partition an open node begins and ends, so its parts
carry one name (owner, depth) and are summed. Open nodes ordered by owner and depth have every subtree
in one stretch, so what lies below one is a difference of running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.llm.spark import checkpoint

#: Bytes of a turn's digest; ids of a piece of a list that is hashed in order.
WIDTH, PIECE = 16, 2000
#: What a partition makes: closed nodes, parts of open nodes, pieces of the lists of open nodes.
CLOSED, OPEN, IDS = 0, 1, 2
FOREST = (
    "kind int, part int, owner int, depth long, last int, parent_owner int, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved long, chars long, piece int, ends string"
)
NODE = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two conversations have in common from the start, in steps that double and halve."""
    n = min(len(a), len(b)) // WIDTH
    at, step = 0, 1
    while at < n:
        step = min(step, n - at)
        if a[WIDTH * at : WIDTH * (at + step)] == b[WIDTH * at : WIDTH * (at + step)]:
            at += step
            step *= 2
        elif step == 1:
            return at
        else:
            step //= 2
    return n


def merge_tree(turns: list[int], shared: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Branching and ending nodes of sorted neighbours: depth, first and last row, and parent of each; the root is the last.

    `turns` are the lengths of the rows, `shared` the LCPs of neighbours. Edges are taken in
    descending depth and, at one depth, from left to right; nodes that were found to be one
    have the parent -2.
    """
    m = len(turns)
    depth, low, high, parent = list(turns), list(range(m)), list(range(m)), [-1] * m
    up, top = list(range(m)), list(range(m))  # union-find over rows; the node on top of each component

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in sorted(range(m - 1), key=lambda k: -shared[k]):
        left, right = find(e), find(e + 1)
        x, y, d = top[left], top[right], shared[e]
        if depth[x] > d:
            depth.append(d)
            low.append(low[x])
            high.append(high[x])
            parent.append(-1)
            parent[x] = len(depth) - 1
            x = parent[x]
        if depth[y] == d:  # a row that ends here as well, and nothing yet below it
            parent[y] = -2
        else:
            parent[y] = x
        high[x] = high[y]
        up[right] = left
        top[left] = x
    if m and depth[top[find(0)]] > 0:
        x = top[find(0)]
        depth.append(0)
        low.append(low[x])
        high.append(high[x])
        parent.append(-1)
        parent[x] = len(depth) - 1
    return depth, low, high, parent


def _open_names(k: int, shared: list[int], inner: list[int]) -> tuple[list[int], list[int]]:
    """Of partition k: by depth, the owner of what is open to the left, and the last partition of what is open to the right.

    A node goes on beyond a neighbour only if all of the neighbour has it in common (`inner`).
    """
    owners: list[int] = []
    at, depth = k, shared[k - 1] if k else -1
    while depth >= 0:
        at -= 1
        rest = min(depth, inner[at], shared[at - 1] if at else -1)
        owners += [at] * (depth - rest)
        depth = rest
    lasts: list[int] = []
    at, depth = k, shared[k] if k < len(shared) else -1
    while depth >= 0:
        at += 1
        rest = min(depth, inner[at], shared[at] if at < len(shared) else -1)
        lasts += [at] * (depth - rest)
        depth = rest
    return owners[::-1], lasts[::-1]


def _forest(batches: Iterator[pa.RecordBatch], parts: list[int], shared: list[int], inner: list[int]) -> Iterator[pa.RecordBatch]:
    """The closed nodes of a sorted partition, and its parts of the open ones."""
    keys: list[bytes] = []
    ids: list[int] = []
    chars: list[np.ndarray] = []
    number = None
    for batch in batches:
        if batch.num_rows:
            number = batch.column(3)[0].as_py()
            ids += batch.column(0).to_pylist()
            keys += batch.column(1).to_pylist()
            chars.append(np.asarray(batch.column(2).flatten(), dtype=np.int64))
    if not keys:
        return
    k, m = parts.index(number), len(keys)
    owners, lasts = _open_names(k, shared, inner)
    flat = np.concatenate(chars)
    turns = [len(x) // WIDTH for x in keys]
    start = np.concatenate([[0], np.cumsum(turns)]).tolist()
    depth, low, high, parent = merge_tree(turns, [common_turns(keys[i], keys[i + 1]) for i in range(m - 1)])
    count = len(depth)
    below: list[list[int]] = [[0, 0, 0, 0] for _ in range(count)]  # closed leaves, closed saved, closed children, all children
    least = ids + [1 << 63] * (count - m)

    def owner(v: int, d: int) -> int | None:
        """Who owns the node at depth d on the way down to v, if it is open."""
        if low[v] == 0 and d < len(owners):
            return owners[d]
        return k if high[v] == m - 1 and d < len(lasts) else None

    alive = [v for v in range(count) if parent[v] != -2]
    at = 0
    for v in range(m):  # rows that end together are one node, that of the first of them
        at = at if parent[v] == -2 else v
        least[at] = min(least[at], ids[v])
    out: list[tuple] = []
    for v in sorted(alive, key=lambda v: -depth[v]):
        u = parent[v]
        above, n = depth[u] if u >= 0 else -1, high[v] - low[v] + 1
        leaves, saved, kids, all_kids = below[v]
        ending = 0
        while low[v] + ending <= high[v] and turns[low[v] + ending] == depth[v]:
            ending += 1
        if u >= 0:
            least[u] = min(least[u], least[v])
        row = start[low[v]]
        for d in range(depth[v], above, -1):
            own, size = owner(v, d), int(flat[row + d - 1]) if d else 0
            here = ids[low[v] : low[v] + ending] if d == depth[v] else []
            over = (owner(v, d - 1) if d - 1 > above else owner(u, d - 1)) if d else None
            if own is None:
                leaves, saved = leaves or 1, saved + (n - 1) * size
                ends = hashlib.sha256(",".join(map(str, here)).encode()).hexdigest()
                out.append([CLOSED, k, None, d, None, over, v, None if over is not None or not d else v if d - 1 > above else u, n, all_kids if d == depth[v] else 1, leaves, saved, None, None, ends])
                kids = 1
            else:
                mine = own == k
                out.append([OPEN, k, own, d, lasts[d] if mine else None, over if mine else None, v, None, n, kids, leaves, saved, size, None, None])
                for p in range(0, len(here), PIECE):
                    out.append([IDS, k, own, d, None, None, None, None, None, None, None, None, None, p // PIECE, ",".join(map(str, here[p : p + PIECE]))])
                leaves = saved = kids = 0
        if u >= 0:
            closed = owner(v, above + 1) is None
            for j, x in enumerate((leaves, saved, 1) if closed else (0, 0, 0)):
                below[u][j] += x
            below[u][3] += 1
    schema = [(n.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[n.split()[1]]) for n in FOREST.split(", ")]
    for i in range(0, len(out), 10_000):
        some = out[i : i + 10_000]
        for r in some:  # nodes stand for their smallest members, known only now
            r[6], r[7] = (None if x is None else least[x] for x in r[6:8])
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in some], t) for j, (_, t) in enumerate(schema)], [n for n, _ in schema])


def _outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last conversation of a partition."""
    first = last = number = None
    for batch in batches:
        if batch.num_rows:
            first = batch.column(0)[0].as_py() if first is None else first
            last, number = batch.column(0)[batch.num_rows - 1].as_py(), batch.column(1)[0].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())], ["part", "first", "last"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        before, first, last = (batch.column(j).to_pylist() for j in (1, 2, 3))
        shared = [-1 if a is None else common_turns(a, b) for a, b in zip(before, first, strict=True)]
        inner = [common_turns(a, b) for a, b in zip(first, last, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.int64()), pa.array(inner, pa.int64())], ["part", "shared", "inner"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of ids of each node, piece by piece in their order."""
    name, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int64()), pa.array([state.hexdigest()])], ["owner", "depth", "ends_sha256"])

    for batch in batches:
        for owner, depth, ends in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
            if (owner, depth) == name:
                state.update(b",")
            else:
                if name is not None:
                    yield done()
                name, state = (owner, depth), hashlib.sha256()
            state.update(ends.encode())
    if name is not None:
        yield done()


def conversation_rows(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: conv_id, key (the digests of its turns in order, 16 bytes each), chars (code points of its texts).

    Turns come by number, null first, and those of one number by their digests. Null roles and
    texts are empty. Rows without a conv_id belong to no conversation.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.md5(F.encode(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), "UTF-8"))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(said).alias("chars")).alias("t"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("key"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def with_shared_heads(rows: DataFrame, group: int = 100, modulus: int = 6) -> DataFrame:
    """Conversations rebuilt: the first h turns are those of conversation c - c % group, the rest their own after the first h.

    h is the unsigned CRC-32 of the decimal id modulo `modulus`; a conversation that is not there gives no turns.
    """
    most = modulus - 1
    heads = rows.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.expr(f"substring(key, 1, {WIDTH * most})").alias("head"), F.slice("chars", 1, most).alias("head_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("int")
    own = rows.withColumn("head_id", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    j = own.join(heads, "head_id", "left")
    key = F.expr(f"concat(coalesce(substring(head, 1, {WIDTH} * h), X''), substring(key, {WIDTH} * h + 1))")
    chars = F.expr("concat(coalesce(slice(head_chars, 1, h), array()), slice(chars, h + 1, greatest(size(chars), 1)))")
    return j.select("conv_id", key.alias("key"), chars.alias("chars"))


def prefix_trie(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, key, chars as from `conversation_rows`).

    A node is a distinct beginning; its members are the conversations that start with it. Returns
    per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over
    its subtree, members but one times code points of the last text), ends_sha256 (digest of the
    ascending ids of those that end there). Conversations without turns are members of the root
    alone. An empty table has no nodes. conv_ids must be distinct. A conversation is held by one
    task, 20 bytes a turn; equal ones are spread over partitions by their ids, and lists of ids
    are hashed in a stream. To the driver go three numbers a partition.
    """
    order = ["key", "conv_id"]
    dealt = rows.select("conv_id", "key", F.transform("chars", lambda x: x.cast("long")).alias("chars"))
    dealt = dealt.repartitionByRange(partitions, *order) if partitions else dealt.repartitionByRange(*order)
    dealt = checkpoint(dealt.sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    outer = dealt.select("key", "part").mapInArrow(_outer, "part int, first binary, last binary")
    edges = outer.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"), "first", "last").mapInArrow(_shared, "part int, shared long, inner long").orderBy("part").collect()  # one a partition
    parts, shared, inner = [r["part"] for r in edges], [r["shared"] for r in edges[1:]], [r["inner"] for r in edges]
    forest = checkpoint(dealt.mapInArrow(partial(_forest, parts=parts, shared=shared, inner=inner), FOREST))
    names = ["owner", "depth"]
    some = forest.where(F.col("kind") == OPEN)
    merged = some.groupBy(*names).agg(F.min("conv_id").alias("conv_id"), F.max("last").alias("last"), F.max("parent_owner").alias("parent_owner"), F.max("chars").alias("chars"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    merged = checkpoint(merged)
    kids = merged.where("parent_owner is not null").groupBy(F.col("parent_owner").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("open_children"))
    nodes = merged.join(kids, names, "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("chars"))
    # The subtree of a node: the deeper nodes of its owner, and all of the owners up to its last partition.
    deeper = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    run = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = nodes.groupBy("owner").agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    at = rows.sparkSession.range(len(parts) + 1).select(F.col("id").cast("int").alias("at"))
    before = at.join(totals.withColumnRenamed("owner", "at"), "at", "left").select("at", F.coalesce(F.sum("l").over(run), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(run), F.lit(0)).alias("s"))
    upto = before.select(F.col("at").alias("last"), F.col("l").alias("l_end"), F.col("s").alias("s_end"))
    since = before.select((F.col("at") - 1).alias("owner"), F.col("l").alias("l_start"), F.col("s").alias("s_start"))
    nodes = nodes.withColumn("l_own", F.sum("n_leaves").over(deeper)).withColumn("s_own", F.sum("saved").over(deeper)).join(upto, "last").join(since, "owner")
    between = lambda k: F.col(f"{k}_own") + F.greatest(F.lit(0), F.col(f"{k}_end") - F.col(f"{k}_start"))
    pieces = forest.where(F.col("kind") == IDS).select("owner", "depth", "ends", "part", "piece").repartition(*names).sortWithinPartitions(*names, "part", "piece")
    ends = pieces.mapInArrow(_digests, "owner int, depth long, ends_sha256 string")
    above = merged.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("over"))
    nodes = nodes.join(ends, names, "left").join(above, ["parent_owner", "depth"], "left")
    nodes = nodes.select("conv_id", "depth", F.col("over").alias("parent_conv_id"), "n_convs", "n_children", between("l").alias("n_leaves"), between("s").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    # Parents of closed nodes that are open are looked up by partition as well, so no name is hot.
    local = some.select("part", *names).join(merged.select(*names, F.col("conv_id").alias("over")), names).select("part", F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), "over")
    closed = forest.where(F.col("kind") == CLOSED).select("part", "parent_owner", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends").join(local, ["part", "parent_owner", "depth"], "left")
    closed = closed.select("conv_id", "depth", F.coalesce("parent_conv_id", "over").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
    return closed.unionByName(nodes).select(*NODE)
