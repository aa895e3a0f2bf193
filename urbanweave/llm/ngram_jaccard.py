"""Exact Jaccard join on word n-grams by universe partition and the pigeonhole principle.

Documents become sets of hashed n-grams. Sizes fall into bands, so that only equal or
neighbouring bands can link. In a band the symmetric difference of a linked pair is at
most H, so when the universe is hashed into segments with allowances that sum to H + 1,
at least one segment of both sets differs by less than its allowance: an allowance of 1
asks for equal segments, one of 2 is served by the segment and its one-deletion
neighbourhood. Empty segments count only together with others (see _keys). How many segments get which allowance is chosen per band by expected cost.

Sets that share a segment key meet in a bucket. Within it leaders are chosen, and a set is
tied to every leader that a set linked with it may be near to, by a distance that is never
larger than the number of n-grams in which two sets differ. What is tied together is a
family: no link leads out of it. Families are verified exactly, in pairs of blocks whose
sets travel as their differences from one set of the family, and every pair of blocks
returns star edges and numbers of links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.arrays import giving_back, mix, signed, slices, words
from urbanweave.llm.spark import BROADCAST_ROWS, checkpoint, components, fitted, look_up

_U = np.uint64
#: Sets of a block of a family, and of a block of a bucket.
BLOCK, BUCKET = 512, 4096
#: Rows of a task that works on many blocks, or on many buckets, one after the other.
TASK_ROWS = 20_000
#: Segments of a group in which empty segments make keys with others.
GROUP = 16
#: Text of a slice whose keys are packed together, and tokens (about as many keys) of all sets for every range of keys.
SIGNED_BYTES, RANGE_TOKENS = 1 << 22, 3_000_000
#: Cost of a chance meeting relative to one emitted key, and the chance that another set agrees on one token.
COLLISION_COST, TOKEN_AGREES = 50.0, 0.1
#: How much larger the largest size of a band is than its smallest: wide bands give fewer sets keys of two bands,
#: narrow ones more tokens a segment and so fewer chance meetings.
BAND_WIDTH = 1.25


@lru_cache(maxsize=16)
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each band up to `largest`, its number of segments, and how many of them get allowance 2.

    A set of a band links only with sets of that band and of the bands beside it.
    """
    steps = max(1, round(math.log(BAND_WIDTH) / math.log(den / num))) if num < den else 1
    first = [1]
    while len(first) < 3 or first[-3] <= largest:
        low = first[-1]
        near = den * (low - 1) // num  # sizes that link with the band before
        far = int(low * (den / num) ** steps + 1e-9)
        first.append(max(low + 1, near + 1, far))
    segments, double = [], []
    for low, high in zip(first, first[1:], strict=False):
        size = (low + high - 1) / 2
        need = 2 * (high - 1) * (den - num) // (den + num) + 1
        m = np.arange((need + 1) // 2, need + 1)
        stay = 1 - (1 - TOKEN_AGREES) / m
        equal, one_off = stay**size, size / m * stay ** max(size - 1, 0)
        two = need - m
        cost = (m - two) * (1 + COLLISION_COST * equal) + two * (1 + size / m + COLLISION_COST * (equal + one_off))
        best = int(np.argmin(cost))
        segments.append(int(m[best]))
        double.append(int(two[best]))
    return np.array(first), np.array(segments), np.array(double)


def shingle_sets(text: pa.Array, shingle: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, sorted within the row, with the n+1 row offsets.

    A row of fewer words than `shingle` has its whole sequence as one n-gram; a row without
    words has none.
    """
    w = words(text, lower=lower)
    counts, rows = w.counts, w.row
    found = []
    for k in range(1, shingle + 1):
        if k < shingle and not (counts == k).any():
            continue
        at, value = w.runs(k)
        keep = slice(None) if k == shingle else counts[rows[at]] == k
        found.append((rows[at][keep], value[keep]))
    row, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def _identities(value: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit identities of every set (0 for the empty set)."""
    sizes = np.diff(offsets).astype(np.uint64)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ _U(salt)), dtype=np.uint64)])
        out.append(signed(np.where(sizes > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + sizes), 0).astype(np.uint64)))
    return out[0], out[1]


def _sketches(value: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Per set, the parity of the number of tokens hashed to each of its bits: a power of two, two bits a token or more."""
    sizes = np.diff(offsets)
    bits = 64 << np.ceil(np.log2(np.maximum(sizes, 32) / 32)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    own = (mix(value ^ _U(0x2545F4914F6CDD1D)) & np.repeat(bits - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(base[:-1], sizes) + own, minlength=base[-1]).astype(np.uint8) & 1
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a >> 3 : b >> 3] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


@giving_back
def _digests(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, offsets = shingle_sets(part.column(1), shingle)
            node, check = _identities(value, offsets)
            arrays = [part.column(0), part.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(node), pa.array(check), pa.array(_sketches(value, offsets), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "n", "node", "check", "sketch"])


def _keys(value: np.ndarray, sizes: np.ndarray, scheme: np.ndarray, segments: np.ndarray, double: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment keys of sets (tokens one after the other) under one band each, and the set that each key belongs to.

    A share of all sets has any given segment empty, so an empty segment as a key would be a
    hot one. Groups of segments split H + 1 between them, so in one group of g segments a
    linked pair differs by less than g. If it agrees in no segment of the group but c empty
    ones, the others differ by 1 at least, and fewer than c of them by more. So with one of
    the empty segments, any c further segments hold one that is equal or one deletion apart:
    an empty segment makes its keys together with as many segments after it (around the
    group) as the set has empty segments in the group, and their one-deletion neighbourhoods.
    """
    m = segments[scheme]
    base = np.concatenate([[0], np.cumsum(m)])
    token_scheme = np.repeat(scheme, sizes).astype(np.uint64)
    segment = (mix(value + token_scheme * _U(0xA0761D6478BD642F)) % np.repeat(m, sizes).astype(np.uint64)).astype(np.int64)
    place = np.repeat(base[:-1], sizes) + segment
    code = mix(value ^ _U(0xE7037ED1A0B428DB))
    order = np.argsort(place, kind="stable")
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[order], dtype=np.uint64)])
    ends = np.searchsorted(place[order], np.arange(base[-1] + 1))
    total = sums[ends[1:]] - sums[ends[:-1]]
    inside = np.arange(base[-1]) - np.repeat(base[:-1], m)
    tag = mix(np.repeat(scheme, m).astype(np.uint64) * _U(0x8EBC6AF09C88C6E3) + inside.astype(np.uint64))
    owner_of = np.repeat(np.arange(len(m)), m)
    # Empty segments that need no key of their own: those of a group of segments with an allowance of 1 each.
    groups = np.maximum(1, m // GROUP)
    m_of, groups_of = np.repeat(m, m), np.repeat(groups, m)
    group = inside * groups_of // m_of
    low = -(-group * m_of // groups_of)
    width = -(-(group + 1) * m_of // groups_of) - low
    empty = (np.diff(ends) == 0) & (np.repeat(double[scheme], m) == 0) & (width > 1)
    keys, owner = [mix(total ^ tag)[~empty]], [owner_of[~empty]]
    if empty.any():
        at = np.flatnonzero(empty)
        group = (np.repeat(np.cumsum(groups) - groups, m) + group)[at]
        partners = np.minimum(np.bincount(group)[group], width[at] - 1)
        step = np.arange(int(partners.sum())) - np.repeat(np.cumsum(partners) - partners, partners) + 1
        at = np.repeat(at, partners)
        other = base[owner_of[at]] + low[at] + (inside[at] - low[at] + step) % width[at]
        salt = mix(tag[at] + _U(0x9FB21C651E98DF25))
        keys.append(mix(total[other] ^ tag[other] ^ salt))
        owner.append(owner_of[at])
        size = ends[other + 1] - ends[other]
        token = np.repeat(ends[other] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        other, salt, at = (np.repeat(x, size) for x in (other, salt, at))
        keys.append(mix((total[other] - code[order[token]]) ^ tag[other] ^ salt))
        owner.append(owner_of[at])
    two = np.flatnonzero(segment < np.repeat(double[scheme], sizes))
    if len(two):
        keys.append(mix((total[place[two]] - code[two]) ^ tag[place[two]]))
        owner.append(np.repeat(np.arange(len(m)), sizes)[two])
    return np.concatenate(keys), np.concatenate(owner)


@giving_back
def _signatures(batches: Iterator[pa.RecordBatch], shingle: int, num: int, den: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Keys of all sets, packed: (part, keys, nodes), a row for every range of keys in a slice.

    A key is 8 bytes: its lowest 48 bits and the place of its set among the nodes of the row.
    Sets that share a key within a slice need no other to know it: their whole keys go, one
    node a key, to a part below 0. One of them goes on to meet the sets of other slices, so
    that a frequent key is 8 bytes a slice and not a set.
    """
    seen: set[int] = set()  # a set that repeats within this task is emitted once
    # Slices of one content in many tasks, as copies of a table have them, go to different parts.
    task = TaskContext.get()
    task_salt = mix(np.array([task.partitionId() if task else 0], dtype=np.uint64))
    for batch in batches:
        rows: list[list] = [[], [], []]
        for part in slices(batch, limit=SIGNED_BYTES):
            value, offsets = shingle_sets(part.column(0), shingle)
            node, _ = _identities(value, offsets)
            sizes = np.diff(offsets)
            fresh = np.zeros(len(node), dtype=bool)
            for i, x in enumerate(node.tolist()):
                if sizes[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            if not fresh.any():
                continue
            value, node, sizes = value[np.repeat(fresh, sizes)], node[fresh], sizes[fresh]
            first, segments, double = bands(num, den, 1 << max(10, int(sizes.max()).bit_length()))
            own = np.searchsorted(first, sizes, side="right") - 1
            up = den * sizes // num >= first[own + 1]  # some linked set may lie in the next band
            both = [_keys(value, sizes, own, segments, double)]
            if up.any():
                key, owner = _keys(value[np.repeat(up, sizes)], sizes[up], own[up] + 1, segments, double)
                both.append((key, np.flatnonzero(up)[owner]))
            key, owner = (np.concatenate(x) for x in zip(*both, strict=True))
            place = (((key >> _U(48)) * _U(ranges)) >> _U(16)) << _U(48)
            key = place | (key & _U((1 << 48) - 1))
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner = key[new], owner[new]
            head = np.ones(len(key), dtype=bool)
            head[1:] = key[1:] != key[:-1]
            count = np.diff(np.append(np.flatnonzero(head), len(key)))
            shared = np.repeat(count > 1, count)
            if shared.any():
                for column, x in zip(rows, (-1 - int(mix(node[:1].view(np.uint64) + task_salt)[0] % _U(ranges)), key[shared].tobytes(), node[owner[shared]].tobytes()), strict=True):
                    column.append(x)
            key, owner = key[head], owner[head]
            part_of = key >> _U(48)
            for low, high in _runs(part_of):
                for at in range(low, high, 1 << 16):
                    to = min(high, at + (1 << 16))
                    names, index = np.unique(owner[at:to], return_inverse=True)
                    for column, x in zip(rows, (int(part_of[at]), ((key[at:to] << _U(16)) | index.astype(np.uint64)).tobytes(), node[names].tobytes()), strict=True):
                        column.append(x)
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "nodes"])


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of every run of equal values."""
    edge = np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist()
    return list(zip(edge, [*edge[1:], len(x)], strict=True))


@giving_back
def _meet(table: pa.Table) -> pa.Table:
    """Rows (key, node) of all keys of one part that two different sets share."""
    part = table.column("part")[0].as_py()
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    nodes = [np.frombuffer(x, np.int64) for x in table.column("nodes").to_pylist()]
    if part >= 0:
        nodes = [n[(k & _U(0xFFFF)).astype(np.int64)] for k, n in zip(keys, nodes, strict=True)]
    key, node = np.concatenate(keys), np.concatenate(nodes)
    if part >= 0:
        key >>= _U(16)
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        differ = np.minimum.reduceat(node, edge) < np.maximum.reduceat(node, edge)
        keep = np.repeat(differ, np.diff(np.append(edge, len(key))))
        key, node = key[keep] | _U(part << 48), node[keep]
    return pa.table({"key": pa.array(signed(key)), "node": pa.array(node)})


def _tie(bucket: np.ndarray, n: np.ndarray, sketch: list[bytes], radius: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tie the sets of every bucket to leaders: (rows, rows of their leaders, rows that lead).

    bucket: ascending. Leaders are chosen one after the other among the sets that no leader
    has within their `radius`; every set is tied to all leaders within its `reach`.
    """
    tied, leaders = [], []
    size = np.array([len(s) >> 3 for s in sketch], dtype=np.int64)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    least = np.minimum.reduceat(size, start)
    group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(bucket))))
    for width in np.unique(least):
        rows = np.flatnonzero(least[group] == width)
        # Sketches of more bits fold to fewer: the parity of a bit is that of all bits that fall on it.
        s = np.empty((len(rows), width), dtype=np.uint64)
        for w in np.unique(size[rows]):
            k = np.flatnonzero(size[rows] == w)
            s[k] = np.bitwise_xor.reduce(np.frombuffer(b"".join(sketch[i] for i in rows[k]), np.uint64).reshape(len(k), w // width, width), axis=1)
        homeless = np.ones(len(rows), dtype=bool)
        active = np.arange(len(rows))
        while len(active):
            g = group[rows[active]]
            head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            count = np.diff(np.append(head, len(active)))
            lead = np.minimum.reduceat(np.where(homeless[active], active, len(rows)), head)
            leaders.append(rows[lead])
            lead = np.repeat(lead, count)
            apart = np.bitwise_count(s[active] ^ s[lead]).sum(axis=1, dtype=np.int64)
            apart = np.maximum(apart, np.abs(n[rows[active]] - n[rows[lead]]))
            near = (apart <= reach[rows[active]]) & (active != lead)
            tied.append(np.stack([rows[active[near]], rows[lead[near]]]))
            homeless[active[(apart <= radius[rows[active]]) | (active == lead)]] = False
            active = active[np.repeat(np.add.reduceat(homeless[active], head) > 0, count)]
    a, b = np.concatenate(tied, axis=1) if tied else np.zeros((2, 0), np.int64)
    return a, b, np.concatenate(leaders) if leaders else np.zeros(0, np.int64)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges as stars: every node but the smallest of its component, and that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def _tie_buckets(num: int, den: int, split: bool):
    """Star edges of what the leaders of many buckets tie together, and the leaders of buckets that are split.

    A linked set has at most n (den - num) / num tokens that its partner has not, or the
    other way round. With split buckets, leaders of two parts are tied if sets near them may link.
    """

    @giving_back
    def run(table: pa.Table) -> pa.Table:
        bucket, salt, node, n = (np.asarray(table.column(c), dtype=np.int64) for c in ("bucket", "salt", "node", "n"))
        order = np.lexsort((node, salt, bucket))
        bucket, salt, node, n = bucket[order], salt[order], node[order], n[order]
        sketch = table.column("sketch").to_pylist()
        sketch = [sketch[i] for i in order]
        place = np.cumsum(np.append(False, (np.diff(bucket) != 0) | (np.diff(salt) != 0)))
        less = den - num
        if split:
            # Near sets have at most n / (1 - less / 2 num) tokens.
            most = (n * (2 * num)) // (2 * num - less) + 1
            radius = np.full(len(n), -1)
            reach = most * less * (3 * num + den) // (2 * num * num) + 2
        else:
            radius = n * less // (2 * num)
            reach = (2 * num * n * less + n * den * less) // (2 * num * num)
        a, b, leaders = _tie(place, n, sketch, radius, reach)
        pairs = _stars(node[a], node[b])
        lead = leaders[np.asarray(table.column("split"), dtype=bool)[order][leaders]]
        return pa.table({
            "a": pa.array(np.concatenate([pairs[0], node[lead]])), "b": pa.array(np.concatenate([pairs[1], node[lead]])),
            "bucket": pa.array(np.concatenate([np.zeros(len(pairs[0]), np.int64), bucket[lead]])), "leads": pa.array(np.arange(len(pairs[0]) + len(lead)) >= len(pairs[0])),
        })

    return run


@giving_back
def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, offsets = shingle_sets(part.column(0), shingle)
            node, _ = _identities(value, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([value[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], ["node", "tokens"])


@giving_back
def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that a set has beyond its family's first set as they are, and those that it lacks as their complements."""
    for batch in batches:
        rows: list[list] = [[], [], []]
        for mine, base in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            mine, base = np.frombuffer(mine, np.uint64), np.frombuffer(base, np.uint64)
            more, lacks = np.setdiff1d(mine, base, assume_unique=True), np.setdiff1d(base, mine, assume_unique=True)
            for column, x in zip(rows, (len(mine), len(lacks), np.concatenate([more, ~lacks]).tobytes()), strict=True):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.binary()), strict=True))], ["node", "component", "n", "lacks", "apart"])


def _links(sets: list[np.ndarray], n: np.ndarray, lacks: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of a block link, exactly: with differences from one base, |A and B| = |base| - lacks(A) - lacks(B) + shared differences."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = times[token] > 1
    new_id = np.cumsum(times > 1) - 1
    token, owner = new_id[token[shared]], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 4096
    for low in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [low, low + width])
        m = np.zeros((len(sets), min(width, int(token[-1]) + 1 - low)), dtype=np.float32)
        m[owner[a:b], token[a:b] - low] = 1
        both += m @ m.T
    base = int(n[0] - (size[0] - lacks[0]) + lacks[0])
    both += base - lacks[:, None] - lacks[None, :]
    link = den * both >= num * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(link, False)
    return link


def _verify(num: int, den: int):
    """Exact check of all pairs of pairs of blocks: star edges of what links, and every set's number of links."""

    @giving_back
    def run(table: pa.Table) -> pa.Table:
        component, i, j, blk, node, n, lacks = (np.asarray(table.column(c), dtype=np.int64) for c in ("component", "i", "j", "blk", "node", "n", "lacks"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("apart").to_pylist()]
        order = np.lexsort((node, j, i, component))
        cut = np.flatnonzero((np.diff(component[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        found: list[list[np.ndarray]] = [[], [], []]
        for rows in np.split(order, cut):
            rows = rows[np.append(True, np.diff(node[rows]) != 0)]  # rows that share a doc_id may bring a set twice
            if len(rows) < 2:
                continue
            link = _links([sets[k] for k in rows], n[rows], lacks[rows], num, den)
            if i[rows[0]] != j[rows[0]]:
                link &= blk[rows][:, None] != blk[rows][None, :]
            degree = link.sum(axis=1)
            at = np.flatnonzero(degree)
            if not len(at):
                continue
            label = np.arange(len(rows))
            while True:
                least = np.minimum(label, np.where(link, label[None, :], len(rows)).min(axis=1))
                if (least == label).all():
                    break
                label = least
            for column, x in zip(found, (node[rows][at], node[rows][label[at]], degree[at]), strict=True):
                column.append(x)
        return pa.table({c: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for c, x in zip(("a", "b", "degree"), found, strict=True)})

    return run


def _dealt(df: DataFrame, keys: list[str], n: int, rows: int = TASK_ROWS) -> DataFrame:
    """Groups of equal keys dealt to parts of about `rows` rows, so that a task's memory is bounded and small groups share a call."""
    return df.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(1 + n // rows)).cast("int")).groupBy("part")


def families(sketches: DataFrame, members: DataFrame, n_members: int, num: int, den: int) -> DataFrame:
    """Pairs of sets (a, b) whose components hold every link.

    sketches: node, n, sketch. members: bucket, node, size (of the bucket), n_members in number.
    """
    schema = "a long, b long, bucket long, leads boolean"
    columns = ["bucket", "salt", "node", "n", "sketch", "split"]
    parts = F.ceil(F.col("size") / BUCKET)
    drawn = members.join(sketches, "node").withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("split", parts > 1)
    near = checkpoint(_dealt(drawn.select(*columns), ["bucket", "salt"], n_members).applyInArrow(_tie_buckets(num, den, split=False), schema))
    edges = near.where(~F.col("leads")).select("a", "b")
    # Parts of a split bucket meet by their leaders, in pairs of blocks of leaders.
    wide = members.where(parts > 1).select("bucket").distinct()
    if not wide.isEmpty():
        leaders = near.where("leads").join(wide, "bucket").select("bucket", F.col("a").alias("node")).distinct()
        counts = leaders.groupBy("bucket").agg(F.ceil(F.count("*") / (BUCKET // 2)).cast("int").alias("blocks"))
        dealt = leaders.join(counts, "bucket").withColumn("blk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        salt = F.least("blk", "other") * F.lit(1 << 20) + F.greatest("blk", "other")
        dealt, n_dealt = fitted(dealt.select("bucket", "node", salt.alias("salt")))
        met = _dealt(dealt.join(sketches, "node").withColumn("split", F.lit(False)).select(*columns), ["bucket", "salt"], n_dealt).applyInArrow(_tie_buckets(num, den, split=True), schema)
        edges = edges.union(met.select("a", "b"))
    return edges.distinct()


def key_ranges(nodes: DataFrame) -> int:
    """Ranges of keys for sets (n, copies), so that a range has about RANGE_TOKENS keys of all rows.

    Copies count: each task that meets a set signs it once more, so that as many keys may come as the rows have tokens.
    """
    tokens = nodes.agg(F.sum(F.col("n") * F.col("copies"))).first()[0] or 0
    return min(1 << 16, 8 + tokens // RANGE_TOKENS)


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 8, den: int = 10, doc_id: str = "doc_id", text: str = "text", with_mark: bool = False) -> DataFrame:
    """Connected components of the links `den * |A and B| >= num * |A or B|` between documents.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links
    (number of other, different sets that link with this one) and, on request, mark (a hash
    of the text, which tells rows with one doc_id apart). Null or wordless text has an empty
    set, links with nothing and is its own component. Repeated rows stay repeated, and equal
    sets are one component. A null doc_id is a row like any other but never a component_id,
    unless all of the component are null. Texts of any length are read whole. An empty table
    gives an empty result. Extra columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digests = checkpoint(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(partial(_digests, shingle=shingle), "doc_id long, mark long, n long, node long, check long, sketch binary"))
    nodes = digests.where("n > 0").groupBy("node", "check").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = checkpoint(nodes)
    n_rows = nodes.agg(F.sum("copies")).first()[0] or 0

    # Keys that two sets share: packed by range of keys, so that the shuffle carries 8 bytes a key.
    ranges = key_ranges(nodes)
    keys = docs.select("text").mapInArrow(partial(_signatures, shingle=shingle, num=num, den=den, ranges=ranges), "part int, keys binary, nodes binary")
    shared = checkpoint(keys.groupBy("part").applyInArrow(_meet, "key long, node long").distinct())
    # Buckets of the same sets are one bucket.
    buckets = shared.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("size")).where("size > 1")
    buckets = buckets.select("key", F.xxhash64("x", "y", "size").alias("bucket"), "size")
    members, n_members = fitted(shared.join(buckets, "key").select("bucket", "node", "size").distinct())
    sketches = nodes.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    edges = families(sketches, members, n_members, num, den)
    family, n_family = fitted(components(edges))

    # Sets of the families, from one document each, as differences from the first set of the family.
    asked, n_asked = fitted(nodes.join(family.select("node"), "node", "left_semi").select(F.col("least").alias("asked")).distinct())
    texts = docs.join(F.broadcast(asked) if n_asked <= BROADCAST_ROWS else asked, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi").select("text")
    sets = checkpoint(texts.mapInArrow(partial(_sets, shingle=shingle), "node long, tokens binary").join(family, "node").select("node", "component", "tokens"))
    base = sets.where("node = component").select("component", F.col("tokens").alias("base"))
    apart = sets.join(base, "component").select("node", "component", "tokens", "base").mapInArrow(_differences, "node long, component long, n long, lacks long, apart binary")
    apart = checkpoint(apart)
    counts = family.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    counts, _ = fitted(counts)
    n_dealt = counts.agg(F.sum(F.col("m") * F.col("blocks"))).first()[0] or 0
    dealt = apart.join(counts, "component").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "n", "lacks", "apart")
    found = checkpoint(_dealt(dealt, ["component", "i", "j"], n_dealt, 4096).applyInArrow(_verify(num, den), "a long, b long, degree long"))

    # One row a set: its component and its number of links; then one look-up a document.
    labels = components(found).select("node", F.col("component").alias("root"))
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("degree").alias("n_links"))
    nodes = nodes.select("node", "check", "least", "copies").join(labels, "node", "left").join(degree, "node", "left")
    # Different sets that share the 64-bit node keep apart unless links join them.
    nodes = nodes.select("node", "check", "least", "copies", "n_links", F.coalesce("root", "node").alias("root"), F.when(F.col("n_links").isNull(), F.col("check")).otherwise(F.lit(0)).alias("apart"))
    nodes = checkpoint(nodes)
    smallest = nodes.groupBy("root", "apart").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(smallest, ["root", "apart"]).select(F.xxhash64("node", "check").alias("class"), "copies", "n_links", "component_id")
    rows = digests.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.xxhash64("node", "check")).otherwise(F.xxhash64(F.lit("alone"), "doc_id", "mark")).alias("class"))
    out = look_up(rows, nodes, "class", n_rows, F.xxhash64(F.lit("spread"), "doc_id", "mark"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *["mark"] * with_mark)
