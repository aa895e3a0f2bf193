"""The trie of conversations against sets of prefixes, at one partition and at many."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from urbanweave.llm import queries as Q
from urbanweave.llm.prefix_trie import common_turns, conversation_rows, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)) for p, m in members.items()}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def made_up(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in sorted(rng.sample(range(2 * n), n)):
        if rng.random() < 0.2:
            turns = ["same", "conversation", "all along"][: rng.choice([1, 2, 3, 3])]
        else:
            turns = [rng.choice("abc") * rng.randint(0, 2) for _ in range(rng.randint(1, 7))]
        rows += [(c, t if rng.random() < 0.98 else None, rng.choice(["user", None, ""]) if rng.random() < 0.1 else "user", x or None) for t, x in enumerate(turns)]
    return rows


@pytest.mark.parametrize("partitions", [1, 2, 5, 23, 60])
def test_matches_sets_of_prefixes(spark, partitions):
    for seed in (1, 2):
        rows = made_up(seed, 330) + [(None, 0, "user", "nobody's")]
        df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("depth", F.lit(1))
        assert found(prefix_trie(with_shared_heads(conversation_rows(df)), partitions)) == plain(rows)


def test_copies_and_one_long_conversation_over_boundaries(spark):
    rows = [(100 + c, t, "user", "twin") for c in range(60) for t in range(3)] + [(c, t, "user", f"{t}") for c in (7, 8) for t in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie(with_shared_heads(conversation_rows(df)), 17)) == plain(rows)


def test_repeated_rows_are_turns_and_empty_tables_have_no_nodes(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(prefix_trie(with_shared_heads(conversation_rows(df)))) == plain(rows)
    assert prefix_trie(with_shared_heads(conversation_rows(df.limit(0)))).count() == 0


def test_turns_in_common():
    unit = [bytes([k]) * 16 for k in range(4)]
    for n in (0, 1, 2, 3, 7, 8, 9, 100):
        a = b"".join(unit[k % 3] for k in range(n))
        assert common_turns(a + unit[3], a + unit[0]) == (n + 1 if n % 3 == 3 else n)
        assert common_turns(a, a + unit[0]) == n


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.01/conversations.parquet')")
    rel = con.sql(Q.ORACLE_SQL["op12_prefix_trie"])
    df = Q.op12_prefix_trie(spark, "/root/testdata/sf0.01")
    assert rel.columns == df.columns
    assert found(df) == sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in rel.fetchall())
