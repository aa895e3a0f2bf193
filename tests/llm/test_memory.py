"""Memory that tasks leave behind in processes that live on."""

import numpy as np
import pyarrow as pa

from urbanweave.llm import language_id, ngram_jaccard, packing, substring_dedup
from urbanweave.llm.arrays import giving_back


def resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20


def test_a_task_gives_its_memory_back():
    def batches(n):
        kept = [np.ones(1 << 15) for _ in range(1600)]  # 400 MB in pieces that the C library keeps
        kept.append(pa.array(np.arange(1 << 22)).cast(pa.string()))
        for _ in range(n):
            yield len(kept)

    list(giving_back(batches)(1))
    before = resident()
    assert list(giving_back(batches)(3)) == [1601] * 3
    assert resident() < before + 50
    assert giving_back(lambda table: table + 1)(1) == 2


def test_all_tasks_of_the_pipeline_give_back():
    tasks = {language_id: ["_accept", "_predict", "_word_counts"], ngram_jaccard: ["_digests", "_signatures", "_meet", "_sets", "_differences"], substring_dedup: ["_emit_anchors", "_emit_windows", "_cut"], packing: ["_pieces"]}
    for module, names in tasks.items():
        for name in names:
            assert hasattr(getattr(module, name), "__wrapped__"), name
    assert hasattr(ngram_jaccard._tie_buckets(8, 10, False), "__wrapped__") and hasattr(ngram_jaccard._verify(8, 10), "__wrapped__")


def test_ranges_of_keys_follow_all_copies(spark, monkeypatch):
    """Every task that meets a copy signs it again: the keys of one range must not grow with the copies."""
    import functools

    from urbanweave.llm import ngram_jaccard as J

    asked = []
    monkeypatch.setattr(J, "RANGE_TOKENS", 500)
    monkeypatch.setattr(J, "partial", lambda f, **k: (asked.append(k), functools.partial(f, **k))[1])
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(64))
    docs = spark.createDataFrame([(c * 10 + k, text(k)) for c in range(20) for k in range(10)], "doc_id long, text string").repartition(20, "doc_id")
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.jaccard_components(docs, shingle=5).collect()}
    assert got == {c * 10 + k: (k, 0) for c in range(20) for k in range(10)}
    assert max(k.get("ranges", 0) for k in asked) == 8 + 20 * 10 * 60 // 500


def test_equal_slices_of_many_tasks_go_to_many_parts(spark):
    """Keys that a slice shares within itself go on by the task too: tables of copies have equal slices in all tasks."""
    from functools import partial

    from urbanweave.llm import ngram_jaccard as J

    text = lambda k: " ".join(f"w{i + k}" for i in range(64))
    docs = spark.createDataFrame(spark.sparkContext.parallelize([(text(k),) for _ in range(16) for k in range(2)], 16), "text string")
    keys = docs.mapInArrow(partial(J._signatures, shingle=5, num=8, den=10, ranges=64), "part int, keys binary, nodes binary")
    parts = [r.part for r in keys.where("part < 0").select("part").collect()]
    assert len(parts) == 16 and len(set(parts)) > 8 and all(-64 <= p for p in parts)
