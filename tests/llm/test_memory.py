"""What keeps the operators within the memory and the disk of a task."""
import tracemalloc

import numpy as np

from basketry.llm import ngram_lm, order_minhash, prefix_tree_join
from basketry.session import spool


def test_fingerprints_work_on_small_parts():
    """Three megabytes of texts, as one batch holds, need far less than ten times as much at once."""
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 123, 2000))) for _ in range(1500)]
    tracemalloc.start()
    try:
        whole = order_minhash.fingerprints(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    assert (whole[[0, 700]] == order_minhash.fingerprints([texts[0], texts[700]])).all()


def test_ngrams_are_shuffled_before_they_are_summed(spark):
    """Nearly all of them are seen once: sums beside the text would fill memory and disk and merge nothing."""
    docs = spark.createDataFrame([("a b c a b c",), ("a b c",), (None,)], "text string")
    for size, kept in ((2, [2, 3, 3]), (3, [2, 3])):
        counted = ngram_lm.ngram_counts(docs, "text", size)
        text = counted._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in text[text.index("Exchange hashpartitioning(x"):]
        rows = counted.filter(f"size = {size}").collect()
        assert len({r["key"] for r in rows}) == len(rows) and sorted(r["n"] for r in rows) == kept


def test_first_round_of_the_join_writes_no_copy_of_the_fronts(spark, monkeypatch):
    """Nothing is connected in the first round, so the fronts are neither joined with classes nor written again."""
    labels = []

    def noted(df, label="spool"):
        labels.append(label)
        return spool(df, label)

    monkeypatch.setattr(prefix_tree_join, "spool", noted)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " tail"), (3, "quite another text of some words"), (4, "and one more of its own")]
    found = prefix_tree_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert labels.index("pairs") < labels.index("open")
