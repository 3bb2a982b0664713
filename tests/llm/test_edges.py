"""Empty tables, NULL columns, repeated rows and clashing names for every operator and stage."""
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basketry.llm import (blocks, chaining, decontaminate, language_id, mixing, ngram_lm, order_minhash, prefix_tree_join, secret_scan,
                          suffix_dedup, url_filter)

from . import brute


def _lm(docs):
    model, counts = ngram_lm.fit(docs)
    return ngram_lm.score_texts(docs.select("doc_id", "text"), model, counts)


def _overlaps(docs):
    items = docs.sparkSession.createDataFrame([(1, "one two three"), (None, "x"), (2, None)], "item_id long, text string")
    return decontaminate.find_overlaps(docs, items)


def _identified(docs):
    return language_id.identify(docs, language_id.fit(docs))


#: Operators that give a row per row of their input.
ROWWISE = {
    "overlaps": _overlaps, "language": _identified, "components": prefix_tree_join.similar_components, "mix": mixing.mix, "lm": _lm,
    "fingerprint": order_minhash.fingerprint_column, "edits": order_minhash.compare_with_edits,
    "repeats": suffix_dedup.repeated_strings, "secrets": secret_scan.find_secrets, "mask": secret_scan.mask_secrets,
}
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", ROWWISE)
def test_empty_table(table, name):
    assert ROWWISE[name](table([])).collect() == []


@pytest.mark.parametrize("name", ROWWISE)
def test_nulls_and_repeats(table, name):
    text = "same words in a row that is long enough " * 5
    docs = table([{}, {}, {"doc_id": 1, "text": text}, {"doc_id": 1, "text": text}, {"text": text, "source": "a"}, {"doc_id": 2, "source": "a"},
                  {"doc_id": 1, "text": "other text under one id"}])
    assert ROWWISE[name](docs).count() == 7


#: Operators that pass other columns through; names of their own results in the input give way.
CLASHING = {
    "overlaps": (_overlaps, "overlap"), "language": (_identified, "lang_pred"), "mix": (mixing.mix, "taken"),
    "fingerprint": (order_minhash.fingerprint_column, "fingerprint"), "mask": (secret_scan.mask_secrets, "spans"),
}


@pytest.mark.parametrize("name", CLASHING)
def test_clashing_columns(table, name):
    run, column = CLASHING[name]
    docs = table([{"doc_id": 1, "text": "some words", "lang": "en"}]).withColumn(column, F.lit("mine")).withColumn("score", F.lit("mine"))
    out = run(docs)
    assert out.columns.count(column) == 1 and out.count() == 1 and set(COLUMNS) <= set(out.columns)


def test_no_training_text(table):
    row = _lm(table([{"doc_id": 3}])).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (1, 1, 1)
    model, counts = ngram_lm.fit(table([]))
    scored = ngram_lm.score_texts(table([{"doc_id": 3, "text": "a b"}]).select("doc_id", "text"), model, counts).first()
    assert (scored.n_tokens, scored.n_known, scored.base_score, scored.score) == (3, 0, 0.0, 0.0)


def test_every_ngram_seen_twice_counts(table, monkeypatch):
    """Scores are those of a plain back-off model over all n-grams of two sightings, in the trie or not."""
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(rng.randint(0, 30)))) for i in range(40)]
    docs += [(40, "unseen ax by rare words"), (41, "unheard ax by rare words"), (42, None)]
    train = [d for d in docs if d[0] != 41]
    frame = lambda rows: table([{"doc_id": i, "text": t} for i, t in rows])
    expected = brute.back_off_scores([t for _, t in train], [t for _, t in docs])
    for share, exact in ((1e-6, 0.05), (4e-3, 0.05), (2.0, 1e-9)):  # all in the trie, whose values are rounded; some; none
        for name in ("WORD_SHARE", "CONTEXT_SHARE", "NGRAM_SHARE"):
            monkeypatch.setattr(ngram_lm, name, share)
        model, counts = ngram_lm.fit(frame(train))
        scored = ngram_lm.score_texts(frame(docs).select("doc_id", "text"), model, counts).collect()
        assert [r.score for r in sorted(scored)] == pytest.approx(expected, abs=exact), share


def test_nothing_learned(table):
    row = _identified(table([{"doc_id": 1, "text": "words without any label"}])).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


def test_long_words_and_texts(table):
    docs = table([{"doc_id": i, "text": t, "lang": "en"} for i, t in enumerate(["x" * 300_000, "word " * 60_000, "é" * 50_000])])
    for run in (_overlaps, _identified, _lm, prefix_tree_join.similar_components, order_minhash.fingerprint_column, suffix_dedup.repeated_strings):
        assert run(docs).count() == 3


def test_items_in_blocks(table, rows):
    docs, items, _ = rows
    spark = table([]).sparkSession
    frame = spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id long, text string")
    whole = decontaminate.find_overlaps(table(docs), frame).select("doc_id", "overlap").collect()
    parts = decontaminate.find_overlaps(table(docs), frame, block_words=10).select("doc_id", "overlap").collect()
    assert sorted(whole) == sorted(parts)


def test_text_above_two_million_words(table):
    """Items at both ends, across the first cut between shards and repeated, in one text of 2.2 million words."""
    n, item = 2_200_000, "ka kb kc kd ke kf kg kh ki kj kk".split()
    places = [0, decontaminate.SHARD_WORDS - 6, n - len(item)]
    words = ["w"] * n
    for p in places:
        words[p:p + len(item)] = item
    docs = table([{"doc_id": 1, "text": " ".join(words)}, {"doc_id": 2, "text": " ".join(item[:9])}])
    items = docs.sparkSession.createDataFrame([("q", " ".join(item)), ("r", "none of it")], "item_id string, text string")
    found = {r.doc_id: r.overlap for r in decontaminate.find_overlaps(docs, items).collect()}
    assert found[1].n_words == n and found[1]["items"] == ["q"] and found[2].spans == []
    assert [list(s) for s in found[1].spans] == [[p, p + len(item)] for p in places]


def test_hits_in_small_shards(rows, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": [d["text"] for d in rows[0]]}, pa.schema([("text", pa.string())]))
    found = decontaminate._words(batch, "text")
    parts = [blocks.words(*blocks.text_bytes(pa.array([i["text"]])), blocks.ALPHANUMERIC).hashes for i in rows[1]]
    items = decontaminate.Items([str(i["item_id"]) for i in rows[1]], np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    whole = decontaminate._hits(found, items, 10)
    assert whole[0]
    for size in (31, 18, 1):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", size)
        assert decontaminate._hits(found, items, 10) == whole


def test_longest_match(table):
    docs = table([{"doc_id": 4, "text": "x a b c d y"}, {"doc_id": 2, "text": "a b c d"}, {"doc_id": 9, "text": "b c d e f"}])
    items = docs.sparkSession.createDataFrame([("q", "A B c d e")], "item_id string, text string")
    found = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(docs, items).collect()}
    assert found == {0: (4, "2", 0), 1: (4, "9", 0), 2: (3, "9", 1)}


def test_passages_of_nothing(table):
    assert chaining.fuzzy_passages(table([])).collect() == []
    assert chaining.fuzzy_passages(table([{}, {"doc_id": 1, "text": ""}, {"doc_id": 2, "text": "short"}])).collect() == []


def test_urls_of_nothing(spark):
    schema = "page_id long, url string, html string"
    assert url_filter.judge(spark.createDataFrame([], schema)).collect() == []
    rows = url_filter.judge(spark.createDataFrame([(None, None, None), (1, "", "<link"), (1, "://", "")], schema)).collect()
    assert [r.verdict for r in rows] == ["allow"] * 3


def test_redirect_chain_through_a_table(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, "http://d.org/")], "page_id long, url string").withColumn("html", F.lit(None).cast("string"))
    hops = spark.createDataFrame([("http://a.org/", "http://b.org/"), ("http://c.org/", "http://b.org/"), ("http://c.org/", "http://bad.org/x")],
                                 "from_url string, to_url string")
    out = {r.page_id: r.verdict for r in url_filter.judge(pages, (("block", "bad.org", "/"),), hops).collect()}
    assert out == {1: "block", 2: "allow"}


def test_frequent_shingles_and_hot_copies(table, rows, monkeypatch):
    """Tiny limits send every pair through the paths of frequent shingles, anchors and salts."""
    monkeypatch.setattr(prefix_tree_join, "FULL", 2)
    monkeypatch.setattr(prefix_tree_join, "FREQUENT", 0.02)
    found = prefix_tree_join.similar_components(table(rows[0])).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute.ngram_components(rows[0]), key=repr)


def test_parities_never_tell_similar_sets_apart():
    rng = np.random.default_rng(3)
    for n in (1, 5, 90, 3000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for changed in range(0, min(n, 40), 3):
            other = np.concatenate([base[changed:], rng.integers(0, 1 << 63, changed + 2, np.uint64)])
            a, b = prefix_tree_join.parities([np.sort(base), np.sort(other)])
            assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(base, other))


def test_group_of_unlike_copies_is_not_paired(table, monkeypatch):
    """Copies that share most shingles, no two of which are similar: their pairs were all read and compared."""
    rng, words = random.Random(5), [f"word{i}" for i in range(110)]
    docs = []
    for i in range(60):
        copy = list(words)
        for at in (rng.randrange(5, 50), rng.randrange(60, 105)):
            copy[at] = f"own{i}at{at}"
        docs.append({"doc_id": i, "text": " ".join(copy)})
    docs += [{"doc_id": 60 + i, "text": docs[i]["text"] + " more"} for i in range(3)]
    compared, verify = [], prefix_tree_join._verify
    monkeypatch.setattr(prefix_tree_join, "_verify", lambda pairs, *more: compared.append(pairs.count()) or verify(pairs, *more))
    found = prefix_tree_join.similar_components(table(docs)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute.ngram_components(docs), key=repr)
    assert 3 <= sum(compared) < 60


def test_anchors_in_small_blocks(table, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 300)
    found = suffix_dedup.repeated_strings(table(rows[0]))
    found = found.select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept_sha256").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute.repeated_bytes(rows[0]), key=repr)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_keeps_columns_and_clean_documents(spark, sf, rows, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = STAGES[name](spark, docs, sf)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert {d["doc_id"] for d in rows[0] if d["doc_id"] < 60 and len(d["text"]) > 60} - kept <= ({5} if name == "n-gram Jaccard join" else set())


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_empty_and_null(spark, sf, table, name):
    assert STAGES[name](spark, table([]), sf).collect() == []
    out = STAGES[name](spark, table([{}, {"doc_id": 1}, {"doc_id": 1, "text": "a few plain words", "lang": "en"}]), sf).collect()
    assert any(r.text == "a few plain words" for r in out)


def test_pipeline_decisions(spark, sf, rows):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert 108 not in out and 106 not in out and 103 not in out  # contaminated, letterless, NULL
    assert len({95, 96, 97, 98, 99, 100, 101, 102} & set(out)) <= 1
    assert all("AbCdEf123456GhIjKl789" not in r.text for r in out.values())  # one owner's, looks live
    assert all(r.taken > 0 for r in out.values())


def _template_case(n_items, n_docs):
    template = " ".join(f"t{i}" for i in range(13))
    items = [{"item_id": f"i{n}", "text": f"{template} question {n} of {n % 3}"} for n in range(n_items)]
    docs = [{"doc_id": d, "text": f" filler {d} ".join([template] * 5) + (f" question {d} of {d % 3}" if d % 2 else "")} for d in range(n_docs)]
    return docs, items


def test_items_of_one_template_equal_brute_force(table):
    docs, items = _template_case(30, 20)
    docs += [{"doc_id": 90, "text": "nothing here"}, {"doc_id": 91, "text": None}, {"doc_id": 92, "text": ""}]
    frame = table([]).sparkSession.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id string, text string")
    want = [(d, n, hit, k) for d, n, hit, k, _, _ in brute.decontaminate(docs, items)]
    found = decontaminate.find_overlaps(table(docs), frame).select("doc_id", "overlap").collect()
    assert sorted((r.doc_id, r.overlap.n_words, sum(b - a for a, b in r.overlap.spans), len(r.overlap["items"])) for r in found) == sorted(want)


def test_pairs_put_together_in_pieces_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    in_docs = np.unique(rng.integers(0, 6, 60) * 9 + rng.integers(0, 9, 60))
    of_items = np.unique(rng.integers(0, 6, 40) * 7 + rng.integers(0, 7, 40))
    want = sorted({int(d % 9 * 7 + i % 7) for d in in_docs for i in of_items if d // 9 == i // 7} | {1})
    for piece in (1, 5, 1 << 20):
        monkeypatch.setattr(decontaminate, "PAIRS", piece)
        assert decontaminate._with_items(np.array([1]), in_docs, 9, of_items, 7).tolist() == want


def test_many_items_of_one_template_need_little_memory():
    docs, items = _template_case(4000, 256)
    batch = pa.RecordBatch.from_arrays([pa.array([d["text"] for d in docs])], names=["text"])
    words = [decontaminate._words(pa.RecordBatch.from_arrays([pa.array([i["text"]])], names=["text"]), "text").hashes for i in items]
    block = decontaminate.Items([i["item_id"] for i in items], np.concatenate(words), np.cumsum([0, *map(len, words)]))
    found = decontaminate._words(batch, "text")
    tracemalloc.start()
    spans, ids = decontaminate._hits(found, block, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == 256 and all(len(v) == 4000 for v in ids.values())
    assert peak < 160 << 20  # it was 811 MB before equal windows were merged, 75 MB after


def test_mix_passes_columns_of_any_name(table):
    docs = table([{"doc_id": i, "text": "w " * i, "source": "ab"[i % 2]} for i in range(1, 9)])
    mine = ["_key", "_source", "_bucket", "_before", "_sum", "_offset", "_budget", "_full", "_rest", "u0", "a.b"]
    out = mixing.mix(docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in mine}))
    assert out.columns == [*docs.columns, *mine, "size", "source_size", "target", "taken"]
    for r in out.collect():
        assert [r[c] for c in mine] == [f"{c}{r.doc_id}" for c in mine]
    plain = mixing.mix(docs).select("doc_id", "taken").collect()
    assert sorted(plain) == sorted(out.select("doc_id", "taken").collect())
