"""Toxicity: folding, exceptions, learned stems and edge cases."""
import random
import zlib

import pytest

from basketry.llm import registry, toxicity as T

from .conftest import prose

BAD = {"en": ["grumblor", "snarfidge"], "de": ["quarzel"]}


def corpus(n=600, seed=2):
    """Texts of two languages; toxic ones hold bad words or words on a bad stem."""
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lang = ("en", "de")[i % 2]
        words = prose(rng, rng.randint(40, 150), lang).split()
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(6):
                w = rng.choice(BAD[lang]) + ("" if lang == "en" else rng.choice(["en", "ung", "haft", "los", "bar"]))
                words.insert(rng.randrange(len(words)), w)
        elif i % 21 == 1:  # harmless in this phrase
            words.insert(5, "garden snarfidge")
        docs.append((i, " ".join(words), toxic))
    return docs


@pytest.fixture(scope="module")
def lexicon(spark):
    docs = [d for d in corpus() if zlib.crc32(str(d[0]).encode()) % 5]
    return T.fit(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string"), spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int"))


def scores(spark, lexicon, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in sorted(T.score(docs, lexicon).collect(), key=lambda r: r.doc_id)]


def test_fold():
    assert T.fold("Ｉdіоt") == T.fold("1D10T") == T.fold("idi­ot") == " ldlot "
    assert T.fold("pa$$word $tupid the$$$ $100 2024") == " password stupld the 100 2024 "
    assert T.fold(None) == T.fold("") == " " and T.fold("!!!").split() == []
    assert T.fold("one,two\n three").split() == ["one", "two", "three"]


def test_matches_count_a_word_once_and_spare_exceptions():
    lexicon = T.Lexicon({" bad": 2.0, " badly ": 3.0, " worse ": 1.0}, [" not bad "])
    found = T.matches(lexicon.automaton(), " badly bad not bad worse forbad ")
    assert sorted(found.values()) == [1.0, 2.0, 3.0]
    assert T.matches(T.Lexicon({}).automaton(), " x ") == {}


def test_held_out_rows(spark, lexicon):
    apart = [d for d in corpus() if zlib.crc32(str(d[0]).encode()) % 5 == 0]
    got = scores(spark, lexicon, [d[1] for d in apart])
    right = sum((s >= 0.5) == bool(d[2]) for s, d in zip(got, apart))
    assert right >= 0.97 * len(apart)
    assert any("snarfldge" in e for e in lexicon.exceptions)


def test_disguises_unseen_endings_and_length(spark, lexicon):
    clean = prose(random.Random(9), 100)
    at = lambda w, n=1: " ".join([clean] + [w] * 6) + " " + " ".join([clean] * (n - 1))
    plain, digits, cyrillic, ending, diluted, none = scores(
        spark, lexicon, [at("grumblor"), at("Grumbl0r"), at("grumblоr"), at("quarzelkeit"), at("grumblor", 60), clean])
    assert plain >= 0.5 and digits == cyrillic == plain and ending >= 0.5
    assert none <= diluted < plain and none < 0.5


def test_edges(spark, lexicon):
    docs = spark.createDataFrame(
        [(1, None, "a", 0.1), (1, "", "b", 0.2), (None, "!!!", "c", None), (2, "grumblor " * 200_000, "d", 0.3), (2, "grumblor " * 200_000, "d", 0.3)],
        "doc_id long, text string, measure string, score double")
    got = T.score(docs, lexicon).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert sorted({r.score for r in got if r.measure in "abc"}) == [lexicon.rest] and {r.score >= 0.5 for r in got if r.measure == "d"} == {True}
    assert T.score(docs.limit(0), lexicon).collect() == []


def test_without_labels_only_own_entries_count(spark):
    docs = spark.createDataFrame([(1, "some text"), (None, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, None), (None, 0)], [(7, 0), (8, 1)]):
        found = T.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), entries={" bad": 2.0})
        assert found.entries == {" bad": 2.0}


def test_repeated_labels_and_rows(spark):
    docs = corpus(200)
    frame = spark.createDataFrame([d[:2] for d in docs] * 2, "doc_id long, text string")
    labels = [(d[0], d[2]) for d in docs]
    found = T.fit(frame, spark.createDataFrame(labels + labels + [(d[0], 0) for d in docs], "doc_id long, toxic int"))
    assert any(k.startswith(" quar") for k in found.entries)


def test_query(spark, sf, rows, tmp_path):
    labels = [(d["doc_id"], int(d["doc_id"] % 9 == 0)) for d in rows[0]]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{sf}/labels.parquet")
    got = registry.queries()["op13_toxicity"].build(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(d["doc_id"] for d in rows[0])
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
