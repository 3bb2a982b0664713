"""Toxicity by a weighted lexicon with exception phrases.

Texts are folded first: look-alike letters of other scripts, digits that stand for letters and invisible
characters become plain letters.  A lexicon of word beginnings and whole words, weighted by
their log odds, is matched in one Aho-Corasick pass; phrases in which an entry is harmless take its
matches back.  The weight that is left, per word of the text, is turned into a probability.
"""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm import blocks
from basketry.session import spool

#: Labelled rows of each class that the lexicon is learned from, chosen by a hash.
TRAIN_ROWS = 10_000
#: Letters of a word's beginning that may become an entry; longer words count by their first 24.
STEM, LONGEST = range(3, 9), 24
#: Documents an entry needs, and the least log odds of an entry.
LEAST_DOCS, LEAST_ODDS = 4, 1.5
#: Documents a harmless phrase needs, and the largest share of toxic ones among them.
LEAST_PHRASE, PHRASE_SHARE = 3, 0.1
#: Bins of the calibration, per doubling of the weight.
STEP = 4

#: Letters of other scripts that look like Latin ones, in the order of the line below them.
LOOKALIKES = "аеорсухіјѕԁһӏԛԝгьвкмнтαεορυχικνητβɑɡıℓ"
LOOKS_LIKE = "aeopcyxijsdhlqwrbbkmhtaeopyxiknntbagil"
#: Digits and signs that stand for letters inside a word, likewise.
SUBSTITUTES = "01345789@$€£!|+"
STANDS_FOR = "oieastbgaseliit"
#: i, l and 1 look alike, so they are one letter.
ONE = "l"
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_LETTERS = str.maketrans(LOOKALIKES, LOOKS_LIKE) | INVISIBLE
_DIGITS = str.maketrans(SUBSTITUTES, STANDS_FOR)
_FOREIGN = re.compile(f"[{LOOKALIKES}{''.join(map(chr, INVISIBLE))}]")
_DISGUISED = re.compile(r"[0-9@$€£!|+]+")
_BETWEEN = re.compile(r"[\W_]+")


def _uncovered(match: re.Match) -> str:
    """Digits next to a letter as letters; signs only before a letter, ``!|+`` only between letters."""
    run, text, start, stop = match.group(), match.string, match.start(), match.end()
    before, after = start > 0 and text[start - 1].isalpha(), stop < len(text) and text[stop].isalpha()
    if not (before or after) or not (after or run.isdigit()) or (not before and run[0] in "!|+"):
        return run
    return run.translate(_DIGITS)


def fold(text: str | None) -> str:
    """Lower-case words between single spaces, with one at each end; disguised letters are plain ones."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(_LETTERS)
    text = _DISGUISED.sub(_uncovered, text).replace("i", ONE)
    return " " + _BETWEEN.sub(" ", text).strip() + " "


def entries_of(text: str) -> set[str]:
    """Possible entries of a folded text: ``" stem"`` and ``" word "``."""
    out = set()
    for word in set(text.split()):
        word = word[:LONGEST]
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEM if n <= len(word))
    return out


def phrases_of(text: str, start: int) -> list[str]:
    """The word that begins after ``start``, alone and with each neighbour."""
    stop = text.index(" ", start + 1)
    out = [text[start:stop + 1]]
    if start > 0:
        out.append(text[text.rindex(" ", 0, start):stop + 1])
    if stop < len(text) - 1:
        out.append(text[start:text.index(" ", stop + 1) + 1])
    return out


@dataclass
class Lexicon:
    """Entries with weights, harmless phrases, and the probability that a weight per word stands for."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0
    rest: float = 0.0  # probability without any match

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight, False))
        for phrase in self.exceptions:
            weight = self.entries.get(phrase, 0.0)
            found.add_word(phrase, (len(phrase), weight, True))
        if len(found):
            found.make_automaton()
        return found

    def probability(self, measure: np.ndarray) -> np.ndarray:
        """Of toxicity, for the values of ``measure``; rising with them."""
        z = np.clip(self.slope * np.log(np.maximum(measure, 1e-12)) + self.offset, -30, 30)
        return np.where(measure > 0, np.maximum(1 / (1 + np.exp(-z)), self.rest), self.rest)


def matches(automaton, folded: str) -> dict[int, float]:
    """Weight of every matched word by its place: its heaviest entry, unless a harmless phrase covers it."""
    if not len(automaton):
        return {}
    weight: dict[int, float] = {}
    harmless: list[tuple[int, int]] = []
    for end, (length, w, is_exception) in automaton.iter(folded):
        start = end - length + 1
        if is_exception:
            harmless.append((start, end))
        if w > weight.get(start, 0.0):
            weight[start] = w
    for start, end in harmless:
        for place in [p for p in weight if start <= p < end]:
            del weight[place]
    return weight


def measure(automaton, folded: str) -> float:
    """Weight per thousand words; a word or two in a short text count as in one of fifty."""
    found = matches(automaton, folded)
    return 1000 * sum(found.values()) / max(folded.count(" ") - 1, 50) if found else 0.0


def _counted(name: str, counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    keys = sorted(set(counts[0]) | set(counts[1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array([counts[0][k] for k in keys], pa.int64()), pa.array([counts[1][k] for k in keys], pa.int64())],
        names=[name, "clean", "toxic"])


def _per_document(rows: DataFrame, found_in) -> DataFrame:
    """(key, clean, toxic): documents of each class that hold a key that ``found_in(folded)`` gives."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.slices(batches, "text", 1 << 20):
            counts = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(set(found_in(fold(text))))
            yield _counted("key", counts)

    return rows.select("text", "toxic").mapInArrow(count, "key string, clean long, toxic long").groupBy("key").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _sample(labels: DataFrame, sizes: dict[int, int], train_rows: int) -> DataFrame:
    """About ``train_rows`` ids of each class, those whose hash falls under the class's share."""
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, train_rows / max(1, sizes[1])))).otherwise(F.lit(min(1.0, train_rows / max(1, sizes[0]))))
    return labels.filter(point < share)


def _calibrated(values: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the logarithm, by Newton's steps with a mild prior."""
    x = np.log(values)
    slope, offset = 1.0, -float(x.mean())
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        n = clean + toxic
        error, w = toxic - n * p, n * p * (1 - p)
        g = np.array([(error * x).sum() - 0.01 * (slope - 1), error.sum() - 0.01 * offset])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        slope, offset = max(slope + step[0], 0.05), offset + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return round(float(slope), 9), round(float(offset), 9)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", toxic: str = "toxic", row_id: str = "doc_id", train_rows: int = TRAIN_ROWS,
        entries: dict[str, float] | None = None, exceptions: list[str] | None = None) -> Lexicon:
    """Learn lexicon, phrases and calibration from ``docs`` and the ``labels`` (0 or 1) of their ids.

    Other labels count as none; an id with several labels is toxic if one says so.
    Three passes over about ``train_rows`` whole texts of each class: documents per possible entry, per phrase around a
    match, and per step of the measure.  ``entries`` and
    ``exceptions`` give own ones, which are added.  Without rows of both classes only those count.
    """
    spark = blocks.limit_batches(docs.sparkSession)
    labels = labels.select(F.col(row_id).alias("id"), F.col(toxic).cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)")
    labels = labels.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    own = {k: float(v) for k, v in (entries or {}).items()}
    known = list(exceptions or [])
    if not sizes[0] or not sizes[1]:
        return Lexicon(own, known, 1.0, -3.0, 0.0)
    # The chosen ids are about 2 x train_rows, whatever the size of the corpus, so the texts stay where they are.
    chosen = F.broadcast(_sample(labels, sizes, train_rows))
    texts = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).filter("text is not null")
    sample = spool(texts.join(chosen, "id").select("text", "toxic"), "toxic-sample")
    totals = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals[0] or not totals[1]:
        return Lexicon(own, known, 1.0, -3.0, 0.0)
    n_clean, n_toxic = totals[0] + 1.0, totals[1] + 1.0

    counted = _per_document(sample, entries_of)
    odds = F.round(F.log((F.col("toxic") + 0.5) / n_toxic) - F.log((F.col("clean") + 0.5) / n_clean), 9)
    kept = counted.filter(F.col("toxic") >= LEAST_DOCS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    candidates = kept.orderBy(F.desc(F.col("toxic") * F.col("odds")), "key").limit(20_000).collect()
    learned = _without_nested({r["key"]: (r["odds"], r["toxic"], r["clean"]) for r in candidates}) | own

    sent = spark.sparkContext.broadcast(Lexicon(learned))
    automata: list = []

    def phrases(folded: str) -> list[str]:
        if not automata:
            automata.append(sent.value.automaton())
        return [p for start in matches(automata[0], folded) for p in phrases_of(folded, start)]

    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    harmless = _per_document(sample, phrases).filter((F.col("clean") >= LEAST_PHRASE) & (share <= PHRASE_SHARE))
    known += [r["key"] for r in harmless.orderBy(F.desc("clean"), "key").limit(20_000).collect()]
    lexicon = Lexicon(learned, sorted(set(known)))

    binned = _measured(sample, lexicon).select(
        "toxic", F.when(F.col("measure") > 0, F.round(F.log2("measure") * STEP)).alias("bin")).groupBy("bin", "toxic").count().toPandas()
    table = binned.pivot_table(index="bin", columns="toxic", values="count", aggfunc="sum", fill_value=0, dropna=False).reindex(columns=[0, 1], fill_value=0)
    # The sample holds the classes in other shares than all rows; weights set that right.
    clean, toxic_ = table[0].to_numpy(float) * sizes[0] / max(1, totals[0]), table[1].to_numpy(float) * sizes[1] / max(1, totals[1])
    hit = ~np.isnan(table.index.to_numpy(float))
    if hit.any():
        lexicon.slope, lexicon.offset = _calibrated(2.0 ** (table.index.to_numpy(float)[hit] / STEP), clean[hit], toxic_[hit])
    missed = binned[binned["bin"].isna()].groupby("toxic")["count"].sum().to_dict()
    t, c = missed.get(1, 0) * sizes[1] / max(1, totals[1]), missed.get(0, 0) * sizes[0] / max(1, totals[0])
    lexicon.rest = round(min((t + 0.5) / (t + c + 1.0), 0.49), 9)
    return lexicon


def _without_nested(candidates: dict[str, tuple[float, int, int]]) -> dict[str, float]:
    """Entries (odds, toxic and clean documents) that say more than the others they begin or end with.

    A beginning goes where one longer entry has as good as all its toxic documents, so ``" idiot "`` stays and ``" idi"``
    goes; a longer entry goes unless it is heavier than what is left of its beginnings.
    """
    vague = set()
    for key, (_, toxic, clean) in candidates.items():
        for shorter in (key[:n] for n in range(2, len(key))):
            if shorter in candidates and toxic >= 0.98 * candidates[shorter][1] and clean <= candidates[shorter][2]:
                vague.add(shorter)
    out: dict[str, float] = {}
    for key in sorted(candidates.keys() - vague, key=lambda k: (len(k), k)):
        weight = candidates[key][0]
        if weight > max((out[key[:n]] for n in range(2, len(key)) if key[:n] in out), default=weight - 1) + 0.1:
            out[key] = weight
    return out


def _measured(rows: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "measure") -> DataFrame:
    """``rows`` with the weight per thousand words in place of the text."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    rest = [c for c in rows.columns if c != text]
    schema = rows.select(*[F.col(f"`{c}`") for c in rest], F.lit(0.0).alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for batch in blocks.slices(batches, text, 1 << 20):
            values = [measure(automaton, fold(t)) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(values, pa.float64())], names=[*rest, into])

    return rows.mapInArrow(run, schema)


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic in place of the text, from the whole text alone.

    NULL, empty and wordless texts have no match and get the share of toxic rows among those.  Rows, repeated
    ones too, pass through without a shuffle; an earlier column ``into`` is replaced.
    """
    blocks.limit_batches(docs.sparkSession)
    ready = docs if into == text else docs.drop(into)
    found = _measured(ready, lexicon, text, into)
    z = F.lit(lexicon.slope) * F.log(F.greatest(F.col(into), F.lit(1e-12))) + F.lit(lexicon.offset)
    fitted = F.greatest(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))), F.lit(lexicon.rest))
    return found.withColumn(into, F.when(F.col(into) > 0, fitted).otherwise(F.lit(lexicon.rest)))
