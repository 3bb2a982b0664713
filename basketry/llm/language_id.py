"""Language identification by unigram pieces, summed over all segmentations of a word.

The pieces are a fixed public vocabulary.  Each language has a probability for every piece, learned by
expectation maximisation on a bounded sample of labelled rows.  A word's probability is the sum
over all ways to cut it into pieces, computed with the forward algorithm; a text's is the product
over its words.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm import blocks
from basketry.session import spool

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled rows of a language that the model is fitted on, chosen by a hash.
TRAIN_ROWS = 2000
#: Most frequent labels that become languages.
MAX_LANGUAGES = 256
ROUNDS = 4
SMOOTHING = 0.05
#: Probability of a byte that no piece covers, in every language.
BYTE = 1e-7
#: Longer runs of letters are cut, so that no product underflows.
CUT = 28
UNKNOWN = "und"
#: A letter run: ASCII letters and every byte of a character beyond ASCII.
_C = np.arange(256)
LETTERS = ((_C >= 65) & (_C <= 90)) | ((_C >= 97) & (_C <= 122)) | (_C >= 128)
LOWER = np.where((_C >= 65) & (_C <= 90), _C + 32, _C).astype(np.uint8)
MARK = "▁".encode()


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a sentencepiece model without its control, unknown and byte entries."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({
        model.id_to_piece(i).encode() for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    })


@dataclass
class Pieces:
    """Prefix table of the vocabulary: a hash finds each prefix and, where it is one, the piece."""

    texts: list[bytes]
    keys: np.ndarray = field(init=False)
    ids: np.ndarray = field(init=False)

    def __post_init__(self):
        prefixes: dict[bytes, int] = {}
        for i, t in enumerate(self.texts):
            for n in range(1, len(t)):
                prefixes.setdefault(t[:n], -1)
            prefixes[t] = i
        size = 1 << max(4, (len(prefixes) * 6).bit_length())
        self.keys, self.ids = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        codes = blocks.byte_codes(False)
        base, mask = int(blocks.BASE), (1 << 64) - 1
        hashes = {b"": 0}
        for p in sorted(prefixes, key=len):
            hashes[p] = h = (hashes[p[:-1]] * base + int(codes[p[-1]])) & mask
            slot = h >> 40 & (size - 1)
            while self.keys[slot]:
                slot = (slot + 1) & (size - 1)
            self.keys[slot], self.ids[slot] = h, prefixes[p]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a prefix, and its piece or -1."""
        slot = ((h >> np.uint64(40)) & np.uint64(len(self.keys) - 1)).astype(np.int64)
        known, piece = np.zeros(len(h), bool), np.full(len(h), -1, np.int32)
        open_ = np.arange(len(h))
        while len(open_):
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            at = open_[hit]
            known[at], piece[at] = True, self.ids[slot[at]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
        return known, piece

    def lattice(self, matrix: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every piece in every word, by start; -1 is a lone byte."""
        codes = blocks.byte_codes(False)
        for start in range(matrix.shape[1]):
            rows = np.flatnonzero(lengths > start)
            if not len(rows):
                return
            yield start, start + 1, rows, np.full(len(rows), -1, np.int32)
            h, end = np.zeros(len(rows), np.uint64), start
            while len(rows):
                h = h * blocks.BASE + codes[matrix[rows, end]]
                known, piece = self.look_up(h)
                end += 1
                full = piece >= 0
                if full.any():
                    yield start, end, rows[full], piece[full]
                keep = known & (lengths[rows] > end)
                rows, h = rows[keep], h[keep]


_tables: dict[int, Pieces] = {}


def _pieces(texts: list[bytes]) -> Pieces:
    """The table of a vocabulary, built once in each Python worker."""
    key = hash(tuple(texts))
    if key not in _tables:
        _tables.clear()
        _tables[key] = Pieces(texts)
    return _tables[key]


def word_matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = [MARK + w for w in words]
    lengths = np.array([len(w) for w in marked], np.int64)
    matrix = np.zeros((len(words), int(lengths.max(initial=0))), np.uint8)
    flat = np.frombuffer(b"".join(marked), np.uint8)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix[np.repeat(np.arange(len(words)), lengths), column] = flat
    return matrix, lengths


def log_probabilities(pieces: Pieces, table: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probability of each word (row) in each language (column), over all segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    for at in range(0, len(words), 1 << 14):
        rows = order[at:at + (1 << 14)]
        matrix, lengths = word_matrix([words[i] for i in rows])
        alpha = np.zeros((matrix.shape[1] + 1, len(rows), table.shape[1]))
        alpha[0] = 1
        for start, end, which, piece in pieces.lattice(matrix, lengths):
            alpha[end, which] += alpha[start, which] * table[piece]  # row -1 of the table is the lone byte
        out[rows] = np.log(alpha[lengths, np.arange(len(rows))])
    return out


def expected_counts(pieces: Pieces, table: np.ndarray, words: list[bytes], language: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in every language, given the words' counts (one E-step)."""
    total = np.zeros_like(table)
    for at in range(0, len(words), 1 << 14):
        part = slice(at, at + (1 << 14))
        matrix, lengths = word_matrix(words[part])
        lang, n = language[part], len(lengths)
        alpha, beta = np.zeros((matrix.shape[1] + 1, n)), np.zeros((matrix.shape[1] + 1, n))
        alpha[0] = 1
        arcs = list(pieces.lattice(matrix, lengths))
        for start, end, which, piece in arcs:
            alpha[end, which] += alpha[start, which] * table[piece, lang[which]]
        beta[lengths, np.arange(n)] = 1
        for start, end, which, piece in reversed(arcs):
            beta[start, which] += table[piece, lang[which]] * beta[end, which]
        weight = count[part] / alpha[lengths, np.arange(n)]
        for start, end, which, piece in arcs:
            use = alpha[start, which] * table[piece, lang[which]] * beta[end, which] * weight[which]
            np.add.at(total, (piece, lang[which]), use)
    return total


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    table: np.ndarray  # pieces + 1 lone byte, by language
    prior: np.ndarray


def _letter_runs(column: pa.Array) -> tuple[np.ndarray, blocks.Words]:
    data, offsets = blocks.text_bytes(column)
    found = blocks.words(data, offsets, LETTERS)
    long = np.flatnonzero(found.ends - found.starts > CUT)
    if len(long):  # cut long runs; each part counts as a word
        parts = -(-(found.ends - found.starts) // CUT)
        which = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = found.starts[which] + nth * CUT
        ends = np.minimum(starts + CUT, found.ends[which])
        first = np.concatenate([[0], np.cumsum(parts)])[found.first]
        found = blocks.Words(starts, ends, blocks.span_hashes(data, starts, ends, True), first)
    return LOWER[data], found


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one word for each distinct hash, and for each word its number among those."""
    order = np.argsort(hashes)
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks.slices(batches, "text"):
        data, found = _letter_runs(batch.column(0))
        if not len(found.hashes):
            continue
        names, lang = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
        first, number = _distinct(blocks.mixed(found.hashes + lang[found.doc].astype(np.uint64)))
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([
            pa.array(names[lang[found.doc[first]]], pa.string()),
            pa.array([raw[a:b] for a, b in zip(found.starts[first], found.ends[first])], pa.binary()),
            pa.array(np.bincount(number, minlength=len(first)), pa.int64()),
        ], names=["lang", "word", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", row_id: str = "doc_id", vocabulary: str = VOCABULARY,
        train_rows: int = TRAIN_ROWS, rounds: int = ROUNDS, max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn the piece probabilities from rows with a label.

    The sample holds about ``train_rows`` whole texts of each label (all, if there are fewer), those
    whose hash of id and text falls under the label's share; nothing is sorted or shuffled for it.  Word counts and each E-step run as
    jobs; the driver holds one table of pieces by languages.
    """
    spark = blocks.limit_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.col(row_id).cast("string").alias("_id"))
    rows = rows.filter("lang is not null and text is not null")
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    languages = sorted(r["lang"] for r in frequent)
    size = {r["lang"]: r["count"] for r in frequent}
    texts = read_pieces(vocabulary)
    prior = np.log(np.array([size[x] for x in languages], float) / max(1, sum(size.values())))
    if not languages:
        return Model([], texts, np.zeros((len(texts) + 1, 0)), prior)
    # Each label's share of rows follows from its count, so every task can tell alone which rows it keeps.
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, train_rows / size[x]))])
    point = F.pmod(F.xxhash64("_id", F.xxhash64("text")), F.lit(1 << 40)) / float(1 << 40)
    sample = rows.filter(F.col("lang").isin(languages)).filter(point < F.element_at(share, F.col("lang")))
    words = spool(
        sample.select("text", "lang").mapInArrow(_count_words, "lang string, word binary, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    words = words.repartition(max(2, spark.sparkContext.defaultParallelism)) if rounds else words

    table = np.full((len(texts) + 1, len(languages)), 1 / (len(texts) + 1))
    for _ in range(rounds):
        table[-1] = BYTE
        sent = spark.sparkContext.broadcast((texts, table, languages))

        def e_step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            texts, table, languages = sent.value
            number = {x: i for i, x in enumerate(languages)}
            total = np.zeros_like(table)
            for batch in batches:
                language = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
                count = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                total += expected_counts(_pieces(texts), table, batch.column(1).to_pylist(), language, count)
            piece, lang = np.nonzero(total[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(total[piece, lang], pa.float64())],
                names=["piece", "lang", "n"])

        got = words.mapInArrow(e_step, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(texts), len(languages)))
        counts[got["piece"], got["lang"]] = got["n"]
        table = np.vstack([(counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(texts)), np.full((1, len(languages)), BYTE)])
        sent.destroy()
    return Model(languages, texts, np.round(table, 12) + 1e-12, prior)


#: Words whose scores a Python worker keeps from batch to batch.
CACHE_WORDS = 400_000


class _Cache:
    """Scores of words seen lately in this worker; emptied when full, so its memory is bounded."""

    def __init__(self, languages: int):
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros((0, languages), np.float32)

    def scores_of(self, hashes: np.ndarray, compute) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == hashes[known]
        out = np.zeros((len(hashes), self.scores.shape[1]), np.float32)
        out[known] = self.scores[at[known]]
        missing = np.flatnonzero(~known)
        if len(missing):
            out[missing] = compute(missing)
            if len(self.hashes) + len(missing) > CACHE_WORDS:
                merged, scores = hashes, out
            else:
                merged, scores = np.concatenate([self.hashes, hashes[missing]]), np.concatenate([self.scores, out[missing]])
            order = np.argsort(merged)
            self.hashes, self.scores = merged[order], scores[order]
        return out


def identify(docs: DataFrame, model: Model, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the most probable language and its posterior probability, from the text alone.

    NULL, empty and letterless texts are ``und`` with score 0, as is everything when no language
    was learned.  Ties go to the first language by name.  Whole texts count, however long; rows pass
    through without a shuffle; earlier columns with the two names are replaced.
    """
    spark = blocks.limit_batches(docs.sparkSession)
    docs = docs.drop(prediction, score)
    sent = spark.sparkContext.broadcast(model)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    ready = docs.select("*", lettered.alias("_lettered"), F.lit(None).cast("string").alias(prediction), F.lit(0.0).alias(score))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        n_lang = len(model.languages)
        pieces, cache = _pieces(model.pieces), _Cache(n_lang)
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in blocks.slices(batches, text):
            schema = batch.schema
            data, found = _letter_runs(batch.column(schema.get_field_index(text)))
            n_docs = batch.num_rows
            best, sure = np.full(n_docs, n_lang), np.zeros(n_docs)
            if n_lang and len(found.hashes):
                first, number = _distinct(found.hashes)
                raw = data.tobytes()
                spell = lambda i: [raw[found.starts[j]:found.ends[j]] for j in first[i]]
                per_word = cache.scores_of(found.hashes[first], lambda i: log_probabilities(pieces, model.table, spell(i)))
                total = np.stack([np.bincount(found.doc, per_word[number, k], n_docs) for k in range(n_lang)], 1) + model.prior
                share = np.exp(total - total.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best, sure = share.argmax(1), share.max(1)
            lettered = batch.column(schema.get_field_index("_lettered")).to_numpy(zero_copy_only=False)
            best, sure = np.where(lettered, best, n_lang), np.where(lettered & (best < n_lang), sure, 0.0)
            columns = list(batch.columns)
            columns[schema.get_field_index(prediction)] = pa.array(names[best], pa.string())
            columns[schema.get_field_index(score)] = pa.array(sure, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ready.mapInArrow(predict, ready.schema).drop("_lettered")


#: Least posterior probability of a document that is kept.
MIN_SCORE = 0.5


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language is told, with the same columns.

    The model learns from the labels of these documents.  Rows that are ``und`` go, and rows whose
    best language is less probable than ``min_score``.  Without any label nothing can be learned
    and only texts without letters go.
    """
    model = fit(docs, text, lang, doc_id)
    if not model.languages:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    marked = identify(docs, model, text, "_lang_pred", "_lang_score")
    return marked.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= min_score)).select(*docs.columns)


def held_out(row_id, modulus: int, remainder: int):
    """Whether the CRC-32 of the id as text has that remainder; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit("")).cast("binary")) % modulus == remainder
