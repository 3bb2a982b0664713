"""Alignment of two tokenizers by the byte offsets at which their tokens end.

A document is encoded by both vocabularies over the same bytes.  The ends of the tokens of each side
are the keys of a dictionary from end to index; the keys that both dictionaries hold, sorted, cut
the two id lists into slices.  Every slice is a group of tokens that cover the same bytes, and its links
are the pairs of tokens that end together.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from basketry.llm import blocks

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
VOCABULARY_B = "/opt/tokenizers/piece_bpe_32k.model"
#: How a byte-level vocabulary cuts a text before merging (fixed value).
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space make the fast encoder's pattern matcher recurse too deep.
LONG_SPACE = re.compile(r"\s{500}")
ALIGNMENT = "struct<a_ids: array<int>, b_ids: array<int>, a_cuts: array<int>, b_cuts: array<int>>"
DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"


def _byte_of_character() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Pair:
    """Both encoders with the bytes of each of their entries."""

    path_a: str
    fast_a: object | None
    model_b: object
    bytes_a: list[bytes]
    bytes_b: list[bytes]

    def __post_init__(self):
        self.length_a = np.array([len(b) for b in self.bytes_a], np.int64)
        self.length_b = np.array([len(b) for b in self.bytes_b], np.int64)

    def ids_a(self, text: str) -> list[int]:
        """Ids of a space and ``text``; strings of special tokens are plain text."""
        if self.fast_a is None or LONG_SPACE.search(text):
            return plain_encoder(self.path_a).encode(" " + text, add_special_tokens=False).ids
        return self.fast_a.encode_ordinary(" " + text)

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.model_b.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def plain_encoder(path_a: str):
    """Side A as its file describes it; the encoder by ranks gives the same ids faster."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    encoder = tokenizers.Tokenizer.from_file(path_a)
    encoder.encode_special_tokens = True
    return encoder


@lru_cache(maxsize=2)
def load_pair(path_a: str, path_b: str) -> Pair:
    """Load the two vocabularies once per Python worker."""
    import sentencepiece
    import tiktoken

    with open(path_a, encoding="utf-8") as f:
        description = json.load(f)
    model, byte_of = description["model"], _byte_of_character()
    entries = model["vocab"] | {t["content"]: t["id"] for t in description["added_tokens"]}
    bytes_a = [b""] * (max(entries.values()) + 1)
    for text, i in entries.items():
        bytes_a[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode()
    # Merging by rank needs ids in the order of the merges.
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ranked = all(model["vocab"].get(m) == 256 + i for i, m in enumerate(merged))
    fast_a = tiktoken.Encoding(
        "a", pat_str=WORD_PATTERN, mergeable_ranks={bytes_a[i]: i for i in model["vocab"].values() if i < 256 + len(merged)},
        special_tokens={}) if ranked else None
    model_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bytes_b = [
        bytes([int(model_b.id_to_piece(i)[3:-1], 16)]) if model_b.is_byte(i) else model_b.id_to_piece(i).replace("▁", " ").encode()
        for i in range(model_b.get_piece_size())]
    return Pair(path_a, fast_a, model_b, bytes_a, bytes_b)


@lru_cache(maxsize=2)
def possible_links(path_a: str, path_b: str) -> np.ndarray:
    """Every pair of ids that can end together, as sorted ``a << 32 | b``.

    Of two tokens that end together, the bytes of one are a suffix of the other's, so the
    vocabularies alone bound the number of different links, however large the corpus.
    """
    pair = load_pair(path_a, path_b)
    of_a: dict[bytes, list[int]] = {}
    of_b: dict[bytes, list[int]] = {}
    for i, b in enumerate(pair.bytes_a):
        of_a.setdefault(b, []).append(i)
    for i, b in enumerate(pair.bytes_b):
        of_b.setdefault(b, []).append(i)
    keys = {a << 32 | b for text, ids in of_a.items() for cut in range(len(text)) for b in of_b.get(text[cut:], ()) for a in ids}
    keys |= {a << 32 | b for text, ids in of_b.items() for cut in range(len(text)) for a in of_a.get(text[cut:], ()) for b in ids}
    return np.array(sorted(keys), np.int64)


def common_cuts(ids_a: np.ndarray, ids_b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of each side before every end that both sides have, in order."""
    after_a = dict(zip(np.cumsum(length_a[ids_a]).tolist(), range(1, len(ids_a) + 1)))
    after_b = dict(zip(np.cumsum(length_b[ids_b]).tolist(), range(1, len(ids_b) + 1)))
    ends = sorted(filter(after_a.__contains__, after_b))
    return tuple(np.fromiter(map(after.__getitem__, ends), np.int32, len(ends)) for after in (after_a, after_b))


def align_texts(pair: Pair, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and cuts of each text; empty arrays for no text and where the bytes are not the text's."""
    texts = [t or "" for t in texts]
    out = []
    for text, b in zip(texts, pair.ids_b(texts)):
        whole = b" " + text.encode()
        a = pair.ids_a(text) if text else []
        if text and b"".join([pair.bytes_a[i] for i in a]) == whole and b"".join([pair.bytes_b[i] for i in b]) == whole:
            a, b = np.array(a, np.int32), np.array(b, np.int32)
            out.append((a, b, *common_cuts(a, b, pair.length_a, pair.length_b)))
        else:
            out.append((np.zeros(0, np.int32),) * 4)
    return out


def _int_lists(lists: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
    return blocks.list_array(pa.array(flat, pa.int32()), np.array([len(x) for x in lists], np.int64))


class GroupText:
    """Writes groups as ``a1,a2|b1;a3|b2,b3`` with one look-up per token."""

    def __init__(self, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b
        self.tables = [f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)] + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)]

    def of(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> str:
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[a_cuts - 1] = 1
        last_b[b_cuts - 1] = 1
        # A token of side A comes after the B tokens of earlier groups; one of B after the A tokens up to its group's.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], b_cuts])[group_a]] = a + self.n_a * last_a
        order[np.arange(len(b)) + a_cuts[group_b]] = 2 * self.n_a + b + self.n_b * last_b
        return "".join(map(self.tables.__getitem__, order.tolist()))[:-1]


def _digest_columns(sides: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], writer: GroupText, known: np.ndarray) -> list[pa.Array]:
    """The columns of ``DIGEST`` for the alignments of a batch."""
    counts, hashes, links = [], [], []
    for a, b, a_cuts, b_cuts in sides:
        a, b = a.astype(np.int64), b.astype(np.int64)
        hashes.append(hashlib.sha256(writer.of(a, b, a_cuts, b_cuts).encode()).hexdigest() if len(a) else "")
        links.append(np.searchsorted(known, a[a_cuts - 1] << 32 | b[b_cuts - 1]) if len(a) else a)
        counts.append((len(a), len(b), len(a_cuts), len(a_cuts)))
    numbers = np.array(counts, np.int64).reshape(-1, 4)
    return [*[pa.array(numbers[:, i]) for i in range(4)], pa.array(hashes, pa.string()), _int_lists(links)]


def align(docs: DataFrame, text: str = "text", into: str = "alignment", keep_text: bool = True, digest: bool = False,
          path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """``docs`` with a struct of both sides' ids and of the cuts that group them.

    ``a_cuts[g]`` and ``b_cuts[g]`` count the tokens of the first ``g + 1`` groups.  NULL and empty texts, and
    texts that either vocabulary does not give back byte by byte, have four empty lists.  Texts of
    any length are encoded as a whole; rows (repeats too) pass through without a shuffle; an earlier
    column of the name ``into`` is replaced.

    With ``digest`` the struct gives way to its digest, made in the same pass: counts of tokens, groups and links, the hash of the groups'
    text, and ``links``, each the number of its id pair in ``possible_links``.  Without tokens the counts are 0, the
    hash is an empty string and the list is empty.  Earlier columns of these names are replaced.
    """
    blocks.limit_batches(docs.sparkSession)
    made = [c.split()[0] for c in DIGEST.split(", ")] if digest else [into]
    ready = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    returned = ready if keep_text else ready.drop(text)
    added = T._parse_datatype_string(DIGEST if digest else f"`{into}` {ALIGNMENT}")
    schema = T.StructType([*returned.schema.fields, *added.fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = load_pair(path_a, path_b)
        writer, known = (GroupText(len(pair.bytes_a), len(pair.bytes_b)), possible_links(path_a, path_b)) if digest else (None, None)
        for batch in blocks.slices(batches, text, 1 << 20):
            at = batch.schema.get_field_index(text)
            sides = align_texts(pair, batch.column(at).to_pylist())
            rest = [(c, f.name) for i, (c, f) in enumerate(zip(batch.columns, batch.schema)) if keep_text or i != at]
            columns = _digest_columns(sides, writer, known) if digest else [pa.StructArray.from_arrays(
                [_int_lists(list(s)) for s in zip(*sides)], ["a_ids", "b_ids", "a_cuts", "b_cuts"])]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in rest], *columns], names=[*[n for _, n in rest], *made])

    return ready.mapInArrow(encode, schema)


def link_counts(digested: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """How many links of the corpus each id pair has: (link, n), at most ``len(possible_links)`` rows.

    A task adds its rows up in one array of that length before anything is shuffled.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(possible_links(path_a, path_b)), np.int64)
        for batch in batches:
            found = batch.column(0).values.to_numpy(zero_copy_only=False)
            total += np.bincount(found, minlength=len(total))
        link = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(link, pa.int32()), pa.array(total[link], pa.int64())], names=["link", "n"])

    return digested.select("links").mapInArrow(count, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))


def rate_links(digested: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """``digested`` with ``n_best`` and ``count_sum`` in place of the links.

    ``count_sum`` adds the corpus-wide counts of a document's links; ``n_best`` counts the links whose count
    is the highest of their B id, ties included.  The counts go to the tasks as one array, whose length
    the vocabularies bound.
    """
    spark = digested.sparkSession
    known = possible_links(path_a, path_b)
    got = link_counts(digested, path_a, path_b).toPandas()
    count = np.zeros(len(known), np.int64)
    count[got["link"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    highest = np.zeros(int((known & 0xFFFFFFFF).max()) + 1, np.int64)
    np.maximum.at(highest, known & 0xFFFFFFFF, count)
    sent = spark.sparkContext.broadcast((count, count == highest[known & 0xFFFFFFFF]))
    rest = [c for c in digested.columns if c != "links"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in digested.drop("links").schema], "n_best long, count_sum long"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("links"))
            offsets = lists.offsets.to_numpy().astype(np.int64)
            found = lists.values.to_numpy(zero_copy_only=False)
            add = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[found].astype(np.int64))])[offsets])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(add(best)), pa.array(add(count))],
                names=[*rest, "n_best", "count_sum"])

    return digested.mapInArrow(rate, schema)
