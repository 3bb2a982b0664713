"""Tokenizer alignment against plain Python that compares every pair of token ends."""
import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
import tokenizers

from basketry.llm import alignment, registry

ODD = ["a  b", " a", "a ", " ", "▁a b", "<s> hi <unk> <0x41> <|endoftext|>", "a\r\nb\tc", "\x00 a", "日本語 テキスト 𝒳", "é́ x", " " * 700 + "x", "x" * 3000,
       "don't I'll 12345 !!! ünïcödé", "ab" * 20_000, "word and word " * 4000]


def plain(texts):
    """Ids, groups and links of each text by the definitions alone."""
    a = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in shown} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in shown)}
    out = []
    for text in texts:
        whole = b" " + (text or "").encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], [], []))
            continue
        ends_a = [sum(map(len, bytes_a[:i + 1])) for i in range(len(ids_a))] if len(ids_a) < 2000 else None
        if ends_a is None:
            ends_a, n = [], 0
            for x in bytes_a:
                n += len(x)
                ends_a.append(n)
        ends_b, n = [], 0
        for x in bytes_b:
            n += len(x)
            ends_b.append(n)
        at_b = {e: j for j, e in enumerate(ends_b)}
        links = [(i, at_b[e]) for i, e in enumerate(ends_a) if e in at_b]
        groups, i, j = [], 0, 0
        for p, q in links:
            groups.append((ids_a[i:p + 1], ids_b[j:q + 1]))
            i, j = p + 1, q + 1
        out.append((ids_a, ids_b, groups, [(ids_a[p], ids_b[q]) for p, q in links]))
    return out


def expected(rows):
    found = plain([t for _, t in rows])
    count = Counter(pair for *_, links in found for pair in links)
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(n, highest.get(b, 0))
    for (doc, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        yield (doc, len(a), len(b), len(groups), len(links), sum(count[p] == highest[p[1]] for p in links), sum(count[p] for p in links),
               hashlib.sha256(text.encode()).hexdigest() if a else "")


def test_query_equals_definition(spark, sf, rows):
    got = sorted(map(tuple, registry.queries()["op11_align_tokenizers"].build(spark, sf).collect()), key=repr)
    assert got == sorted(expected([(d["doc_id"], d["text"]) for d in rows[0]]), key=repr)


def test_odd_and_long_texts(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "", ODD[0], ODD[0]])] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = alignment.rate_links(alignment.align(docs, digest=True))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(expected(rows), key=repr)


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "two words", "mine", [7], 0.5), (2, None, None, None, None)],
                                 "doc_id long, text string, groups_sha256 string, links array<int>, other double")
    got = {r.doc_id: r for r in alignment.rate_links(alignment.align(docs, digest=True)).collect()}
    assert got[1].other == 0.5 and got[1].text == "two words" and len(got[1].groups_sha256) == 64 and got[2].n_a == 0


def test_groups_rebuild_the_text(spark):
    docs = spark.createDataFrame([("x", "Plain words, größer 12", 1.5)], "alignment string, text string, n_a double")
    row = alignment.align(docs, into="alignment").collect()[0]
    pair = alignment.load_pair(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    assert row.n_a == 1.5 and row.text == "Plain words, größer 12"
    a, b, cuts_a, cuts_b = row.alignment
    start_a = start_b = 0
    for stop_a, stop_b in zip(cuts_a, cuts_b):
        assert b"".join(pair.bytes_a[i] for i in a[start_a:stop_a]) == b"".join(pair.bytes_b[i] for i in b[start_b:stop_b])
        start_a, start_b = stop_a, stop_b
    assert (start_a, start_b) == (len(a), len(b))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.rate_links(alignment.align(docs, keep_text=False, digest=True)).collect() == []
    assert alignment.align(docs).collect() == []


def test_links_are_bounded_by_the_vocabularies(spark):
    known = alignment.possible_links(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    pair = alignment.load_pair(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    assert len(known) < 500_000 and (known[1:] > known[:-1]).all()
    for key in known[::997].tolist():
        a, b = pair.bytes_a[key >> 32], pair.bytes_b[key & 0xFFFFFFFF]
        assert a.endswith(b) or b.endswith(a)
