"""Token ids in ORC, longest-match counts, SentencePiece."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

public = pytest.importorskip("public_tokenizers")

from cases import documents, table  # noqa: E402
from maskflow.llm import op1_token_output as op1  # noqa: E402
from maskflow.llm import op2_token_counts as op2  # noqa: E402
from maskflow.llm import op6_sentencepiece as op6  # noqa: E402
from maskflow.llm.common import text_buffer, word_bounds, work_path  # noqa: E402

BPE, RANKS, PIECES = public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.path("piece_bpe_32k.model")


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_orc_round_trip_and_cases(spark):
    docs = documents(spark)
    path = op1.write_tokens(docs, work_path(spark, "t1"), BPE, partitions=5)
    got = table(op1.digest(op1.read_tokens(spark, path)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    with_id = sorted([r for r in rows if r[0] is not None], key=lambda r: r[0])
    # rows without id come first, in an order of their own
    first = [g for g in got if g[0] is None]
    assert len(first) == 2 and {g[2] for g in first} == {g[2] for g in brute_tokens([r for r in rows if r[0] is None])}
    shift = sum(g[2] for g in first)
    assert sorted(g for g in got if g[0] is not None) == [(i, s + shift, n, c) for i, s, n, c in brute_tokens(with_id)]


def test_orc_prunes_and_has_blooms(spark):
    path = op1.write_tokens(documents(spark), work_path(spark, "t1"), BPE, partitions=5)
    one = op1.read_tokens(spark, path).where("doc_id = 7")
    assert one.count() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(doc_id,7)" in plan
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(one.select("doc_id").inputFiles()[0])
    reader = jvm.org.apache.orc.OrcFile.createReader(name, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
    assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
    assert footer.getColumns(5).getKind().toString() == "DIRECT_V2"  # run-length encoded integers


def test_orc_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert table(op1.digest(op1.read_tokens(spark, op1.write_tokens(empty, work_path(spark, "t1"), BPE)))) == []


def test_units_equal_whole_texts():
    from tokenizers import Tokenizer

    rng = random.Random(1)
    parts = ["a", "B", " ", " ", "\n", "\t", "　", "\xa0", "1", "!", "'s", "é", "😀", "​", "\x1c", "\x85", "<|endoftext|>", "'", "\n\n", "word"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    for memo in (op1.MEMO, 0):
        op1.MEMO = memo
        flat, off = op1.UnitEncoder(BPE)(*text_buffer(pa.array(texts)))
        assert [x.tolist() for x in np.split(flat, off[1:-1])] == [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def greedy(word, vocabulary):
    n = 0
    while word:
        k = max(k for k in range(1, min(len(word), 140) + 1) if word[:k] in vocabulary or k == 1)
        word, n = word[k:], n + 1
    return n


def test_units_with_one_hash_are_told_apart(monkeypatch):
    """Whatever the hash does, even if all units get the same, ids are the library's."""
    a, b = "ab", "ba"
    for _ in range(10):
        a, b = a + b, b + a
    texts = [f"first {a} word", f"then {b} word", f"{a} {b} {a}", "plain words again", "", "first word"]
    want = brute_tokens(list(enumerate(texts)))
    for weak in (None, lambda data, starts, ends: np.zeros(len(starts), np.uint64), lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64)):
        if weak:
            monkeypatch.setattr(op1, "hash_words", weak)
        encoder = op1.UnitEncoder(BPE)
        for part in (texts, texts, list(reversed(texts))):
            ids, ends = encoder(*text_buffer(pa.array(part)))
            got = {t: ids[x:y].tolist() for t, x, y in zip(part, ends[:-1], ends[1:], strict=True)}
            for (_, _, n, crc), t in zip(want, texts, strict=True):
                assert len(got[t]) + 1 == n and zlib.crc32(np.array([*got[t], 2], "<u4").tobytes()) == crc


def test_automaton_equals_greedy_matching():
    rng = random.Random(2)
    for vocabulary in ([b"ab", b"abcab", b"bc", b"cabca"], [b"a", b"aa", b"aaaa", b"b"], [b" a", b" abc", b"bcd", b"cd"]):
        a = op2.LongestMatch(vocabulary)
        words = [bytes(rng.choices(b"abcd ", k=rng.randint(1, 40))) for _ in range(300)] + [bytes(rng.choices(b"abcd", k=2000))]
        data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
        assert a.count(data, ends - [len(w) for w in words], ends).tolist() == [greedy(w, set(vocabulary)) for w in words]


def test_long_pieces_are_counted():
    automaton = op2.LongestMatch([b"a" * 400, b"ab"])
    for text, n in ((b"a" * 399, 399), (b"a" * 400, 1), (b"a" * 399 + b"b", 399), (b"a" * 801, 3)):
        data = np.frombuffer(text, np.uint8)
        assert automaton.count(data, np.array([0]), np.array([len(text)])).tolist() == [n]


def test_counts_and_cases(spark):
    docs = documents(spark)
    have = set(op2.byte_pieces(RANKS))
    want = []
    for r in docs.collect():
        words = [w for w in (r.text or "").encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")).split(b" ") if w]
        long = r.text is not None and len(r.text) > 100_000
        want.append((r.doc_id, len(words), sum(map(len, words)), None if long else sum(greedy(b" " + w, have) for w in words)))
    got = table(op2.token_counts(docs, RANKS))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:3] == w[:3] and (w[3] is None or g[3] == w[3])
    assert table(op2.token_counts(docs.limit(0), RANKS)) == []


def test_words_never_cross_rows():
    data, off = text_buffer(pa.array(["ab", None, "", "c d", " e"]))
    starts, ends, row = word_bounds(data, off)
    assert [(bytes(data[a:b]), int(r)) for a, b, r in zip(starts, ends, row, strict=True)] == [(b"ab", 0), (b"c", 3), (b"d", 3), (b"e", 4)]


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(spark)
    want = []
    for r in docs.collect():
        ids = sp.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    rows = table(op6.round_trip(docs, PIECES))
    assert sorted((r[:4] for r in rows), key=str) == sorted(want, key=str)
    assert all(r[5] for r in rows)
    assert table(op6.round_trip(docs.limit(0), PIECES)) == []


def test_spans_are_the_pieces_of_the_text(spark):
    encoded = op6.encode(documents(spark).where("doc_id in (1, 9, 13)"), PIECES)
    texts = {r.doc_id: r.text for r in documents(spark).where("doc_id in (1, 9, 13)").collect()}
    codec = op6.Codec(PIECES)
    for r in encoded.collect():
        raw = texts[r.doc_id].encode()
        assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw
        for i, a, b in zip(r.ids, r.starts, r.ends, strict=True):
            piece = codec.library.id_to_piece(i)
            assert codec.library.is_byte(i) or raw[a:b].decode().lstrip(" ") == piece.replace("▁", " ").lstrip(" ")
    assert {r.doc_id: r.text for r in op6.decode(encoded, PIECES).collect()} == texts


def char_map(entries):
    """A compiled character map: a double-array trie, built naively, and its replacements."""
    pool = b""
    trie = {}
    for key, value in entries.items():
        node = trie
        for b in key:
            node = node.setdefault(b, {})
        node[None] = len(pool)
        pool += value + b"\0"
    units, used = {0: 0}, {0}

    def place(node, at):
        labels = [b for b in node if b is not None]
        taken = [0, *labels] if None in node else labels
        offset = next(o for o in range(1, 1 << 20) if all((at ^ o ^ b) not in used for b in taken) and o < 1 << 20)
        used.update(at ^ offset ^ b for b in taken)
        units[at] |= offset << 10 | (1 << 8 if None in node else 0)
        if None in node:
            units[at ^ offset] = node[None] | 1 << 31
        for b in labels:
            units[at ^ offset ^ b] = b
        for b in labels:
            place(node[b], at ^ offset ^ b)

    place(trie, 0)
    raw = b"".join(struct.pack("<I", units.get(k, 0xFF)) for k in range(max(units) + 1))
    return struct.pack("<I", len(raw)) + raw + pool


def test_character_map_is_matched_longest_first():
    entries = {"ﬁ".encode(): b"fi", b"a": b"A", b"ab": b"X", "é".encode(): "é".encode(), b"\t": b" "}
    normalize = op6.Normalizer(op6.Rules(char_map(entries), True, True, True))
    out, source = normalize("  abaﬁ \t é ".encode())
    assert out.decode() == "▁XAfi▁é"
    raw = "  abaﬁ \t é ".encode()
    assert len(source) == len(out) + 1
    at = out.index(b"fi")
    assert raw[source[at] : source[at + 2]] == "ﬁ".encode()
    assert raw[source[out.index(b"X")] : source[out.index(b"X") + 1]] == b"ab"
    assert op6.Normalizer(op6.Rules(char_map(entries), False, False, False))(b"xa b")[0] == b"xA b"
    assert op6.Normalizer(op6.Rules(b"", True, True, True))(b"   ")[0] == b""
