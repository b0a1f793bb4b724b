"""SentencePiece encoding and decoding with the byte span of every piece in the original text.

The normaliser of the model is re-done here so as to keep track of where each byte came from: the compiled
character map (a double-array trie of UTF-8 prefixes and their replacements) is matched longest first, every
byte it puts out is noted with the original byte it starts at, then the model's white-space rules follow. The
library segments; a piece's span is the original range that its normalised bytes came from.

Defined cases: null text is empty (no ids, empty decoded text); an empty table gives no rows; repeated rows are
encoded each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_list, read_table, spread, text_slices

SPACE_SYMBOL = "▁".encode()


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = message[at : at + size], at + size
        yield key >> 3, value


@dataclass(frozen=True)
class Rules:
    """What a model says of normalisation."""

    char_map: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True
    space_suffix: bool = False

    @classmethod
    def of(cls, model: bytes) -> Rules:
        top = dict(_fields(model))
        spec, trainer = dict(_fields(top.get(3, b""))), dict(_fields(top.get(2, b"")))
        return cls(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)))


class Normalizer:
    """Longest-prefix normalisation that keeps the source of each byte."""

    def __init__(self, rules: Rules):
        self.rules, self.units, self.replaced = rules, None, b""
        if rules.char_map:
            (size,) = struct.unpack_from("<I", rules.char_map)
            self.units = np.frombuffer(rules.char_map, "<u4", size // 4, 4).tolist()
            self.replaced = rules.char_map[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest entry of the character map that stands at ``at``, and its replacement."""
        units, found = self.units, None
        node = units[0] >> 10 << ((units[0] & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                begin = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.replaced[begin : self.replaced.index(b"\0", begin)]
        return found

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each and one past the last, the original byte it comes from."""
        rules = self.rules
        space = SPACE_SYMBOL if rules.escape else b" "
        if self.units is None and not rules.remove_extra:
            return self._plain(text, space)
        chunks: list[tuple[bytes, int]] = []  # (put out, where from)
        at = 0
        while at < len(text):
            hit = self.longest(text, at) if self.units else None
            size, put = hit or (_char_size(text, at), None)
            chunks.append((text[at : at + size] if put is None else put, at))
            at += size
        end = len(text)
        if rules.remove_extra:
            while chunks and not chunks[0][0].strip(b" "):
                chunks.pop(0)
        out, source = bytearray(), []

        def add(put: bytes, where: int) -> None:
            out.extend(put)
            source.extend([where] * len(put))

        after_space = rules.remove_extra
        if chunks and rules.dummy_prefix and not rules.space_suffix:
            add(space, chunks[0][1])
        for put, where in chunks:
            if after_space:
                put = put.lstrip(b" ")
            add(put.replace(b" ", space), where)
            if put:
                after_space = rules.remove_extra and put.endswith(b" ")
        if rules.remove_extra:
            while out.endswith(space):
                del out[-len(space) :]
                end = source[-len(space)]
                del source[-len(space) :]
        if out and rules.dummy_prefix and rules.space_suffix:
            add(space, end)
        return bytes(out), np.array([*source, end], np.int64)

    def _plain(self, text: bytes, space: bytes) -> tuple[bytes, np.ndarray]:
        """No character map, no white space removed: only spaces become longer."""
        if not text:
            return b"", np.zeros(1, np.int64)
        lengths = np.ones(len(text), np.int64)
        lengths[np.frombuffer(text, np.uint8) == 32] = len(space)
        source = np.repeat(np.arange(len(text)), lengths)
        front = len(space) if self.rules.dummy_prefix and not self.rules.space_suffix else 0
        back = len(space) if self.rules.dummy_prefix and self.rules.space_suffix else 0
        out = b"".join([space * bool(front), text.replace(b" ", space), space * bool(back)])
        return out, np.concatenate([np.zeros(front, np.int64), source, np.full(back + 1, len(text))])


def _char_size(text: bytes, at: int) -> int:
    lead = text[at]
    return min(len(text) - at, 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)


class Codec:
    """Encodes and decodes with a model file; one instance for each worker."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.normalize = Normalizer(Rules.of(f.read()))
        n = self.library.get_piece_size()
        self.sizes = np.array([1 if self.library.is_byte(k) else len(self.library.id_to_piece(k).encode()) for k in range(n)], np.int64)
        self.unknown = self.library.unk_id()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in bytes of the original text, of each piece."""
        flat, source = self.normalize(text.encode("utf-8", "surrogatepass"))
        which = np.array(ids, np.int64)
        sizes = self.sizes[which]
        if (which == self.unknown).any():  # an unknown piece is as long as the run the library made of it
            proto = self.library.encode(text, return_type="proto")
            sizes = np.array([len(p.piece.encode()) for p in proto.pieces], np.int64)
        ends = np.cumsum(sizes)
        assert (ends[-1] if len(ends) else 0) == len(flat), "pieces and normalised text differ"
        return source[ends - sizes], source[ends]


@cache
def _codec(path: str) -> Codec:
    return Codec(path)


ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, and starts and ends of the pieces in bytes of the original text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, _, ids, starts, ends in _encoded(batch, model):
                off = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), np.int32, off[-1])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *(arrow_list(x, off, pa.int32()) for x in (flat, starts, ends))], names=["doc_id", "ids", "starts", "ends"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def _encoded(batch: pa.RecordBatch, model: str):
    codec = _codec(model)
    for rows in text_slices(batch):
        texts = [t or "" for t in rows.column("text").to_pylist()]
        ids = codec.encode(texts)
        spans = [codec.spans(t, x) for t, x in zip(texts, ids, strict=True)]
        yield rows, texts, ids, *(np.concatenate([np.zeros(0, np.int64), *(s[k] for s in spans)]).astype(np.int32) for k in (0, 1))


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(codec.decode([x or [] for x in rows.column("ids").to_pylist()]), pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encodes and decodes each text in one pass: digests of the ids, of the piece spans and of the decoded text.

    spans_crc32 is over the pieces' starts, then ends (little-endian 32-bit); covered says whether the pieces'
    spans tile the whole original text.
    """
    import zlib

    def sha(data: bytes) -> str:
        return hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for rows, texts, ids, starts, ends in _encoded(batch, model):
                back = codec.decode(ids)
                off = np.cumsum([0, *map(len, ids)]).tolist()
                crc, covered = [], []
                for k, t in enumerate(texts):
                    s, e = starts[off[k] : off[k + 1]], ends[off[k] : off[k + 1]]
                    crc.append(zlib.crc32(e.astype("<i4").tobytes(), zlib.crc32(s.astype("<i4").tobytes())))
                    covered.append(bool((s[1:] == e[:-1]).all() and (s[0] == 0 and e[-1] == len(t.encode()) if len(s) else not t)))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").cast(pa.int64()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([sha(str(x)[1:-1].replace(" ", "").encode()) for x in ids], pa.string()),
                        pa.array([sha(x.encode()) for x in back], pa.string()),
                        pa.array(crc, pa.int64()),
                        pa.array(covered, pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32", "covered"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long, covered boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op6_sentencepiece": op6_sentencepiece}
ORACLE: dict[str, str] = {}
