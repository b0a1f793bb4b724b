"""Token ids in ORC: integer run-length encoded stripes, row indexes and Bloom filters on document ids.

Rows are dealt by ranges of doc_id, sorted, encoded and written; every file holds one range, so stripes can
be read in parallel and a lookup of one document skips all files and stripes but its own (min/max in the row
index, then the Bloom filter). A row's ``start`` is its file's base plus ``local_start``: the base is a prefix
sum over one small row for each file, so no sum ever runs over all documents in one task.

Defined cases: null text is empty (one end id); null doc_id sorts first; rows with the same doc_id are ordered
by a hash of their text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_list, hash_words, read_table, text_buffer, text_slices, work_path

END_ID = 2
#: Distinct units of text whose ids and bytes a worker keeps (about 60 bytes each); the ids of further ones last for one slice.
MEMO = 2_000_000
#: Bytes of units that are compared in one step; its temporaries take about 30 times as much.
COMPARED = 1 << 19
#: Bytes of text in one range of doc_ids, which one task sorts, encodes and writes.
RANGE_BYTES = 128 << 20
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, token_ids array<int>"


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: 2: ASCII letter, 1: ASCII punctuation, -9: any other byte.
_KIND = np.array([2 if chr(b).isalpha() and b < 128 else 1 if 33 <= b < 127 and not chr(b).isalnum() else -9 for b in range(256)], np.int8)


def unit_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each unit. The byte-level pre-tokenizer always breaks before a single space and around a
    single line feed between characters that aren't white space, and between an ASCII letter and ASCII punctuation;
    cut at such places only, a text's ids are its units' ids, joined."""
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
    if len(data) > 1:  # characters that are, or share two bytes with, white space beyond ASCII
        lead, then = data[:-1], data[1:]
        wide = np.flatnonzero(((lead == 0xC2) & ((then == 0x85) | (then == 0xA0))) | ((lead >= 0xE1) & (lead <= 0xE3) & ((then == 0x9A) | (then == 0x80) | (then == 0x81))))
        for k in range(3):
            blank[np.minimum(wide + k, len(data) - 1)] = True
    inner = np.zeros(len(data), bool)
    alone = np.flatnonzero(((data[1:-1] == 32) | (data[1:-1] == 10)) & ~blank[:-2] & ~blank[2:]) + 1
    inner[alone] = True
    inner[alone[data[alone] == 10] + 1] = True
    inner[1:] |= _KIND[data[:-1]] - _KIND[data[1:]] == 1
    edge = off[(off > 0) & (off < len(data))]
    inner[alone[np.isin(alone, edge) | np.isin(alone + 1, edge)]] = False
    inner[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(inner)
    return starts, np.append(starts[1:], len(data))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


def same_bytes(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether ranges of ``a`` and ``b`` are equal, pair by pair, COMPARED bytes at a time (a longer range goes alone)."""
    same = a_size == b_size
    every = np.flatnonzero(same)
    upto = np.cumsum(a_size[every])
    at = 0
    while at < len(every):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, side="right")))
        rows = every[at:to]
        differ = a[ranges(a_at[rows], a_size[rows])] != b[ranges(b_at[rows], a_size[rows])]
        if differ.any():
            same[rows[np.repeat(np.arange(len(rows)), a_size[rows])[differ]]] = False
        at = to
    return same


class UnitEncoder:
    """Encodes through the tokenizers library, each frequent distinct unit of text once. Units are found by a 64-bit
    hash and compared byte by byte; one whose hash belongs to another unit is encoded anew each time."""

    def __init__(self, path: str):
        tokenizer = _tokenizer(path)
        self.encode_batch = tokenizer.encode_batch
        self.added = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, number of the unit
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.bytes, self.upto = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # of each unit

    def _with_added(self, data: np.ndarray, off: np.ndarray) -> set[int]:
        """Texts that hold the string of an added token."""
        raw, found = data.tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.add(row := int(np.searchsorted(off, at, side="right")) - 1)
                at = raw.find(token, int(off[row + 1]))
        return found

    def _fresh(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        lists = [e.ids for e in self.encode_batch([raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int32, sizes.sum()), sizes

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offset of each text)."""
        starts, ends = unit_bounds(data, off)
        if whole := self._with_added(data, off):  # the library looks for added tokens before anything else
            inner = np.isin(np.searchsorted(off, starts, side="right") - 1, list(whole)) & ~np.isin(starts, off)
            starts = starts[~inner]
            ends = np.append(starts[1:], len(data))
        hashes, at, inverse = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        seen, number = self.known
        place = np.searchsorted(seen, hashes)
        met = np.zeros(len(hashes), bool)
        if len(seen):
            met = seen[np.minimum(place, len(seen) - 1)] == hashes
        old = met.copy()
        old[met] = same_bytes(data, starts[at[met]], size[at[met]], self.bytes, self.upto[number[place[met]]], np.diff(self.upto)[number[place[met]]])
        odd = np.flatnonzero(~same_bytes(data, starts, size, data, starts[at][inverse], size[at][inverse]))
        anew = np.concatenate([at[~met], at[met & ~old], odd])
        ids, sizes = self._fresh(data, starts[anew], ends[anew])
        first = len(self.ends) - 1
        unit = np.empty(len(hashes), np.int64)
        unit[old] = number[place[old]]
        n_new = np.count_nonzero(~met)
        unit[~met] = first + np.arange(n_new)
        unit[met & ~old] = first + n_new + np.arange(np.count_nonzero(met & ~old))
        which = unit[inverse]
        which[odd] = first + len(anew) - len(odd) + np.arange(len(odd))
        upto = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        ids = np.concatenate([self.ids, ids])
        if len(seen) < MEMO:  # else the new units last for this call only
            new = at[~met]
            self.known = np.insert(seen, place[~met], hashes[~met]), np.insert(number, place[~met], unit[~met])
            self.ids, self.ends = ids[: upto[first + n_new]], upto[: first + n_new + 1]
            self.bytes = np.concatenate([self.bytes, data[ranges(starts[new], size[new])]])
            self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(size[new])])
        length = (upto[1:] - upto[:-1])[which]
        total = np.concatenate([[0], np.cumsum(length)])
        flat = ids[np.repeat(upto[which] - total[:-1], length) + np.arange(total[-1])]
        return flat, total[np.searchsorted(starts, off)]


@cache
def _unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)  # tasks of one worker share it


def _encoder(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = _unit_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, limit=4 << 20):
                ids, ends = encode(*text_buffer(rows.column("text")))
                n = np.diff(ends) + 1
                off = np.concatenate([[0], np.cumsum(n)])
                ids = np.insert(ids, ends[1:], end_id)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(start + off[:-1]), pa.array(n), arrow_list(ids, off, pa.int32())],
                    names=["doc_id", "part", "local_start", "n_tokens", "token_ids"],
                )
                start += int(off[-1])

    return run


def ranges_wanted(docs: DataFrame) -> int:
    """As many ranges as there are RANGE_BYTES of text, but at least the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> str:
    """Encodes ``docs`` (doc_id, text) and writes the ORC files under ``path`` in ascending doc_id order."""
    partitions = partitions or ranges_wanted(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    (
        rows.mapInArrow(_encoder(tokenizer, end_id), SCHEMA)
        .write.format("orc")
        .options(**{"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(64 << 20)})
        .save(path)
    )
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, token_ids (filters on doc_id reach the ORC reader)."""
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "token_ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("token_ids")
        off = np.asarray(ids.offsets)
        data = memoryview(np.ascontiguousarray(np.asarray(ids.values, dtype="<u4"))).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    return tokens.mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = write_tokens(read_table(spark, sf_dir, "documents"), work_path(spark, "op1"), public_tokenizers.path("byte_bpe_50k.json"))
    return digest(read_tokens(spark, path))


QUERIES = {"op1_token_output": op1_token_output}
ORACLE: dict[str, str] = {}
