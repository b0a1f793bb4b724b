"""Greedy longest-match token counts by a linear automaton; no piece is ever built.

The vocabulary's byte strings form a trie. When a node has no child for the next byte, its failure link names
the node reached after the greedy matcher has cut off its longest pieces, and a precomputed number says how many
pieces that cuts off. Both are closed over all bytes (next node and pieces popped for each node and byte), so a
word of n bytes takes n steps; the words of a slice take their k-th step together.

A word is a space and a run of bytes outside white space (``common.SPACES``); the count of a text is the sum
over its words. A byte that no piece begins with counts as one token of its own.

Defined cases: null or blank text counts 0; repeated rows count each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, spread, text_buffer, text_slices, word_bounds

#: Words up to so many bytes step together; longer ones (few) walk alone.
TOGETHER = 256


class LongestMatch:
    """``step[node * 256 + byte]`` is the next node, ``pops[...]`` the pieces cut off on the way."""

    def __init__(self, pieces: Iterable[bytes]):
        have = sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)}, key=lambda p: (len(p), p))
        children: list[dict[int, int]] = [{}]
        depth, is_piece = [0], [False]
        for piece in have:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    is_piece.append(False)
                node = nxt
            is_piece[node] = True
        n = len(children)
        kind = np.min_scalar_type(max(depth))  # a node's string is cut into at most as many pieces as it has bytes
        self.step, self.pops = np.zeros((n, 256), np.int32), np.zeros((n, 256), kind)
        link, popped = np.zeros(n, np.int32), np.zeros(n, kind)  # popped: pieces in a node's string before its link
        order = sorted(range(n), key=depth.__getitem__)
        for node in order:
            for b, child in children[node].items():
                if is_piece[child]:
                    link[child], popped[child] = 0, 1
                else:  # node is not the root: every single byte is a piece
                    up = link[node]
                    link[child], popped[child] = self.step[up, b], popped[node] + self.pops[up, b]
            if node:
                self.step[node], self.pops[node] = self.step[link[node]], self.pops[link[node]] + popped[node]
            for b, child in children[node].items():
                self.step[node, b], self.pops[node, b] = child, 0
        # what is left at a word's end: pieces of the node's own string
        self.rest = np.zeros(n, np.int32)
        for node in order[1:]:
            self.rest[node] = popped[node] + self.rest[link[node]]
        self.step, self.pops = self.step.ravel(), self.pops.ravel()

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int = 0) -> np.ndarray:
        """Pieces of each byte range; ``first``: the node that every range begins at."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        begin, size = starts[order], length[order]
        node, total = np.full(len(order), first, np.int64), np.zeros(len(order), np.int64)
        alone = int(np.searchsorted(-size, -TOGETHER, side="left"))  # longer than TOGETHER
        for k in range(alone):
            node[k], total[k] = self._walk(data[begin[k] : begin[k] + size[k]], first)
        live = np.searchsorted(-size[alone:], -np.arange(1, (size[alone] if alone < len(size) else 0) + 1), side="right") + alone
        for k, to in enumerate(live.tolist()):
            at = node[alone:to] * 256 + data[begin[alone:to] + k]
            total[alone:to] += self.pops[at]
            node[alone:to] = self.step[at]
        out = np.empty(len(order), np.int64)
        out[order] = total + self.rest[node]
        return out

    def _walk(self, word: np.ndarray, node: int) -> tuple[int, int]:
        step, pops, total = memoryview(self.step), memoryview(self.pops), 0
        for b in word.tobytes():
            at = node * 256 + b
            total += pops[at]
            node = step[at]
        return node, total


def byte_pieces(path: str) -> list[bytes]:
    """The byte strings of a vocabulary file of lines 'base64 rank'."""
    import base64

    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@cache
def _automaton(path: str) -> LongestMatch:
    return LongestMatch(byte_pieces(path))


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_bytes (of the words) and n_tokens of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(vocabulary)
        space = int(automaton.step[ord(" ")])  # every word begins with a space
        for batch in batches:
            for rows in text_slices(batch):
                data, off = text_buffer(rows.column("text"))
                starts, ends, row = word_bounds(data, off)
                n, tally = rows.num_rows, lambda w, row=row, n=rows.num_rows: pa.array(np.bincount(row, w, n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(np.bincount(row, minlength=n).astype(np.int64)), tally(ends - starts), tally(automaton.count(data, starts, ends, space))], names=["doc_id", "n_words", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spread(read_table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
