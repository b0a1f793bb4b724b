"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Vocabulary: word beginnings (4 to 10 characters) and whole words that occur in toxic examples more often than chance
allows (log-likelihood ratio); all other words together are one more term. A text is the vector of its term shares
times the terms' weights, ln((1 + N) / (1 + df)) with N and df counted over all documents (the last term weighs as much
as the terms of a middling toxic example), so the cosine also sees how dense the toxic terms are. The K nearest
examples vote, weighted by their distance; a logistic curve, fitted on the examples' own left-one-out votes, turns
votes into probabilities. Neighbours are returned as evidence.

The index keeps, for each term, its examples' weights by blocks of BLOCK examples and each block's largest weight.
A query bounds every block by the largest weights, visits blocks from the highest bound on, and stops when no bound
reaches its K-th neighbour: the result is exact.

Fitting uses at most ``2 * (PER_CLASS[0] + PER_CLASS[1])`` labelled rows of at most ``sampling.SAMPLE_BYTES`` bytes
(documented bounds); every text is counted and scored, whole.

Defined cases: a text without a word (null, empty, no letter) is no vector: its score is the share of toxic rows among
all training labels, without evidence. No training row of both classes: score 0. Repeated rows are scored each, repeated labels and documents with the same id and text count once in fitting;
null doc_id: held_out null, never trained on; ties between examples go to the smaller example number; a document with
several labels counts each; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, spread, text_slices
from .sampling import bounded, by_class, fold

#: Examples wanted of the classes 0 and 1.
PER_CLASS = (1500, 1000)
K, BLOCK = 15, 64
#: Least log-likelihood ratio and least number of toxic examples of a term.
LEAST_RATIO, LEAST_DOCS = 12.0, 3
#: Everything that separates words.
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-cased words, each with a space before it, and a space at the end."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else " "


def _terms_of(text: str) -> set[str]:
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(" " + w[:n] for n in range(4, min(len(w), 10) + 1))
    return out


def choose_terms(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Terms that toxic examples hold beyond chance, strongest first."""
    counts = [Counter(), Counter()]
    for t, y in zip(texts, toxic.tolist(), strict=True):
        counts[y].update(_terms_of(t))
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    found = []
    for term, a in counts[1].items():
        b = counts[0].get(term, 0)
        if a < LEAST_DOCS or a * n0 <= 3 * b * n1:
            continue
        p, p0, p1 = (a + b) / (n0 + n1), b / n0, a / n1
        ratio = 2 * sum(k * np.log(q / p) for k, q in ((a, p1), (b, p0)) if k) + 2 * sum(k * np.log((1 - q) / (1 - p)) for k, q in ((n1 - a, p1), (n0 - b, p0)) if k)
        if ratio >= LEAST_RATIO:
            found.append((-ratio, term))
    return [t for _, t in sorted(found)]


class Counting:
    """Counts the terms of a text in one pass of an Aho-Corasick automaton."""

    def __init__(self, terms: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            self.automaton.add_word(t, k)
        if terms:
            self.automaton.make_automaton()
        self.rest = len(terms)

    def __call__(self, text: str) -> dict[int, float]:
        """Share of each term in the words of a plain text; under ``rest``, that of words without any."""
        words = text.count(" ") - 1
        if words <= 0:
            return {}
        hits = Counter(k for _, k in self.automaton.iter(text)) if self.rest else {}
        out = {k: n / words for k, n in hits.items()}
        out[self.rest] = 1.0
        return out


@dataclass
class BlockMaxIndex:
    """Inverted lists of unit vectors, in blocks, with the largest weight of each block and term."""

    n: int
    terms: int
    places: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    begins: np.ndarray | None = None
    largest: np.ndarray | None = None

    @classmethod
    def of(cls, vectors: np.ndarray) -> BlockMaxIndex:
        n, terms = vectors.shape
        index = cls(n, terms)
        blocks = max(1, -(-n // BLOCK))
        index.begins, index.largest = np.zeros((terms, blocks + 1), np.int64), np.zeros((terms, blocks))
        for t in range(terms):
            at = np.flatnonzero(vectors[:, t])
            index.places.append(at)
            index.weights.append(vectors[at, t])
            index.begins[t] = np.searchsorted(at, np.arange(blocks + 1) * BLOCK)
            np.maximum.at(index.largest[t], at // BLOCK, vectors[at, t])
        return index

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the ``k`` nearest examples, ties to the smaller number; none for an empty query."""
        if not query or not self.n:
            return []
        terms, values = list(query), np.array(list(query.values()))
        bounds = values @ self.largest[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            if len(best) >= k and bounds[block] < best[-1][0] - 1e-12:  # of equal ones the smaller number counts
                break
            base = block * BLOCK
            score = np.zeros(min(BLOCK, self.n - base))
            for t, v in zip(terms, values.tolist(), strict=True):
                lo, hi = self.begins[t, block], self.begins[t, block + 1]
                score[self.places[t][lo:hi] - base] += v * self.weights[t][lo:hi]
            if 0 <= without - base < len(score):
                score[without - base] = -1
            score = score.round(12)
            order = np.argsort(-score, kind="stable")[:k].tolist()
            best = sorted([*best, *((float(score[j]), base + j) for j in order if score[j] >= 0)], key=lambda x: (-x[0], x[1]))[:k]
        return best


@dataclass
class Model:
    terms: list[str]
    weight: np.ndarray  # of each term, the rest's last
    index: BlockMaxIndex
    toxic: np.ndarray
    doc_ids: list[int]
    curve: tuple[float, float]
    base: float = 0.0  # score of a text that is no vector
    k: int = K

    def vector(self, shares: dict[int, float]) -> dict[int, float]:
        x = {t: s * self.weight[t] for t, s in shares.items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        return {t: v / norm for t, v in x.items()} if norm else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Mean label of the neighbours, the nearer the heavier."""
        w = np.array([1 / (0.02 + max(0.0, 1 - s)) for s, _ in near])
        return float((w * self.toxic[[i for _, i in near]]).sum() / w.sum())

    def score(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.base
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.vote(near) + b))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve, with a weak prior; the slope is never negative."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 1e-2 * a, (y - p).sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return max(0.0, float(a)), float(b)


def document_counts(docs: DataFrame, terms: list[str]) -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that hold each term (the last: any word at all); a row of sums for each
    task and term is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, seen, df = Counting(held.value), 0, np.zeros(len(held.value) + 1, np.int64)
        for batch in batches:
            for rows in text_slices(batch):
                seen += rows.num_rows
                for t in rows.column("text").to_pylist():
                    df[list(counting(plain(t)))] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], seen))], names=["term", "n"])

    counts = np.zeros(len(terms) + 1)
    total = 0
    for r in spread(docs.select("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        if r["term"] < 0:
            total = r["n"]
        else:
            counts[r["term"]] = r["n"]
    return total, counts


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits on a bounded sample of ``labels`` (doc_id, toxic) and their texts; None unless both classes occur."""
    labels = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    share = labels.agg(F.avg("toxic")).first()[0]
    sample = by_class(labels.where("toxic = 0"), "toxic", PER_CLASS[0], 1).union(by_class(labels.where("toxic = 1"), "toxic", PER_CLASS[1], 1))
    # the sample is bounded, so it can be broadcast whatever the size of either table
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text", F.xxhash64("doc_id", "toxic", "text").alias("_at"))
    got = sorted((r["doc_id"], r["toxic"], plain(r["text"])) for r in bounded(rows, "_at", 2 * sum(PER_CLASS), "text").collect())
    got = [g for g in got if g[2].strip()]
    toxic = np.array([y for _, y, _ in got], np.int64)
    if not len(toxic) or not 0 < toxic.sum() < len(toxic):
        return None
    texts = [t for *_, t in got]
    terms = choose_terms(texts, toxic)
    shares = [Counting(terms)(t) for t in texts]
    total, df = document_counts(docs, terms)
    return build(got, toxic, terms, shares, np.log((1 + total) / (1 + df)), float(share))


def build(got: list[tuple], toxic: np.ndarray, terms: list[str], shares: list[dict[int, float]], weight: np.ndarray, base: float) -> Model:
    """The model of examples (doc_id, toxic, plain text) with their term shares and the terms' idf."""
    # the rest weighs as much as the terms of a middling toxic example, so that cosine tells dense from thin
    mass = [m for s, y in zip(shares, toxic, strict=True) if y and (m := sum((v * weight[t]) ** 2 for t, v in s.items() if t < len(terms)) ** 0.5)]
    weight[-1] = 0.5 * float(np.median(mass)) if mass else 1.0
    # like examples share blocks: order by class, strongest term and density
    model = Model(terms, weight, BlockMaxIndex(0, 0), toxic, [], (0.0, 0.0), base)
    vectors = [model.vector(s) for s in shares]
    order = sorted(range(len(vectors)), key=lambda k: (max(vectors[k], key=vectors[k].get, default=-1), toxic[k], k))
    dense = np.zeros((len(vectors), len(terms) + 1))
    for place, k in enumerate(order):
        for t, v in vectors[k].items():
            dense[place, t] = v
    model.index, model.toxic, model.doc_ids = BlockMaxIndex.of(dense), toxic[order], [got[k][0] for k in order]
    votes = np.array([model.vote(near) if (near := model.index.nearest(vectors[k], K, without=place)) else base for place, k in enumerate(order)])
    model.curve = _logistic(votes, model.toxic)
    return model


def score(docs: DataFrame, model: Model | None, keep: bool = False, prefix: str = "") -> DataFrame:
    """doc_id, score, predicted and evidence (doc_ids of the nearest examples) of each row; all columns of ``docs``
    besides, if ``keep``; ``prefix`` goes before the new names, where a column has one of them already."""
    columns = docs.columns if keep else ["doc_id"]
    new = [prefix + c for c in ("score", "predicted", "evidence")]
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by PER_CLASS and the words of so many texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = pickle.loads(held.value)
        counting = Counting(m.terms) if m else None

        @lru_cache(maxsize=20_000)
        def judged(shares: tuple[tuple[int, float], ...]) -> tuple[float, list[int]]:
            near = m.index.nearest(m.vector(dict(shares)), m.k)
            return m.score(near), [m.doc_ids[i] for _, i in near]

        for batch in batches:
            for rows in text_slices(batch):
                texts = rows.column("text").to_pylist()
                got = [judged(tuple(sorted(counting(plain(t)).items()))) if m else (0.0, []) for t in texts]
                value = np.array([s for s, _ in got], np.float64)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in columns), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array([e for _, e in got], pa.list_(pa.int64()))],
                    names=[*columns, *new],
                )

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"`{c}` {t}" for c, t in zip(new, ("double", "int", "array<bigint>"), strict=True))])
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, kinds)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score(spread(docs.select("doc_id", "text")), model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
