"""Nearest-centroid language identification over TF-IDF vectors of character n-grams.

A text's letters, lower-cased, with every run of other characters as one space, give n-grams of 1 to 3 characters,
hashed to DIM places; log counts times idf, scaled to length one. Each language has several centroids (spherical
k-means over its training vectors); the nearest by cosine names the language.

Rejection is by distance and length: each half of all training texts, cut to the numbers of letters CUTS, is scored
by centroids of the other half, and the QUANTILE of these cosines at each length is the bound there; between lengths
it is interpolated over the logarithm, beyond them it stays. A text whose best cosine is below its bound is rejected,
short ones too.

Nothing is fitted on a sample: idf, ln((1 + N) / (1 + df)) + 0.1, is counted over all training texts, all of them take
part in each step of k-means and in the bounds, whose quantile is exact. Their n-grams are counted once and kept packed (at
most 512 bytes of places and a byte or four for each count). Sums of vectors are exact multiples of 2^-24, so the model
doesn't depend on how rows are dealt. k-means starts from the texts whose n-grams have the smallest hashes and ends when
nothing moves, or after STEPS passes.

Defined cases: a text that is null or has no letter gives ``und``, score 0, rejected; without any training row
everything is ``und``; more than max_languages values of lang are an error. Null lang or null doc_id: never trained on,
still predicted. Equal cosines: the language that sorts first. Repeated rows count and are predicted each; other columns
are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, spread, text_slices
from .sampling import fold

UNKNOWN = "und"
DIM = 4096
MAX_LANGUAGES, CENTROIDS, STEPS = 64, 4, 12
#: A text is rejected when its best cosine is below this quantile of those of held-back training texts of its length.
QUANTILE = 0.005
#: Numbers of letters that held-back texts are cut to; a length with fewer than LEAST_CUTS of them has the bound of the
#: next shorter one, unless all have fewer.
CUTS, LEAST_CUTS = (3, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560), 100

_LETTER = np.zeros(0x110000, bool)
_letter_known = False


def _letters() -> np.ndarray:
    global _letter_known
    if not _letter_known:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
        _letter_known = True
    return _LETTER


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of n-grams, a row for each text; number of letters of each)."""
    lowered = [t.lower() for t in texts]
    # a line feed before and after each text; it may hold some itself, so rows are told by length
    codes = np.frombuffer("".join(f"\n{t}\n" for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    lengths = np.array([len(t) + 2 for t in lowered], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other character after a letter stands for the whole run
    keep[np.cumsum(lengths) - lengths] = True
    c = np.where(letter, codes, 32)[keep].astype(np.uint64)
    r = row[keep]
    n_letters = np.bincount(row[letter], minlength=len(texts))
    counts = np.zeros(len(texts) * DIM)
    gram = np.zeros(len(c), np.uint64)
    for n in range(3):
        if len(c) <= n:
            break
        gram = gram[: len(c) - n] * np.uint64(0x100000001B3) + c[n:] + np.uint64(n + 1)
        same = (r[: len(c) - n] == r[n:]) & ((c[: len(c) - n] != 32) | (n > 0))
        h = gram[same] * np.uint64(0x9E3779B97F4A7C15)
        place = (h >> np.uint64(64 - 12)).astype(np.int64)
        counts += np.bincount(r[n:][same] * DIM + place, minlength=len(counts))
    return counts.reshape(len(texts), DIM), n_letters


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(counts)
    return _dense(at, _weights(at, counts.ravel()[at], idf, len(counts)), len(counts))


def _weights(at: np.ndarray, n: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """Weight of each n-gram, for its number of occurrences and row * DIM + place."""
    row = at // DIM
    value = np.log1p(n) * idf[at % DIM]
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return (value / np.where(norm > 0, norm, 1)[row]).astype(np.float32)


def _dense(at: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    x = np.zeros(rows * DIM, np.float32)
    x[at] = value
    return x.reshape(rows, DIM)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    bounds: list[tuple[int, float]]  # (letters, least cosine that isn't rejected)

    def least(self, letters: np.ndarray) -> np.ndarray:
        if not self.bounds:
            return np.zeros(len(letters))
        at, bound = zip(*self.bounds, strict=True)
        return np.interp(np.log(np.maximum(letters, 1)), np.log(at), bound)


def cuts(text: str) -> list[tuple[int, str]]:
    """(letters, whole words from the second third of a text on, then from its start, up to so many) for each of CUTS
    that the text has."""
    words = text.split()
    first = len(words) // 3
    turned = words[first:] + words[:first]
    out: list[tuple[int, str]] = []
    have = 0
    for k, w in enumerate(turned):
        have += len(w) if w.isalpha() else sum(map(str.isalpha, w))
        while len(out) < len(CUTS) and have >= CUTS[len(out)]:
            out.append((CUTS[len(out)], " ".join(turned[: k + 1])))
        if len(out) == len(CUTS):
            break
    return out


def _bounds(rows: DataFrame, models: list[Model]) -> list[tuple[int, float]]:
    """Bounds from all ``rows`` (half, lang, text), each half scored by the other's model; texts whose language that one
    doesn't have are left out."""
    held = rows.sparkSession.sparkContext.broadcast(pickle.dumps(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: list[Model] = pickle.loads(held.value)
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                letters, cosines = [], []
                for at in range(0, part.num_rows, 8):  # as many as fit a processor's cache
                    some = [(r["half"], c) for r in part.slice(at, 8).to_pylist() if r["lang"] in others[1 - r["half"]].languages for c in cuts(r["text"] or "")]
                    if some:
                        x = weigh(features([text for _, (_, text) in some])[0], others[0].idf)  # both halves have that of all texts
                        best = np.stack([(x @ m.centroids.T).max(1) for m in others])
                        cosines.append(best[[1 - half for half, _ in some], np.arange(len(some))])
                        letters += [k for _, (k, _) in some]
                if letters:  # positive floats sort as their bits do
                    bits = np.maximum(np.concatenate(cosines), 0).astype(np.float32).view(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(letters, pa.int32()), pa.array(bits)], names=["letters", "bits"])

    found = rows.mapInArrow(run, "letters int, bits int").groupBy("letters", "bits").agg(F.count("*").alias("n"))
    return _quantiles(materialize(found, "language-cosines"))


def _quantiles(found: DataFrame) -> list[tuple[int, float]]:
    """(letters, exact QUANTILE of the cosines), from ``found`` (letters, bits, n): first the upper halves of the bits are
    counted, then the bits within the halves that hold the ranks asked for."""
    high = F.shiftright("bits", 16)
    upper: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(found.groupBy("letters", high.alias("high")).agg(F.sum("n").alias("n")).collect()):  # a few hundred for each of CUTS
        upper.setdefault(r["letters"], []).append((r["high"], r["n"]))
    ranks, asked = {}, {}
    for k, counted in upper.items():
        ends = np.cumsum([n for _, n in counted])
        at = QUANTILE * (int(ends[-1]) - 1)
        for rank in {int(np.floor(at)), int(np.ceil(at))}:
            j = int(np.searchsorted(ends, rank, side="right"))
            ranks[k, rank] = counted[j][0], rank - (int(ends[j - 1]) if j else 0)
            asked[k, counted[j][0]] = []
    if not asked:
        return []
    wanted = F.lit(False)
    for k, h in asked:
        wanted = wanted | ((F.col("letters") == k) & (high == h))
    for r in sorted(found.where(wanted).groupBy("letters", "bits").agg(F.sum("n").alias("n")).collect()):
        asked[r["letters"], r["bits"] >> 16].append((r["bits"], r["n"]))
    value = {}
    for (k, rank), (h, within) in ranks.items():
        j = int(np.searchsorted(np.cumsum([n for _, n in asked[k, h]]), within, side="right"))
        value[k, rank] = float(np.array(asked[k, h][j][0], np.int32).view(np.float32))
    got = []
    for k, counted in sorted(upper.items()):
        n = sum(n for _, n in counted)
        at = QUANTILE * (n - 1)
        low, over = int(np.floor(at)), int(np.ceil(at))
        got.append((k, value[k, low] + (at - low) * (value[k, over] - value[k, low]), n))
    enough = [g for g in got if g[2] >= LEAST_CUTS]
    return [(k, bound) for k, bound, _ in enough or got]


def _pack(rows: DataFrame) -> DataFrame:
    """(half, lang, places: a bit each, counts: a byte each, or four, seed: a hash of both) of the texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    counts, n = features([t or "" for t in some.column("text").to_pylist()])
                    own = [x[x > 0] for x in counts]
                    packed = [x.astype(np.uint8 if x.max(initial=0) < 256 else np.uint32).tobytes() for x in own]
                    out = pa.RecordBatch.from_arrays([some.column("half"), some.column("lang"), pa.array([b.tobytes() for b in np.packbits(counts > 0, axis=1)], pa.binary()), pa.array(packed, pa.binary())], names=["half", "lang", "places", "counts"])
                    yield out.filter(pa.array(n > 0))

    done = spread(rows.select("half", "lang", "text")).mapInArrow(run, "half int, lang string, places binary, counts binary")
    return materialize(done.withColumn("seed", F.xxhash64("places", "counts")), "language-packed")


def _unpack(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row * DIM + place, count) of each n-gram of packed texts."""
    bits = np.frombuffer(b"".join(rows.column("places").to_pylist()), np.uint8).reshape(rows.num_rows, DIM // 8)
    at = np.flatnonzero(np.unpackbits(bits.ravel()).view(bool))
    held = np.bincount(at // DIM, minlength=rows.num_rows).tolist()
    counts = [np.frombuffer(c, np.uint8 if len(c) == k else np.uint32) for c, k in zip(rows.column("counts").to_pylist(), held, strict=True)]
    return at, np.concatenate(counts).astype(np.float64)


def _each(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def document_idf(packed: DataFrame) -> np.ndarray:
    """idf of each place over all packed texts; a row of sums for each task and place is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, df = 0, np.zeros(DIM, np.int64)
        for rows in _each(batches):
            seen += rows.num_rows
            df += np.bincount(_unpack(rows)[0] % DIM, minlength=DIM)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[seen], df]))], names=["place", "n"])

    sums = packed.select("places", "counts").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    df = np.zeros(DIM + 1)
    for r in sums.collect():  # a row for each place
        df[r["place"]] = r["n"]  # the last one, -1, is the number of texts
    return np.log((1 + df[-1]) / (1 + df[:-1])) + 0.1


def _seeds(packed: DataFrame, k: int, idf: np.ndarray) -> list[tuple[list[str], np.ndarray]]:
    """(language of each centroid, centroids to start from) for half 0, half 1 and both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[tuple, list[int]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                own = least.setdefault((r["half"], r["lang"]), [])
                if (len(own) < k or r["seed"] < own[-1]) and r["seed"] not in own:
                    own[:] = sorted([*own, r["seed"]])[:k]
        found = [(h, lang, x) for (h, lang), own in least.items() for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int64())], names=["half", "lang", "seed"])

    least: list[dict[str, set[int]]] = [{}, {}, {}]
    for r in packed.select("half", "lang", "seed").mapInArrow(run, "half int, lang string, seed long").collect():
        for g in (r["half"], 2):
            least[g].setdefault(r["lang"], set()).add(r["seed"])
    chosen = [[(lang, x) for lang, own in sorted(group.items()) for x in sorted(own)[:k]] for group in least]
    asked = sorted({x for group in chosen for _, x in group})
    texts = packed.where(F.col("seed").isin(asked)).groupBy("seed").agg(F.min("places").alias("places"), F.min("counts").alias("counts")).collect() if asked else []
    vectors = {}
    for r in texts:
        one = pa.RecordBatch.from_pylist([{"places": bytes(r["places"]), "counts": bytes(r["counts"])}])
        at, n = _unpack(one)
        vectors[r["seed"]] = _dense(at, _weights(at, n, idf, 1), 1)[0]
    return [([lang for lang, _ in group], np.array([vectors[x] for _, x in group], np.float32).reshape(-1, DIM)) for group in chosen]


def _moved(packed: DataFrame, groups: list[tuple[list[str], np.ndarray]], idf: np.ndarray) -> dict[int, np.ndarray]:
    """Sums of the vectors nearest to each centroid of their language, by number over all groups; one pass over all texts."""
    held = packed.sparkSession.sparkContext.broadcast(pickle.dumps((groups, idf)))
    schema = "cell int, sums binary"

    def table(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["cell", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = pickle.loads(held.value)
        names = np.array([n for g, _ in own for n in g], object)
        means = np.concatenate([m for _, m in own])
        group = np.repeat([0, 1, 2], [len(g) for g, _ in own])
        total, seen = np.zeros(len(names) * DIM), np.zeros(len(names), np.int64)
        for rows in _each(batches):
            at, n = _unpack(rows)
            value = _weights(at, n, weights, rows.num_rows)
            whole = np.rint(value.astype(np.float64) * (1 << 24))
            lang, half = np.array(rows.column("lang").to_pylist(), object), np.array(rows.column("half"))
            cosine = np.where(lang[:, None] == names[None], _dense(at, value, rows.num_rows) @ means.T, -np.inf)
            for other in (group == 2, group[None] == half[:, None]):
                near = np.where(other, cosine, -np.inf).argmax(1)
                total += np.bincount(near[at // DIM] * DIM + at % DIM, whole, len(total))
                seen += np.bincount(near, minlength=len(seen))
        yield table({int(j): total[j * DIM : (j + 1) * DIM] for j in np.flatnonzero(seen)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, raw in zip(batch.column("cell").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.float64)
                sums[cell] = sums[cell] + x if cell in sums else x
        yield table(sums)

    found = packed.select("half", "lang", "places", "counts").mapInArrow(run, schema).repartition("cell").mapInArrow(add, schema)
    return {r["cell"]: np.frombuffer(bytes(r["sums"]), np.float64) for r in found.collect()}  # a row for each centroid


def _cluster(packed: DataFrame, k: int, idf: np.ndarray) -> list[tuple[list[str], np.ndarray]]:
    """(language of each centroid, centroids) for half 0, half 1 and both, by spherical k-means within each language."""
    groups = _seeds(packed, k, idf)
    before: dict[int, np.ndarray] = {}
    for _ in range(STEPS):
        sums = _moved(packed, groups, idf)
        if sums.keys() == before.keys() and all((x == before[j]).all() for j, x in sums.items()):
            break
        before, at, moved = sums, 0, []
        for names, means in groups:
            new = np.stack([sums.get(at + j, m) for j, m in enumerate(means)]) if len(means) else means
            moved.append((names, (new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)).astype(np.float32)))
            at += len(names)
        groups = moved
    return groups


def fit(rows: DataFrame, per_language: int | None = None, max_languages: int = MAX_LANGUAGES, centroids: int = CENTROIDS) -> Model | None:
    """Fits on all ``rows`` (doc_id, text, lang) with an id and a language; None without one that has a letter.
    ``per_language`` is without effect, as nothing is sampled."""
    rows = rows.where("doc_id is not null and lang is not null")
    known = rows.select("lang").distinct().limit(max_languages + 1).count()
    if known > max_languages:
        raise ValueError(f"more than max_languages={max_languages} values of lang: none is left out, raise the limit")
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half"), "lang", "text")
    packed = _pack(rows)
    packed = packed.coalesce(packed.sparkSession.sparkContext.defaultParallelism)  # each task gives a vector for each centroid
    idf = document_idf(packed)
    *halves, (names, means) = _cluster(packed, centroids, idf)
    if not names:
        return None
    bounds = _bounds(spread(rows), [Model(own, x, idf, []) for own, x in halves]) if all(own for own, _ in halves) else []
    return Model(names, means, idf, bounds)


def predict(docs: DataFrame, model: Model | None, keep: bool = False, prefix: str = "") -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row; all columns of ``docs`` besides, if ``keep``; ``prefix`` goes
    before the new names, where a column has one of them already."""
    columns = docs.columns if keep else ["doc_id"]
    new = [prefix + c for c in ("lang_pred", "score", "rejected")]
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # at most MAX_LANGUAGES * CENTROIDS * DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = pickle.loads(held.value)
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                for at in range(0, part.num_rows, 512):
                    rows = part.slice(at, 512)
                    texts = [t or "" for t in rows.column("text").to_pylist()]
                    if m is None:
                        best, score, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                    else:
                        counts, n = features(texts)
                        cosine = weigh(counts, m.idf) @ m.centroids.T
                        near = cosine.argmax(1)
                        score = np.where(n > 0, np.clip(cosine[np.arange(len(near)), near], 0, 1), 0).astype(np.float64)
                        best = [m.languages[j] if k else UNKNOWN for j, k in zip(near.tolist(), n.tolist(), strict=True)]
                        out = (n == 0) | (score < m.least(n))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(best, pa.string()), pa.array(score), pa.array(out)], names=[*columns, *new])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(f"`{c}` {t}" for c, t in zip(new, ("string", "double", "boolean"), strict=True))])
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, kinds)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(spread(docs.select("doc_id", "text")), model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_language": op10_language}
ORACLE: dict[str, str] = {}
