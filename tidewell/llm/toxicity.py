"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its beginnings; filters of widths 1, 2 and 3 slide over the words, each filter's
maximum over the whole text is kept, and a logistic layer reads the maxima. As only the winning window of each filter
carries gradient, training is cheap. At scoring, embeddings times filters are computed once for each distinct word, so
a text costs one gather and one maximum for each of its words.

Logits are calibrated by language: the training rows are grouped by the language that their text tells (by its function
words; the ``lang`` column is never read), each group gets the threshold that separates its labels best, and the score is
the logistic of the distance to it, so 0.5 is the threshold in every language.

Null and empty texts get the score of a text without evidence. Fitting reads at most about ``positives`` + ``negatives``
labelled rows, whose whole texts reach the driver: a bound on rows and not on bytes. Scoring reads every whole text, however long, in one pass without a
shuffle. Where there are no labels every score is 0. A score of just 0.5 is toxic. Rows repeat as they come; of repeated labels of an id any 1 counts; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_by_hash, slices, utf8

BUCKETS = 1 << 16
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Lengths in characters of the beginnings that have embeddings beside the whole word.
HEADS = (4, 5, 6, 7)
#: Distinct words that a worker keeps before it starts anew.
CACHE_WORDS = 200_000
#: Frequent function words that tell a text's language for calibration.
FUNCTION_WORDS = {
    "en": "the and of to in is that it for was with as on are this be".split(),
    "de": "der die und das ist nicht von mit den sich auf ein eine zu im".split(),
    "fr": "le la les et des est un une du dans que pour qui par en".split(),
    "es": "el los las y que es una del por con para se no su como".split(),
}
GROUPS = ["other", *FUNCTION_WORDS]
_GROUP_OF = {w.encode(): GROUPS.index(g) for g, ws in FUNCTION_WORDS.items() for w in ws}
_TRIM = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def features(word: bytes) -> list[int]:
    """Buckets of a word: the whole and its beginnings, in lower case, without punctuation at its ends."""
    text = word.strip(_TRIM).decode("utf-8", "replace").lower()
    return [zlib.crc32(f"{k}:{text[:k] if k else text}".encode()) % BUCKETS for k in (0, *HEADS) if len(text) >= k]


@dataclass
class ToxicityModel:
    table: np.ndarray  # buckets by DIM
    filters: np.ndarray  # DIM by FILTERS * (1 + 2 + 3)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(GROUPS)))
    slope: float = 1.0

    def vectors(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        got = np.zeros((n, DIM), np.float32)
        np.add.at(got, owner, self.table[rows])
        return got

    def maxima(self, projected: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over a text's words, and the first word of the winning window (-1: text too short)."""
        best, where, at = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1), 0
        for k, width in enumerate(WIDTHS):
            if (n := len(ids) - width + 1) > 0:
                z = projected[ids[:n], at : at + FILTERS].copy()
                for j in range(1, width):
                    z += projected[ids[j : j + n], at + j * FILTERS : at + (j + 1) * FILTERS]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                where[own] = z.argmax(0)
                best[own] = z.max(0)
            at += FILTERS * width
        return np.where(where >= 0, np.maximum(best + self.bias, 0), 0), where

    def scores(self, logits: np.ndarray, groups: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (logits - self.cuts[groups]), -30, 30)))


class Vocabulary:
    """Distinct words seen, their buckets and their language group; ids are dense."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.rows: list[int] = []
        self.owner: list[int] = []
        self.group: list[int] = []

    def add(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        for w in words:
            if w not in ids:
                ids[w] = k = len(ids)
                got = features(w)
                self.rows += got
                self.owner += [k] * len(got)
                self.group.append(_GROUP_OF.get(w.lower(), 0))
        return np.fromiter(map(ids.__getitem__, words), np.int32, len(words))


def group_of(votes: np.ndarray) -> int:
    """The language group with most function words; 0 if there are none."""
    count = np.bincount(votes, minlength=len(GROUPS))[1:]
    return int(count.argmax()) + 1 if count.any() else 0


def train(texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.02, seed: int = 5) -> ToxicityModel:
    """Adam over mini-batches; the classes weigh alike."""
    rng, vocab = np.random.default_rng(seed), Vocabulary()
    words = [vocab.add(t.split()) for t in texts]
    rows, owner = np.array(vocab.rows, np.int64), np.array(vocab.owner, np.int64)
    begins = np.searchsorted(owner, np.arange(len(vocab.ids) + 1))
    wide = FILTERS * sum(WIDTHS)
    m = ToxicityModel((rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(np.float32), (rng.standard_normal((DIM, wide)) * 0.3).astype(np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0)
    moments = {k: (np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))) for k in ("table", "filters", "bias", "out")}
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y == 0).sum()))
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            step += 1
            used, inverse = np.unique(np.concatenate([words[i] for i in part]), return_inverse=True)
            take = np.concatenate([np.arange(begins[u], begins[u + 1]) for u in used]) if len(used) else np.zeros(0, int)
            vectors = m.vectors(rows[take], np.searchsorted(used, owner[take]), len(used))
            projected = vectors @ m.filters
            grads = {"filters": np.zeros_like(m.filters), "bias": np.zeros_like(m.bias), "out": np.zeros_like(m.out)}
            vector_grads, at, out_bias = np.zeros_like(vectors), 0, 0.0
            for i in part:
                ids = inverse[at : at + len(words[i])]
                at += len(ids)
                h, where = m.maxima(projected, ids)
                d = weight[i] * (1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30))) - y[i]) / len(part)
                grads["out"] += d * h
                out_bias += d
                dh = d * m.out * ((h > 0) & (where >= 0))
                grads["bias"] += dh
                col = 0
                for k, width in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        if g := dh[k * FILTERS + f]:
                            for j in range(width):
                                w = ids[where[k * FILTERS + f] + j]
                                grads["filters"][:, col + j * FILTERS + f] += g * vectors[w]
                                vector_grads[w] += g * m.filters[:, col + j * FILTERS + f]
                    col += FILTERS * width
            m.out_bias -= rate * out_bias
            for k, g in grads.items():
                a, b = moments[k]
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                getattr(m, k)[...] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            moved = np.flatnonzero(vector_grads.any(1))
            if len(moved):  # embeddings: only the rows that won
                at_rows = np.concatenate([np.arange(begins[used[u]], begins[used[u] + 1]) for u in moved])
                g = np.zeros((len(at_rows), DIM), np.float32) + vector_grads[np.searchsorted(used, owner[at_rows])]
                uniq, inv = np.unique(rows[at_rows], return_inverse=True)
                gu = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(gu, inv, g)
                b = moments["table"][1]
                b[uniq] += gu * gu
                m.table[uniq] -= 2 * rate * gu / (np.sqrt(b[uniq]) + 1e-6)
    return m


def calibrate(m: ToxicityModel, logits: np.ndarray, groups: np.ndarray, y: np.ndarray, least: int = 20) -> None:
    """The threshold of each language group: the one that errs least on rows that weren't trained on. Small groups take that of all rows."""

    def best(z: np.ndarray, t: np.ndarray) -> float:
        order = np.argsort(z)
        z, t = z[order], t[order]
        errors = np.concatenate([[0], np.cumsum(t)]) + np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
        ties = np.flatnonzero(errors == errors.min())
        k = ties[len(ties) // 2]
        return float((z[max(0, k - 1)] + z[min(k, len(z) - 1)]) / 2)

    whole = best(logits, y) if 0 < y.sum() < len(y) else 0.0
    for g in range(len(GROUPS)):
        own = groups == g
        enough = min(y[own].sum(), (1 - y[own]).sum()) >= least
        m.cuts[g] = best(logits[own], y[own]) if enough else whole


def logits_of(m: ToxicityModel, texts: list[bytes], cache: dict) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language group of each text. cache: words known so far with their projections, bounded by CACHE_WORDS and one slice."""
    if "vocab" not in cache or len(cache["vocab"].ids) > CACHE_WORDS:
        cache |= {"vocab": Vocabulary(), "projected": np.zeros((0, m.filters.shape[1]), np.float32), "group": np.zeros(0, np.int64)}
    vocab, logits, groups = cache["vocab"], np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    before, at = len(vocab.ids), len(vocab.rows)
    words = [vocab.add(t.split()) for t in texts]
    if len(vocab.ids) > before:
        fresh = m.vectors(np.array(vocab.rows[at:], np.int64), np.array(vocab.owner[at:], np.int64) - before, len(vocab.ids) - before) @ m.filters
        cache["projected"] = np.concatenate([cache["projected"], fresh])
        cache["group"] = np.concatenate([cache["group"], np.array(vocab.group[before:], np.int64)])
    for i, ids in enumerate(words):
        logits[i] = m.maxima(cache["projected"], ids)[0] @ m.out + m.out_bias
        groups[i] = group_of(cache["group"][ids])
    return logits, groups


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, positives: int = 1500, negatives: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """Fits on a hashed sample of at most about so many labelled rows of either class where ``learn`` (over docs' columns) holds. Three quarters train, the rest calibrates.

    Rows without id, label or text don't count; of repeated labels of an id, any 1 makes it 1.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(True) if learn is None else learn).alias("learn")).where("learn AND text IS NOT NULL").drop("learn")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("y") == 1, min(1.0, positives / counts[1])).otherwise(min(1.0, negatives / counts[0]))
    # the sampled labels are a few thousand rows by that bound, so they go to the documents and not the other way round
    got = rows.join(F.broadcast(sample_by_hash(known, share, 202)), "id").select("id", "y", F.col("text").cast("binary").alias("text")).toArrow().sort_by([("id", "ascending")])
    texts, y = got["text"].to_pylist(), np.array(got["y"].to_pylist(), np.float32)
    held = np.arange(len(y)) % 4 == 3
    if not len(y) or not 0 < y[~held].sum() < (~held).sum():
        return None
    m = train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    logits, groups = logits_of(m, texts, {})
    calibrate(m, logits[held], groups[held], y[held])
    return m


def score(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, score, predicted."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS by DIM floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for part in slices(batches):
            p = np.zeros(part.num_rows)
            if m is not None:
                p = m.scores(*logits_of(m, utf8(part.column(1)), cache))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, score double, predicted int")
