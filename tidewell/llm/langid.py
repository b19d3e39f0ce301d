"""Language identification by hierarchical discrimination.

First the language family is told, then the language within the family. Both levels are one-versus-one linear support
vector machines over frequencies of hashed byte trigrams of the text in lower case. They are fitted on a sample of
labelled rows of at most about ``per_language`` rows a language; predictions read every whole text in one pass without
a shuffle, as sums of the rows of a weight table that all tasks share (``2**BITS`` rows of a few floats).

A text that is null or has no letter is ``und`` with score 0, as is every text where nothing can be learned. Very long texts are read in blocks.
Tied votes go to the greater sum of probabilities. Rows repeat as they come, an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, sample_by_hash, slices

#: Families of closely related languages, by ISO 639-1 code. Other languages are families of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "lb"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk", "ky"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu", "ur"),
}
UNKNOWN = "und"
BITS = 13
#: Rows of a class that a machine is fitted on, at most.
CLASS_ROWS = 1200
#: Share of labelled texts and passages whose scores, halved, are those of no language.
REJECTED = 0.001
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), f"other:{lang}")


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that begins at each byte, runs over the end included as if spaces followed."""
    x = np.concatenate([_LOWER[data], np.array([32, 32], np.uint32)])
    key = x[:-2] | x[1:-1] << 8 | x[2:] << 16
    return (key * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def frequencies(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a text has and their frequencies."""
    counts = np.bincount(trigram_buckets(np.frombuffer(text, np.uint8)), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, len(text))).astype(np.float32)


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), 1 << BITS), np.float32)
    for x, (at, share) in zip(out, rows, strict=True):
        x[at] = share
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, reg: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear support vector machine by stochastic subgradients (Pegasos) over mini-batches; y is -1 or 1, classes weigh alike."""
    rng, w, b, step = np.random.default_rng(seed), np.zeros(x.shape[1], np.float32), 0.0, 0
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            rate = 1 / (reg * (step + 1 / reg))
            wrong = y[at] * (x[at] @ w + b) < 1
            g = (weight[at] * y[at] * wrong)[:, None]
            w = (1 - rate * reg) * w + rate * (g * x[at]).sum(0) / len(at)
            b += rate * float(g.sum()) / len(at)
    return w, b


@dataclass
class Votes:
    """One-versus-one machines over classes; columns of ``weights`` are pairs."""

    classes: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    bias: np.ndarray
    unit: np.ndarray  # typical margin of each pair

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], names: list[str], most: int = CLASS_ROWS) -> Votes:
        """At most about ``most`` rows of a class, evenly spread, so that the matrix of a pair is bounded however many classes there are."""
        classes, own, size = sorted(set(names)), {}, 1 << BITS
        for name in classes:
            at = [i for i, n in enumerate(names) if n == name]
            own[name] = [rows[i] for i in at[:: -(-len(at) // most)]]
        some = [r for name in classes for r in own[name]]
        total, squares = np.zeros(size), np.zeros(size)
        for at, share in some:
            total[at] += share
            squares[at] += share.astype(float) ** 2
        n = max(1, len(some))
        spread = (np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)) + 1e-4).astype(np.float32)  # floors the weight of trigrams that hardly occur
        pairs, ws, bs, units = list(combinations(range(len(classes)), 2)), [], [], []
        for a, b in pairs:
            first, second = own[classes[a]], own[classes[b]]
            y = np.repeat(np.array([1.0, -1.0], np.float32), [len(first), len(second)])
            z = dense(first + second)
            z /= spread * np.sqrt(np.float32(size))
            w, bias = linear_svm(z, y)
            ws.append(w / spread / np.sqrt(size))
            bs.append(bias)
            units.append(max(1e-3, float(np.median(np.abs(z @ w + bias)))))
        return cls(classes, pairs, np.array(ws, np.float32).reshape(len(pairs), size).T.copy(), np.array(bs), np.array(units))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes, margins break ties; and its mean probability against the others."""
        n = len(margins)
        p = 1 / (1 + np.exp(-np.clip(3 * (margins + self.bias) / self.unit, -40, 40)))
        total = np.zeros((n, len(self.classes)))
        votes = np.zeros((n, len(self.classes)))
        for k, (a, b) in enumerate(self.pairs):
            total[:, a] += p[:, k]
            total[:, b] += 1 - p[:, k]
            votes[:, a] += p[:, k] >= 0.5
            votes[:, b] += p[:, k] < 0.5
        if not self.pairs:
            return np.zeros(n, int), np.ones(n)
        win = (votes + total / len(self.classes) / 2).argmax(1)
        return win, total[np.arange(n), win] / (len(self.classes) - 1)


@dataclass
class LanguageModel:
    family: Votes | None
    within: dict[str, Votes]
    least: float = 0.0  # score below which a text looks like none of the languages

    @classmethod
    def fit(cls, texts: list[bytes], langs: list[str]) -> LanguageModel:
        """Each text counts twice, whole and as a passage of a hundred bytes from its midst, as short texts are to be told as well."""
        if not texts:
            return cls(None, {})
        parts = [(t, lang) for t, lang in zip(texts, langs, strict=True) if t] + [(t[len(t) // 2 :][:100], lang) for t, lang in zip(texts, langs, strict=True) if len(t) > 200]
        x = [frequencies(t) for t, _ in parts]
        names = [lang for _, lang in parts]
        families = [family_of(n) for n in names]
        within = {}
        for f in sorted(set(families)):
            at = [i for i, g in enumerate(families) if g == f]
            within[f] = Votes.fit([x[i] for i in at], [names[i] for i in at])
        model = cls(Votes.fit(x, families), within)
        _, scores = model.predict(np.frombuffer(b"".join(t for t, _ in parts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t, _ in parts])]))
        model.least = float(np.quantile(scores, REJECTED)) / 2 if parts else 0.0
        return model

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; texts lie end to end in data."""
        sizes = np.diff(offsets)
        n = len(sizes)
        langs, scores = [UNKNOWN] * n, np.zeros(n)
        if self.family is None or not n:
            return langs, scores
        members = [self.family, *self.within.values()]
        table = np.concatenate([v.weights for v in members], axis=1)
        sums = np.zeros((n, table.shape[1]))
        for i in range(n):  # by text: the trigrams of a long one are taken in blocks
            for at in range(offsets[i], offsets[i + 1], 1 << 16):
                block = data[at : min(at + (1 << 16) + 2, offsets[i + 1])]
                buckets = trigram_buckets(block)[: 1 << 16]
                sums[i] += np.bincount(buckets, minlength=len(table)) @ table if len(buckets) > 1 << 11 else table[buckets].sum(0)
        margins = sums / np.maximum(1, sizes)[:, None]
        at = len(self.family.pairs)
        best, p = self.family.decide(margins[:, :at])
        for k, (name, votes) in enumerate(self.within.items()):
            own = np.flatnonzero(best == self.family.classes.index(name))
            win, q = votes.decide(margins[own, at : at + len(votes.pairs)])
            for i, w, s in zip(own, win, p[own] * q, strict=True):
                langs[i], scores[i] = votes.classes[w], s
            at += len(votes.pairs)
        return langs, scores


def fit(docs: DataFrame, learn: Column | None = None, per_language: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on about per_language rows of each language (all of those that have fewer) among the rows where ``learn`` holds and lang is not null.

    The sample is by hash of the id, so it is the same at each run and needs no shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (F.lit(True) if learn is None else learn).alias("learn"))
    rows = rows.where("learn AND lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return LanguageModel(None, {})
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    got = sample_by_hash(rows, share, 101).select("id", "lang", F.col("text").cast("binary").alias("text")).toArrow().sort_by([("id", "ascending")])
    return LanguageModel.fit(got["text"].to_pylist(), got["lang"].to_pylist())


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS rows by the pairs of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            langs, scores = model.predict(*buffer_of(part.column(1)))
            letters = [any(map(str.isalpha, x or "")) for x in part.column(1).to_pylist()]
            langs = [lang if ok else UNKNOWN for lang, ok in zip(langs, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(np.where(np.array(langs) == UNKNOWN, 0.0, scores))], names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a language: it has a letter, and the score of the language predicted is not below what
    the model takes as none (far under that of labelled texts and of short passages). Where nothing was learned, texts with a letter stay."""
    names, at = docs.columns, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches):
            _, scores = model.predict(*buffer_of(part.column(at)))
            keep = [(model.family is None or s >= model.least) and any(map(str.isalpha, x or "")) for s, x in zip(scores, part.column(at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns], names=names)

    return docs.mapInArrow(run, docs.schema)
