"""Quality rules and an isolation forest over their statistics.

Rules count, over every whole text, what tells prose from junk. The statistics of a document go down trees of random
splits; anomalous documents are isolated after few of them. Each tree of the forest grows on 256 rows of its own, drawn from all labelled rows, and
the threshold on its anomaly score is calibrated on all labels: of all thresholds that keep at least ``keep_share``
of the good rows, the one that keeps the fewest bad ones. Where there are no labels, all that pass the rules are kept.

Words in repeats are found exactly: five-word windows are renamed to dense numbers by sorting, level by level.
Null and empty texts have no words and fail the rules. Very long texts are counted whole; a score of just the threshold is kept. Rows repeat as they come; an
empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, scratch, slices, staged, utf8

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[*range(65, 91)]] = 3
_KIND[list(SYMBOLS)] = 4
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS]] = 5
_KIND[128:192] = 6  # continuation bytes are no code points of their own
STATISTICS = ("word_length", "symbols", "marks", "repeats")
#: Bad rows in a forest's sample for each good one, so that some splits lie where good rows never are.
BAD_SHARE = 0.02


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words within windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # only windows all of whose pairs recur can recur
    pair = ids[:-1] * len(number) + ids[1:]
    _, name, times = np.unique(pair, return_inverse=True, return_counts=True)
    again = times[name] > 1
    live = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(again, size - 1).all(1))
    if not len(live):
        return 0
    key = name[live]
    for step in range(1, size - 1):
        _, key = np.unique(key * (len(pair) + 1) + name[live + step], return_inverse=True)
    _, key, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = live[times[key] > 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def rules(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the statistics that the forest reads."""
    words = [w for w in text.translate(_TO_SPACE).split(b" ") if w]
    kind = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) if text else np.zeros(7, int)
    chars = len(text) - int(kind[1]) - int(kind[6])
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    n, c = max(1, len(words)), max(1, chars)
    stats = [chars / n, kind[4] / c, kind[5] / c, repeat / n]
    return len(words), chars, int(kind[4]), dup, repeat, [float(x) for x in stats]


_TO_SPACE = bytes(32 if b in SPACES else b for b in range(256))


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 10 or 100 * n_repeat > 20 * n_words


@dataclass
class Forest:
    """Trees as arrays: split column, split value, children; leaves have column -1 and their path length."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    unit: float
    threshold: float = np.inf

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 3) -> Forest:
        rng = np.random.default_rng(seed)
        return cls.grow_each([x[rng.choice(len(x), min(sample, len(x)), replace=False)] for _ in range(trees)], seed)

    @classmethod
    def grow_each(cls, samples: list[np.ndarray], seed: int = 3) -> Forest:
        """A tree on each of the samples."""
        rng, trees, sample = np.random.default_rng(seed), len(samples), max(map(len, samples))
        most = max(1, int(np.ceil(np.log2(max(2, sample)))))
        size = 2 ** (most + 1) - 1
        column, value = np.full((trees, size), -1), np.zeros((trees, size))
        depth = np.zeros((trees, size))
        for t, x in enumerate(samples):
            stack = [(0, 0, np.arange(len(x)))]
            while stack:
                node, d, own = stack.pop()
                if d >= most or len(own) < 2 or not len(wide := np.flatnonzero(x[own].max(0) > x[own].min(0))):
                    depth[t, node] = d + average_path(len(own))
                    continue
                k = rng.choice(wide)
                v = rng.uniform(x[own, k].min(), x[own, k].max())
                column[t, node], value[t, node] = k, v
                left = x[own, k] <= v
                stack += [(2 * node + 1, d + 1, own[left]), (2 * node + 2, d + 1, own[~left])]
        return cls(column, value, np.array(0), depth, max(1e-9, average_path(sample)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / that of an average tree): near 1 anomalous, under 0.5 ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, value, depth in zip(self.column, self.value, self.depth, strict=True):
            node = np.zeros(len(x), int)
            while (inner := column[node] >= 0).any():
                right = x[rows, np.maximum(column[node], 0)] > value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += depth[node]
        return 2.0 ** -(total / len(self.column) / self.unit)


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def level(scores: DataFrame, rank: int, least: float = 0.0, most: float = 1.0, bins: int = 1024, gather: int = 10_000) -> float:
    """The exact value at a rank (from 0) of column ``anomaly``: the range is narrowed to the bin that has it until few enough values are left to be gathered."""
    while True:
        own = scores.where((F.col("anomaly") >= least) & (F.col("anomaly") <= most))
        width = (most - least) / bins
        place = F.least(F.floor((F.col("anomaly") - least) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
        found = {r["b"]: r for r in own.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("anomaly").alias("low"), F.max("anomaly").alias("high")).collect()}
        for b in sorted(found):
            if rank < found[b]["n"]:
                break
            rank -= found[b]["n"]
        low, high, n = found[b]["low"], found[b]["high"], found[b]["n"]
        if low == high:
            return low
        if n <= gather:
            return sorted(r[0] for r in own.where((F.col("anomaly") >= low) & (F.col("anomaly") <= high)).select("anomaly").collect())[rank]
        least, most = low, high


def fit(docs: DataFrame, labels: DataFrame, keep_share: float = 0.985, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = 200, sample: int = 256) -> Forest | None:
    """Grows and calibrates on all labelled rows; label 1 is good. Of repeated labels of an id the largest counts. docs may be what ``measure`` made of them.

    Each tree takes its own ``sample`` rows, as isolation trees do, by least hash of id and tree among all that pass the rules, bad ones with a chance that
    leaves ``BAD_SHARE`` of them for each good one. The threshold is found over the scores of all.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    rows = docs if "stats" in docs.columns else measure(docs, id_col, text_col)
    with scratch():
        passing = ~((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        own = staged(rows.where(passing).join(known, "id").select(F.xxhash64(F.lit(303), "id").alias("h"), (F.col("y") == 1).alias("good"), "stats"), "labelled")
        n = {r["good"]: r["count"] for r in own.groupBy("good").count().collect()}
        n_good, n_bad = n.get(True, 0), n.get(False, 0)
        if n_good < 10:
            return None
        bad_share = min(1.0, np.ceil(BAD_SHARE * n_good) / max(1, n_bad))
        drawn = n_good + bad_share * n_bad
        chance = min(1.0, (sample + 6 * sample**0.5 + 20) / drawn)  # of each tree's least hashes; too few come once in a billion trees

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = np.random.default_rng(3).integers(0, 1 << 64, trees, dtype=np.uint64)
            for part in slices(batches, 4096):
                h, good = part.column(0).to_numpy().view(np.uint64), np.array(part.column(1).to_pylist(), bool)
                x = (h[:, None] ^ seeds) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                unit = (x >> np.uint64(11)) / float(1 << 53) / np.where(good, 1.0, bad_share)[:, None]
                row, tree = np.nonzero(unit < chance)
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(unit[row, tree]), part.column(2).take(pa.array(row))], names=["tree", "at", "stats"])

        got = own.mapInArrow(draw, "tree int, at double, stats array<double>").toArrow()  # some 370 rows a tree
        tree, at, x = got["tree"].to_numpy(), got["at"].to_numpy(), np.array(got["stats"].to_pylist()).reshape(-1, len(STATISTICS))
        order = np.lexsort((*x.T, at, tree))
        starts = np.searchsorted(tree[order], np.arange(trees + 1))
        forest = Forest.grow_each([x[order[a:b][:sample]] for a, b in zip(starts[:-1], starts[1:], strict=True)])
        scores = staged(own.mapInArrow(_scorer(docs, forest), "good boolean, anomaly double"), "label-scores")
        rank = min(n_good - 1, int(np.ceil(keep_share * n_good)) - 1)
        top = level(scores.where("good"), rank)
        higher = scores.where(~F.col("good") & (F.col("anomaly") > top)).agg(F.min("anomaly")).first()[0]
        forest.threshold = np.inf if higher is None else float((top + higher) / 2)
        return forest


def _scorer(docs: DataFrame, forest: Forest):
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            x = np.array(part.column(2).to_pylist()).reshape(part.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(shared.value.score(x), pa.float64())], names=["good", "anomaly"])

    return run


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five rule counts and the statistics of each row, for ``fit`` and ``judge`` to read without the texts."""
    return _measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"])


def _measured(rows: DataFrame, carry: list[str]) -> DataFrame:
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [rules(t) for t in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *(pa.array([g[k] for g in got], pa.int64()) for k in range(5)), pa.array([g[5] for g in got], pa.list_(pa.float64()))], names=[*carry, *RULES, "stats"])

    return rows.mapInArrow(run, f"{head}, " + ", ".join(f"{r} long" for r in RULES) + ", stats array<double>")


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, the five rule counts, anomaly, base_failed, kept. docs may be what ``measure`` made of them."""
    rows = docs if "stats" in docs.columns else measure(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded: trees by nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for part in slices(batches, 4096):
            x = np.array(part.column("stats").to_pylist()).reshape(part.num_rows, len(STATISTICS))
            anomaly = np.zeros(len(x)) if forest is None else forest.score(x)
            failed = np.array([base_failed(w, r) for w, r in zip(part.column("n_words").to_pylist(), part.column("n_repeat_words").to_pylist(), strict=True)], bool)
            kept = ~failed & (anomaly <= (np.inf if forest is None else forest.threshold))
            yield pa.RecordBatch.from_arrays([part.column("id"), *(part.column(c) for c in RULES), pa.array(anomaly, pa.float64()), pa.array(failed), pa.array(kept)], names=[id_col, *RULES, "anomaly", "base_failed", "kept"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{r} long" for r in RULES) + ", anomaly double, base_failed boolean, kept boolean")
