"""SimHash near-duplicate groups by bit-sliced comparison.

Each text gets a 64-bit fingerprint, the majority of the hashes of its word shingles. Fingerprints are compared bit-sliced: bit planes
are stored vertically, 64 fingerprints to a word, each file beginning a word of its own, so that many short files and parts of long ones
share the same passes. For each fingerprint and word that may hold partners of it the differing bits are added plane by plane into
carry-save counters and a sticky overflow, and words in which all counters exceed the radius are abandoned. A file gives one link a
fingerprint to one of its component, never all pairs. Files longer than ``FILE_ROWS`` are dealt into parts, and each pair of parts is a task of its own.

Two operators compare in this way and differ in what they file:

* ``near_duplicates`` links fingerprints that differ in at most ``radius`` bits. Its files lose none, by pigeonhole: the bits are dealt into
  m blocks, and two fingerprints within the radius agree in at least m - radius blocks, so each is filed under every choice of m - radius
  blocks. m follows from the number of distinct fingerprints such that files stay short at any size; every choice of m gives the same links.
* ``near_copies`` links texts whose shingle sets have a Jaccard similarity of ``similarity`` or more. No radius that pigeonholes can serve finds
  all of them (at 0.8 about ten bits differ, with wide spread), so texts are filed by their rare shingles: if all sets are sorted by one
  order, two that are similar enough share one among the first n - ceil(similarity * n) + 1 of each. Within a file fingerprints of 128 bits are
  compared at a wide radius, ``WIDE``: of pairs at a similarity of 0.8 fewer than one in ten million differs by more (of sets of four and five shingles one in
  200,000), of unrelated ones fewer than one in a thousand by less. What remains joins into loose groups, and within a loose group all whole sets are
  compared exactly. Large loose groups are dealt into parts like files.

Only distinct fingerprints or sets are compared; copies join at the end. Null and word-less texts have fingerprint zero and an empty set and
are linked like any other. Null ids count as greatest; repeated rows are one group. Empty tables give empty tables. Very long texts are hashed
in blocks. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.components import components

from .common import SPACES, sample_by_hash, scratch, slices, staged, utf8

FILE_ROWS = 4096
#: Radius at which fingerprints of 128 bits are compared before whole sets are.
WIDE = 46
#: Rows and shingles of a part of a loose group.
PART_ROWS, PART_SHINGLES = 1024, 1 << 22
#: Texts that the order of shingles is taken from, at least, and the share of all of them.
SAMPLE_ROWS, SAMPLE_SHARE = 4096, 1 / 64
#: Frequent shingles that the order knows; a fixed number, so they are broadcast.
FREQUENT = 1 << 18
_TO_SPACE = bytes(32 if b in SPACES else b for b in range(256))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, size: int, seed: int) -> np.ndarray:
    """Hashes of the shingles in their order; a text of fewer words is one shingle, one without words has none."""
    words = [w for w in text.lower().translate(_TO_SPACE).split(b" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    pairs = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in pairs), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, size, seed))


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp long for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fp = np.array([fingerprint(t, size) for t in utf8(part.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def pairs_within(fps: np.ndarray, starts: np.ndarray, meets: np.ndarray, radius: int, words_at_once: int = 2048, entries_at_once: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of index pairs of fingerprints (uint64, or rows of several) that differ in at most ``radius`` bits.

    ``starts`` has where each block begins, and the end; ``meets`` the block that each is compared with: itself, the one after it, or -1 for none.
    """
    words = -(-np.diff(starts) // 64)
    edges = np.concatenate([[0], np.cumsum(words)])
    first = 0
    while first < len(words):  # as many blocks as share a pass; one and the block that it meets stay together
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + words_at_once, "right")) - 1)
        last += bool(meets[last - 1] == last)
        begin, total = starts[first], int(edges[last] - edges[first])
        block = np.repeat(np.arange(first, last), np.diff(starts[first : last + 1]))
        own = fps[begin : starts[last]].reshape(len(block), -1)
        wide = own.shape[1]
        slot = (edges[block] - edges[first]) * 64 + np.arange(begin, starts[last]) - starts[block]
        row_of = np.full(total * 64, -1, np.int64)
        row_of[slot] = np.arange(len(own))
        lanes = np.zeros((total * 64, wide), np.uint64)
        lanes[slot] = own
        bits = np.unpackbits(lanes.view(np.uint8).reshape(total, 64, 8 * wide), axis=2, bitorder="little")
        planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64 * wide, total)
        valid = np.ascontiguousarray(np.packbits((row_of >= 0).reshape(total, 64), axis=1, bitorder="little")).view(np.uint64)[:, 0]
        # words that each fingerprint meets: those of its own block from its own on, or all of the next block
        other = meets[block]
        since = np.where(other == block, slot // 64, edges[other] - edges[first])
        counts = np.where(other < 0, 0, edges[other + 1] - edges[first] - since)
        ends, at = np.cumsum(counts), 0
        while at < len(counts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + entries_at_once, "right")))
            q = np.repeat(np.arange(at, to), counts[at:to])
            word = np.arange(len(q)) - np.repeat(ends[at:to] - counts[at:to] - (ends[at] - counts[at]), counts[at:to]) + since[q]
            q, word, near = _near(own, planes, valid, q, word, radius)
            entry, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, partner = q[entry], word[entry] * 64 + lane
            fresh = (other[a] != block[a]) | (partner > slot[a])
            yield begin + a[fresh], begin + row_of[partner[fresh]]
            at = to
        first = last


def _near(fps: np.ndarray, planes: np.ndarray, valid: np.ndarray, q: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, word, lanes within the radius) for the entries that have any."""
    counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over, own = ~valid[word], fps[q]
    for p in range(len(planes)):
        carry = planes[p][word] ^ (np.uint64(0) - (own[:, p >> 6] >> np.uint64(p & 63) & np.uint64(1)))
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
        over |= carry
        if p >= radius and p % 8 == 7:
            beyond = over | _greater(counters, radius)
            open_ = beyond != _ALL
            if p == len(planes) - 1 or open_.sum() < 0.8 * len(open_):
                q, word, own, over, counters, beyond = q[open_], word[open_], own[open_], over[open_], [c[open_] for c in counters], beyond[open_]
    return q, word, ~beyond


def _greater(counters: list[np.ndarray], limit: int) -> np.ndarray:
    """Where the counters, lowest plane first, exceed the limit; compared bit by bit from the highest."""
    greater, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if limit >> k & 1:
            equal &= counters[k]
        else:
            greater |= equal & counters[k]
            equal &= ~counters[k]
    return greater


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a and b, pair by pair, in place; label has the least index that is known of each one's component."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def local_links(fps: np.ndarray, starts: np.ndarray, meets: np.ndarray, radius: int, fits=None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (row, another of its component) that join all fingerprints within the radius; ``fits`` says which pairs count, by default all."""
    label = np.arange(len(fps))
    for a, b in pairs_within(fps, starts, meets, radius):
        if fits is not None:
            own = fits(a, b)
            a, b = a[own], b[own]
        joined(label, a, b)
    found = np.flatnonzero(label != np.arange(len(fps)))
    return found, label[found]


def _masks(distinct: int, radius: int) -> list[int]:
    """Masks of the files: smallest m for which agreeing blocks have two bits more than it takes to number the fingerprints."""
    need = log2(max(2, distinct)) + 2
    m = next((m for m in range(radius + 1, radius + 6) if 64 * (m - radius) / m >= need), radius + 6)
    edges = [round(64 * i / m) for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(blocks, m - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def dealt(filed: DataFrame, file: list[str], key: str, parts: str = "parts") -> DataFrame:
    """Rows of files, with columns i <= j and part: a row of a file of several parts goes to each pair of parts that its own is one of. Sorted by file, pair, part and key."""
    rows = filed.withColumn("part", F.pmod(F.xxhash64(F.col(key)), F.col(parts)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(parts).cast("int") - 1)))
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("other", parts)
    return rows.repartition(*file, "i", "j").sortWithinPartitions(*file, "i", "j", "part", key)


def blocks_of(file: list[np.ndarray], i: np.ndarray, j: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """starts and meets of the blocks of sorted dealt rows: of a file that is one part each row meets all others, of two parts the first meets the second."""
    n = len(part)
    new_file = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in (*file, i, j)], axis=0)])[:n]
    starts = np.flatnonzero(new_file | np.concatenate([[True], part[1:] != part[:-1]])[:n])
    of, block = np.cumsum(new_file)[starts], np.arange(len(starts))
    followed = np.append(of[1:] == of[:-1], False)[: len(starts)]
    return np.append(starts, n), np.where((i == j)[starts], block, np.where(followed, block + 1, -1))


def whole_files(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows as arrays, cut such that rows with the same first ``keys`` columns stay together."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        n = len(cols[0])
        if not n:
            continue
        last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)) if n > 1 else []
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [c[:cut] for c in cols]
        rest = [c[cut:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """a, b: links that join all fingerprints within the radius of one another."""
    masks = _masks(n, radius)
    filed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("file", "key"))
    long_enough = staged(filed.groupBy("file", "key").agg(F.count("*").alias("n")).where("n > 1"), "files")
    rows = dealt(filed.join(long_enough, ["file", "key"]).withColumn("parts", F.ceil(F.col("n") / FILE_ROWS)).drop("n"), ["file", "key"], "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, key, i, j, part, fp in whole_files(batches, 4):
            a, b = local_links(fp.view(np.uint64), *blocks_of([file, key], i, j, part), radius)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return rows.select("file", "key", "i", "j", "part", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id (least id of its group). radius: up to 7, as files of wider ones would be long."""
    if not 0 <= radius <= 7:
        raise ValueError("radii are from 0 to 7")
    with scratch() as own:
        rows = own.keep(staged(fingerprints(docs, size, id_col, text_col), "fingerprints"))
        distinct = staged(rows.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
        linked = components(_links(distinct.select("fp"), distinct.count(), radius), "a", "b").withColumnRenamed("node", "fp")
        roots = staged(distinct.join(linked, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
        least = staged(roots.groupBy("root").agg(F.min("first").alias("component_id")), "least")
        named = own.keep(staged(roots.join(least, "root").select("fp", "component_id"), "named"))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits: the majority of the hashes, and that of the hashes mixed once more."""
    h = shingles.view(np.uint64)
    mixed = (h ^ h >> np.uint64(31)) * np.uint64(0x9FB21C651E98DF25)
    return majority(h), majority(mixed ^ mixed >> np.uint64(28))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, size, 0).view(np.int64))


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """The columns of rows with shingles for text, which is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = pa.array([shingle_set(t, size) for t in utf8(part.columns[-1])], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], own], names=[*part.schema.names[:-1], "shingles"])

    others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{others}, shingles array<long>")


def _frequent(rows: DataFrame, size: int) -> np.ndarray:
    """Shingles that come last in the order, the most frequent at the end."""
    share = max(SAMPLE_SHARE, min(1.0, SAMPLE_ROWS / max(1, rows.count())))
    some = _sets(sample_by_hash(rows.withColumn("id", F.col("row")), F.lit(share), 11).select("row", "text"), size)
    counted = some.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    return counted.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()["h"].to_numpy()[::-1]


def alike(sets: list[np.ndarray], fps: np.ndarray, part: np.ndarray, crossing: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that join all sets of one loose group with the similarity or more; crossing: only those of different parts are compared.

    A set is compared with those that sizes and fingerprints leave possible and that are not yet of its component, all at once.
    """
    n, label = np.array([len(s) for s in sets], np.int64), np.arange(len(sets))
    _, coded = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    edges, mark = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(coded) + 1, bool)
    for a in range(len(sets) - 1):
        rest = np.arange(a + 1, len(sets))
        fits = (label[rest] != label[a]) & (np.minimum(n[rest], n[a]) >= similarity * np.maximum(n[rest], n[a]) - 1e-9) & (np.bitwise_count(fps[rest] ^ fps[a]).sum(1) <= WIDE)
        rest = rest[fits & (part[rest] != part[a])] if crossing else rest[fits]
        if not len(rest):
            continue
        mark[own := coded[edges[a] : edges[a + 1]]] = True
        take = np.repeat(edges[rest] - np.cumsum(n[rest]) + n[rest], n[rest]) + np.arange(int(n[rest].sum()))
        shared = np.add.reduceat(mark[coded[take]].astype(np.int64), np.cumsum(n[rest]) - n[rest])
        mark[own] = False
        hit = rest[(1 + similarity) * shared >= similarity * (n[rest] + n[a]) - 1e-9]
        joined(label, np.full(len(hit), a), hit)
    found = np.flatnonzero(label != np.arange(len(sets)))
    return found, label[found]


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, row_col: str = "row", text_col: str = "text") -> DataFrame:
    """row (a distinct long of each row of docs), root: equal for all rows of a group and the row of one of it."""
    with scratch() as kept:  # joins with what grows as the texts do are merges at every size
        rows = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
        late = _frequent(rows, size)
        by_hash = np.argsort(late)
        shared = rows.sparkSession.sparkContext.broadcast((late[by_hash], by_hash + 1))

        def prefix(own: np.ndarray) -> np.ndarray:
            known, rank_of = shared.value
            rank = np.zeros(len(own), np.int64)
            if len(known):
                at = np.searchsorted(known, own).clip(max=len(known) - 1)
                rank = np.where(known[at] == own, rank_of[at], 0)
            return own[np.argsort(rank, kind="stable")][: len(own) - ceil(similarity * len(own) - 1e-9) + 1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                own = [shingle_set(t, size) for t in utf8(part.column(1))]
                fp = np.array([wide_fingerprint(s) for s in own], np.uint64).reshape(-1, 2).view(np.int64)
                cols = [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int64()), pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), pa.array([prefix(s) for s in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["row", "digest", "n", "fp", "fq", "prefix"])

        read = staged(rows.mapInArrow(run, "row long, digest binary, n long, fp long, fq long, prefix array<long>"), "prefixes")
        named = staged(read.groupBy("digest").agg(F.min("row").alias("rep")), "sets")
        again = staged(read.select("row", "digest").join(named, "digest").where("row != rep").select("row"), "equal-sets")
        listed = read.join(again.hint("merge"), "row", "left_anti").select("row", "n", "fp", "fq", F.posexplode("prefix").alias("at", "h"))
        several = staged(listed.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"), "shared-shingles")
        filed = dealt(listed.join(several.hint("merge"), "h").withColumn("parts", F.ceil(F.col("m") / FILE_ROWS)).drop("m"), ["h"], "row")

        def loosely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, i, j, part, row, fp, fq, n, at in whole_files(batches, 3):
                left = n - at  # the most that can be shared from a first common shingle on
                fits = lambda a, b: (1 + similarity) * np.minimum(left[a], left[b]) >= similarity * (n[a] + n[b]) - 1e-9  # noqa: E731, B023
                a, b = local_links(np.stack([fp, fq], 1).view(np.uint64), *blocks_of([h], i, j, part), WIDE, fits)
                yield pa.RecordBatch.from_arrays([pa.array(row[a]), pa.array(row[b])], names=["a", "b"])

        loose = staged(components(filed.select("h", "i", "j", "part", "row", "fp", "fq", "n", "at").mapInArrow(loosely, "a long, b long").distinct(), "a", "b"), "loose")
        members = staged(loose.select(F.col("node").alias("row"), "component").join(read.select("row", "n", "fp", "fq"), "row"), "members")
        sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum("n") / PART_SHINGLES)).alias("parts"))
        members = staged(members.join(sizes, "component").select("row", "component", "parts", "fp", "fq"), "placed")
        sets = _sets(members.join(rows.hint("merge"), "row").select("row", "component", "parts", "fp", "fq", "text"), size)

        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for component, i, j, part, row, fp, fq, shingles in whole_files(batches, 3):
                cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in (component, i, j)], axis=0)) + 1
                found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
                for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(row)], strict=True):
                    a, b = alike(list(shingles[x:y]), np.stack([fp[x:y], fq[x:y]], 1).view(np.uint64), part[x:y], bool(i[x] != j[x]), similarity)
                    found.append(row[x:y][np.stack([a, b])])
                a, b = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        links = dealt(sets, ["component"], "row").select("component", "i", "j", "part", "row", "fp", "fq", "shingles").mapInArrow(compared, "a long, b long").distinct()
        linked = components(links, "a", "b").withColumnRenamed("node", "rep")
        roots = staged(named.join(linked, "rep", "left").select("digest", F.coalesce("component", "rep").alias("root")), "near-roots")
        found = kept.keep(staged(read.select("row", "digest").join(roots, "digest").select(F.col("row").alias(row_col), "root"), "near-copies"))
    return found
