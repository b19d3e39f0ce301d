"""Removal of repeated byte strings by column-wise multi-document suffix sorting.

Every byte covered by a string of ``span`` bytes that also starts earlier in the collection is removed. Equal strings have
equal least-hashed inner substrings, so each string of ``span`` bytes belongs to the place of that substring, its anchor, and
neighbouring strings with the same anchor form a fragment of less than twice the span. Only fragments whose anchor hash
occurs again can hold repeats. Of these:

1. identical fragments collapse into a class with its first place (an aggregate with map-side combining, so a fragment that
   a third of all documents share is one row); every later occurrence is removed outright;
2. classes that share an anchor hash but differ, as at the edges of copied passages, are suffix-sorted: collections of at most ``COLLECTION``
   fragments are built column by column, one symbol of each fragment a round, the order of suffixes and their common
   prefixes being updated in one sequential pass over the Burrows-Wheeler transform of the column before. Fragments lie with their anchors
   in one column, so only suffixes of the same column can be alike and each round sorts one suffix a fragment. Those with a
   common prefix of ``span`` bytes are the repeats. A collection is bounded, so its transform is kept in memory, not in files;
3. anchors with more classes than an eighth of a collection are dealt over several tasks; each resolves its own, and what remains first
   there meets in an aggregate keyed by the string itself.

Place order is (id, start), matches never cross documents, and strings are judged on the input. Rows with equal or null ids
are told apart by an order of their own, null ids first. Null and empty texts have nothing to remove. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, discard, numbered, scratch, slices, staged, utf8

SPAN = 100
ANCHOR = 32
COLLECTION = 8192
SEGMENT = 1 << 22
#: Passes over which anchors are dealt, so that this share of all fragments lies on disk at a time.
PARTS = 4
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def fragments(text: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, width, anchor hash, anchor's offset from start): strings of span bytes from start to start + width - 1 share an anchor, the leftmost least-hashed substring."""
    n, reach = len(text), span - anchor + 1
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    if n > SEGMENT + span:
        parts = [(at, fragments(text[at : at + SEGMENT + span - 1], span, anchor)) for at in range(0, n - span + 1, SEGMENT)]
        return np.concatenate([p[0] + at for at, p in parts]), *(np.concatenate([p[k] for _, p in parts]) for k in (1, 2, 3))
    h, size = _TABLE[text], 1
    while size < anchor:
        step = min(size, anchor - size)
        # of the first size bytes and the last size bytes; they overlap where anchor is no power of two
        h = h[:-step] * np.uint64(pow(_BASE, size, 1 << 64)) + h[step:]
        size += step
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    least, size = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: size - reach], least[reach - size :])
    at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return starts, np.diff(np.append(starts, len(at))), h[at[starts]].view(np.int64), at[starts] - starts


def digests(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit digest of each fragment, so that even among very many no two different ones are taken as equal."""
    whole = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True))
    halves = np.frombuffer(whole, ">i8").astype(np.int64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def columns(strings: list[bytes], leads: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """From the last column to the first: (column, strings in the order of their suffixes from there, common prefix with the one before).

    Strings lie such that their anchors begin at column 0, as equal parts of theirs have equal anchors. A round puts one symbol before each
    string's suffix: the new order is a stable sort of the last by these symbols, the column's Burrows-Wheeler transform, and the
    common prefix of two that begin alike is one more than the least between their rests. Strings that end at a column join first,
    as empty suffixes; those that begin after it have left.
    """
    begin = -np.array(leads, np.int64)
    sizes = np.array([len(x) for x in strings], np.int64)
    end, flat = begin + sizes, np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(sizes) - sizes - begin
    by_end = np.argsort(-end, kind="stable")
    order, lcp, joined = np.zeros(0, np.int64), np.zeros(0, np.int16), 0
    for c in range(int(end.max(initial=0)) - 1, int(begin.min(initial=0)) - 1, -1):
        upto = joined
        while upto < len(by_end) and end[by_end[upto]] == c + 1:
            upto += 1
        if upto > joined:
            order, lcp = np.concatenate([by_end[joined:upto], order]), np.concatenate([np.zeros(upto - joined, np.int16), lcp])
            joined = upto
        stays = np.flatnonzero(begin[order] <= c)
        if len(stays) < len(order):
            lcp = np.minimum.reduceat(lcp[: stays[-1] + 1], np.concatenate([[0], stays[:-1] + 1])) if len(stays) else lcp[:0]
            order = order[stays]
        if not len(order):
            continue
        symbol = flat[base[order] + c]
        o = np.argsort(symbol, kind="stable")
        symbol = symbol[o]
        fresh = np.zeros(len(o), np.int16)
        alike = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(alike):
            first, last = o[alike - 1] + 1, o[alike]
            width = last - first + 1
            level = np.frexp(width)[1] - 1
            table, least = lcp, np.zeros(len(alike), np.int16)
            for k in range(int(level.max()) + 1):
                if k:
                    table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
                own = np.flatnonzero(level == k)
                if len(own):
                    least[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
            fresh[alike] = least + 1
        order, lcp = order[o], fresh
        yield c, order, lcp


def resolve(strings: list[bytes], leads: list[int], places: list[tuple], report: list[bool], span: int = SPAN) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """For each string the offsets whose span bytes also start earlier, by (key, start) in places; and (string, offset) of those that are first, of strings to report."""
    keys = {k: i for i, k in enumerate(sorted({p[0] for p in places}))}
    at = np.array([keys[p[0]] for p in places], np.int64) << 40 | np.array([p[1] for p in places], np.int64)
    begin, sizes, wanted = -np.array(leads, np.int64), np.array([len(x) for x in strings], np.int64), np.array(report, bool)
    gone_of, gone_at, firsts = [], [], []
    for c, order, lcp in columns(strings, leads):
        whole = np.flatnonzero(begin[order] + sizes[order] - c >= span)
        if not len(whole):
            continue
        own, shared = order[whole], lcp[whole] >= span  # between two whole ones that are alike all are whole
        starts = np.flatnonzero(~shared)
        place = at[own] + (c - begin[own])
        first = np.repeat(np.minimum.reduceat(place, starts), np.diff(np.append(starts, len(own)))) == place
        lost = own[~first]
        gone_of.append(lost)
        gone_at.append(c - begin[lost])
        if wanted.any():
            firsts += [(int(i), int(c - begin[i])) for i in own[first & wanted[own]]]
    sid, offset = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (gone_of, gone_at))
    order = np.lexsort((offset, sid))
    return np.split(offset[order], np.searchsorted(sid[order], np.arange(1, len(strings)))), firsts


def runs(offsets: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of consecutive offsets."""
    if not len(offsets):
        return []
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return list(zip(offsets[np.append(0, cut + 1)].tolist(), offsets[np.append(cut, len(offsets) - 1)].tolist(), strict=True))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, text; key is the id, or where ids repeat or are null the id and the row's number, for which no copy of the texts is made."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        return rows.select("id", F.col("id").alias("key"), "text")
    known = numbered(docs, "__place")
    return known.select(F.col(id_col).alias("id"), F.struct(F.col(id_col).alias("id"), F.col("__place").alias("row")).alias("key"), F.col(text_col).alias("text"))


def repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, parts: int = PARTS) -> DataFrame:
    """key, since, until: byte ranges that cover all that is to be removed; docs has key and text. Ranges may overlap.

    Anchors are dealt by hash over ``parts`` passes over the texts, each of which places the fragments of its own anchors, takes them to classes and leaves only
    ranges and the classes to be sorted behind. So the tables of fragments, which are larger than the texts where all of these repeat, never lie on disk as a whole.
    """
    key_type = docs.schema["key"].dataType.simpleString()
    rows = docs.select("key", "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            data, offsets = buffer_of(part.column(1))
            found = [fragments(data[a:b], span, anchor)[2] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int32))], names=["h", "n"])

    def placed(own: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            data, offsets = buffer_of(part.column(1))
            raw = data.tobytes()
            found = [fragments(data[a:b], span, anchor) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            start, width, h, lead = (np.concatenate([x[k] for x in found]) for k in range(4))
            mine = np.flatnonzero(h % parts == own)
            owner, start, width, h, lead = (x[mine] for x in (owner, start, width, h, lead))
            begin = start + offsets[owner]
            f, g = digests(raw, begin, begin + width + span - 1)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(h), pa.array(f), pa.array(g), pa.array(start.astype(np.int32)), pa.array(width.astype(np.int16)), pa.array(lead.astype(np.int16))], names=["key", "h", "f", "g", "start", "width", "lead"])

    laters, splits = [], []
    with scratch() as kept:
        again = staged(rows.mapInArrow(anchors, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors")
        for own in range(parts):
            with scratch() as now:
                hits = rows.mapInArrow(partial(placed, own), f"key {key_type}, h long, f long, g long, start int, width smallint, lead smallint")
                hits = staged(hits.join(again.where(F.pmod("h", F.lit(parts)) == own), "h"), "fragments")
                classes = staged(hits.groupBy("h", "f", "g").agg(F.min(F.struct("key", "start")).alias("first"), F.min("width").alias("width"), F.min("lead").alias("lead"), F.count("*").alias("n")), "classes")
                later = hits.join(classes.where("n > 1").select("h", "f", "g", "first"), ["h", "f", "g"]).where(F.struct("key", "start") != F.col("first"))
                later = later.select("key", F.col("start").alias("since"), (F.col("start") + F.col("width") + span - 1).alias("until"))
                laters.append(kept.keep(now.keep(staged(later, "later"))))
                discard(hits)
                mixed = classes.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
                split = classes.join(mixed, "h").withColumn("parts", F.ceil(F.col("m") / max(1, COLLECTION // 8)).cast("int"))
                split = split.select(F.col("first.key").alias("key"), F.struct("h", F.pmod("f", F.col("parts")).cast("int").alias("salt"), "parts", F.col("first.start").alias("start"), "width", "lead").alias("x"))
                splits.append(now.keep(staged(split, "split")))
        discard(again)
        found = kept.keep(_sorted(rows, reduce(DataFrame.unionByName, splits), key_type, span))
        open_ = found.where("string IS NOT NULL")
        first = kept.keep(staged(open_.groupBy("string").agg(F.min(F.struct("key", "since")).alias("first")), "firsts"))
    beaten = open_.join(first, "string").where(F.struct("key", "since") != F.col("first")).select("key", "since", "until")
    return reduce(DataFrame.unionByName, [*laters, found.where("string IS NULL").select("key", "since", "until"), beaten])


def _sorted(rows: DataFrame, split: DataFrame, key_type: str, span: int) -> DataFrame:
    """The suffix order of classes that share an anchor: ranges that also start earlier, and with their strings what is first among the classes of a task."""
    wanted = split.groupBy("key").agg(F.collect_list("x").alias("xs"))
    # the places of one document that are first of their class are fewer than its bytes
    texts = rows.join(wanted, "key").select("key", "text", "xs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            xs = part.column(2)
            owner = np.repeat(np.arange(part.num_rows), [len(x) for x in xs])
            flat = xs.flatten()
            h, salt, parts, start, width, lead = (flat.field(k) for k in range(6))
            whole = utf8(part.column(1))
            own = [whole[o][s : s + w + span - 1] for o, s, w in zip(owner.tolist(), start.to_pylist(), width.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([h, salt, parts, part.column(0).take(pa.array(owner)), start, lead, pa.array(own, pa.binary())], names=["h", "salt", "parts", "key", "start", "lead", "bytes"])

    pieces = texts.mapInArrow(cut, f"h long, salt int, parts int, key {key_type}, start int, lead smallint, bytes binary").repartition("h", "salt").sortWithinPartitions("h", "salt")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole anchors, as many as make a collection; anchors dealt over several collections also report what is first here."""
        key_arrow: list = []

        def answer(own: list[tuple]) -> pa.RecordBatch:
            gone, firsts = resolve([x[6] for x in own], [x[5] for x in own], [(_comparable(x[3]), x[4]) for x in own], [x[2] > 1 for x in own], span)
            keys, since, until, string = [], [], [], []
            for x, offsets in zip(own, gone, strict=True):
                for a, b in runs(offsets):
                    keys.append(x[3]), since.append(x[4] + a), until.append(x[4] + b + span), string.append(None)
            for i, o in firsts:
                keys.append(own[i][3]), since.append(own[i][4] + o), until.append(own[i][4] + o + span), string.append(own[i][6][o : o + span])
            return pa.RecordBatch.from_arrays([pa.array(keys, key_arrow[0]), pa.array(since, pa.int32()), pa.array(until, pa.int32()), pa.array(string, pa.binary())], names=["key", "since", "until", "string"])

        held: list[tuple] = []
        whole = 0  # rows of held that are whole anchors
        for part in slices(batches, 1024):
            key_arrow[:] = [part.schema.field("key").type]
            for x in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and held[-1][:2] != x[:2]:
                    if whole and len(held) > COLLECTION:
                        yield answer(held[:whole])
                        held = held[whole:]
                    whole = len(held)
                held.append(x)
        if held:
            if whole and len(held) > COLLECTION:
                yield answer(held[:whole])
                held = held[whole:]
            yield answer(held)

    return staged(pieces.mapInArrow(sort, f"key {key_type}, since int, until int, string binary"), "sorted")


def _comparable(key):
    """Keys as Python orders them: None before all, structs field by field."""
    if isinstance(key, dict):
        return tuple(_comparable(v) for v in key.values())
    return (key is not None, key if key is not None else 0)


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and on request the kept bytes (whose cuts may fall within characters)."""
    rows = _keyed(docs, id_col, text_col)
    found = repeats(rows, span, anchor).groupBy("key").agg(F.collect_list(F.struct("since", "until")).alias("ranges"))
    joined = rows.join(found, "key", "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out: list[tuple] = []
            for text, ranges in zip(utf8(part.column(1)), part.column(2).to_pylist(), strict=True):
                gone = union([(r["since"], r["until"]) for r in ranges or ()])
                kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = [pa.array([x[k] for x in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.string()), *([(4, pa.binary())] * with_kept))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept])

    return joined.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)
