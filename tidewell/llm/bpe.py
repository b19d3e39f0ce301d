"""BPE encoding and decoding by prefix-sharing trie traversal.

Byte-pair encodings have the *last token* property: the encoding of a byte string is the encoding of a shorter prefix
plus one last token, and a vocabulary token t that ends the string is its last token exactly if t may follow the last
token of what stands before it, that is if the pair encodes to itself. So the state of a prefix is one token, and all
words that share a prefix share its states. The distinct words of a batch go into a trie, a depth-first walk hands the
states down, and each prefix is computed once whatever number of words begin with it. Cost is linear in trie nodes,
also for a word of a hundred thousand letters, where merging pairs would be quadratic.

Null and empty texts have no tokens. Texts are encoded whole; memory is bounded by one slice of texts and a cache of
words that starts anew when it is full. Repeated rows give repeated results, extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keeps_cache, slices

#: Fixed value: the pattern by which byte-level BPE cuts text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose encodings a worker keeps before it starts anew.
CACHE_WORDS = 300_000
#: Longer words are encoded but not kept.
CACHE_BYTES = 64


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow 255."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_ODD_SPACE = re.compile(r"[^\S \n]").search


class TrieEncoder:
    """Encodes and decodes with the vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letters for c in s)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self._rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        ids = sorted(self.bytes_of)
        self._sizes = np.zeros(ids[-1] + 1, np.int64)
        self._sizes[ids] = [len(self.bytes_of[i]) for i in ids]
        self._begins = np.cumsum(self._sizes) - self._sizes
        self._flat = np.frombuffer(b"".join(self.bytes_of[i] for i in ids), np.uint8)
        self._parts = {vocab[l + r]: (vocab[l], vocab[r], k) for k, (l, r) in enumerate(self._rank) if l + r in vocab}
        self._rank = {vocab[l] << 20 | vocab[r]: k for k, (l, r) in enumerate(self._rank) if l in vocab and r in vocab}
        # a token that does not encode to itself never appears; parts precede the tokens made of them
        self._id = {b: i for b, i in vocab.items() if len(b) == 1}
        sound = set(self._id.values())
        for i, (left, right, _) in self._parts.items():
            if left in sound and right in sound and self._stand(left, right, True):
                sound.add(i)
                self._id[self.bytes_of[i]] = i
        self._heads = {b[:k] for b in self._id for k in range(len(b) + 1)}
        self._suffixes: dict[bytes, tuple] = {}  # state: (next states by byte, tokens that end here, longest first)
        self._start = self._suffix(b"")
        self._follows: dict[int, bool] = {}
        self._split = regex.compile(WORD_PATTERN).findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self._words: dict[str, str] = {}
        self._pieces: tuple[dict[str, str], dict[str, str]] = ({}, {})  # without and with a space before them

    def _stand(self, left: int, right: int, joins_at_last: bool = False) -> bool:
        """Whether two tokens side by side stay two tokens until all their own merges are done.

        Takes the merges back, the latest first. At each moment one piece ends the left token and one begins the right
        one; the tokens don't stay apart if these two would merge before the merge that ends the moment.
        """
        rank, parts = self._rank, self._parts
        until_left = until_right = len(parts) + len(rank)
        while True:
            r = None if joins_at_last else rank.get(left << 20 | right)
            if r is not None and r < until_left and r <= until_right:
                return False
            joins_at_last = False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[2] > b[2]:
                left, until_left = a[1], a[2]
            else:
                right, until_right = b[0], b[2]

    def _may_follow(self, left: int, right: int) -> bool:
        if len(self._follows) > 1_000_000:
            self._follows.clear()
        ok = self._follows[left << 20 | right] = self._stand(left, right)
        return ok

    def _suffix(self, read: bytes) -> tuple:
        """The state of an automaton that knows which vocabulary tokens end at the byte read last; made when first needed."""
        while read not in self._heads:
            read = read[1:]
        state = self._suffixes.get(read)
        if state is None:
            ends = tuple((self._id[t], len(t)) for k in range(len(read)) if (t := read[k:]) in self._id)
            state = self._suffixes[read] = ({}, ends, read)
        return state

    def _walk(self, words: Iterable[tuple[str, bytes]]) -> dict[str, str]:
        """The ids of each word as decimal text, by one depth-first walk over the trie of all of them."""
        trie: dict = {}
        for word, raw in words:
            node = trie
            for x in raw:
                nxt = node.get(x)
                if nxt is None:
                    nxt = node[x] = {}
                node = nxt
            node[-1] = word
        found: dict[str, str] = {}
        token, size = [-1], [0]  # of the path: last token of the prefix of length d, and its length
        follows, may, suffix = self._follows, self._may_follow, self._suffix
        stack = [(0, x, child, self._start) for x, child in trie.items() if x != -1]
        while stack:
            depth, x, node, state = stack.pop()
            nxt = state[0].get(x)
            if nxt is None:
                nxt = state[0][x] = suffix(state[2] + bytes([x]))
            depth += 1
            for hit, length in nxt[1]:  # the longest token that ends here and may follow what stands before it
                if length == depth:
                    break
                pair = token[depth - length] << 20 | hit
                ok = follows.get(pair)
                if ok or ok is None and may(token[depth - length], hit):
                    break
            if depth == len(token):
                token.append(hit)
                size.append(length)
            else:
                token[depth], size[depth] = hit, length
            for y, child in node.items():
                if y != -1:
                    stack.append((depth, y, child, nxt))
                else:
                    ids, d = [], depth
                    while d:
                        ids.append(str(token[d]))
                        d -= size[d]
                    ids.reverse()
                    found[child] = ",".join(ids)
        return found

    def _learn(self, words: set[str]) -> dict[str, str]:
        """Ids of the words of the pattern; those that are short enough are kept."""
        known = self._words
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = {w for w in words if w not in known}
        own = {s: str(i) for s, i in self.specials.items() if s in fresh}
        own |= self._walk((w, w.encode()) for w in fresh if w not in own)
        long_words = {w: ids for w, ids in own.items() if len(w) > CACHE_BYTES}
        known.update((w, ids) for w, ids in own.items() if w not in long_words) if long_words else known.update(own)
        return {**known, **long_words} if long_words else known

    def _cut(self, text: str) -> list[str]:
        if self._special and "<" in text and (parts := self._special.split(text))[1:]:
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._split(p))]
        return self._split(text)

    def encode_decimal(self, texts: list[str]) -> list[str]:
        """For each text its ids as decimal text, joined by commas.

        Where all white space is single spaces and newlines, as in most prose, the pattern never looks across them: what
        stands between two of them is cut and encoded once, with and without a space before it. Other texts are cut whole.
        """
        if len(self._pieces[0]) + len(self._pieces[1]) > CACHE_WORDS:
            self._pieces[0].clear(), self._pieces[1].clear()
        bare, spaced = self._pieces
        cut: list = []
        words: set[str] = set()
        new_bare: set[str] = set()
        new_spaced: set[str] = set()
        for text in texts:
            if not (text[:1] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD_SPACE(text) or self._special and self._special.search(text)):
                lines = [line.split(" ") for line in text.split("\n")]
                for line in lines:
                    new_bare.add(line[0])
                    new_spaced.update(line[1:])
                cut.append((lines,))
            else:
                cut.append(own := self._cut(text))
                words.update(own)
        split = self._split
        new = [(bare, w, split(w)) for w in new_bare if w not in bare] + [(spaced, w, split(" " + w)) for w in new_spaced if w not in spaced]
        for _, _, parts in new:
            words.update(parts)
        get = self._learn(words).__getitem__
        more: tuple[dict, dict] = ({}, {})  # long pieces are not kept
        for kept, w, parts in new:
            ids = ",".join(map(get, parts))
            if len(w) > CACHE_BYTES:
                more[kept is spaced][w] = ids
            else:
                kept[w] = ids
        first = ({**bare, **more[0]} if more[0] else bare).__getitem__
        later = ({**spaced, **more[1]} if more[1] else spaced).__getitem__
        newline = f",{self._id[bytes([10])]},"
        return [newline.join([",".join([first(line[0]), *map(later, line[1:])]) for line in x[0]]) if type(x) is tuple else ",".join(map(get, x)) for x in cut]

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_decimal([text])[0].split(",") if x]

    def decode(self, ids: Sequence[int]) -> str:
        """The bytes of the tokens end to end, read as UTF-8; ids that the vocabulary doesn't have fail."""
        tokens = np.asarray(ids, np.int64)
        sizes = self._sizes[tokens]
        if not sizes.all():
            raise ValueError("token ids outside the vocabulary")
        ends = np.cumsum(sizes)
        take = np.repeat(self._begins[tokens] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self._flat[take].tobytes().decode("utf-8", "replace")


_loaded: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder a worker process and file; its word cache serves every task that follows, until the worker turns to another operator."""
    if path not in _loaded:
        _loaded[path] = TrieEncoder(path)
    keeps_cache(_loaded.clear)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: id, n_tokens, ids_sha256, decoded_sha256, and on request token_ids array<int> and the decoded text.

    A single pass without a shuffle: vocabulary and trie live in the workers.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"{id_col} {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", token_ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = encoder(path), hashlib.sha256
        gc.disable()  # tries are many small dicts without cycles; looking for cycles costs more than the walk. The worker's next operator turns it on
        for part in slices(batches, 1024, own_cache=True):
            ids = bpe.encode_decimal([x or "" for x in part.column(1).to_pylist()])
            arrays = [np.fromstring(x, np.int32, sep=",") for x in ids]
            back = [bpe.decode(x) for x in arrays]
            out = [part.column(0), pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()), pa.array([sha(x.encode()).hexdigest() for x in ids]), pa.array([sha(x.encode()).hexdigest() for x in back])]
            if with_ids:
                out.append(pa.array(arrays, pa.list_(pa.int32())))
            if with_text:
                out.append(pa.array(back))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids, *["decoded"] * with_text])

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """One row for each row of tokens: id, text. Null ids give an empty text, unknown ids fail."""
    rows = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for part in slices(batches, own_cache=True):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, text string")
