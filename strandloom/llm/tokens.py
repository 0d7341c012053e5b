"""Problem 6: token ids of whole texts by a public byte-level BPE vocabulary.

Pre-tokenisation without a regex: texts are codepoint arrays, a table gives each codepoint's class (letter, number, white
space, other). Read as an automaton over the classes, the vocabulary's pattern forgets everything but its last two inputs, so the
composition of the transition functions up to any place (an associative scan) is fixed by that place's neighbours; a few array
comparisons of shifted classes give all token starts at once. Apostrophe endings are the only look-ahead.

The slices go through a cache of words whose pairs were merged once. Starts are kept, so each id can be traced to its text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters that are tokenised together, about, and words that a task remembers.
CHUNK, REMEMBERED = 1 << 20, 1 << 20
OTHER, LETTER, NUMBER, SPACE, END = range(5)
# The codepoints that Unicode calls white space, as first and last of each range.
WHITE = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


@cache
def _classes() -> np.ndarray:
    """The class of each codepoint."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for a, b in WHITE:
        out[a : b + 1] = SPACE
    return out


def token_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end, each followed by one codepoint at ``ends``; the ends count as starts."""
    c = np.full(len(points) + 4, END, np.uint8)
    c[1 : len(points) + 1] = _classes()[points]
    c[ends + 1] = END
    here, before, after = c[1:-3], c[:-4], c[2:-2]
    blank = np.zeros(len(points) + 1, bool)
    blank[1:] = points == 32
    blank[ends + 1] = False
    space = here == SPACE
    start = (here != before) & ~blank[:-1]
    start |= space & ((before != SPACE) | ((after != SPACE) & (after != END)))
    start |= here == END
    quote = np.flatnonzero((points == 39) & start & (after == LETTER))
    if len(quote):
        p = np.concatenate((points, np.zeros(3, points.dtype)))
        one, two = p[quote + 1], p[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        long &= ~short & (c[quote + 3] == LETTER)
        for found, n in ((quote[short], 2), (quote[long], 3)):
            start[found + 1] = False
            rest = found + n
            start[rest[c[rest + 1] == LETTER]] = True
    return np.flatnonzero(start)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Encoder:
    """Merges the pairs of a word, lowest rank first, and remembers words."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.forget()

    def forget(self):
        self.words, self.ids, self.at = _Words(self._add), array("i"), array("q", [0])

    def _add(self, word: str) -> int:
        self.ids.extend(self.merge(word.encode()))
        self.at.append(len(self.ids))
        return len(self.at) - 2

    def merge(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        get, n = self.ranks.get, len(data)
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, wide = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= n or size[i] + size[j] != wide:
                continue
            size[i], size[j], after[i] = wide, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get(data[i : i + wide + size[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, wide + size[after[j]]))
            if (h := before[i]) >= 0 and (r := get(data[h : i + wide])) is not None:
                heapq.heappush(heap, (r, h, size[h] + wide))
        return [self.ranks[data[i : i + size[i]]] for i in range(n) if size[i]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin, words' starts (in all texts with one codepoint between) and ids of each."""
        joined = "\n".join(texts) + "\n"
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        starts = token_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends)
        cuts = starts.tolist()
        known = self.words
        number = np.fromiter((known[joined[a:b]] for a, b in zip(cuts, [*cuts[1:], len(joined)])), np.int64, len(cuts))
        at, ids = np.frombuffer(self.at, np.int64), np.frombuffer(self.ids, np.int32)
        count = at[number + 1] - at[number]
        is_end = np.searchsorted(starts, ends)
        count[is_end] = 0
        total = np.cumsum(count)
        out = ids[np.repeat(at[number] - (total - count), count) + np.arange(total[-1])]
        begin = np.concatenate(([0], total[is_end]))
        del at, ids
        if len(self.words) > REMEMBERED:
            self.forget()
        return out, begin, starts, count


class _Words(dict):
    def __init__(self, add):
        self.add = add

    def __missing__(self, word):
        self[word] = n = self.add(word)
        return n


_encoders: dict[int, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    """One encoder for each vocabulary in a Python worker; its memory of words lasts from task to task."""
    key = hash(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def _chunks(batch: pa.RecordBatch):
    """Rows of a batch, about CHUNK characters at a time: offset, texts (null as empty)."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK:
            yield lo, texts[lo : i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def encoded(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Token ids of each text: doc_id, ids. Null and empty texts have the empty list; other columns are ignored.

    Strings of special tokens are ordinary text. Repeated rows give repeated rows, a null doc_id keeps its row.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(ranks.value)
        for batch in batches:
            for lo, texts in _chunks(batch):
                ids, begin, _, _ = by.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens: how many ids each text has."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(ranks.value)
        for batch in batches:
            for lo, texts in _chunks(batch):
                begin = by.encode(texts)[1]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(np.diff(begin).astype(np.int64))], names=["doc_id", "tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(count, "doc_id bigint, tokens bigint")


def word_offsets(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, starts, counts: the character at which each pre-token starts, and how many ids it has."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(path))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = encoder(ranks.value)
        for batch in batches:
            for lo, texts in _chunks(batch):
                _, _, starts, count = by.encode(texts)
                size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
                first = np.cumsum(size) - size
                keep = count > 0
                starts, count = starts[keep], count[keep]
                edge = np.searchsorted(starts, np.append(first, size.sum())).astype(np.int32)
                starts = starts - np.repeat(first, np.diff(edge))
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x.astype(np.int32))) for x in (starts, count)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), *lists], names=["doc_id", "starts", "counts"])

    return spread(documents.select("doc_id", "text")).mapInArrow(locate, "doc_id bigint, starts array<int>, counts array<int>")


def decoded(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows of doc_id, ids; ids that don't end a character give the replacement character."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {n: x for x, n in encoder(ranks.value).ranks.items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(piece.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")


