"""Benchmark decontamination with a generalised suffix automaton.

The test items, as word numbers, are put into one suffix automaton. A document's
words then stream through it while the longest match that ends at each word is
tracked: where it reaches a window's length, the window occurs there and its
words are hit. An automaton is built per shard of items of about SHARD_WORDS words (an item is never
split), and each shard is a broadcast of its own. The driver holds one while it builds it, and a
worker LOADED at a time: with more, it takes documents GROUP_BYTES together and leads them
through one shard after another.

Only runs of words whose neighbours also stand side by side in some item are
streamed: outside them no match can reach a window's length.

Nulls and odd input: a null or empty text or item has no words; an item with no
words has no window; equal items are all reported; items with a null id are
left out; repeated documents are judged row by row; a very long text is one chunk, a very long item
one shard; empty tables give no hits or an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R

WINDOW = 10
#: Item words in one automaton (about 1 KB of memory a word, and 0.1 KB as it is sent).
SHARD_WORDS = 100_000
#: Shards that a worker keeps, and bytes of text that are led through the shards together where there are more.
LOADED, GROUP_BYTES = 2, 32 << 20


def _word_table() -> np.ndarray:
    """True for the bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` once A-Z are lower-cased."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


WORD = _word_table()


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, byte starts, byte ends, words per text) of normalised words."""
    low = R.lower_ascii(data)
    s, e, n = R.words(low, offsets, WORD)
    return R.span_hash(low, s, e), s, e, n


class Automaton:
    """A generalised suffix automaton over the items' words; states are numbers."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next, self.link, self.len = [{}], [-1], [0]
        ends = []
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            ends.append(last)
        self.items = [name for name, _ in items]
        #: Items by the state of their windows, and whole short items as (length, item).
        self.at: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                self.short.setdefault(self._state(ends[k], len(words)), []).append((len(words), k))
            else:
                v = length = 0
                for w in words:
                    v, length = self.step(v, length, w)
                    if length >= window:
                        hit = self.at.setdefault(self._state(v, window), [])
                        if not hit or hit[-1] != k:
                            hit.append(k)
        self._suffix_shorts: dict[int, list[tuple[int, int]]] = {}

    def _add(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the longest string of p followed by c, cut out of q."""
        clone = self._add(self.len[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item goes this way
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        cur, p = self._add(self.len[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return cur

    def step(self, v: int, length: int, c: int) -> tuple[int, int]:
        """The longest match that ends with c."""
        while v and c not in self.next[v]:
            v = self.link[v]
            length = self.len[v]
        if c in self.next[v]:
            return self.next[v][c], length + 1
        return 0, 0

    def _state(self, v: int, length: int) -> int:
        """The state of the match's last `length` words."""
        while self.len[self.link[v]] >= length:
            v = self.link[v]
        return v

    def shorts(self, v: int, length: int) -> list[tuple[int, int]]:
        """Short items that end the match."""
        if v not in self._suffix_shorts:
            out, u = [], v
            while u > 0:
                out += self.short.get(u, ())
                u = self.link[u]
            self._suffix_shorts[v] = out
        return [x for x in self._suffix_shorts[v] if x[0] <= length]

    def run(self, words: list[int]) -> Iterator[tuple[int, int, list[int]]]:
        """(end, length, items): each window that ends before words[end]."""
        v = length = 0
        for i, w in enumerate(words, 1):
            v, length = self.step(v, length, w)
            if length >= self.window:
                yield i, self.window, self.at[self._state(v, self.window)]
            if self.short and v:
                for n, k in self.shorts(v, length):
                    yield i, n, [k]


class Shard:
    """The automaton of some items, with the word pairs that decide what is streamed."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.least = min([window, *(len(w) for _, w in items)])
        self.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        number = [(name, np.searchsorted(self.vocabulary, w).tolist()) for name, w in items]
        self.pairs = np.unique(np.array([a << 32 | b for _, w in number for a, b in zip(w, w[1:], strict=False)], np.int64))
        self.automaton = Automaton(number, window)

    def find(self, hashes: np.ndarray, counts: np.ndarray, hit: np.ndarray, found: list[set]) -> None:
        """Adds to the hit flag of each word and the items of each text."""
        if not len(hashes):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        text = np.repeat(np.arange(len(counts)), counts)
        joined = known[:-1] & known[1:] & (text[:-1] == text[1:])
        if len(self.pairs):
            key = at[:-1].astype(np.int64) << 32 | at[1:]
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined &= self.pairs[place] == key
        else:
            joined[:] = False
        starts = np.flatnonzero(known & ~np.append(False, joined))
        ends = np.flatnonzero(known & ~np.append(joined, False)) + 1
        long = ends - starts >= self.least
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            for end, n, items in self.automaton.run(at[s:e].tolist()):
                hit[s + end - n : s + end] = True
                found[text[s]].update(self.automaton.items[k] for k in items)


def shards_of(benchmark: DataFrame, item_column: str = "item_id", window: int = WINDOW) -> Iterator[Shard]:
    """The automata of a benchmark. Items are a stated query set that the driver reads a partition at a time; documents never come here."""
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("item is not null")
    held, size = [], 0
    for row in rows.toLocalIterator():
        data = np.frombuffer((row.text or "").encode(), np.uint8)
        words = hashed_words(data, np.array([0, len(data)]))[0]
        if not len(words):
            continue
        if held and size + len(words) > SHARD_WORDS:
            yield Shard(held, window)
            held, size = [], 0
        held.append((row.item, words))
        size += len(words)
    if held:
        yield Shard(held, window)


_loaded: dict[str, Shard] = {}


def _shard(held) -> Shard:
    name, blob = held.value
    if name not in _loaded:
        while len(_loaded) >= LOADED:
            del _loaded[next(iter(_loaded))]
        _loaded[name] = pickle.loads(blob)
    return _loaded[name]


def _sent(benchmark: DataFrame, item_column: str, window: int) -> list:
    """A broadcast for each shard."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast((uuid.uuid4().hex, pickle.dumps(s))) for s in shards_of(benchmark, item_column, window)]


def _grouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list]:
    """Chunks of batches, about `size` bytes together."""
    held, total = [], 0
    for batch in batches:
        for part in R.chunks(batch):
            held.append(part)
            total += part.nbytes
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def _hits(batches: Iterator[pa.RecordBatch], sent: list, at: int) -> Iterator[tuple]:
    """(chunk, word starts, word ends, words of each text, hit flags, items of each text) of column `at`."""
    for group in _grouped(batches, GROUP_BYTES if len(sent) > LOADED else 1):
        state = []
        for part in group:
            h, s, e, n = hashed_words(*R.buffers(part.column(at)))
            state.append((part, h, s, e, n, np.zeros(len(h), bool), [set() for _ in n]))
        for held in sent:
            shard = _shard(held)
            for _, h, _, _, n, hit, found in state:
                shard.find(h, n, hit, found)
        for part, _, s, e, n, hit, found in state:
            yield part, s, e, n, hit, found


FOUND = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _spans(hit: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int]]]:
    """The ranges of hit words of each text."""
    out = []
    cut = R.first_of(hit.astype(np.int64))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if cut[b] == cut[a]:
            out.append([])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """text without the words of spans; starts and ends are those of its words in it."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]]).decode()


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", item_column: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items, spans): words hit, the items that occur and the hit word ranges."""
    sent = _sent(benchmark, item_column, window)
    source = docs.select(id_column, F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, _, n, hit, found in _hits(batches, sent, 1):
            first = R.first_of(n)
            spans = [[{"start": a, "end": b} for a, b in x] for x in _spans(hit, first)]
            n_hit = np.diff(R.first_of(hit.astype(np.int64))[first])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n_hit), pa.array([sorted(x) for x in found], pa.list_(pa.string())), pa.array(spans, _SPANS)], names=[id_column, "n_words", "n_hit", "items", "spans"])

    kind = source.schema[id_column].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, {FOUND}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_column: str = "item_id", window: int = WINDOW, max_share: float = 0.5) -> DataFrame:
    """docs with hit spans cut out of text; a document with more than max_share of its words hit goes as a whole."""
    sent = _sent(benchmark, item_column, window)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s, e, n, hit, _ in _hits(batches, sent, at):
            first, (_, off) = R.first_of(n), R.buffers(part.column(at))
            n_hit = np.diff(R.first_of(hit.astype(np.int64))[first])
            text = part.column(at).to_pylist()
            for i, spans in enumerate(_spans(hit, first)):
                if spans:
                    mine = slice(first[i], first[i + 1])
                    text[i] = _cut(text[i].encode(), spans, s[mine] - off[i], e[mine] - off[i])
            columns = list(part.columns)
            columns[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array(n_hit <= max_share * n))

    return docs.mapInArrow(run, docs.schema)
