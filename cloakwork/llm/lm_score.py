"""Language-model scores by prediction by partial matching.

A trie of byte contexts holds, for each context of up to `order` bytes, how often each byte
followed it. The longest context predicts first; a byte it has not seen costs an
escape (method C: as many escapes as distinct followers), and the shorter context
then predicts among the bytes that the longer one has not (symbol exclusion). A
document's score is the sum of log10 probabilities over its bytes: its code length
with the sign turned. The pretrained model is learnt from all training documents.
Its counts of contexts of up to two bytes are at most 2**24 whatever the corpus, the bound on what is
collected and broadcast; tasks sum them before they are shuffled by trigram. Those of longer contexts grow with the corpus and stay distributed: blocks
of documents send their distinct grams (context and byte) to buckets of contexts' last
three bytes, which hold all that the longer contexts need, and get each gram's probability back.
`adaptive_score` is the model that learns a text as it reads it.

Beside it stands an additive unigram score over words, whose counts grow with the
corpus and stay distributed: blocks of documents send their distinct words to
buckets of hashes and get the corpus counts back.

Nulls and odd input: a null or empty text has one token, its end, and code length 0; rows with
a null id are left out, as no fold is defined for them; repeated rows each count
and come back; a very long text is handled in pieces of its own block, whose task holds its distinct
grams and words; no training documents give uniform bytes and counts of 0; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import ragged as R
from .cluster import block_of, layout, written

FOLDS, HELD_OUT = 10, 0
ALPHA = 0.1
#: Bytes of context that the query's model looks back; a gram is one byte longer and has 8 bytes at most.
ORDER = 5
#: Grams of a bucket whose probabilities are worked out at once.
GRAM_SLICE = 50_000
#: Of layout()'s blocks, so many make one here: the fewer the blocks, the fewer times a gram is sent and answered.
BLOCKS_IN_ONE = 2
#: Bytes of text handled at once: a byte takes some eight numbers.
GRAM_CHUNK = 1 << 19
#: Stands for the end of a text among word hashes.
END = np.uint64(0x0123456789ABCDEF)
_U = np.uint64


class ByteTrie:
    """Counts of bytes after contexts of up to `order` bytes, in nested dictionaries: the plain form of the model."""

    def __init__(self, order: int = 2):
        self.order, self.followers = order, {}

    def _contexts(self, history: bytes) -> Iterator[bytes]:
        for k in range(self.order, -1, -1):
            yield history[len(history) - k :]

    def learn(self, history: bytes, symbol: int) -> None:
        for context in self._contexts(history):
            seen = self.followers.setdefault(context, {})
            seen[symbol] = seen.get(symbol, 0) + 1

    def log10(self, history: bytes, symbol: int) -> float:
        p, excluded = 1.0, set()
        for context in self._contexts(history):
            seen = {s: c for s, c in self.followers.get(context, {}).items() if s not in excluded}
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbol in seen:
                return math.log10(p * seen[symbol] / total)
            p *= len(seen) / total
            excluded |= set(seen)
        return math.log10(p / (256 - len(excluded)))

    def score(self, text: bytes, learn: bool = False) -> float:
        """log10 probability of text; with learn, the trie takes in each byte after it is predicted."""
        history, total = b"\0" * self.order, 0.0
        for symbol in text:
            total += self.log10(history, symbol)
            if learn:
                self.learn(history, symbol)
            history = (history + bytes([symbol]))[1:]
        return total


def adaptive_score(text: bytes, order: int = 2) -> float:
    return ByteTrie(order).score(text, learn=True)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """context << 8 | byte for each byte; a text starts after two zero bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32)
    d = data.astype(np.uint32)
    one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    one[1:], two[2:] = d[:-1], d[:-2]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    one[starts] = 0
    two[starts] = 0
    seconds = starts + 1
    two[seconds[seconds < n]] = 0
    return two << 16 | one << 8 | d


class Low:
    """What contexts of two bytes, one and none have seen: sorted trigrams with counts, and sums for each context.

    The followers of a context are among those of its shorter ones, so what an escape excludes is a
    sum and a number for each context.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.n2 = np.append(keys, 1 << 40), np.append(counts, 0.0)  # the last stands for none
        last, symbol, context = keys >> 8 & 255, keys & 255, keys >> 8
        self.n1 = np.bincount(last << 8 | symbol, weights=counts, minlength=1 << 16)
        self.n0 = np.bincount(symbol, weights=counts, minlength=256)
        pairs = np.flatnonzero(self.n1)
        #: Of each context: its total, its kinds, and what its symbols count in the next shorter context.
        self.two = self._sums(context, counts, self.n1[last << 8 | symbol], 1 << 16)
        self.one = self._sums(pairs >> 8, self.n1[pairs], self.n0[pairs & 255], 256)
        self.none = (self.n0.sum(), float((self.n0 > 0).sum()))

    @staticmethod
    def _sums(context, counts, below, size):
        return tuple(np.bincount(context, weights=w, minlength=size) for w in (counts, np.ones(len(counts)), below))

    def count(self, trigram: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, trigram)
        return np.where(self.keys[at] == trigram, self.n2[at], 0.0)

    def levels(self, trigram: np.ndarray) -> list[tuple]:
        """(count, and total, kinds and excluded sum of the context) of each trigram, for contexts of two bytes, one and none."""
        two, one = trigram >> 8, trigram >> 8 & 255
        return [(self.count(trigram), *(x[two] for x in self.two)), (self.n1[trigram & 0xFFFF], *(x[one] for x in self.one)), (self.n0[trigram & 255], *self.none, 0.0)]

    def log10(self, trigram: np.ndarray) -> np.ndarray:
        return _escaping(self.levels(trigram))


def _escaping(levels: list[tuple]) -> np.ndarray:
    """log10 probabilities from the longest context to none: the first that has the symbol gives it, the others escape."""
    n = len(levels[0][0])
    p, open_, gone, gone_kinds = np.ones(n), np.ones(n, bool), 0.0, 0.0
    for count, total, kinds, out in levels:
        left, weight = kinds - gone_kinds, total - gone + kinds - gone_kinds
        here = open_ & (left > 0)
        found = here & (count > 0)
        p *= np.where(here, np.where(found, count, left) / np.where(here, weight, 1), 1)
        open_ &= ~found
        gone, gone_kinds = out, kinds
    return np.log10(np.where(open_, p / np.maximum(256 - gone_kinds, 1), p))


_low: dict[str, Low] = {}


def _loaded(model) -> Low:
    """A worker's model, built once from the broadcast (name, keys, counts); one at a time is kept."""
    name, blob = model.value
    if name not in _low:
        _low.clear()
        _low[name] = Low(*pickle.loads(blob))
    return _low[name]


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """context << 8 | byte for each byte, the context's nearest byte first; a text starts after zero bytes."""
    out = data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, order + 1):
        back = np.zeros(len(data), np.uint64)
        back[k:] = data[:-k]
        back[place < k] = 0
        out |= back << _U(8 * (order + 1 - k))
    return out


def gram_bucket(keys: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The bucket of each gram, by its context's last three bytes."""
    return (R.mix(keys >> _U(8 * (order - 2))) % _U(buckets)).astype(np.int64)


def gram_log10(keys: np.ndarray, counts: np.ndarray, order: int, low: Low) -> np.ndarray:
    """log10 probabilities of sorted distinct grams with their training counts, about GRAM_SLICE at once.

    For a context of three bytes all grams must be there, and are in one slice.
    """
    contexts = keys >> _U(8 * (order - 2))
    firsts = np.append(np.flatnonzero(np.diff(contexts, prepend=~contexts[:1])), len(keys))
    cuts = np.unique(np.append(firsts[np.searchsorted(firsts, np.arange(0, len(keys), GRAM_SLICE))], len(keys)))
    out = np.zeros(len(keys), np.float32)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = _slice_log10(keys[a:b], counts[a:b], order, low)
    return out


def _slice_log10(keys: np.ndarray, counts: np.ndarray, order: int, low: Low) -> np.ndarray:
    """gram_log10 of a slice: sums by context of each order, and the low orders below."""
    near = (keys >> _U(8 * order) & _U(255)).astype(np.int64)
    trigram = (keys >> _U(8 * (order - 1)) & _U(255)).astype(np.int64) << 16 | near << 8 | (keys & _U(255)).astype(np.int64)
    held, at = [], np.arange(len(keys))
    level, n = keys, counts.astype(np.float64)
    for k in range(order, 2, -1):
        _, context = np.unique(level >> _U(8), return_inverse=True)
        if k > 3:
            shorter, up = np.unique(level >> _U(16) << _U(8) | level & _U(255), return_inverse=True)
            below = np.bincount(up, weights=n, minlength=len(shorter))
            under = below[up]
        else:
            first = np.zeros(len(level), np.int64)
            first[at] = np.arange(len(keys))  # a key of each gram
            under = low.count(trigram[first])
        seen = n > 0
        total, kinds, out = (np.bincount(context, weights=w) for w in (n, seen, under * seen))
        held.append((n[at], total[context][at], kinds[context][at], out[context][at]))
        if k > 3:
            level, n, at = shorter, below, up[at]
    return _escaping(held + low.levels(trigram))


def is_held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of each text's words and its end."""
    low = R.lower_ascii(data)
    s, e, n = R.words(low, offsets)
    h = R.span_hash(low, s, e)
    return np.insert(h, R.first_of(n)[1:], END), n + 1


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, summed counts, place of each part's keys among them)."""
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.uint64)
    return keys, total, place


def _trigram_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's training trigrams with their counts."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for batch in batches:
        for part in R.chunks(batch, size=GRAM_CHUNK):
            data, off = R.buffers(part.column("text"))
            learns = ~is_held_out(part.column("doc").to_numpy(zero_copy_only=False))
            keys, counts = np.unique(trigrams(data, off)[np.repeat(learns, np.diff(off))], return_counts=True)
            parts.append((keys.astype(np.uint64), counts.astype(np.uint64)))
        parts = [_merged(parts)[:2]]
    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in parts[0]], names=["trigram", "times"])


def _learn(buckets: int, order: int):
    """Buckets of words come first, then as many of grams."""

    def run(docs: pa.Table) -> pa.Table:
        """A block's distinct words and grams with their training counts."""
        block = docs.column("block")[0].as_py()
        hashes, train, sent = [], [], []
        for part in R.chunks(docs, size=GRAM_CHUNK):
            data, off = R.buffers(part.column("text"))
            learns = ~is_held_out(part.column("doc").to_numpy())
            h, n = _word_hashes(data, off)
            hashes.append(h)
            train.append(np.repeat(learns, n))
            if order > 2:
                keys, place = np.unique(grams(data, off, order), return_inverse=True)
                sent.append((keys, np.bincount(place, weights=np.repeat(learns, np.diff(off)), minlength=len(keys))))
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate(train), minlength=len(words)).astype(np.uint64)
        out = [(k, block, X.squeezed(X.deltas(words[a:b])), X.squeezed(X.planes(counts[a:b]))) for k, a, b in X.ranges(words, 64, buckets)]
        if sent:
            keys, total, _ = _merged(sent)
            out += [(buckets + k, block, X.squeezed(X.deltas(x)), X.squeezed(X.planes(c))) for k, x, c in R.by_bucket(gram_bucket(keys, order, buckets), keys, total)]
        return X.messages(out)

    return run


def _count(buckets: int, order: int, model):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's corpus counts, or its grams' log10 probabilities, back to each block; totals of words as block -1."""
        bucket = table.column("bucket")[0].as_py()
        sent = [(X.sums(X.opened(a.as_py())), X.unplane(X.opened(b.as_py()))) for a, b in zip(table.column("a"), table.column("b"), strict=True)]
        sizes = [len(names) for names, _ in sent]
        distinct, total, inverse = _merged(sent)
        del sent
        out, at = [], 0
        if bucket < buckets:
            out.append((bucket, -1, R.pack(np.array([(total > 0).sum(), total.sum()], np.uint64)), b""))
            back = total[inverse]
        else:
            back = gram_log10(distinct, total, order, _loaded(model))[inverse]
        for block, size in zip(table.column("block").to_pylist(), sizes, strict=True):
            mine = back[at : at + size]
            out.append((bucket, block, X.squeezed(X.planes(mine) if bucket < buckets else np.ascontiguousarray(mine.view(np.uint8).reshape(-1, 4).T).tobytes()), b""))
            at += size
        return X.messages(out)

    return run


SCORED = "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, count_log double, score double"
_SCORED = pa.schema([("doc", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("count_log", pa.float64()), ("score", pa.float64())])


def _score(model, buckets: int, order: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _SCORED.empty_table()
        got = dict(zip(replies.column("bucket").to_pylist(), replies.column("a").to_pylist(), strict=True))
        parts = [(part, *_word_hashes(*R.buffers(part.column("text")))) for part in R.chunks(docs, size=GRAM_CHUNK)]
        words, inverse = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
        corpus = np.zeros(len(words), np.uint64)
        for bucket, a, b in X.ranges(words, 64, buckets):
            corpus[a:b] = X.unplane(X.opened(got[bucket]))
        counts = corpus[inverse].astype(np.float64)
        if order > 2:
            named = []
            for part, _, _ in parts:
                mine, place = np.unique(grams(*R.buffers(part.column("text")), order), return_inverse=True)
                named.append((mine, place.astype(np.int32)))
            keys = np.unique(np.concatenate([k for k, _ in named]))
            log10 = np.zeros(len(keys))
            for bucket, places in R.by_bucket(gram_bucket(keys, order, buckets), np.arange(len(keys))):
                log10[places] = np.ascontiguousarray(np.frombuffer(X.opened(got[buckets + bucket]), np.uint8).reshape(4, -1).T).view(np.float32).ravel()
        out, at = [], 0
        for k, (part, h, n) in enumerate(parts):
            mine = counts[at : at + len(h)]
            at += len(h)
            first = R.first_of(n)
            ids = part.column("doc").to_numpy()
            data, off = R.buffers(part.column("text"))
            if order > 2:
                log = log10[np.searchsorted(keys, named[k][0])][named[k][1]]
            else:
                mine3, place = np.unique(trigrams(data, off).astype(np.int64), return_inverse=True)
                log = _loaded(model).log10(mine3)[place] if len(data) else np.zeros(0)
            total = np.zeros(len(data) + 1)
            np.cumsum(log, out=total[1:])
            scores = total[off[1:]] - total[off[:-1]]
            out.append((ids, is_held_out(ids), n, np.add.reduceat(mine > 0, first[:-1], dtype=np.int64), np.add.reduceat(np.log10(mine + ALPHA), first[:-1]), scores))
        return pa.Table.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(6)], schema=_SCORED)

    return run


def score_documents(docs: DataFrame, id_column: str = "doc_id", order: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; order: 2 to 7 bytes of context."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc is not null")
    blocks, buckets = layout(docs)
    blocks = -(-blocks // BLOCKS_IN_ONE)
    seen = docs.mapInArrow(_trigram_parts, "trigram bigint, times bigint").groupBy("trigram").agg(F.sum("times").alias("times")).orderBy("trigram").toArrow()  # at most 2**24 rows
    low = pickle.dumps((seen.column("trigram").to_numpy(), seen.column("times").to_numpy().astype(np.float64)))
    model = spark.sparkContext.broadcast((uuid.uuid4().hex, low))
    held = docs.withColumn("block", block_of(blocks, "doc", "text"))
    sent = held.groupBy("block").applyInArrow(_learn(buckets, order), X.MESSAGE)
    counted = written(sent.groupBy("bucket").applyInArrow(_count(buckets, order, model), X.MESSAGE), "counts")
    totals = [R.unpack(r.a, "u8")[0] for r in counted.filter("block = -1").select("a").toLocalIterator()]
    kinds, tokens = (sum(int(t[i]) for t in totals) for i in (0, 1))
    scored = held.groupBy("block").cogroup(counted.filter("block >= 0").groupBy("block")).applyInArrow(_score(model, buckets, order), SCORED)
    log_total = math.log10(tokens + ALPHA * (kinds + 1))
    return scored.select(F.col("doc").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("count_log") - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), "score")
