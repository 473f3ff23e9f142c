"""Token counts by rank-synchronous merging of ragged numpy arrays.

A BPE piece model is applied to many sequences at once: their symbols lie in
one flat array, and each step merges the lowest-rank pair of every sequence
together, all its occurrences in the sequence at once. Pre-tokens end before a white space mark, since
no piece holds one after another character; equal pre-tokens are merged once and remembered by their
bytes. A pre-token is cut into sequences where two neighbouring characters stand together in no piece:
no merge can cross such a place.

Nulls and odd input: a null or empty text has no bytes and no tokens; rows are
independent, so repeated rows, repeated ids and null ids are counted as they
stand; a very long text or word goes the same way as any other: a step costs the symbols that still
merge; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R

MARK = "▁"
#: Pre-tokens whose counts a worker remembers, and the bytes of one at most; beyond, it starts anew.
REMEMBER, LONGEST = 1_000_000, 64
_NONE = np.int64(1) << 40


class PieceModel:
    """The merges of a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores = {}, {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i)):
                pieces[sp.id_to_piece(i)] = i
                scores[sp.id_to_piece(i)] = sp.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a white space mark after another character")
        levels = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: levels[s] for p, s in scores.items()}
        chars = {c for p in pieces for c in p}
        self.names = {p: i for i, p in enumerate([*pieces, *(c for c in chars if c not in pieces)])}
        self.unknown = len(self.names)  # any character of no piece
        pairs = []
        for p in pieces:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in self.names and b in self.names:
                    pairs.append((self.names[a] << 32 | self.names[b], rank[p], self.names[p]))
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs] or [0], np.int64)
        self.ranks = np.array([x[1] for x in pairs] or [_NONE], np.int64)
        self.merged = np.array([x[2] for x in pairs] or [0], np.int64)
        best = {}  # lowest rank of a merge that takes the piece in
        for key, r, _ in pairs:
            for side in (key >> 32, key & 0xFFFFFFFF):
                best[side] = min(best.get(side, _NONE), r)
        tied = {r for r, n in Counter(rank.values()).items() if n > 1}
        #: Ranks whose merge can make no pair of a lower or equal rank: all its occurrences may go at once.
        self.safe = np.zeros(len(levels) + 1, bool)
        for p, r in rank.items():
            self.safe[r] = r not in tied and best.get(self.names[p], _NONE) > r
        #: Symbols beyond which two merges can't meet: what a merge sets off at lower ranks is one growing piece around it.
        self.reach = 2 * max(map(len, pieces), default=1) + 2
        #: Symbol of each code point, and the tokens that a symbol left over counts as.
        self.symbol = np.full(0x110000, self.unknown, np.int32)
        for c in chars:
            self.symbol[ord(c)] = self.names[c]
        self.in_vocabulary = np.zeros(self.unknown + 1, bool)
        self.in_vocabulary[[self.names[p] for p in pieces]] = True
        #: Characters that stand side by side in some piece, as symbols.
        self.beside = np.unique(np.array([self.names[a] << 32 | self.names[b] for p in pieces for a, b in zip(p, p[1:], strict=False)] or [0], np.int64))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def counts(self, points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each sequence of code points (`points` is flat, `lengths` per sequence)."""
        sym = self.symbol[points].astype(np.int64)
        size = np.where(self.in_vocabulary[sym], 1, np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4))))
        total = np.zeros(len(lengths), np.int64)
        token = np.repeat(np.arange(len(lengths)), lengths)
        if not len(sym):
            return total
        key = sym[:-1] << 32 | sym[1:]
        near = self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] == key
        seq = np.cumsum(np.append(True, ~near | (token[1:] != token[:-1]))) - 1
        owner = token[np.append(True, seq[1:] != seq[:-1])]
        while len(sym):
            rank, at = self.pair_ranks(sym[:-1], sym[1:])
            rank[seq[:-1] != seq[1:]] = _NONE
            rank = np.append(rank, _NONE)
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, heads)
            spans = np.diff(np.append(heads, len(sym)))
            done = np.repeat(low == _NONE, spans)
            if done.any():  # nothing more to merge in these
                total += np.bincount(owner[seq[done]], weights=size[done], minlength=len(total)).astype(np.int64)
                keep = ~done
                sym, size, seq, rank = sym[keep], size[keep], seq[keep], rank[keep]
                at = np.append(at, 0)[keep]
                low, spans = low[low != _NONE], spans[low != _NONE]
                heads = R.first_of(spans)[:-1]
            else:
                at = np.append(at, 0)
            if not len(sym):
                break
            hit = rank == np.repeat(low, spans)
            where = np.flatnonzero(hit)
            group = seq[where]
            # of a rank that isn't safe: the first in its sequence, and those too far from the one before to meet it
            leftmost = np.append(True, (group[1:] != group[:-1]) | (np.diff(where) > self.reach))
            run = np.append(True, (np.diff(where) != 1) | (np.diff(group) != 0))  # of hits side by side
            nth = np.arange(len(where)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            take = where[leftmost | (self.safe[rank[where]] & (nth % 2 == 0))]
            sym[take], size[take] = self.merged[at[take]], 1
            gone = np.ones(len(sym), bool)
            gone[take + 1] = False
            sym, size, seq = sym[gone], size[gone], seq[gone]
        return total


_models: dict[str, tuple[PieceModel, dict]] = {}


def _model(path: str) -> tuple[PieceModel, dict]:
    """A worker's model and what it remembers, loaded once from a file that every host has."""
    if path not in _models:
        _models[path] = (PieceModel(path), {})
    return _models[path]


_EMPTY, _SPACE = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
_IS_SPACE = np.arange(256) == 0x20


def count_texts(column, path: str) -> np.ndarray:
    """Tokens of each text of an Arrow string column."""
    model, known = _model(path)
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), MARK, " ")
    data, off = R.buffers(pc.if_else(pc.equal(column, ""), _EMPTY, pc.binary_join_element_wise(_SPACE, column, _EMPTY)))
    if not len(data):
        return np.zeros(len(off) - 1, np.int64)
    space = _IS_SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    _, index, inverse = np.unique(R.span_hash(data, starts, ends), return_index=True, return_inverse=True)
    raw = data.tobytes()
    spelt = [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
    counts = np.array([known.get(x, -1) for x in spelt], np.int64)
    new = np.flatnonzero(counts < 0)
    if len(new):
        texts = [spelt[i].decode().replace(" ", MARK) for i in new]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        counts[new] = model.counts(points, np.array([len(t) for t in texts]))
        if len(known) + len(new) > REMEMBER:
            known.clear()
        known.update((spelt[i], c) for i, c in zip(new.tolist(), counts[new].tolist(), strict=True) if len(spelt[i]) <= LONGEST)
    total = R.first_of(counts[inverse])
    at = np.searchsorted(starts, off)
    return total[at[1:]] - total[at[:-1]]


def count_tokens(docs: DataFrame, model_path: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens) of each row's whole text under the piece model at model_path."""
    source = docs.select(id_column, F.col("text").cast("string").alias("text"))
    kind = source.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in R.chunks(batch):
                _, off = R.buffers(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(count_texts(part.column(1), model_path))], names=[id_column, "n_bytes", "n_tokens"])

    return source.mapInArrow(run, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint")
