"""Substring dedup by recompression.

Words are symbols. A round names every run of equal symbols and then every
pair whose left symbol falls on the left side and whose right symbol falls on
the right side of a split of the alphabet. A name is a hash of what it stands for,
so equal content gets one name everywhere without a table of names. Inside a
repeated passage all rounds make the same symbols, save for a few at its edges:
for each window of `window` words the interior that does not depend on
what stands around it is known at every level. The window is represented by the
smallest tuple of neighbouring interior symbols at the highest level that has
enough of them; level 0, the words themselves, always has.

1. Blocks of documents send the distinct tuple names they hold; names seen twice
   anywhere come back as a mask. Unique text ends here.
2. Windows with a shared name are verified: blocks send the first place of each
   such window (two independent 64-bit hashes of its words' bytes, which stand for
   the content); all but the earliest come back.
3. Words covered by a window that also starts earlier are cut.

A block sends a name or window once however many copies it holds, so a group of
copies costs its reducer a row for each block, not for each copy. Blocks are sized by
bytes; nothing is collected or broadcast.

Nulls and odd input: a null or empty text has no words and stays as it is; rows
with a null id are left out, since no order is defined for them; rows that repeat an id
are the same place, not an earlier one, and each row comes back; a very long text or word is
whole in one block, whose task holds some fifty times its bytes; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import ragged as R
from .cluster import block_of, layout

WINDOW = 20
#: Interior symbols in a tuple, by level.
TUPLE = (10, 6, 4)
#: Bits of a name that are sent; more would only spare a few needless verifications.
NAME_BITS = 44
#: Bits of a symbol's place in its block.
_PLACE = np.uint64((1 << 32) - 1)
#: Windows that are named at once: their names do not depend on what stands around them.
PIECE = 200_000
_U = np.uint64


def _round(sym: np.ndarray, text: np.ndarray, level: int):
    """One round: (symbols, their texts, run of each old symbol, side of each run, new symbol of each run)."""
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])
    run = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    length = np.diff(np.append(heads, len(sym))).astype(np.uint64)
    name = np.where(length > 1, R.mix(sym[heads] * _U(0x9FB21C651E98DF25) + length), sym[heads])
    run_text = text[heads]
    side = (R.mix(name ^ _U(0x5851F42D4C957F2D + level)) >> _U(63)).astype(bool)
    joined = np.zeros(len(name), bool)  # with the run before
    joined[1:] = ~side[:-1] & side[1:] & (run_text[1:] == run_text[:-1])
    pair = np.cumsum(~joined) - 1
    first = np.flatnonzero(~joined)
    out = name[first].copy()
    second = np.flatnonzero(joined)
    out[pair[second]] = R.mix(name[second - 1] * _U(0xD1342543DE82EF95) + R.mix(name[second]))
    return out, run_text[first], run, side, pair


def _smallest(values: np.ndarray, lo: np.ndarray, length: np.ndarray) -> np.ndarray:
    """min(values[lo:lo+length]) for each range, by doubling."""
    out = np.empty(len(lo), np.uint64)
    level, step = values, 1
    power = np.zeros(len(lo), np.int64)
    for k in range(1, 40):
        power += length >= (1 << k)
    for k in range(int(power.max(initial=0)) + 1):
        mine = np.flatnonzero(power == k)
        out[mine] = np.minimum(level[lo[mine]], level[lo[mine] + length[mine] - step])
        grown = level.copy()
        grown[: max(0, len(level) - step)] = np.minimum(level[: max(0, len(level) - step)], level[step:])
        level, step = grown, 2 * step
    return out


def window_names(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, name, place of the tuple) of every window: equal windows have equal names, and few have a place of their own."""
    text, start = R.window_starts(counts, window)
    name, place = np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
    if not len(start):
        return text, start, name, place
    levels = [(words, start, start + window)]
    sym, sym_text, lo, hi = words, np.repeat(np.arange(len(counts)), counts), start, start + window
    for level in range(1, len(TUPLE)):
        sym, sym_text, run, side, pair = _round(sym, sym_text, level)
        full = hi > lo
        a, b = run[np.minimum(lo, len(run) - 1)] + 1, run[np.maximum(hi - 1, 0)]  # the outer runs may go on outside
        full &= b > a
        a, z = np.minimum(a, len(side) - 1), np.maximum(b - 1, 0)
        lo = np.where(full, pair[a] + side[a], 0)  # a right symbol may belong to a pair that starts outside
        hi = np.where(full, pair[z] + side[z], 0)  # a left one to a pair that ends outside
        levels.append((sym, lo, hi))
    todo = np.arange(len(start))
    for level in range(len(TUPLE) - 1, -1, -1):
        sym, lo, hi = levels[level]
        m = min(TUPLE[level], window)
        fits = hi[todo] - lo[todo] >= m
        mine, todo = todo[fits], todo[~fits]
        if len(mine):
            at = np.arange(len(sym) - m + 1)
            key = R.window_hash(sym, at, m, R.SEED2 + _U(2 * level))
            best = _smallest((key & ~_PLACE) | at.astype(np.uint64), lo[mine], hi[mine] - lo[mine] - m + 1)
            found = (best & _PLACE).astype(np.int64)
            name[mine], place[mine] = key[found], found * len(TUPLE) + level
    return text, start, name, place


def _pieces(counts: np.ndarray, window: int):
    """(first word, words per text) of pieces of about PIECE windows: runs of texts, and parts of long texts that overlap by a window."""
    first, held, total = R.first_of(counts), [], 0
    for text, n in enumerate(counts.tolist()):
        if held and total + n > PIECE:
            yield int(first[text - len(held)]), np.array(held, np.int64)
            held, total = [], 0
        if n > PIECE:
            for at in range(0, n - window + 1, PIECE):
                yield int(first[text]) + at, np.array([min(n - at, PIECE + window - 1)], np.int64)
        else:
            held.append(n)
            total += n
    if held:
        yield int(first[len(counts) - len(held)]), np.array(held, np.int64)


def _block(table: pa.Table, id_column: str) -> pa.Table:
    return table.sort_by([(id_column, "ascending"), ("text", "ascending")])


def _words(table: pa.Table, second: bool = False):
    """(hashes, second hashes, words per text) of a block's words."""
    one, two, counts = [], [], []
    for part in R.chunks(table):
        data, off = R.buffers(part.column("text"))
        s, e, n = R.words(data, off)
        one.append(R.span_hash(data, s, e))
        if second:
            two.append(R.span_hash(data, s, e, R.SEED2))
        counts.append(n)
    z = np.zeros(0, np.uint64)
    return np.concatenate([z, *one]), np.concatenate([z, *two]), np.concatenate([np.zeros(0, np.int64), *counts])


def _send_names(buckets: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        h, _, counts = _words(table)
        found = []
        for lo, part in _pieces(counts, window):
            _, _, names, place = window_names(h[lo : lo + part.sum()], part, window)
            head = np.ones(len(names), bool)
            head[1:] = place[1:] != place[:-1]
            found.append(names[head] >> _U(64 - NAME_BITS))
        names, places = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return X.messages([(k, block, X.deltas(names[a:b]), np.packbits(places[a:b] > 1).tobytes()) for k, a, b in X.ranges(names, NAME_BITS, buckets)])

    return run


def _share_names(table: pa.Table) -> pa.Table:
    """For each block the mask of its names that another block, or the block itself, holds again."""
    sent = [X.sums(x.as_py()) for x in table.column("a")]
    twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(s)).astype(np.int64) for x, s in zip(table.column("b"), sent, strict=True)]
    names = np.concatenate(sent)
    order = np.argsort(names)
    ordered = names[order]
    head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    many = np.add.reduceat(1 + np.concatenate(twice)[order], head) > 1
    mask = np.empty(len(names), bool)
    mask[order] = np.repeat(many, np.diff(np.append(head, len(names))))
    out, at = [], 0
    for bucket, block, s in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), sent, strict=True):
        out.append((bucket, block, np.packbits(mask[at : at + len(s)]).tobytes(), b""))
        at += len(s)
    return X.messages(out)


def _send_windows(buckets: int, window: int, id_column: str):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows or not replies.num_rows:
            return X.messages([])
        block, docs = docs.column("block")[0].as_py(), _block(docs, id_column)
        h, h2, counts = _words(docs, second=True)
        name, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, part in _pieces(counts, window):
            _, at, found, _ = window_names(h[lo : lo + part.sum()], part, window)
            name.append(found >> _U(64 - NAME_BITS))
            start.append(at + lo)
        name, start = np.concatenate(name), np.concatenate(start)
        names = np.unique(name)
        shared = np.zeros(len(names), bool)
        masks = dict(zip(replies.column("bucket").to_pylist(), replies.column("a").to_pylist(), strict=True))
        for bucket, a, b in X.ranges(names, NAME_BITS, buckets):
            shared[a:b] = np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=b - a)
        names = names[shared]
        if not len(names):
            return X.messages([])
        place = start[names[np.minimum(np.searchsorted(names, name), len(names) - 1)] == name]
        del name, start
        first = R.first_of(counts)
        text = np.searchsorted(first, place, "right") - 1
        one, two = R.window_hash(h, place, window), R.window_hash(h2, place, window, R.SEED)
        ids, within = docs.column(id_column).to_numpy()[text], place - first[text]
        order = np.lexsort((within, ids, two, one))
        one, two, ids, within, place = one[order], two[order], ids[order], within[order], place[order]
        head = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        again = (ids != ids[lead]) | (within != within[lead])  # the same place twice is not earlier
        out = [(buckets, block, np.sort(place[again]).astype(np.uint32).tobytes(), b"")]
        keep = ~again  # the first place, and rows that repeat it
        one, two, ids, within, place = one[keep], two[keep], ids[keep], within[keep], place[keep]
        for k, a, b in X.ranges(one >> _U(64 - NAME_BITS), NAME_BITS, buckets):
            out.append((k, block, X.deltas(one[a:b]), X.pack(two[a:b], ids[a:b], within[a:b], place[a:b])))
        return X.messages(out)

    return run


def _earliest(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        """For each block the places whose window starts earlier too: in a smaller document, or further ahead in the same."""
        if table.column("bucket")[0].as_py() == buckets:  # known within the block already
            return table
        one = [X.sums(x.as_py()) for x in table.column("a")]
        two, ids, within, place = (np.concatenate(c) for c in zip(*(X.unpack(x, 4) for x in table.column("b").to_pylist()), strict=True))
        ids = ids.view(np.int64)
        owner = np.repeat(np.arange(len(one)), [len(x) for x in one])
        one = np.concatenate(one)
        order = np.lexsort((within, ids, two, one))
        one, two, ids, within = one[order], two[order], ids[order], within[order]
        head = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = order[(ids != ids[lead]) | (within != within[lead])]
        blocks = table.column("block").to_pylist()
        return X.messages([(0, blocks[k], np.sort(places).astype(np.uint32).tobytes(), b"") for k, places in R.by_bucket(owner[later], place[later])])

    return run


def _cut(window: int, id_column: str, schema: pa.Schema):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = _block(docs, id_column)
        removed = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in replies.column("a").to_pylist())]).astype(np.int64)
        base, out = 0, {"n_words": [], "n_removed": [], "kept": []}
        for part in R.chunks(docs):
            data, off = R.buffers(part.column("text"))
            s, e, n = R.words(data, off)
            mine = removed[(removed >= base) & (removed < base + len(s))] - base
            edge = np.zeros(len(s) + window + 1, np.int64)
            np.add.at(edge, mine, 1)
            np.add.at(edge, mine + window, -1)
            gone = np.cumsum(edge)[: len(s)] > 0
            base += len(s)
            first = R.first_of(n)
            lost = R.first_of(gone.astype(np.int64))
            n_removed = lost[first[1:]] - lost[first[:-1]]
            raw = data.tobytes()
            for i in range(len(n)):
                text = raw[off[i] : off[i + 1]]
                if n_removed[i]:
                    text = b" ".join([w for w, g in zip(text.split(), gone[first[i] : first[i + 1]].tolist(), strict=True) if not g])
                else:
                    text = b" ".join(text.split())
                out["kept"].append(text.decode())
            out["n_words"].append(n)
            out["n_removed"].append(n_removed)
        z = np.zeros(0, np.int64)
        return pa.Table.from_arrays([docs.column(id_column).cast(schema.field(0).type), pa.array(np.concatenate([z, *out["n_words"]])), pa.array(np.concatenate([z, *out["n_removed"]])), pa.array(out["kept"], pa.string())], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text): words of windows that start earlier too are removed, judged on the input."""
    docs = docs.select(F.col(id_column).cast("long").alias(id_column), F.col("text").cast("string").alias("text")).filter(F.col(id_column).isNotNull())
    blocks, buckets = layout(docs)
    held = docs.withColumn("block", block_of(blocks, id_column, "text"))
    names = held.groupBy("block").applyInArrow(_send_names(buckets, window), X.MESSAGE)
    shared = names.groupBy("bucket").applyInArrow(_share_names, X.MESSAGE)
    windows = held.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_windows(buckets, window, id_column), X.MESSAGE)
    # what is known within a block goes back as it is, dealt by block
    dealt = windows.withColumn("deal", F.when(F.col("bucket") == buckets, F.col("block") + buckets).otherwise(F.col("bucket")))
    later = dealt.groupBy("deal").applyInArrow(lambda t: _earliest(buckets)(t.drop_columns(["deal"])), X.MESSAGE)
    schema = pa.schema([(id_column, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    return held.groupBy("block").cogroup(later.groupBy("block")).applyInArrow(_cut(window, id_column, schema), f"`{id_column}` bigint, n_words bigint, n_removed bigint, kept_text string")
