"""N-gram Jaccard join with several global token orders.

Tokens are a document's distinct 5-word shingles, as 64-bit hashes. Two sets reach a Jaccard
similarity of t only if, under any one order of all tokens, they share a token
among the first n - ceil(t n) + 1 of each. Candidates must pass that under
several orders before they are verified:

* order 1, rare tokens first, is an inverted index over the prefixes: tokens of a
  single document are never indexed, and frequent passages come last, out of the
  prefix. What remains of both sets after the shared token bounds the
  overlap, which drops most pairs of a passage's users;
* orders 2 and 3 (rare first, then by other hashes) must have a common prefix token too: a
  join with these prefixes alone, before any whole set is sent;
* the rest are verified on the whole sets of 64-bit hashes.

Sets that are equal by size and by 128 bits of their shingles' bytes are one class with one
representative, so copies are never paired.
Links are needed only between components: each round, a document proposes the
smallest component that shares a prefix token with it, links are verified and the graph of
components is contracted. Only documents that are still apart after the last round are
all tested: on a shared token, those pairs whose sizes and places let the overlap suffice, which meet
by size class, so the many users of a form letter that no two share enough of are not paired.
Pairs inside a component are never listed, and no group is held in a task.

Nulls and odd input: a null or empty text has no shingles and no links; rows with
a null id are left out; rows that repeat an id are texts of one document, each
with its own count, and linked where any of them is; a very long text is a set of all its shingles,
which one task holds; an empty table gives an empty result; other columns are ignored. `keep_one` keeps
rows without an id, drops a document if any of its texts is linked with a smaller id, and keeps one of
the rows that repeat both id and text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import ragged as R
from .cluster import block_of, dropped, layout, written

WORDS = 5
#: Similarity as a fraction, 75 / 100.
NUMERATOR, DENOMINATOR = 3, 4
#: Bits of a shingle that document frequencies are counted by; all orders stay valid whatever this is.
COUNT_BITS, ID_BITS = 44, 64
#: Pairs up to this number are broadcast to the sets, 16 bytes each.
BROADCAST_PAIRS = 500_000
#: Ids up to this number are broadcast to the documents that lose them, 16 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Parts that the copies of one text are dealt to.
SALTS = 16
#: Size classes of a doubling; smaller sizes than this are a class each.
CLASSES = 16
_U = np.uint64


def shingle_ids(column, n: int = WORDS, both: bool = False) -> tuple[np.ndarray, ...]:
    """(ids sorted within each text, text of each, distinct ids of each text[, second hashes]); a shorter text is one shingle."""
    data, off = R.buffers(column)
    data = R.lower_ascii(data)
    s, e, counts = R.words(data, off)
    text, start = R.window_starts(counts, n)
    first, many = R.first_of(counts), np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = []
    for seed in (R.SEED, R.SEED2)[: 1 + both]:
        h = R.span_hash(data, s, e, seed)
        ids = np.empty(many.sum(), np.uint64)
        at = R.first_of(many)[:-1]
        ids[(counts >= n)[np.repeat(np.arange(len(counts)), many)]] = R.window_hash(h, start, n, seed)
        for k in range(1, n):
            short = np.flatnonzero(counts == k)
            ids[at[short]] = R.window_hash(h, first[short], k, seed)
        out.append(ids)
    order = R.order_within(out[0], many)
    owner = np.repeat(np.arange(len(counts)), many)
    ids = out[0][order]
    new = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])) if len(ids) else np.zeros(0, bool)
    owner = owner[new]
    return (ids[new], owner, np.bincount(owner, minlength=len(counts)), *(x[order][new] for x in out[1:]))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """n - ceil(t n) + 1."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def signatures(docs: DataFrame) -> DataFrame:
    """(doc, block, n, f1, f2) of docs (doc, block, text): set size and a 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in R.chunks(batch):
                ids, owner, n, second = shingle_ids(part.column(2), both=True)
                sums = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
                for total, x, salt in zip(sums, (ids, second), (0x2545F4914F6CDD1D, 0x369DEA0F31A53F85), strict=True):
                    np.add.at(total, owner, R.mix(x + _U(salt)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), *(pa.array(x.view(np.int64)) for x in sums)], names=["doc", "block", "n", "f1", "f2"])

    return docs.select("doc", "block", "text").mapInArrow(run, "doc bigint, block int, n bigint, f1 bigint, f2 bigint")


MESSAGE = "bucket int, block int, doc bigint, a binary, b binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("doc", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def _messages(rows: list[tuple]) -> pa.Table:
    return X.messages(rows, _MESSAGE)


def _block_shingles(docs: pa.Table, representatives: np.ndarray):
    """(doc ids, shingle ids, owner, counts) of the block's representatives."""
    docs = docs.filter(pa.array(np.isin(docs.column("doc").to_numpy(), representatives)))
    parts, owners, counts, base = [], [], [], 0
    for part in R.chunks(docs):
        ids, owner, n = shingle_ids(part.column("text"))
        parts.append(ids)
        owners.append(owner + base)
        counts.append(n)
        base += len(n)
    z = np.zeros(0, np.int64)
    return docs.column("doc").to_numpy(), np.concatenate([z.astype(np.uint64), *parts]), np.concatenate([z, *owners]), np.concatenate([z, *counts])


def _send_keys(buckets: int):
    def run(docs: pa.Table, reps: pa.Table) -> pa.Table:
        """A block's distinct keys with their number in the block, by bucket."""
        if not reps.num_rows or not docs.num_rows:
            return _messages([])
        _, ids, _, _ = _block_shingles(docs, reps.column("doc").to_numpy())
        keys, df = np.unique(ids >> _U(ID_BITS - COUNT_BITS), return_counts=True)
        block = docs.column("block")[0].as_py()
        return _messages([(k, block, None, X.deltas(keys[a:b]), df[a:b].astype(np.uint32).tobytes()) for k, a, b in X.ranges(keys, COUNT_BITS, buckets)])

    return run


def _count_keys(table: pa.Table) -> pa.Table:
    """For each block the mask of its keys of two documents or more, and their document frequencies."""
    sent = [X.sums(x) for x in table.column("a").to_pylist()]
    local = [np.frombuffer(x, np.uint32) for x in table.column("b").to_pylist()]
    keys, counts = np.concatenate(sent), np.concatenate(local).astype(np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.add.reduceat(counts[order], head)
    df = np.empty(len(keys), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(head, len(keys))))
    out, at = [], 0
    for bucket, block, s in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), sent, strict=True):
        mine = df[at : at + len(s)]
        out.append((bucket, block, None, np.packbits(mine > 1).tobytes(), mine[mine > 1].tobytes()))
        at += len(s)
    return _messages(out)


CANDIDATE = "doc bigint, n bigint, ids binary, token array<bigint>, place array<int>, second array<bigint>, third array<bigint>"
_LIST = pa.list_(pa.int64())
_CANDIDATE = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("token", _LIST), ("place", pa.list_(pa.int32())), ("second", _LIST), ("third", _LIST)])
#: Salts of the hashes that orders 2 and 3 go by.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _candidates(buckets: int):
    def run(docs: pa.Table, info: pa.Table) -> pa.Table:
        """Documents with a shared token in the prefix: those tokens with their places, all shared tokens, and the other orders' prefixes."""
        reps = info.filter(pa.compute.is_valid(info.column("doc")))
        replies = info.filter(pa.compute.is_null(info.column("doc")))
        if not docs.num_rows or not reps.num_rows:
            return _CANDIDATE.empty_table()
        doc, ids, owner, n = _block_shingles(docs, reps.column("doc").to_numpy())
        keys, inverse = np.unique(ids >> _U(ID_BITS - COUNT_BITS), return_inverse=True)
        df = np.ones(len(keys), np.int64)
        got = {k: (a, b) for k, a, b in zip(replies.column("bucket").to_pylist(), replies.column("a").to_pylist(), replies.column("b").to_pylist(), strict=True)}
        for bucket, a, b in X.ranges(keys, COUNT_BITS, buckets):
            mask, values = got[bucket]
            df[a:b][np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a).astype(bool)] = np.frombuffer(values, np.int64)
        often = df[inverse]
        shared = np.flatnonzero(often > 1)
        ids, owner, often = ids[shared], owner[shared], often[shared]
        many = np.bincount(owner, minlength=len(n))
        order = np.lexsort((ids, often, owner))
        rank = np.arange(len(order)) - np.repeat(R.first_of(many)[:-1], many)
        place = (n - many)[owner] + rank
        index = place < prefix_size(n)[owner]  # tokens of one document alone come first in every order
        held = np.bincount(owner[index], minlength=len(n))
        first_id, first_index = R.first_of(many), R.first_of(held)
        token, where = ids[order][index].view(np.int64), place[index].astype(np.int32)
        others = [ids[R.order_within(R.mix(ids + _U(salt)), many)][index].view(np.int64) for salt in ORDERS]
        rows = np.flatnonzero(held)

        def lists(x, kind):
            return pa.array([x[first_index[i] : first_index[i + 1]] for i in rows], kind)

        ids = pa.array([ids[first_id[i] : first_id[i + 1]].tobytes() for i in rows], pa.binary())
        return pa.Table.from_arrays([pa.array(doc[rows]), pa.array(n[rows]), ids, lists(token, _LIST), lists(where, pa.list_(pa.int32())), *(lists(x, _LIST) for x in others)], schema=_CANDIDATE)

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nx, ny, ix, iy = (batch.column(i).to_pylist() for i in range(2, 6))
        keep = []
        for i in range(len(nx)):
            common = len(np.intersect1d(np.frombuffer(ix[i], np.uint64), np.frombuffer(iy[i], np.uint64), assume_unique=True))
            if DENOMINATOR * common >= NUMERATOR * (nx[i] + ny[i] - common):
                keep.append(i)
        yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))


def verified(pairs: DataFrame, sets: DataFrame, n_pairs: int) -> DataFrame:
    """The pairs (x, y) that pass the other orders and whose sets are similar enough."""

    def join(pairs: DataFrame, small: bool, *columns: str) -> DataFrame:
        hint = F.broadcast if small else (lambda df: df)
        left = sets.select(F.col("doc").alias("x"), *[F.col(c).alias(f"{c}x") for c in columns])
        right = sets.select(F.col("doc").alias("y"), *[F.col(c).alias(f"{c}y") for c in columns]).join(hint(pairs.select("y").distinct()), "y", "left_semi")
        return left.join(hint(pairs), "x").join(right, "y")

    small = n_pairs <= BROADCAST_PAIRS
    passed = join(pairs, small, "second", "third").filter(F.arrays_overlap("secondx", "secondy") & F.arrays_overlap("thirdx", "thirdy"))
    passed = written(passed.select("x", "y"), "passed")
    links = written(join(passed, small, "n", "ids").select("x", "y", "nx", "ny", "idsx", "idsy").mapInArrow(_verify, "x bigint, y bigint"), "links")
    dropped(passed)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of links (x, y) can reach, by min labels and pointer jumping."""
    both = written(links.select("x", "y").union(links.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        new = labels.select("node", "label").join(near, F.col("node") == F.col("x")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(new.join(jump, "label", "left").select("node", F.coalesce("far", "label").alias("label"), "old"), "labels")
        dropped(labels)
        labels = new
        if new.filter("old <> label").isEmpty():
            dropped(both)
            return labels


def _labelled(index: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return index.withColumn("label", F.col("doc"))
    return index.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))


def _overlap_can_reach(a: str, b: str):
    """7 * the tokens left in the shorter rest >= 3 * (sum of sizes): overlap >= t / (1 + t) of the sum."""
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}place"), F.col(f"{b}n") - F.col(f"{b}place"))
    return (NUMERATOR + DENOMINATOR) * rest >= NUMERATOR * (F.col(f"{a}n") + F.col(f"{b}n"))


def _size_class(n) -> Column:
    """Classes that grow with n: one a size below CLASSES, then CLASSES a doubling."""
    return F.when(n < CLASSES, n).otherwise(F.floor(CLASSES * (F.log2(n) - int(math.log2(CLASSES)) + 1))).cast("int")


def _apart(here: DataFrame) -> DataFrame:
    """Pairs (x, y) of different components that share a prefix token whose places let the overlap suffice.

    By its size and place, a document accepts partners of some sizes; two that accept each other meet under
    (token, larger size class, smaller size class).
    """
    mixed = here.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    n = F.col("n")
    least = F.ceil(n * NUMERATOR / DENOMINATOR)
    most = F.least(F.floor(n * DENOMINATOR / NUMERATOR), F.floor(((NUMERATOR + DENOMINATOR) * (n - F.col("place")) - NUMERATOR * n) / NUMERATOR))
    open_ = here.join(mixed, "token", "left_semi").withColumn("least", least).withColumn("most", most).filter("most >= least")
    own = _size_class(n)
    larger = open_.filter(F.col("least") <= n).withColumn("big", own).withColumn("small", F.explode(F.sequence(_size_class(F.col("least")), F.least(own, _size_class(F.col("most"))))))
    smaller = open_.withColumn("small", own).withColumn("big", F.explode(F.filter(F.sequence(own, F.greatest(own, _size_class(F.col("most")))), lambda k: k <= _size_class(F.col("most")))))
    keys = ("token", "big", "small")
    a = larger.select(*keys, *[F.col(c).alias(f"x{c}") for c in ("label", "doc", "n", "place")])
    b = smaller.select(*keys, *[F.col(c).alias(f"y{c}") for c in ("label", "doc", "n", "place")])
    met = a.join(b, list(keys)).filter((F.col("xlabel") != F.col("ylabel")) & _overlap_can_reach("x", "y"))
    return met.select(F.greatest("xdoc", "ydoc").alias("x"), F.least("xdoc", "ydoc").alias("y")).distinct()


def _contracted(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """labels (node, label) after the links new (x, y): only the graph of components is searched."""
    if labels is None:
        return components(new)
    for c in ("x", "y"):
        new = new.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    table = components(new.select(F.col("lx").alias("x"), F.col("ly").alias("y")).filter("x <> y"))
    merged = table.select("node", "label")
    known = labels.select("node", "label")
    single = merged.select("node").join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    told = merged.select(F.col("node").alias("label"), F.col("label").alias("far"))
    out = written(known.union(single).join(told, "label", "left").select("node", F.coalesce("far", "label").alias("label")), "labels")
    dropped(table)
    return out


def similar_components(sets: DataFrame) -> DataFrame:
    """(node, label): the smallest document that similar pairs connect with each node that has any."""
    flat = sets.select("doc", "n", F.explode(F.arrays_zip("token", "place")).alias("t")).select("doc", "n", F.col("t.token").alias("token"), F.col("t.place").alias("place"))
    often = flat.groupBy("token").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("token")
    index = written(flat.join(often, "token"), "index")
    none = index.select(F.col("doc").alias("x"), F.col("doc").alias("y")).limit(0)
    tested, labels, tables = none, None, []
    while True:
        here = _labelled(index, labels)
        least = here.groupBy("token").agg(F.min(F.struct("label", "doc", "n", "place")).alias("m"))
        met = here.join(least, "token").select("label", F.col("doc").alias("x"), F.col("n").alias("xn"), F.col("place").alias("xplace"), F.col("m.label").alias("ylabel"), F.col("m.doc").alias("y"), F.col("m.n").alias("yn"), F.col("m.place").alias("yplace"))
        met = met.filter((F.col("label") != F.col("ylabel")) & _overlap_can_reach("x", "y")).select("x", "y", "ylabel")
        if labels is not None:
            met = met.join(tested, ["x", "y"], "left_anti")
        pairs = written(met.groupBy("x").agg(F.min(F.struct("ylabel", "y")).alias("m")).select("x", F.col("m.y").alias("y")), "pairs")
        tables.append(pairs)
        n = pairs.count()
        if not n:
            break
        links = verified(pairs, sets, n)
        tested = tested.union(pairs)
        labels, last, found = (labels, None, False) if links.isEmpty() else (_contracted(labels, links), labels, True)
        dropped(links, last)
        if not found:
            break
    rest = written(_apart(_labelled(index, labels)).join(tested.union(tested.select("y", "x")), ["x", "y"], "left_anti"), "pairs")
    n = rest.count()
    if n:
        links = verified(rest, sets, n)
        labels, last = (labels, None) if links.isEmpty() else (_contracted(labels, links), labels)
        dropped(links, last)
    if labels is None:
        labels = written(none.select(F.col("x").alias("node"), F.col("y").alias("label")), "labels")
    dropped(*tables, rest, index)
    return labels.select("node", "label")


def candidate_sets(held: DataFrame, reps: DataFrame, buckets: int) -> DataFrame:
    """The documents of held (doc, block, text) among reps (block, doc) that may have a similar one, with their shared tokens."""
    keys = held.groupBy("block").cogroup(reps.groupBy("block")).applyInArrow(_send_keys(buckets), MESSAGE)
    replies = keys.groupBy("bucket").applyInArrow(_count_keys, MESSAGE)
    empty = F.lit(None).cast("binary")
    info = replies.union(reps.select(F.lit(0).alias("bucket"), "block", "doc", empty.alias("a"), empty.alias("b")))
    return held.groupBy("block").cogroup(info.groupBy("block")).applyInArrow(_candidates(buckets), CANDIDATE)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that links reach, the row's own where there is none."""
    source = docs.select(F.col(id_column).cast("long").alias("doc"), F.col("text").cast("string").alias("text")).filter("doc is not null")
    blocks, buckets = layout(source)
    held = source.select("doc", block_of(blocks, "doc", "text").alias("block"), "text")
    sizes = written(signatures(held), "signatures")
    classes = sizes.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc", "block")).alias("m"), F.count("*").alias("rows")).select("n", "f1", "f2", "rows", F.col("m.doc").alias("rep"), F.col("m.block").alias("block"))
    sets = written(candidate_sets(held, classes.select("block", F.col("rep").alias("doc")).distinct(), buckets), "sets")
    # an id that is linked by one of its texts is linked as a whole
    labels = similar_components(sets).withColumnRenamed("node", "rep")
    dropped(sets)
    # a class of many copies is dealt to SALTS tasks; classes of one row without links need no join
    known = classes.join(labels, "rep", "left").filter("rows > 1 OR label IS NOT NULL")
    known = known.select("n", "f1", "f2", F.coalesce("label", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = sizes.withColumn("salt", F.pmod(F.hash("doc"), F.lit(SALTS))).join(known, ["n", "f1", "f2", "salt"], "left")
    return members.select(F.col("doc").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """docs without those that are linked, over any path, with a smaller id."""
    found = written(near_duplicates(docs, id_column), "components")
    gone = found.filter(f"component_id <> `{id_column}`").select(id_column).distinct()
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, id_column, "left_anti").select(docs.columns)
    again = found.groupBy(id_column).count().filter("count > 1").select(id_column)
    if again.isEmpty():
        return kept
    once = kept.join(again, id_column, "left_semi").dropDuplicates([id_column, "text"])
    return kept.join(again, id_column, "left_anti").union(once.select(docs.columns))
