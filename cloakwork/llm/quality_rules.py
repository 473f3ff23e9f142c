"""Quality rules by distribution divergence.

A document's character classes and common words are two histograms. Each is
compared with references, one per language, by Jensen-Shannon distance; a text
far from all of them is junk. References are the summed histograms of every
document of the language, so they follow the corpus. A document whose own language has no
reference is not judged by those of others: only the base rule speaks on it. Texts too short for a
steady histogram are not judged by it (minimum-length guards).

Nulls and odd input: a null or empty text has no words and fails the base rule;
a null language takes part in no reference and has none, a table without
languages is compared with all of them;
repeated rows and repeated ids are judged row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged as R

# Character classes by byte, and common words of the languages.
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
COMMON = {
    "en": "the of and to in is it that on for with as was at by be this from are or an a he his not but have",
    "fr": "de la le et les des en un une du que qui dans au est par pour pas sur ne se ce il avec plus son",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er hat aus bei",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le",
}

#: Distances over these are junk; below these many words (or characters) a histogram is not judged.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.36
MIN_CLASS_CHARS = 400
MIN_WORDS = 60
#: A language with fewer words has no reference of its own.
MIN_REFERENCE_WORDS = 2000

LOWER, UPPER, DIGIT, SPACE, NEWLINE, PUNCT, SYMBOL, OTHER_ASCII, WIDE, SKIP = range(10)
N_CLASSES = 9


def _class_table() -> np.ndarray:
    t = np.full(256, OTHER_ASCII, np.uint8)
    t[ord("a") : ord("z") + 1] = LOWER
    t[ord("A") : ord("Z") + 1] = UPPER
    t[ord("0") : ord("9") + 1] = DIGIT
    t[[0x20, 9, 11, 12, 13]] = SPACE
    t[10] = NEWLINE
    t[list(PUNCTUATION)] = PUNCT
    t[list(SYMBOLS)] = SYMBOL
    t[0x80:0xC0] = SKIP  # continuation bytes: a character counts once
    t[0xC0:] = WIDE
    return t


CLASS = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_NOT_NEWLINE = np.arange(256) != 10
_IN_WORD_FORM = ((np.arange(256) >= 0x80) | (CLASS == LOWER) | (CLASS == UPPER) | (CLASS == DIGIT))


def vocabulary() -> list[str]:
    """The common words of all languages, once each, in order."""
    return list(dict.fromkeys(w for words in COMMON.values() for w in words.split()))


def _word_slots() -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the vocabulary, slot of each)."""
    joined = "\n".join(vocabulary()).encode()
    data = np.frombuffer(joined, np.uint8)
    s, e, _ = R.words(data, np.array([0, len(data)]), _NOT_NEWLINE)
    h = R.span_hash(data, s, e)
    order = np.argsort(h)
    return h[order], order


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def groups(counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group start flags, size of the group at each place) of equal hashes within each text of `counts` items."""
    order = R.order_within(h, counts)
    text = np.repeat(np.arange(len(counts)), counts)
    key = h[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    return order, new, np.repeat(size, size)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text, by vector operations over the whole chunk."""
    texts = len(offsets) - 1
    starts, ends, n_words = R.words(data, offsets)
    inside = R.NOT_SPACE[data] if len(data) else np.zeros(0, bool)
    h = R.span_hash(data, starts, ends)
    out = {"n_words": n_words, "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(_IS_SYMBOL[data], offsets)}

    l_start, l_end, n_lines = R.words(data, offsets, _NOT_NEWLINE)
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_text = np.repeat(np.arange(texts), n_lines)[has]
    order, new, _ = groups(np.bincount(l_text, minlength=texts), R.span_hash(data, l_start, l_end)[has])
    out["n_dup_lines"] = np.bincount(l_text[order[~new]], minlength=texts)

    _, w_start = R.window_starts(n_words, 5)
    order, _, size = groups(np.maximum(n_words - 4, 0), R.window_hash(h, w_start, 5))
    cover = np.zeros(len(starts) + 1, np.int64)
    again = w_start[order[size > 1]]
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    out["n_repeat_words"] = per_text(np.cumsum(cover)[:-1] > 0, R.first_of(n_words))

    classes = CLASS[data]
    text_of = np.repeat(np.arange(texts), np.diff(offsets))
    out["classes"] = np.bincount(text_of * 10 + classes, minlength=texts * 10).reshape(texts, 10)[:, :N_CLASSES]
    slots, slot = _word_slots()
    low = R.lower_ascii(data)
    f_start, f_end, n_forms = R.words(low, offsets, _IN_WORD_FORM)
    fh = R.span_hash(low, f_start, f_end)
    at = np.minimum(np.searchsorted(slots, fh), len(slots) - 1)
    known = slots[at] == fh
    f_text = np.repeat(np.arange(texts), n_forms)
    hist = np.bincount(f_text[known] * len(slots) + slot[at[known]], minlength=texts * len(slots)).reshape(texts, len(slots))
    out["n_forms"] = n_forms
    out["common"] = np.column_stack([hist, n_forms - hist.sum(1)])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of counts p to the reference counts q."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2

    def kl(a, b):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / b), 0).sum(1)

    return np.sqrt(np.clip((kl(p, m) + kl(np.broadcast_to(q, p.shape), m)) / 2, 0, 1))


def language_references(docs: DataFrame) -> list[tuple[str, list[int], list[int]]]:
    """(lang, class counts, common word counts) over all documents: one row a language reaches the driver.

    Languages are a closed set; a column with other values would add a row each,
    so those below MIN_REFERENCE_WORDS are dropped before they are collected.
    """
    width = len(vocabulary()) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in R.chunks(batch):
                m = measure_histograms(*R.buffers(part.column("text")))
                langs = np.array([x if x is not None else "" for x in part.column("lang").to_pylist()], object)
                for lang in set(langs) - {""}:
                    rows = np.flatnonzero(langs == lang)
                    sums[lang] = sums.get(lang, 0) + m[rows].sum(0)
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "counts": [v.tolist() for v in sums.values()]}, schema=pa.schema([("lang", pa.string()), ("counts", pa.list_(pa.int64()))]))

    size = N_CLASSES + width
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(partial, "lang string, counts array<bigint>")
    summed = rows.groupBy("lang").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(size)])
    words = sum((F.col(f"c{i}") for i in range(N_CLASSES, size)), F.lit(0))
    got = summed.filter(words >= MIN_REFERENCE_WORDS).orderBy("lang").collect()
    return [(r["lang"], [r[f"c{i}"] for i in range(N_CLASSES)], [r[f"c{i}"] for i in range(N_CLASSES, size)]) for r in got]


def measure_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class and common word counts only, side by side."""
    texts = len(offsets) - 1
    text_of = np.repeat(np.arange(texts), np.diff(offsets))
    classes = np.bincount(text_of * 10 + CLASS[data], minlength=texts * 10).reshape(texts, 10)[:, :N_CLASSES]
    slots, slot = _word_slots()
    low = R.lower_ascii(data)
    s, e, n = R.words(low, offsets, _IN_WORD_FORM)
    h = R.span_hash(low, s, e)
    at = np.minimum(np.searchsorted(slots, h), len(slots) - 1)
    known = slots[at] == h
    hist = np.bincount(np.repeat(np.arange(texts), n)[known] * len(slots) + slot[at[known]], minlength=texts * len(slots)).reshape(texts, len(slots))
    return np.column_stack([classes, hist, n - hist.sum(1)])


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, class_distance double, word_distance double, base_failed boolean, kept boolean"


def judge(m: dict[str, np.ndarray], references, langs=None) -> dict[str, np.ndarray]:
    """The base rule and the divergence verdict for measured texts; with langs, only for those whose language has a reference."""
    base_failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    n = len(base_failed)
    near_c, near_w = np.zeros(n), np.zeros(n)
    if references and n:
        c = np.stack([js_distance(m["classes"], np.array(r[1], float)) for r in references])
        w = np.stack([js_distance(m["common"], np.array(r[2], float)) for r in references])
        best = np.argmin(c + w, 0)
        near_c, near_w = c[best, np.arange(n)], w[best, np.arange(n)]
    junk = (near_c > MAX_CLASS_DISTANCE) & (m["classes"].sum(1) >= MIN_CLASS_CHARS)
    junk |= (near_w > MAX_WORD_DISTANCE) & (m["n_forms"] >= MIN_WORDS)
    if langs is not None:
        known = {r[0] for r in references}
        junk &= np.array([x in known for x in langs], bool)
    return {"class_distance": near_c, "word_distance": near_w, "base_failed": base_failed, "kept": ~base_failed & ~junk}


def score_quality(docs: DataFrame, id_column: str = "doc_id", references=None, keep_columns: bool = False) -> DataFrame:
    """Each row's counts, distances and verdict; with keep_columns, all columns of docs stay beside them.

    references: of language_references(); by default those of docs itself.
    """
    references = language_references(docs) if references is None else references
    names = SCHEMA.replace(" bigint", "").replace(" double", "").replace(" boolean", "").split(", ")
    source = docs if keep_columns else docs.select(id_column, F.col("text").cast("string").alias("text"), *[F.col(c) for c in docs.columns if c == "lang" != id_column])
    source = source.drop(*names)
    kept_fields = [f for f in source.schema.fields if keep_columns or f.name == id_column]
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([*kept_fields, *_parse_datatype_string(SCHEMA).fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in R.chunks(batch):
                m = measure(*R.buffers(part.column("text")))
                langs = part.column("lang").cast(pa.string()).to_pylist() if "lang" in part.schema.names else None
                got = m | judge(m, references, langs)
                arrays = [part.column(f.name) for f in kept_fields] + [pa.array(got[k]) for k in names]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept_fields] + names)

    return source.mapInArrow(score, schema)


def keep_good(docs: DataFrame, references=None) -> DataFrame:
    """The documents that pass, with their own columns."""
    return score_quality(docs, keep_columns=True, references=references).filter("kept").select(docs.columns)
