"""Each stage of the corpus pipeline against a plain version, over the driver's smallest tables."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from cloakwork.llm import quality_rules, secret_scan
from test_corpus_operators import plain_components

SF = "/root/testdata/sf0.001"


def words_at(text):
    """(word, start, end) of normalised words."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_cut(text, windows):
    """The text without hit words, or None where most words are hit."""
    w = words_at(text)
    hit = [False] * len(w)
    for n, grams in windows.items():
        for i in range(len(w) - n + 1):
            if tuple(x for x, _, _ in w[i : i + n]) in grams:
                hit[i : i + n] = [True] * n
    if sum(hit) > 0.5 * len(w):
        return None
    out, at, i = [], 0, 0
    while i < len(w):
        j = i
        while j < len(w) and hit[j]:
            j += 1
        if j > i:
            out.append(text[at : w[i][1]])
            at = w[j - 1][2]
        i = max(j, i + 1)
    return "".join([*out, text[at:]]) if out else text


def plain_redact(text):
    out, at = [], 0
    for _, s, e in secret_scan.scan(text or ""):
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, rows = [], docs
    for name, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.written(stage(spark, rows, SF), f"test-{name}")
        steps.append({r.doc_id: r.text for r in rows.collect()})
        if name != "mixing":
            assert rows.columns == docs.columns
    good, single, clean, safe, mixed = steps
    assert set(good) == {r.doc_id for r in quality_rules.score_quality(docs).filter("kept").collect()}

    ids = sorted(good)
    assert set(single) == {ids[i] for i, (_, c) in enumerate(plain_components([good[k] for k in ids])) if c == i}

    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [x for x, _, _ in words_at(r.text)]
        n = min(10, len(w))
        if n:
            windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    cut = {k: plain_cut(t, windows) for k, t in single.items()}
    assert clean == {k: t for k, t in cut.items() if t is not None}
    assert clean != single

    assert safe == {k: plain_redact(t) for k, t in clean.items()}
    assert set(mixed) <= set(safe) and len(mixed) > 0.8 * len(safe)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = [k for k in safe if k not in mixed and k in labels and labels[k].toxic == 0 and labels[k].quality == 1]
    assert len(lost) <= 0.02 * len(safe)

    again = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in again} == mixed
    assert len(again) == sum(r.copies for r in {r.doc_id: r for r in again}.values())


def test_odd_rows_pass_all_stages(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns and empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in quality_rules.keep_good(docs).select("text", F.length("text").alias("n")).orderBy(F.desc("n")).limit(3).collect()]
    long = " ".join(f"word{i} of the {i * 7919 % 10007}" for i in range(120_000))
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (3, good[1]), (3, good[2]), (None, good[1]), (None, None), (4, None), (5, ""), (6, " \n"), (7, long), (8, long)]
    names = ("n_words", "kept", "component_id", "doc", "n", "block", "rate", "copies", "p_good", "n_tokens", "spans", "label")
    odd = spark.createDataFrame([(i, t, None, "s", len(t or ""), *(["clash"] * len(names))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for n, table in (("documents", odd), ("labels", spark.createDataFrame([(1, 1, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(None, "of the"), (1, None), (2, "")], "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{n}.parquet")
    held = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        held = corpus_pipeline.written(stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet") if name == "quality_rules" else held, str(tmp_path)), f"odd-{name}")
        ids = sorted((r.doc_id or 0) for r in held.collect())
        if name == "quality_rules":
            assert ids == [0, 1, 1, 2, 3, 3, 7, 8] and held.columns == odd.columns
        if name == "ngram_join":  # 2 copies 1, 8 copies 7; repeated rows of 1 are one, texts of 3 stay, rows without an id stay
            assert ids == [0, 1, 3, 3, 7]
    assert set(ids) == {0, 1, 3, 7}
    empty = tmp_path / "none"
    for n in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{n}.parquet").limit(0).write.parquet(f"{empty}/{n}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
