"""Mixing to target weights by soft memberships, with DataFrame functions only.

A labelled table names some documents' domains (toxic, low, good). A Bernoulli
naive Bayes classifier over the features that tell a domain gives every document a
posterior over the domains. Nonnegative document rates r are then fitted by projected gradient
least squares, from r = 1, so that the expected tokens of each domain, sum over d of r_d n_d p_dk, match the
targets times a budget of tokens. The gradient is taken in the metric of the domains' Gram matrix over the
documents that are free to move, so that a step meets the targets unless rates meet their bounds; a step
that does not bring the totals nearer is halved, and the steps go on until the totals are met or cannot come nearer.
A step needs only sums over documents of one posterior, which are added up once; a document's rate is the
fold of all steps, so no state is kept between them.

Domains with target 0 have no total to match: a document that is more likely than not of such a domain has the rate 0,
and others at most their odds of not being of it. The budget is the tokens there are, or more where the first
domain alone would have to give some up: the mix never drops what it asks most of. A rate becomes a number of
copies by a draw that depends on id and text alone, up or down in proportion, so that the tokens taken match too.

The default targets ask for clean text with a small share of the low domain left in, so that its
register is known to a model, and for nothing toxic.

The classifier is fitted on at most MAX_LABELLED labelled rows, the smallest by a
hash of the id. Its features are all that pass a test of significance. Everything else covers all rows.

Nulls and odd input: a null or empty text has no words and no tokens; labels that are
null, or whose id is null or unknown, are not used; repeated labels count as often; without labels
every document is good; rows with a null id are scored as they stand; repeated rows are documents
of their own with one draw; a very long text is a row of words like any other; empty tables give an empty result;
other columns are kept, but those named like a result are replaced.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import dropped, written

DOMAINS = ("good", "low", "toxic")
#: Shares of the expected tokens that are aimed at.
TARGETS = {"good": 0.98, "low": 0.02, "toxic": 0.0}
MAX_LABELLED = 20_000
#: Labelled documents that must hold a word, and its least z-score for some domain.
MIN_DOCUMENTS = 8
MIN_Z = 4.0
#: How many times likelier a word must be in some domain than outside: words of a language differ by less.
MIN_RATIO = 8.0
#: Part of the budget that each domain's tokens may be off; steps after which a fit that goes on is reported.
TOLERANCE, MANY_STEPS = 1e-6, 200
SEED = 20


def words_of(text: Column) -> Column:
    """A text's distinct features: its words, and the shapes of its tokens (letters as w, capitals as W, marks as they are)."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    shapes = F.split(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}{2,}", "\u2191"), r"[\p{L}\p{N}]+", "w"), r"[\x20\x09-\x0D]+")
    shapes = F.transform(F.array_distinct(shapes), lambda x: F.concat(F.lit("shape "), x))
    return F.filter(F.concat(F.array_distinct(words), shapes), lambda w: w != "")


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic before low before good; rows without a full label are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select(F.col("doc_id"), domain.alias("domain")).filter("doc_id is not null and domain is not null")


def fit_classifier(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """(log prior with all features absent, per feature the log odds it adds), each by domain."""
    chosen = domain_of(labels).orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(MAX_LABELLED)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most MAX_LABELLED rows
    known = written(known.select("domain", words_of(F.col("text")).alias("words")), "labelled")
    sizes = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return {d: (0.0 if d == "good" else -50.0) for d in DOMAINS}, {}
    counted = known.select("domain", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS])
    counted = counted.filter(F.col("n") >= MIN_DOCUMENTS)
    held = {d: n for d, n in sizes.items() if 0 < n < total}
    if not held:
        return {d: (math.log((sizes.get(d, 0) + 0.5) / (total + 0.5 * len(DOMAINS)))) for d in DOMAINS}, {}

    def score(d: str) -> Column:
        """The z-score of a word that the domain has MIN_RATIO times as often as the rest."""
        share = held[d] / total
        inside, outside = (F.col(d) + 0.5) / (held[d] + 1), (F.col("n") - F.col(d) + 0.5) / (total - held[d] + 1)
        return F.when(inside >= MIN_RATIO * outside, (F.col(d) - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))).otherwise(0.0)

    z = F.greatest(F.lit(0.0), *map(score, held))
    best = counted.withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").collect()  # of at most MAX_LABELLED rows
    dropped(known)
    absent, odds = {}, {r["word"]: {} for r in best}
    for d in DOMAINS:
        n = sizes.get(d, 0)
        absent[d] = math.log((n + 0.5) / (total + 0.5 * len(DOMAINS)))
        for r in best:
            p = (r[d] + 0.5) / (n + 1)
            absent[d] += math.log(1 - p)
            odds[r["word"]][d] = math.log(p / (1 - p))
    return absent, odds


def _bucket(word: Column, size: int) -> Column:
    return (F.pmod(F.xxhash64(word), F.lit(size)) + 1).cast("int")


def _gains(words: Column, docs: DataFrame, odds: dict[str, dict[str, float]]) -> Column:
    """The log odds of each word that is a feature: found in a table of hash buckets, so more features cost no more a word."""
    size = 1 << max(4, (2 * len(odds)).bit_length())
    names = F.from_json(F.lit(json.dumps(list(odds))), "array<string>")
    places = docs.sparkSession.range(1).select(F.transform(names, lambda w: _bucket(w, size))).first()[0]
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for w, b in zip(odds, places, strict=True):
        buckets[b - 1].append({"word": w, **{d: float(odds[w][d]) for d in DOMAINS}})
    table = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<word:string,{','.join(f'{d}:double' for d in DOMAINS)}>>>")
    used = F.from_json(F.lit(json.dumps([bool(b) for b in buckets])), "array<boolean>")
    likely = F.filter(words, lambda w: F.element_at(used, _bucket(w, size)))
    return F.flatten(F.transform(likely, lambda w: F.filter(F.element_at(table, _bucket(w, size)), lambda e: e["word"] == w)))


def posteriors(docs: DataFrame, model: tuple[dict[str, float], dict[str, dict[str, float]]]) -> DataFrame:
    """docs with n_tokens and a posterior column p_<domain> each."""
    absent, odds = model
    total = F.struct(*[F.lit(float(absent[d])).alias(d) for d in DOMAINS])
    if odds:
        total = F.aggregate(_gains(words_of(F.col("text")), docs, odds), total, lambda acc, g: F.struct(*[(acc[d] + g[d]).alias(d) for d in DOMAINS]))
    out = docs.withColumn("n_tokens", token_count(F.col("text"))).withColumn("__log", total)
    top = F.greatest(*[F.col(f"__log.{d}") for d in DOMAINS])
    norm = sum((F.exp(F.col(f"__log.{d}") - top) for d in DOMAINS), F.lit(0.0))
    return out.select(*docs.columns, "n_tokens", *[(F.exp(F.col(f"__log.{d}") - top) / norm).alias(f"p_{d}") for d in DOMAINS])


def _cap(targets: dict[str, float]) -> Column:
    """The most that a document's rate may be; null: any."""
    caps = [F.when(F.col(f"p_{d}") > 0.5, 0.0).when(F.col(f"p_{d}") > 0, (1 - F.col(f"p_{d}")) / F.col(f"p_{d}")) for d in DOMAINS if not targets[d]]
    return F.least(*caps, F.lit(None).cast("double")) if caps else F.lit(None).cast("double")


def _along(p: list[Column], step) -> Column:
    return sum((p[k] * F.lit(float(step[k])) for k in range(1, len(p))), p[0] * F.lit(float(step[0])))


def rate_after(steps: list[list[float]], targets: dict[str, float]) -> Column:
    """A document's rate after the steps: r <- r - sum of p_k step_k, kept between 0 and its cap, from 1."""
    p, cap = [F.col(f"p_{d}") for d in DOMAINS], _cap(targets)
    start = F.least(F.lit(1.0), cap)
    if not steps:
        return start
    held = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])
    return F.aggregate(held, start, lambda r, s: F.least(F.greatest(F.lit(0.0), r - sum((p[k] * s[k] for k in range(1, len(p))), p[0] * s[0])), cap))


def fit_rates(scored: DataFrame, targets: dict[str, float]) -> tuple[list[list[float]], float, bool]:
    """(steps, budget, met): projected gradient least squares on the domains' expected token totals.

    Not met: no rates within their bounds come nearer to the targets.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    profile = written(scored.groupBy(*[f"p_{d}" for d in DOMAINS]).agg(F.sum("n_tokens").alias("n")).filter("n > 0"), "profile")
    aimed = np.array([targets[d] > 0 for d in DOMAINS])

    def totals(steps) -> np.ndarray:
        r = profile.withColumn("r", rate_after(steps, targets)).agg(*[F.sum(F.col("n") * F.col("r") * x) for x in p]).first()
        return np.array([x or 0.0 for x in r])

    try:
        return _fit(profile, p, aimed, totals, targets)
    finally:
        dropped(profile)


def _fit(profile: DataFrame, p: list[Column], aimed: np.ndarray, totals, targets: dict[str, float]) -> tuple[list[list[float]], float, bool]:
    size = profile.agg(F.sum("n"), *[F.sum(F.col("n") * x) for x in p]).first()
    if not size[0]:
        return [], 0.0, True
    first = next((k for k, d in enumerate(DOMAINS) if targets[d]), None)
    budget = float(size[0]) if first is None else max(float(size[0]), size[1 + first] / targets[DOMAINS[first]])
    want = np.array([targets[d] for d in DOMAINS]) * budget
    steps: list[list[float]] = []
    off = np.where(aimed, totals(steps) - want, 0.0)
    while np.abs(off).max() > TOLERANCE * budget:
        if len(steps) >= MANY_STEPS:
            warnings.warn(f"mixing: {off.max() / budget:.2g} of the budget off its targets after {len(steps)} steps", stacklevel=2)
            return steps, budget, False
        slope, cap = _along(p, off), _cap(targets)
        moved = profile.withColumn("r", rate_after(steps, targets))
        # free: not at a bound that the gradient leads beyond
        free = moved.filter(((F.col("r") > 0) | (slope < 0)) & (F.coalesce(F.col("r") < cap, F.lit(True)) | (slope > 0)))
        pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p)) if aimed[i] and aimed[j]]
        held = free.agg(*[F.sum(F.col("n") * p[i] * p[j]) for i, j in pairs]).first()
        gram = np.zeros((len(p), len(p)))
        for (i, j), x in zip(pairs, held, strict=True):
            gram[i, j] = gram[j, i] = x or 0.0
        highest = np.linalg.eigvalsh(gram)[-1]
        if highest <= 0:
            return steps, budget, False
        # the metric's own step, halved while it leads away; then plain gradient steps by the Lipschitz bound
        ways = [np.linalg.pinv(gram, rcond=1e-9) @ off * 0.5**k for k in range(6)] + [off / highest]
        for way in ways:
            tried = [*steps, way.tolist()]
            new = np.where(aimed, totals(tried) - want, 0.0)
            if new @ new < off @ off * (1 - 1e-9):
                steps, off = tried, new
                break
        else:
            return steps, budget, False
    return steps, budget, True


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs, or their columns `carry`, with n_tokens, posteriors, `rate` and `copies`: how often a document is taken."""
    targets = TARGETS if targets is None else targets
    names = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies"]
    docs = docs.drop(*[c for c in docs.columns if c in names])
    model = fit_classifier(docs, labels)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    scored = posteriors(docs.withColumn("__draw", draw), model)
    if carry is not None:
        scored = scored.select(*carry, "__draw", *names[:-2])
    scored = written(scored, "memberships")
    steps, _, _ = fit_rates(scored, targets)
    rated = scored.withColumn("rate", rate_after(steps, targets))
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col("__draw")).cast("long")).drop("__draw")


def taken(mixed: DataFrame) -> DataFrame:
    """Each document of mix() as many times as it has copies, numbered from 1 by `copy`."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
