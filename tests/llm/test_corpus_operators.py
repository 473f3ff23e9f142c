"""Operators 1, 2, 5, 7, 9 and 10 against plain versions, with odd input."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import chat_format, exchange, html_extract, lm_score, mixing, ngram_join, ragged, substring_dedup
from cloakwork.llm.queries import HOSTILE

r = random.Random(11)
V = [f"w{i}" for i in range(40)] + ["été", "ß", "A", "a"]


def words(n, v=V):
    return [r.choice(v) for _ in range(n)]


def layout_of(d, per_block):
    """Blocks of so many rows, and a few buckets."""
    blocks = max(1, -(-d.count() // per_block))
    return blocks, max(3, blocks // 8)


def corpus():
    base = words(400)
    texts = [None, "", "  \n", "one two", " ".join(words(19)), " ".join(words(20))]
    texts += [" ".join(base[i : i + r.randrange(10, 120)]) for i in range(0, 300, 13)]
    texts += [" ".join(words(30) + base[50 : 50 + n] + words(30)) for n in (18, 19, 20, 21, 25, 60)]
    texts += ["x " * 100, "x " * 45 + "y", "a b " * 50, "a b " * 21 + "c " * 25, " ".join(base), "\t".join(base), " ".join(base).upper()]
    texts += [" ".join(words(300, ["p", "q"])) for _ in range(4)]
    return texts + texts[8:12]


def plain_dedup(texts, n=20):
    split = [(t or "").encode().split() for t in texts]
    seen, out = set(), []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone |= set(range(i, i + n))
            seen.add(k)
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("per_block", [4, 512])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, per_block):
    texts = corpus()
    monkeypatch.setattr(substring_dedup, "layout", lambda d: layout_of(d, per_block))
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "a", "x")], "doc_id long, text string, n_words string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.dedup_substrings(d).collect()}
    assert got == dict(enumerate(plain_dedup(texts)))


@pytest.mark.parametrize("piece", [25, 60, 200_000])
def test_pieces_give_the_same_windows(monkeypatch, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    counts = np.array([0, 5, 20, 19, 300, 0, 24, 26, 25, 61, 21, 45, 44, 4])
    h = ragged.mix(np.random.default_rng(1).integers(0, 9, counts.sum()).astype(np.uint64))
    _, start, name, _ = substring_dedup.window_names(h, counts)
    got = [(s + lo, n) for lo, part in substring_dedup._pieces(counts, 20) for _, s, n, _ in [substring_dedup.window_names(h[lo : lo + part.sum()], part)]]
    assert np.array_equal(np.concatenate([g[0] for g in got]), start) and np.array_equal(np.concatenate([g[1] for g in got]), name)


def test_substring_dedup_repeated_rows(spark):
    t = " ".join(f"u{i}" for i in range(30))
    d = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id long, text string")
    got = sorted((x.doc_id, x.n_removed) for x in substring_dedup.dedup_substrings(d).collect())
    assert got == [(1, 0), (1, 0), (2, 30)]
    later = spark.createDataFrame([(1, "a b " + t), (1, t)], "doc_id long, text string")
    assert sorted(x.n_removed for x in substring_dedup.dedup_substrings(later).collect()) == [0, 30]
    assert substring_dedup.dedup_substrings(d.limit(0)).count() == 0


def test_equal_windows_have_equal_names():
    texts = corpus()
    ids = {w: i for i, w in enumerate(V + ["x", "y", "p", "q"])}
    h = ragged.mix(np.array([ids[w] for t in texts for w in (t or "").split() if w in ids], np.uint64))
    counts = np.array([sum(w in ids for w in (t or "").split()) for t in texts])
    text, start, name, _ = substring_dedup.window_names(h, counts)
    by = {}
    for s, n in zip(start.tolist(), name.tolist(), strict=True):
        assert by.setdefault(h[s : s + 20].tobytes(), n) == n


NEAR_PERIODIC = [bytes(97 + (bin(i).count("1") + k) % 2 for i in range(2048)).decode() for k in (0, 1)]


def test_near_periodic_words_are_told_apart(spark):
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    same = " ".join(f"t{i}" for i in range(19))
    d = spark.createDataFrame([(i, f"{same} {w}") for i, w in enumerate(NEAR_PERIODIC)], "doc_id long, text string")
    assert {x.n_removed for x in substring_dedup.dedup_substrings(d).collect()} == {0}
    few = spark.createDataFrame([(i, f"a b c d {w}") for i, w in enumerate(NEAR_PERIODIC)], "doc_id long, text string")
    assert sorted(x.component_id for x in ngram_join.near_duplicates(few).collect()) == [0, 1]
    bits = [" ".join("pq"[(bin(i).count("1") + k) % 2] for i in range(n)) for n in (64, 128, 256, 300) for k in (0, 1)]
    e = spark.createDataFrame(list(enumerate(bits)), "doc_id long, text string")
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring_dedup.dedup_substrings(e).collect()} == dict(enumerate(plain_dedup(bits)))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(e).collect()} == dict(enumerate(plain_components(bits)))


def plain_components(texts):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_corpus():
    out = [None, "", "one", "ONE", "one two", "one two three four five", "a a a a a a a a", "a a a a a"]
    for size in (6, 8, 20, 60, 200):
        for _ in range(4):
            base = words(size, [f"v{i}" for i in range(300)])
            for edits in (0, 0, 1, 1, 2, 3, 5, 8, 13):
                w = list(base)
                for _ in range(edits):
                    w[r.randrange(len(w))] = f"e{r.randrange(9)}"
                out.append(" ".join(w))
    passage = words(60)
    out += [" ".join(words(k) + passage) for k in (2, 5, 10, 10, 20, 20, 80)]
    chain = words(120, [f"c{i}" for i in range(200)])
    out += [" ".join(chain[i : i + 100]) for i in range(0, 20, 2)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("per_block", [16, 512])
def test_ngram_join_equals_brute_force(spark, monkeypatch, per_block):
    texts = near_corpus()
    monkeypatch.setattr(ngram_join, "layout", lambda d: layout_of(d, per_block))
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, n int")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(d).collect()}
    assert got == dict(enumerate(plain_components(texts)))


def test_ngram_join_odd_tables(spark):
    d = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted(tuple(x) for x in ngram_join.near_duplicates(d).collect()) == [(3, 2, 3), (5, 2, 3), (5, 2, 3), (9, 0, 9)]
    assert ngram_join.near_duplicates(d.limit(0)).count() == 0
    assert sorted(x.doc_id for x in ngram_join.keep_one(d).collect()) == [3, 9]


@pytest.mark.parametrize("per_block", [5, 512])
def test_lm_score_equals_plain_models(spark, monkeypatch, per_block):
    texts = corpus() + ["Ünï😀", "\x00\x01", "z" * 500]
    monkeypatch.setattr(lm_score, "layout", lambda d: layout_of(d, per_block))
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))]
    tokens = [[*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), "END"] for t in texts]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v, trie = sum(c.values()), len(c), lm_score.ByteTrie(2)
    for t, h in zip(texts, held, strict=True):
        if not h:
            past = b"\0\0"
            for b in (t or "").encode():
                trie.learn(past, b)
                past = (past + bytes([b]))[1:]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in lm_score.score_documents(d).collect():
        t = tokens[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert math.isclose(x.score, trie.score((texts[x.doc_id] or "").encode()), rel_tol=1e-5, abs_tol=1e-9)
    assert lm_score.score_documents(d.limit(0)).count() == 0


@pytest.mark.parametrize("per_block", [5, 512])
def test_longer_contexts_equal_the_plain_model(spark, monkeypatch, per_block):
    texts = corpus() + ["Ünï😀", "\x00\x01\x00", "z" * 500, "\x00" * 9, "new grams 123"]
    monkeypatch.setattr(lm_score, "layout", lambda d: layout_of(d, per_block))
    trie = lm_score.ByteTrie(lm_score.ORDER)
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            past = b"\0" * trie.order
            for b in (t or "").encode():
                trie.learn(past, b)
                past = (past + bytes([b]))[1:]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in lm_score.score_documents(d, order=lm_score.ORDER).collect():
        assert math.isclose(x.score, trie.score((texts[x.doc_id] or "").encode()), rel_tol=1e-5, abs_tol=1e-6)
    assert lm_score.score_documents(d.limit(0), order=lm_score.ORDER).count() == 0


def test_messages_of_grams_are_small(spark, monkeypatch):
    """What a block sends takes less disk than its planes do under the shuffle's LZ4, and a block holds two of the layout's."""
    mine = random.Random(4)
    letters = "eeeeetttaaoinshrdlucmfwypvbgk"
    text = " ".join("".join(mine.choice(letters) for _ in range(mine.randrange(2, 9))) for _ in range(60_000))
    table = pa.table({"doc": pa.array([1], pa.int64()), "text": [text], "block": pa.array([0], pa.int32())})
    sent = lm_score._learn(4, lm_score.ORDER)(table)
    keys, counts = np.unique(lm_score.grams(*ragged.buffers(table.column("text")), lm_score.ORDER), return_counts=True)
    plain = sum(len(pa.compress(x, "lz4", asbytes=True)) for k, a, c in ragged.by_bucket(lm_score.gram_bucket(keys, lm_score.ORDER, 4), keys, counts.astype(np.uint64)) for x in (exchange.deltas(a), exchange.planes(c)))
    grams = [(a, b) for k, a, b in zip(*(sent.column(c).to_pylist() for c in ("bucket", "a", "b")), strict=True) if k >= 4]
    assert sum(len(a) + len(b) for a, b in grams) < 0.85 * plain
    assert sorted(x for a, _ in grams for x in exchange.sums(exchange.opened(a)).tolist()) == keys.tolist()
    asked = []
    monkeypatch.setattr(lm_score, "layout", lambda d: (16, 4))
    monkeypatch.setattr(lm_score, "block_of", lambda blocks, *c: asked.append(blocks) or F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("int"))
    assert lm_score.score_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), order=lm_score.ORDER).count() == 1 and asked == [8]


def test_byte_probabilities_sum_to_one():
    trie = lm_score.ByteTrie(2)
    trie.score(b"abracadabra abracadabra", learn=True)
    for past in (b"\0\0", b"ab", b"zz", b"ra"):
        assert math.isclose(sum(10 ** trie.log10(past, s) for s in range(256)), 1)
    assert lm_score.adaptive_score(b"abab" * 20) > lm_score.adaptive_score(bytes(r.randrange(256) for _ in range(80)))


CHATS = [[("user", "hi"), ("assistant", "a\\b<|im_end|>\n</s> <\\|"), ("user", ""), ("assistant", "x\n\ny😀")], [("system\n", "<|im_start|>user\n[INST]"), ("assistant", None)], [(None, "q")], [("assistant", HOSTILE), ("assistant", r"<\;> [\\INST] [\\\\/INST]")]]


def test_chats_read_back(spark):
    rows = [(i, n, role, text) for i, turns in enumerate(CHATS) for n, (role, text) in enumerate(turns)]
    d = chat_format.format_chats(chat_format.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = d.select("conv_id", "layout", "formatted", chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(got) == len(CHATS)
    alone = chat_format.records_of_rows(spark.createDataFrame([(None, 1, "user", "a"), (None, 1, "user", "a"), (4, 1, None, None)], "conv_id long, turn long, role string, text string"))
    assert sorted((x.conv_id or 0, x.n) for x in alone.select("conv_id", F.size("record.messages").alias("n")).collect()) == [(0, 1), (0, 1), (4, 1)]
    assert chat_format.format_chats(alone.limit(0)).count() == 0
    for x in got:
        want = [(role or "", text or "") for role, text in CHATS[x.conv_id]]
        assert [tuple(t) for t in x.back] == want and x.layout == "messages"
        assert x.loss == "".join(t for role, t in want if role == "assistant")
        assert x.formatted.count("<|im_end|>") == len(want)


def test_layouts_become_the_same_turns(spark):
    two = [("user", "q"), ("assistant", "a")]
    records = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "messages", two),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', "conversations", two),
        ('{"response":"a","prompt":"q"}', "prompt_response", two),
        ('{"prompt":"q","completion":"a"}', "prompt_completion", two),
        ('{"instruction":"q","output":"a"}', "instruction", two),
        ('{"instruction":"q","input":"i","output":"a"}', "instruction_input", [("user", "q\n\ni"), ("assistant", "a")]),
        ('{"data":{"question":"q","answer":"a"}}', "question_answer", two),
        ('{"messages":[]}', "messages", []),
        ('{"other":1}', "unknown", None),
        ("not json", "unknown", None),
        (None, "unknown", None),
    ]
    d = spark.createDataFrame([(i, x[0], "clash") for i, x in enumerate(records)], "id long, record string, layout string")
    for x in chat_format.format_chats(d).collect():
        _, layout, turns = records[x.id]
        assert x.layout == layout
        assert (None if x.turns is None else [tuple(t) for t in x.turns]) == turns


def test_chats_over_the_variant_limit(spark):
    rows = spark.range(136, numPartitions=8).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('x', 1048576) AS text")
    got = chat_format.format_chats(chat_format.records_of_rows(rows)).select("layout", F.size("turns").alias("n"), F.length("formatted").alias("chars"), F.size("loss_spans").alias("spans")).first()
    assert (got.layout, got.n, got.spans) == ("messages", 136, 68) and got.chars > 136 << 20
    long = spark.range(1).select(F.concat(F.lit('{"prompt":"q","response":"'), F.repeat(F.lit("x"), 25_000_000), F.lit('"}')).alias("record"))
    x = chat_format.format_chats(long).select("layout", F.length("formatted").alias("chars"), F.length(F.col("turns")[1]["text"]).alias("text")).first()
    assert x.layout == "prompt_response" and x.text == 25_000_000 < x.chars
    large = spark.range(1).select(F.concat(F.lit('{"prompt":"q","response":"'), F.repeat(F.lit("x"), 1 << 27), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="too large to be parsed"):
        chat_format.canonical_turns(large).select("layout").collect()


def page(i, body):
    return f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu {i}</a></li></ul></nav><!-- ad {i} --><div class="ad">buy {i}</div>{body}<footer>&copy; host {i}</footer></body></html>'


def test_html_main_text(spark):
    bodies = [
        ("<article><h1>Head &amp; one</h1><p><b>First\n  line<br><p>Second &eacute;&nbsp;x</p><div class='comments'><p>reader</p></div><aside>side</aside></article>", "Head & one\nFirst line\nSecond é x"),
        ("<main><p>Only</p><form><input value='a'>name</form></main>", "Only"),
        ("<div class='story'><p>No article here, but the text is long.</p><p>Two.</p></div>", "No article here, but the text is long.\nTwo."),
        ("", ""),
    ]
    rows = [(i, f"http://h.example/{i}", page(i, bodies[i % 4][0])) for i in range(24)] + [(90, None, None), (91, "x", ""), (92, "http://h.example/9", "<p>a < b</p>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_extract.extract_main_text(d).collect()}
    assert got == {i: bodies[i % 4][1] for i in range(24)} | {90: "", 91: "", 92: "a < b"}
    assert html_extract.extract_main_text(d.limit(0)).count() == 0
    template = {t for x in html_extract.deduce_templates(d).filter("host = 'h.example'").collect() for t in x.tokens}
    assert {html_extract.path_of("html", "body", "nav"), html_extract.path_of("html", "body", "footer")} <= template


def test_html_template_reaches_into_articles(spark):
    note = "<div class='callout'><p>Read this every day.</p></div>"
    rows = [(i, f"http://h.example/{i}", page(i, f"<article><h1>Head {i}</h1>{note}<p>Text {i}.</p></article>")) for i in range(12)]
    rows += [(100 + i, f"http://copies.example/{i}", page(0, "<article><h1>Same</h1><p>One.</p><p>Two.</p></article>")) for i in range(6)]
    got = {x.page_id: x.text for x in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Head {i}\nText {i}." for i in range(12)} | {100 + i: "Same\nOne.\nTwo." for i in range(6)}


def test_html_keeps_every_slot_without_an_article():
    body = "<div class='title'>Head</div><div class='lead'>Lead.</div><div class='body'><p>The long part.</p></div><div class='more'><p>End.</p></div>"
    assert html_extract.main_text(page(1, body)) == "Head\nLead.\nThe long part.\nEnd."
    tokens, _ = html_extract.parse(page(1, "<div class='title'>Site</div>"))
    assert html_extract.main_text(page(1, body.replace("Head", "Site")), [tokens]) == "Lead.\nThe long part.\nEnd."


def site_pages():
    """Pages of one host: blocks that stand everywhere, some that change places, some on part of the pages, and own text."""
    out = []
    for i in range(12):
        box = [f"<div class=b{k}><p>box {k}</p></div>" for k in range(3)]
        if i % 3 == 1:
            box = box[::-1]
        part = "<section><h2>part</h2><p>of pages</p></section>" if i % 4 else ""
        again = "<i>x</i>" * (i % 3)
        out.append(f"<html><body><div class=top>site</div>{''.join(box)}<div class=lead>{part}<p>own {i} {r.random()}</p></div>{again}<div class=end>bye</div></body></html>")
    out[7] = out[7].replace("<div class=top>site</div>", "").replace("<div class=end>bye</div>", "<div class=end>bye</div><div class=top>site</div>")
    return out


def plain_run(places):
    """The length of a longest increasing subsequence."""
    best = []
    for i, x in enumerate(places):
        best.append(1 + max((b for b, y in zip(best, places[:i], strict=True) if y < x), default=0))
    return max(best, default=0)


def plain_templates(pages):
    """Valid classes by the definitions, page by page."""
    seqs = [list(dict.fromkeys(html_extract.parse(p)[0])) for p in pages]
    times = [Counter(html_extract.parse(p)[0]) for p in pages]
    vector = {t: tuple(c[t] for c in times) for c in times for t in c}
    groups = {}
    for t, v in vector.items():
        if set(v) <= {0, 1} and sum(v) >= max(3, len(pages) / 2):
            groups.setdefault(v, []).append(t)
    classes = {}
    for v, ts in groups.items():
        if len(ts) >= 3:
            ts.sort(key=lambda t: (sum(s.index(t) for s in seqs if t in s), t))
            classes[min(ts)] = ts
    stray, bad, gaps = {c: set() for c in classes}, set(), {}
    for s in seqs:
        runs = {}
        for c, ts in classes.items():
            if ts[0] in s:
                mine = [s.index(t) for t in ts]
                run = [t for k, t in enumerate(ts) if plain_run(mine[:k] + mine[k + 1 :]) < plain_run(mine)]
                stray[c] |= set(ts) - set(run)
                if run:
                    runs[c] = run
        for c, mine in runs.items():
            for d, theirs in runs.items():
                if c != d:
                    where = {sum(s.index(x) < s.index(m) for x in theirs) for m in mine}
                    back = {sum(s.index(x) < s.index(m) for x in mine) for m in theirs}
                    if len(where) == 1:
                        k = where.pop()
                        if 0 < k < len(theirs):
                            gaps.setdefault((c, d), set()).add(classes[d].index(theirs[k - 1]))
                    elif len(back) > 1 and (len(mine), c) < (len(theirs), d):
                        bad.add(c)
    bad |= {c for (c, _), k in gaps.items() if len(k) > 1}
    return {c: [t for t in ts if t not in stray[c]] for c, ts in classes.items() if c not in bad and len(ts) - len(stray[c]) >= 3}, stray, gaps


def test_templates_equal_brute_force(spark):
    pages = site_pages()
    d = spark.createDataFrame([(i, "http://s.example/" + str(i), p, "clash") for i, p in enumerate(pages)], "page_id long, url string, html string, host string")
    want, stray, gaps = plain_templates(pages)
    rows = {x["class"]: x for x in html_extract.deduce_templates(d).collect()}
    assert {c: list(x.tokens) for c, x in rows.items()} == want and any(stray.values())
    for c, x in rows.items():
        around = {e for (k, e), g in gaps.items() if k == c and e in want and len(g) == 1}
        assert (x.parent is None) == (not around) and (x.parent is None or x.parent in around)
    got = {x.page_id: x for x in html_extract.extract_main_text(d, slots=True).collect()}
    for i, p in enumerate(pages):
        template = {t for ts in want.values() for t in ts}
        tokens, blocks = html_extract.parse(p)
        assert got[i].text == "\n".join(b.text for b in blocks if tokens[b.place] not in template) and len(got[i].slots) == len(got[i].text.split("\n"))
        assert got[i].text != html_extract.main_text(p)  # without a template, another result
        assert f"own {i} " in got[i].text


def test_templates_nest(spark):
    inner = "<section><h2>Head</h2><p>note</p><p class=z>more</p></section>"
    pages = [f"<html><body><div class=top>site</div><div class=lead>{inner if i % 4 else ''}<p>own {i}</p></div><div class=end>bye</div></body></html>" for i in range(12)]
    rows = {len(x.tokens): x for x in html_extract.deduce_templates(spark.createDataFrame([(i, "http://s/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")).collect()}
    outer, nested = rows[max(rows)], rows[min(rows)]
    assert outer.parent is None and nested.parent == outer["class"] and html_extract.path_of("html", "body", "div.lead", "section") in nested.tokens
    assert outer.tokens[nested.gap] == html_extract.path_of("html", "body", "div.lead", "p") or outer.tokens[nested.gap] == html_extract.path_of("html", "body", "div.lead")


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, '<a ">" ' * 150_000, "<svg>" * 200_000, "<!" * 500_000, "<b>" * 150_000 + "</i>" * 150_000, "<i>" + "<div>" * 100_000 + "</i>" * 100_000, "<p>" * 200_000, "<tr><td>" * 100_000, "<!--" * 250_000, "&" * 1_000_000], ids=range(11))
def test_html_takes_linear_time(page):
    import time
    import tracemalloc

    began = time.time()
    html_extract.main_text(page)
    assert time.time() - began < 2
    tracemalloc.start()
    html_extract.parse("<div>" * 100_000)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_html_odd_tables(spark):
    rows = [(1, "http://h/", "<p>a</p>"), (1, "http://h/", "<p>a</p>"), (None, None, None), (2, "", "<div>deep " * 3000 + "x" * 300_000)]
    d = spark.createDataFrame([(*x, "t", 1) for x in rows], "page_id long, url string, html string, text string, salt int")
    got = html_extract.extract_main_text(d).collect()
    assert sorted((x.page_id or 0, len(x.text)) for x in got) == [(0, 0), (1, 1), (1, 1), (2, 300_000 + 3000 * 5)]
    assert html_extract.deduce_templates(d.limit(0)).count() == 0


@pytest.mark.parametrize("toxic", [1, 40])
def test_toxic_documents_go_whatever_their_share(spark, toxic):
    rows = [(i, 0.98, 0.02, 0.0) for i in range(4000)] + [(9000 + i, 0.0005, 0.0005, 0.999) for i in range(toxic)]
    scored = spark.createDataFrame([(i, 100, *p) for i, *p in rows], "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double")
    steps, _, met = mixing.fit_rates(scored, mixing.TARGETS)
    rates = {x.doc_id: x.r for x in scored.withColumn("r", mixing.rate_after(steps, mixing.TARGETS)).collect()}
    assert met and min(rates[i] for i in range(4000)) >= 0.999 and {rates[9000 + i] for i in range(toxic)} == {0}


def plain_fit(n, p, targets, budget, steps=60_000):
    """The totals that plain projected gradient steps on the rates themselves come to."""
    aimed = np.array(targets) > 0
    cap = np.full(len(n), np.inf)
    for k in np.flatnonzero(~aimed):
        cap = np.minimum(cap, np.where(p[:, k] > 0.5, 0, np.divide(1 - p[:, k], p[:, k], out=np.full(len(n), np.inf), where=p[:, k] > 0)))
    a = (p * n[:, None])[:, aimed] / budget
    t, rate = np.array(targets)[aimed], np.minimum(1.0, cap)
    step = 1 / np.linalg.eigvalsh(a.T @ a)[-1]
    for _ in range(steps):
        rate = np.clip(rate - step * (a @ (a.T @ rate - t)), 0, cap)
    return a.T @ rate


@pytest.mark.parametrize("targets", [(0.98, 0.02, 0.0), (0.5, 0.3, 0.2), (0.2, 0.8, 0.0), (0.05, 0.05, 0.9)])
def test_rates_equal_plain_projected_gradient(spark, targets):
    g = np.random.default_rng(3)
    p = g.dirichlet([0.5, 0.3, 0.2], 300)
    p[:150] = [0.97, 0.02, 0.01]
    n = g.integers(1, 400, 300)
    scored = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p_good double, p_low double, p_toxic double")
    aim = dict(zip(mixing.DOMAINS, targets, strict=True))
    steps, budget, met = mixing.fit_rates(scored, aim)
    rate = np.array([x.r for x in scored.withColumn("r", mixing.rate_after(steps, aim)).orderBy("doc_id").collect()])
    got = ((p * n[:, None]).T @ rate / budget)[np.array(targets) > 0]
    assert rate.min() >= 0 and (not met or np.abs(got - np.array(targets)[np.array(targets) > 0]).max() <= 2 * mixing.TOLERANCE)
    assert np.abs(got - plain_fit(n.astype(float), p, targets, budget)).max() < 2e-3


def test_mixing_meets_targets(spark):
    docs, labels = [], []
    for i in range(3000):
        kind = ("good", "good", "good", "low", "toxic")[i % 5]
        w = words(50)
        w[::10] = {"good": ["fine"] * 5, "low": ["spam1", "spam2", "spam1", "spam2", "x"], "toxic": ["idiot", "scum", "trash", "idiot", "scum"]}[kind]
        docs.append((i, " ".join(w), 1.0))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    d = spark.createDataFrame([*docs, (9000, None, 1.0), (9001, "", 1.0), (None, "fine day", 1.0)], "doc_id long, text string, rate double")
    lab = spark.createDataFrame([*labels, *labels[:9], (None, 1, 0), (5, None, None), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    mixed = mixing.mix(d, lab, {"good": 0.7, "low": 0.3, "toxic": 0.0}).cache()
    assert mixed.count() == 3003 and mixed.filter("rate < 0").isEmpty()
    for weight in ("rate", "copies"):
        got = mixed.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{k}") * F.col(weight)).alias(k) for k in mixing.DOMAINS]).first()
        total = sum(got)
        assert abs(got.good / total - 0.7) < 0.02 and abs(got.low / total - 0.3) < 0.02 and got.toxic / total < 0.001
    rows = mixing.taken(mixed).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.max("copies").alias("copies")).collect()
    assert all(x.n == x.last == x.copies for x in rows)
    kept = {x.doc_id for x in rows}
    assert not any(i % 5 == 4 for i in kept if i is not None and i < 3000) and {i for i in range(3000) if i % 5 < 3} <= kept
    assert mixing.mix(d.limit(0), lab).count() == 0 and mixing.mix(d, lab.limit(0)).filter("copies >= 1").count() == 3003
