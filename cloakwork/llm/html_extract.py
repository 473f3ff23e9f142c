"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens: tags, told apart by the path of their ancestors, and text blocks with where they
stand. Over the pages of one host, tokens with the same occurrence vector (the same number of times on
the same pages) form an equivalence class; a class of several tokens that occur on most
pages, each once a page, is a candidate for the host's template. It is valid if it is

* ordered: its tokens follow one another in one order, that of their mean places. Tokens that are not in all longest
  runs in this order on some page are taken out of the class, and so stay in the text;
* properly nested: on every page it stands in one gap of another class, the same on all pages, or the other in one of its own,
  or the two stand apart. Of two classes that interleave, the smaller goes.

Valid classes, each inside the innermost class whose gap holds it, are the host's template. What stands between
template tokens are slots. Slots inside menus, adverts, forms and the like are chrome; the
article's slots, or without an article all that are left, are the main text, in page order.

Vectors are compared by sums of two page hashes per (host, token), so a host is never
gathered in one task: sums are combined before the shuffle, and a host's template (tokens
of at least half its pages) has at most twice as many tokens as its mean page.
Pages are parsed twice: once to a table of their tokens, which gives vectors and, joined with the candidates, what is out
of order; once, joined with the templates, for the slots.
Text inside an explicit article belongs to the template as any other where it recurs; only an
article that would be lost whole, a copy of one on most pages of its host, stays as it is.

Nulls and odd input: a null or empty page has the text ''; a null or broken url is the
host ''; unclosed and stray tags are repaired as browsers do, roughly; a tag that no '>' ends is text; where quotes in a
tag are not balanced, this and later tags of the page end at the next '>'; repeated rows and
ids each come back; a very long or deep page takes time and memory in proportion to its length; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import dropped, written

#: Pages that must share a class before it counts, and the share of the host's pages.
MIN_SUPPORT = 3
MIN_SHARE = 0.5
#: Tokens of a class at least.
MIN_CLASS = 3
#: Parts that a host's template is dealt to, so that a hot host's pages spread over tasks.
SALTS = 32

# Fixed word lists: elements by how they lay out, and names that mark chrome.
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul center dialog menu option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object textarea title select button canvas audio video".split())
CHROME = frozenset("nav aside footer form head menu dialog header".split())
CHROME_NAME = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|banner|cookie|cookies|consent|notice|notices|alert|popup|modal|share|social|related|recommended|comment|comments|disqus|replies|newsletter|subscribe|signup|login|search|breadcrumb|breadcrumbs|pagination|widget|copyright)(?:$|[\s_-])", re.I)
CHROME_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
CONTENT_NAME = re.compile(r"(?:^|[\s_-])(?:article-body|articlebody|post-content|entry-content|post-body|story-body|main-content|article-content)(?:$|[\s_-])", re.I)
#: Elements that an opening tag of the key closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
END_OR_QUOTE = re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: What a worker remembers of tags and paths; beyond, it starts anew.
REMEMBER = 100_000


class Block:
    """A text block: its text, the place of its token on the page, and where it stands."""

    __slots__ = ("chrome", "content", "place", "text")

    def __init__(self, text, place, content, chrome):
        self.text, self.place, self.content, self.chrome = text, place, content, chrome


def token(path: int, what: str) -> int:
    """A 63-bit hash of a tag's label, or of a text, under a path; a path is the token of its last tag, 0 for none."""
    return int.from_bytes(blake2b(b"%d " % path + what.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def path_of(*labels: str) -> int:
    path = 0
    for label in labels:
        path = token(path, "<" + label)
    return path


class Tag:
    """What an opening tag says by itself."""

    __slots__ = ("alone", "block", "chrome", "closes", "content", "label", "name", "raw")

    def __init__(self, name: str, raw: str):
        attributes = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw, len(name))} if raw.strip(" /") != name else {}
        mark = " ".join(filter(None, (attributes.get("class"), attributes.get("id"))))
        role = attributes.get("role", "").lower()
        self.name, self.block = name, name in BLOCKS
        self.label = "<" + name + ("." + ".".join(mark.lower().split()[:2]) if mark else "")
        self.raw = name in RAW and not raw.endswith("/")
        self.alone = name in VOID or raw.endswith("/")
        self.closes = CLOSES.get(name, frozenset(() if name in ("td", "th") else ("p",)))
        self.content = name in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody" or bool(mark and CONTENT_NAME.search(mark))
        hidden = "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("aria-hidden") == "true"
        self.chrome = hidden or role in CHROME_ROLE or name in CHROME or bool(mark and not self.content and CHROME_NAME.search(mark)) or (name == "article" and bool(mark and re.search(r"\bcomment", mark, re.I)))


_tags: dict[str, Tag] = {}
_paths: dict[tuple[int, str], int] = {}


def _tag(raw: str) -> Tag:
    got = _tags.get(raw)
    if got is None:
        if len(_tags) > REMEMBER:
            _tags.clear()
        got = Tag(NAME.match(raw)[1].lower(), raw)
        if len(raw) < 200:
            _tags[raw] = got
    return got


def _path(parent: int, label: str) -> int:
    got = _paths.get((parent, label))
    if got is None:
        if len(_paths) > REMEMBER:
            _paths.clear()
        got = _paths[parent, label] = token(parent, label)
    return got


def _tag_end(page: str, at: int) -> tuple[int, bool]:
    """(end of the tag that opens at `at`, whether its quotes are balanced)."""
    i = at
    while m := END_OR_QUOTE.search(page, i):
        if m[0] == ">":
            return m.end(), True
        i = page.find(m[0], m.end()) + 1
        if not i:
            break
    return page.find(">", at) + 1, False


def parse(page: str | None) -> tuple[list[int], list[Block]]:
    """(tokens in order, text blocks in order) of a page, in time linear in its length."""
    page = page or ""
    tokens: list[int] = []
    blocks: list[Block] = []
    words: list[str] = []
    names, paths, contents, chromes = [""], [0], [False], [False]  # the open elements
    block_at: list[int] = []  # which of them are blocks
    opened: dict[str, list[int]] = {}
    unended: set[str] = set()  # raw elements that no end tag follows any more
    balanced = True

    def flush():
        text = "".join(words)
        words.clear()
        text = " ".join((_html.unescape(text) if "&" in text else text).split())
        if text:
            blocks.append(Block(text, len(tokens), contents[-1], chromes[-1]))
            tokens.append(token(paths[block_at[-1] if block_at else 0], text))

    def close(i):
        while len(names) > i:
            opened[names.pop()].pop()
            paths.pop()
            contents.pop()
            chromes.pop()
        while block_at and block_at[-1] >= i:
            block_at.pop()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            words.append(page[at:])
            break
        if lt > at:
            words.append(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else n
            continue
        name = NAME.match(page, lt + 1)
        if not name and page[lt + 1 : lt + 2] not in ("!", "?"):
            words.append("<")
            at = lt + 1
            continue
        end, fine = _tag_end(page, lt) if name and balanced else (page.find(">", lt) + 1, True)
        if not end:  # no tag can end any more
            words.append(page[lt:])
            break
        balanced, at = balanced and fine, end
        if not name:
            continue
        if page[lt + 1] == "/":
            label = name[1].lower()
            if label in BLOCKS:
                if words:
                    flush()
            elif opened.get(label) and block_at and block_at[-1] > opened[label][-1]:
                continue  # a stray inline end tag doesn't close blocks
            if opened.get(label):
                close(opened[label][-1])
            continue
        tag = _tag(page[lt + 1 : end - 1])
        if tag.name == "br":
            words.append(" ")
        if tag.raw:  # what it holds is no text
            found = None if tag.name in unended else RAW_END[tag.name].search(page, at)
            if found:
                at = found.end()
            else:
                unended.add(tag.name)
                at = n if tag.name in ("script", "style", "textarea", "title") else at
            continue
        if tag.block:
            if words:
                flush()
            while block_at and names[block_at[-1]] in tag.closes:
                close(block_at[-1])
            close(block_at[-1] + 1 if block_at else 1)  # unclosed inline elements end with their block
        path = _path(paths[-1], tag.label)
        tokens.append(path)
        if not tag.alone:
            chrome = chromes[-1] or tag.chrome
            if tag.block:
                block_at.append(len(names))
            opened.setdefault(tag.name, []).append(len(names))
            names.append(tag.name)
            paths.append(path)
            contents.append(contents[-1] or (tag.content and not chrome))
            chromes.append(chrome)
    if words:
        flush()
    return tokens, blocks


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1), r"^.*@", "")), F.lit(""))


def _keyed(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with host and salt."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.withColumn("host", _host("url")).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))


def token_table(pages: DataFrame) -> DataFrame:
    """(host, salt, k1, k2, token, times): each page's distinct tokens in order, and two 31-bit hashes of the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(parse(p)[0]) for p in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([list(c) for c in counts], pa.list_(pa.int64())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], names=["host", "salt", "k1", "k2", "token", "times"])

    key = F.xxhash64("page_id", "url", F.lit(10))
    source = _keyed(pages).select("host", "salt", F.shiftrightunsigned(key, 33).alias("k1"), key.bitwiseAND(F.lit((1 << 31) - 1)).alias("k2"), "html")
    return source.mapInArrow(run, "host string, salt int, k1 bigint, k2 bigint, token array<bigint>, times array<int>")


def candidate_classes(tokens: DataFrame) -> DataFrame:
    """(host, class, tokens): tokens once a page on the same pages, MIN_SUPPORT and MIN_SHARE of the host's, by mean place."""
    each = tokens.select("host", "k1", "k2", F.posexplode(F.arrays_zip("token", "times"))).select("host", "pos", F.col("col.token").alias("token"), F.col("col.times").alias("times"), *[(F.col(k) * F.col("col.times")).alias(k) for k in ("k1", "k2")])
    summed = each.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum("times").alias("times"), F.sum("k1").alias("k1"), F.sum("k2").alias("k2"), F.sum("pos").alias("place"))
    often = summed.filter(f"pages >= {MIN_SUPPORT} AND times = pages")
    hosts = tokens.groupBy("host").agg(F.count("*").alias("host_pages")).filter(f"host_pages >= {MIN_SUPPORT}")
    held = often.join(hosts, "host").filter(F.col("pages") >= MIN_SHARE * F.col("host_pages"))
    classes = held.groupBy("host", "pages", "k1", "k2").agg(F.min("token").alias("class"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("t"))
    return classes.filter(F.size("t") >= MIN_CLASS).select("host", "class", F.col("t.token").alias("tokens"))


def _reach(places: list[int]) -> list[int]:
    """For each place the length of a longest increasing subsequence that ends there."""
    ends, out = [], []
    for x in places:
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
        out.append(k + 1)
    return out


def _in_order(places: list[int]) -> list[int]:
    """Indices that belong to every longest increasing subsequence of distinct places: of two that change places, neither."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    before, after = _reach(places), _reach([-x for x in places[::-1]])[::-1]
    longest = max(before)
    at = {}
    for i, (a, b) in enumerate(zip(before, after, strict=True)):
        if a + b - 1 == longest:
            at.setdefault(a, []).append(i)
    return sorted(x[0] for x in at.values() if len(x) == 1)


OUT_OF_ORDER, INTERLEAVED = -1, -2


def judge_page(places: dict[int, int], classes: list[tuple[int, list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(class, other, verdict) for a page: a token out of order, a class that interleaves with a larger one, or the gap of another class that it stands in."""
    held = []
    for name, tokens in classes:
        if tokens[0] in places:
            mine = [places[t] for t in tokens]
            run = _in_order(mine)
            if len(run) < len(mine):
                for i in set(range(len(mine))) - set(run):
                    yield name, tokens[i], OUT_OF_ORDER
            if run:
                held.append((name, run, [mine[i] for i in run]))
    for name, _, mine in held:
        for other, run, theirs in held:
            if name != other:
                a, b = bisect_left(theirs, mine[0]), bisect_left(theirs, mine[-1])
                if a == b:
                    if 0 < a < len(theirs):
                        yield name, other, run[a - 1]
                elif bisect_left(mine, theirs[0]) != bisect_left(mine, theirs[-1]):
                    if (len(mine), name) < (len(theirs), other):
                        yield name, other, INTERLEAVED


def _dealt(templates: DataFrame) -> DataFrame:
    return templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _verdicts(tokens: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, class, other, lo, hi): the least and the greatest verdict of judge_page() over a host's pages."""
    by_host = classes.groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("classes"))
    joined = tokens.select("host", "salt", "token").join(_dealt(by_host), ["host", "salt"]).select("host", "token", "classes")
    schema = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("class", "other", "lo", "hi"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}

        def rows():
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, (*k, *v), strict=True)) for k, v in seen.items()], schema=schema)

        for batch in batches:
            for host, mine, classes in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                places = {t: i for i, t in enumerate(mine)}
                for name, other, verdict in judge_page(places, [(c["class"], c["tokens"]) for c in classes]):
                    span = seen.setdefault((host, name, other), [verdict, verdict])
                    span[0], span[1] = min(span[0], verdict), max(span[1], verdict)
            if len(seen) > 100_000:
                yield rows()
                seen.clear()
        yield rows()

    said = joined.mapInArrow(run, "host string, class bigint, other bigint, lo bigint, hi bigint")
    return said.groupBy("host", "class", "other").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def templates_of(tokens: DataFrame) -> DataFrame:
    """(host, class, tokens, parent, gap) of a token_table(): valid classes, and the gap of the innermost class they stand in."""
    classes = written(candidate_classes(tokens), "classes")
    said = written(_verdicts(tokens, classes), "verdicts")
    stray = said.filter(f"lo = {OUT_OF_ORDER}").groupBy("host", "class").agg(F.collect_set("other").alias("stray"))
    bad = said.filter(f"lo = {INTERLEAVED} OR (lo >= 0 AND lo <> hi)").select("host", "class").distinct()
    valid = classes.join(stray, ["host", "class"], "left").withColumn("tokens", F.array_except("tokens", F.coalesce("stray", F.array().cast("array<bigint>")))).drop("stray")
    valid = valid.join(bad, ["host", "class"], "left_anti").filter(F.size("tokens") >= MIN_CLASS)
    inside = said.filter("lo >= 0 AND lo = hi").join(valid.select("host", F.col("class").alias("other")), ["host", "other"])
    depth = inside.groupBy("host", "class").agg(F.count("*").alias("depth"))
    outer = inside.join(depth.withColumnRenamed("class", "other"), ["host", "other"], "left")
    parent = outer.groupBy("host", "class").agg(F.max(F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), "other", "lo")).alias("m")).select("host", "class", F.col("m.other").alias("parent"), F.col("m.lo").alias("gap"))
    return valid.join(parent, ["host", "class"], "left")


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, class, tokens, parent, gap): for each host its valid equivalence classes and how they nest."""
    tokens = written(token_table(pages), "tokens")
    templates = templates_of(tokens)
    dropped(tokens)
    return templates


def slots_of(tokens: list[int], blocks: list[Block], classes: list[list[int]]) -> list[tuple[tuple[int, int], Block]]:
    """((class, gap), block) for each block that is no template token: the last template token before it, by class and rank; (-1, -1) before all."""
    known = {t: (k, i) for k, mine in enumerate(classes) for i, t in enumerate(mine)}
    out, slot, at = [], (-1, -1), 0
    for b in blocks:
        for t in tokens[at : b.place]:
            slot = known.get(t, slot)
        at = b.place
        if tokens[at] not in known:
            out.append((slot, b))
    return out


def main_slots(page: str | None, classes: list[list[int]] = ()) -> list[tuple[tuple[int, int], str]]:
    """(slot, text) of the page's main text: what the template leaves that is no chrome, of the article where there is one."""
    tokens, blocks = parse(page)
    free = [(s, b) for s, b in slots_of(tokens, blocks, classes) if not b.chrome]
    inside = [x for x in free if x[1].content] or [((-1, -1), b) for b in blocks if b.content and not b.chrome] or free
    return [(s, b.text) for s, b in inside]


def main_text(page: str | None, classes: list[list[int]] = ()) -> str:
    return "\n".join(t for _, t in main_slots(page, classes))


def extract_main_text(pages: DataFrame, slots: bool = False) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html); with slots, also the slot (class, gap) of each block of the text."""
    templates = deduce_templates(pages).groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("classes"))
    joined = _keyed(pages).join(_dealt(templates), ["host", "salt"], "left").select("page_id", "url", "html", "classes")
    kind = pages.schema["page_id"].dataType.simpleString()
    where = pa.list_(pa.struct([("class", pa.int64()), ("gap", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = [], []
            for page, classes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                held = main_slots(page, [c["tokens"] for c in classes or ()])
                texts.append("\n".join(t for _, t in held))
                if slots:
                    places.append([{"class": classes[k]["class"] if k >= 0 else None, "gap": g} for (k, g), _ in held])
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *([pa.array(places, where)] if slots else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "slots"][: len(columns)])

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string" + (", slots array<struct<class:bigint,gap:int>>" if slots else ""))
