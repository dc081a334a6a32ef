"""Main text of web pages by site style trees.

Pages are cut into blocks once: a block is the text between two block-level tags, with the path of elements (tag, class and
role) that it stands under. The DOMs of a host's pages are merged by path. Two entropies, both over the distinct pages of
the host that hold the element, say how important a node of the merged tree is:

* content: text that stands on many pages of the host under the same path is of low importance, text of its own is of
  high importance; a branch has the mean of the texts below it;
* presentation: an element whose children are laid out differently from page to page is more important than one that
  always looks alike. Looking alike says nothing against text of its own.

Branches of low importance are removed from every page of the host. The tree can only tell furniture that repeats from
text that doesn't, so elements whose tag, role or class names them as furniture (navigation, adverts, forms, comments
and the like) are left out before, and if an article or main element holds most of the text that is left, only blocks
below it count.

Pages with the same text are one page for the tree, so copies of an article don't make it furniture.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripspark.session import materialize

#: Importance up to which a branch is removed, and the weight of presentation for each kind of layout below an element.
IMPORTANCE = 0.2
DECAY = 0.9
#: An element on fewer distinct pages is measured as if on so many, so that few pages say little against a text.
LEAST_PAGES = 5
#: A branch that holds more of its pages' text than this is what the pages are about.
MOST_SHARE = 0.3
#: Elements nested deeper than this stand where their ancestor at this depth does; their text stays.
DEEPEST = 256
#: An article or main element is what the page is about if it holds this share of the text that is no furniture.
MAIN_SHARE = 0.5

_SKIPPED_TAGS = frozenset(
    "head title script style noscript template iframe object svg canvas math audio video select button textarea "
    "form fieldset nav aside footer dialog menu".split()
)
_RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr keygen basefont frame".split()
)
_INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var nobr blink output meter progress".split()
)
_FURNITURE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split()
)
#: Words of class and id names that say what an element is there for.
_FURNITURE_WORDS = frozenset(
    "nav navbar navigation menu sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo banner "
    "cookie cookies consent gdpr notice notices comment comments disqus share sharing social related breadcrumb "
    "breadcrumbs footer header masthead popup modal overlay newsletter subscribe subscription login signup search "
    "toolbar pagination pager copyright widget alert disclaimer announcement".split()
)
#: First words that make a name one of content, and words that only say which part of a thing an element is.
_CONTENT_WORDS = frozenset("article post entry content story with has no without".split())
_PART_WORDS = frozenset(
    "area bar block body bottom box button buttons center column container content field footer form grid group head header "
    "heading icon icons inner item items label left link links list main outer panel part posts right row section slot "
    "slots space stories text title top unit widget wrap wrapper".split()
)
_NO_ARTICLE = frozenset("comment reply ad advert promo related teaser".split())
_TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that end when one of the same kind starts.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}


@dataclass
class _Element:
    tag: str
    path: str
    out: bool
    main: bool
    children: list[str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip())
    return found


def _is_furniture(tag: str, own: dict[str, str], in_main: bool) -> bool:
    if tag in _SKIPPED_TAGS or (tag == "header" and not in_main):
        return True
    if "hidden" in own or own.get("aria-hidden") == "true" or own.get("role", "").lower() in _FURNITURE_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    if tag == "article":
        # Publishing systems put many words on an article; only whole names count here.
        return bool(set(own.get("class", "").lower().split()) & _NO_ARTICLE)
    return any(_names_furniture(token) for name in ("class", "id") for token in own.get(name, "").split())


def _names_furniture(token: str) -> bool:
    """Whether one class or id says furniture: by its last word, or by its first one if the rest only names a part.

    ``site-header``, ``ad-slot-2`` and ``left_sidebar`` do; ``article-header``, ``with-sidebar``, ``alert-system-design``
    and ``related-work`` do not.
    """
    words = [w.lower() for w in _NAME_WORD.findall(_CAMEL.sub(" ", token))]
    if not words:
        return False
    if words[-1] in _FURNITURE_WORDS:
        return len(words) == 1 or words[0] not in _CONTENT_WORDS
    return words[0] in _FURNITURE_WORDS and all(w in _PART_WORDS or w in _FURNITURE_WORDS for w in words[1:])


def _next_tag(page: str, at: int) -> tuple[int, int, str, str] | None:
    """The next tag or comment: start, end, name (``/name`` for an end tag, empty for what is no element), attributes.

    Each character is looked at a few times at most: a quote that is never closed is no quote, and a tag that never
    ends is text, as is all that follows it.
    """
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, len(page) if end < 0 else end + 3, "", ""
        name = _TAG_NAME.match(page, start + 1)
        if not name:
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                return None if end < 0 else (start, end + 1, "", "")
            at = start + 1
            continue
        end = name.end()
        while (mark := _QUOTE.search(page, end)) and mark[0] != ">":
            close = page.find(mark[0], mark.end())
            end = mark.end() if close < 0 else close + 1
        if not mark:
            return None
        return start, mark.end(), name[0].lower(), page[name.end() : mark.start()]
    return None


def cut_into_blocks(page: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """The blocks of a page as (path, text), without furniture, and its elements as (path, layout of children).

    Tags may be missing or wrong: a block-level tag ends a paragraph, an end tag without its start is ignored, and what
    is open at the end is closed. Line breaks are white space.
    """
    root = _Element("", "", False, False)
    stack, blocks, layouts, text = [root], [], [], []
    open_tags: Counter[str] = Counter()

    def flush() -> None:
        if text:
            top = stack[-1]
            words = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if words and not top.out:
                blocks.append((top.path, words, top.main))

    def close() -> None:
        flush()
        done = stack.pop()
        open_tags[done.tag] -= 1
        if not done.out and len(stack) <= DEEPEST:
            layouts.append((done.path, " ".join(done.children)))

    at, end = 0, len(page)
    while at < end:
        tag = _next_tag(page, at)
        if not tag:
            text.append(page[at:])
            break
        if tag[0] > at:
            text.append(page[at : tag[0]])
        at, name = tag[1], tag[2]
        if not name:
            continue
        if name.startswith("/"):
            name = name[1:]
            if name in _INLINE_TAGS or name in _VOID_TAGS:
                if name == "br":
                    text.append(" ")
            elif open_tags[name]:
                while stack[-1].tag != name:
                    close()
                close()
            else:
                flush()
            continue
        if name in _RAW_TAGS:
            # What is inside is no markup.
            until = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = until.end() if until else end
            if name not in _SKIPPED_TAGS:
                text.append(" ")
            continue
        if name in _VOID_TAGS:
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
            continue
        if name in _INLINE_TAGS:
            continue
        flush()
        while len(stack) > 1 and (stack[-1].tag == "p" or stack[-1].tag in _SIBLINGS.get(name, ())):
            close()
        own = _attributes(tag[3])
        above = stack[-1]
        deep = len(stack) > DEEPEST
        label = name + "".join(f".{w}" for w in sorted(own.get("class", "").split()))
        if "role" in own:
            label += f"@{own['role']}"
        if not deep and (not above.children or above.children[-1] != label):
            above.children.append(label)
        in_main = above.main or name in ("article", "main") or own.get("role", "").lower() in ("main", "article")
        out = above.out or _is_furniture(name, own, above.main)
        open_tags[name] += 1
        stack.append(_Element(name, above.path if deep else f"{above.path}/{label}", out, in_main and not out))
    while len(stack) > 1:
        close()
    flush()
    inside = [(path, words) for path, words, main in blocks if main]
    share = sum(len(words) for _, words in inside) / max(1, sum(len(words) for _, words, _ in blocks))
    return (inside if share >= MAIN_SHARE else [(path, words) for path, words, _ in blocks]), layouts


_BLOCKS = (
    "page_id {id}, url {url}, host string, print binary, "
    "blocks array<struct<path:string,text:string>>, layouts array<struct<path:string,layout:long>>"
)


def _host(url: Column) -> Column:
    """The host of a url in lower case, without port; null where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string())]))
    layout = pa.list_(pa.struct([("path", pa.string()), ("layout", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            prints, blocks, layouts = [], [], []
            for page in part.column("html").to_pylist():
                texts, elements = cut_into_blocks(page or "")
                prints.append(hashlib.md5("\n".join(t for _, t in texts).encode("utf-8", "replace")).digest())
                blocks.append([{"path": p, "text": t} for p, t in texts])
                shapes = [
                    {"path": p, "layout": int.from_bytes(hashlib.md5(s.encode("utf-8", "replace")).digest()[:7])}
                    for p, s in elements
                ]
                layouts.append(shapes)
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(c) for c in ("page_id", "url", "host")),
                    pa.array(prints, pa.binary()),
                    pa.array(blocks, block),
                    pa.array(layouts, layout),
                ],
                ["page_id", "url", "host", "print", "blocks", "layouts"],
            )


def _unimportant(parsed: DataFrame) -> DataFrame:
    """Per host the paths of branches to remove. All counts are over distinct pages and are made before any shuffle of
    texts: only hashes of texts and layouts travel."""
    pages = parsed.where("host is not null")
    sizes = pages.select("host", "print").distinct().groupBy("host").agg(F.count("*").alias("pages"))

    texts = pages.select("host", "print", F.explode("blocks").alias("b")).select(
        "host", "print", F.col("b.path").alias("path"), F.xxhash64("b.text").alias("text"), F.length("b.text").alias("chars")
    )
    # A text that occurs more than once on a page counts once.
    texts = texts.distinct()
    texts_of_pages = texts.select("host", "print", "path").distinct()
    texts = texts.groupBy("host", "path", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    leaves = texts.groupBy("host", "path").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("spread"),
        F.sum("chars").alias("chars"),
    )
    parts = F.split("path", "/")
    above = F.transform(
        F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    branches = leaves.where("path <> ''").select("*", F.explode(above).alias("branch"))
    branches = branches.groupBy("host", "branch").agg(
        F.sum("n").alias("n"), F.sum("spread").alias("spread"), F.sum("chars").alias("chars")
    )
    held = texts_of_pages.where("path <> ''").select("host", "print", F.explode(above).alias("branch")).distinct()
    held = held.groupBy("host", "branch").agg(F.count("*").alias("held"))
    everything = leaves.groupBy("host").agg(F.sum("chars").alias("all_chars"))

    looks = pages.select("host", "print", F.explode("layouts").alias("l")).select("host", "print", "l.path", "l.layout")
    looks = looks.distinct().groupBy("host", "path", "layout").agg(F.count("*").alias("n"))
    looks = looks.groupBy("host", "path").agg(
        F.sum("n").alias("seen"),
        F.count("*").alias("kinds"),
        F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("alike"),
    )
    looks = looks.select(F.col("host").alias("h"), "path", "seen", "kinds", "alike")

    joined = branches.join(held, ["host", "branch"]).join(sizes, "host").join(everything, "host")
    joined = joined.join(looks, (F.col("host") == F.col("h")) & (F.col("branch") == F.col("path")), "left")
    # Entropies over the pages that hold an element, in their own logarithm: 1 for what differs on each of them.
    def scale(n: str) -> Column:
        return F.log(F.greatest(F.col(n), F.lit(LEAST_PAGES)).cast("double"))

    content = 1 - F.col("spread") / (F.col("n") * scale("held"))
    layout = (F.log(F.col("seen").cast("double")) - F.col("alike") / F.col("seen")) / scale("seen")
    layout = F.coalesce(layout, F.lit(0.0))
    weight = F.pow(F.lit(DECAY), F.coalesce("kinds", F.lit(1)).cast("double"))
    importance = F.greatest(content, (1 - weight) * layout + weight * content)
    removed = joined.where(
        (importance <= IMPORTANCE)
        & (F.col("chars") <= MOST_SHARE * F.col("all_chars"))
        & ~F.col("branch").rlike("/h1[^/]*$")
    )
    return removed.groupBy("host").agg(F.sort_array(F.collect_set("branch")).alias("removed"))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars.

    A null or empty page has an empty text. Pages whose url has no host are not merged with others and lose furniture by
    name only. Repeated rows give the same text each; other columns are ignored; no rows give no rows.
    """
    kinds = dict(pages.dtypes)
    schema = _BLOCKS.format(id=kinds["page_id"], url=kinds["url"])
    parsed = pages.select("page_id", "url", _host(F.col("url")).alias("host"), "html").mapInArrow(_parsed, schema)
    parsed = materialize(parsed, "page-blocks")
    tree = materialize(_unimportant(parsed), "style-trees")
    rows = parsed.select("page_id", "url", "host", "blocks").join(tree, "host", "left")
    kept = F.filter(
        "blocks",
        lambda b: ~F.exists(
            F.coalesce("removed", F.array().cast("array<string>")),
            lambda r: (b["path"] == r) | b["path"].startswith(F.concat(r, F.lit("/"))),
        ),
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
