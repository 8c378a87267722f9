"""Main text of web pages: block rules in two passes over text density, link density and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import slices, table

#: Fixed values. Elements whose content is never text: raw ones end at the first end tag of their name, others at their own.
RAW = "script style title textarea iframe xmp noembed noframes".split()
SILENT = "noscript template svg math object canvas audio video select button datalist".split()
#: Raw elements that run to the end of the page if nothing ends them; any other such tag is passed over.
TO_THE_END = "script style".split()
#: Elements that begin and end blocks, and elements that hold what stands around an article.
BLOCKS = frozenset(
    (
        "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
        "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
    ).split()
)
AROUND = frozenset("nav footer aside menu header dialog".split())
ARTICLE = frozenset("article main".split())
#: Words of a class, id, role or label that say of an element that it stands around the article: wherever they stand in
#: a name (`comment-list`), or only if no other word is beside them (`share`, `related box`, but not `search-results`).
ANYWHERE = frozenset(
    (
        "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disclaimer disqus footer menu nav navbar navigation "
        "newsletter pager pagination popup promo promotion sidebar sponsored toolbar widget"
    ).split()
)
ALONE = frozenset("consent copyright header login modal notice promoted related reply replies respond search share sharing signup skip social sponsor subscribe tags".split())
#: Words that say nothing beside those, and words before one of them by which a name only tells of the layout.
NEUTRAL = frozenset(
    (
        "area articles bar block bottom box button buttons container form group icons inner item items left link links list media outer page panel post posts right section site "
        "stories text this top wrap wrapper"
    ).split()
)
LAYOUT = frozenset("has no not with without hide is".split())
#: Frequent words of the languages that pages are in.
STOP_WORDS = frozenset(
    (
        "the of and to in is that for it as was with be by on not are this at from or an have had but which you "
        "de la le les et des en un une du que qui dans est pour pas sur par au avec ce il elle "
        "der die das und den von zu mit sich auf ist nicht ein eine dem im auch als für "
        "el los las y se del con su para es al lo como no "
        "di il che per non è sono una della "
        "o os não uma com "
        "het een van niet dat "
        "и в не на что с он по это"
    ).split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PAGE = frozenset(["html", "body"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the left kind ends where one of the right kind begins.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: An element with a word as above stands around if it has at most this share of the page's prose: by name or by a whole
#: class name (`comments`, `cookie-notice`), or by a part of one (`content-sidebar-wrap`), or as a form.
MOST_NAMED, MOST_PARTLY_NAMED = 0.9, 0.5
#: First pass: a block with a larger share of linked characters is bad; one of at least LONG characters with a share
#: of stop words of at least DENSE is good; one without any stop word bad, but see main_blocks(); the rest stay open.
MOST_LINKED, PARTLY_LINKED = 0.5, 0.25
LONG, DENSE = 70, 0.08


# Parsing ---------------------------------------------------------------------------------------------------------------


def _patterns():
    import re

    #: Quoted values end at a quote that ends an attribute; a quote that ends nothing is an ordinary sign.
    attrs = r"""(?P<attrs>(?:[^<>=]++|=\s*+(?:"[^"]*"(?=[\s/>]|\Z)|'[^']*'(?=[\s/>]|\Z)|))*+)"""
    tag = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/<>]*){attrs}(?:>|(?=<)|\Z)", re.S)
    attribute = re.compile(r"""(?<![\w-])(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
    link = re.compile(r"(?<![\w-])href\s*=", re.I)
    return tag, attribute, link, re.compile(r"[^\W_]+"), re.compile(r"(?<=[a-z])(?=[A-Z])"), re.compile(r"[^\W\d_]+")


TAG, ATTRIBUTE, HREF, NAME_WORD, CAMEL, WORD = _patterns()


def _pairs(html: str, name: str) -> dict[int, int]:
    """Where each element of that name that has its own end tag begins, and where it ends."""
    import re

    found, waiting = {}, []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^<>]*>?", html, re.I):
        if not m.group(1):
            if not m.group().endswith("/>"):
                waiting.append(m.start())
        elif waiting:
            found[waiting.pop()] = m.end()
    return found


def tags_of(html: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, name or "", is it an end tag, attributes) of all that is not text, in order; silent elements are one."""
    import re

    found, at, pairs, endless = [], 0, {}, set()
    while m := TAG.search(html, at):
        start, at = m.span()
        name, closes, attrs = (m.group("name") or "").lower(), bool(m.group("close")), m.group("attrs") or ""
        if not closes and name in RAW and name not in endless:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            if end or name in TO_THE_END:
                name, at = "", end.end() if end else len(html)
            else:
                endless.add(name)
        elif not closes and name in SILENT:
            if name not in pairs:
                pairs[name] = _pairs(html, name)
            if start in pairs[name]:
                name, at = "", max(at, pairs[name][start])
        found.append((start, at, name, closes, attrs))
    return found


def _share_at_most(attrs: str, in_article: bool) -> tuple[float, bool]:
    """Up to which share of the page's prose an element's words make it stand around (0: not at all); is it an article by them?"""
    share, article = 0.0, False
    for m in ATTRIBUTE.finditer(attrs):
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if kind == "itemprop" or (kind == "role" and value.lower() in ("main", "article")):
            article |= value.lower() in ("articlebody", "main", "article")
            continue
        for mark in value.split():
            words = [w.lower() for w in NAME_WORD.findall(CAMEL.sub("-", mark))]
            said = [w in ANYWHERE or (w in ALONE and not (w == "header" and in_article)) for w in words]
            if not any(said) or words[0] in LAYOUT:
                continue
            rest = [w for w, s in zip(words, said) if not s and w not in NEUTRAL and not w.isdigit()]
            if not rest:
                share = max(share, MOST_NAMED)
            elif any(w in ANYWHERE for w in words):
                share = max(share, MOST_PARTLY_NAMED)
    return share, article


def blocks_of(html: str) -> list[dict]:
    """Blocks of a page in order: text, linked (characters within links), around, article (is it inside), heading, item (of a list), level, meet.

    level: how deep the element lies around the block's own one; meet: around both the block and the one before it.
    """
    from html import unescape

    #: Elements: parent, is it an article, largest share of the prose at which it stands around by its name, and by its words.
    elements: list[tuple[int, bool, float, float]] = []
    stack: list[tuple[str, int]] = []  # name, element
    count: dict[str, int] = {}
    found: list[dict] = []
    pieces: list[tuple[str, bool]] = []
    at = article = low = 0
    link = False
    tags = tags_of(html)
    #: Links that end before another begins; a link that nothing ends goes to the end of its block.
    ended, next_is_end = set(), False
    for k in range(len(tags) - 1, -1, -1):
        if tags[k][2] == "a":
            if tags[k][3]:
                next_is_end = True
            elif HREF.search(tags[k][4]):
                if next_is_end:
                    ended.add(k)
                next_is_end = False

    def close_block() -> None:
        nonlocal low
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = len(" ".join("".join(p for p, is_link in pieces if is_link).split()))
                found.append({"text": text, "linked": linked, "article": article > 0, "heading": any(name in HEADINGS for name, _ in stack[-2:]), "item": any(name == "li" for name, _ in stack[-2:]), "level": len(stack) - 1, "element": stack[-1][1] if stack else -1, "meet": low})
                low = len(stack)
            pieces.clear()

    def pop() -> None:
        nonlocal article, low
        name, e = stack.pop()
        count[name] -= 1
        article -= elements[e][1]
        low = min(low, len(stack))

    ends_itself = False
    for k, (start, end, name, closes, attrs) in enumerate(tags):
        if start > at:
            pieces.append((unescape(html[at:start]), link))
        at = end
        if name in BLOCKS:
            close_block()
            if not ends_itself:
                link = False
        if name == "br":
            pieces.append((" ", link))
        elif name == "a":
            if closes:
                link = False
            elif HREF.search(attrs):
                link, ends_itself = True, k in ended
        elif closes:
            if name in BLOCKS and count.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name in BLOCKS and name not in VOID and name not in PAGE:
            while stack and name in ENDED_BY.get(stack[-1][0], ()):
                pop()
            share, is_article = _share_at_most(attrs, article > 0) if attrs.strip() else (0.0, False)
            is_article |= name in ARTICLE
            by_name = MOST_NAMED if name in AROUND and not (name == "header" and article) else MOST_PARTLY_NAMED if name == "form" else 0.0
            elements.append((stack[-1][1] if stack else -1, is_article, 0.0 if is_article else by_name, 0.0 if is_article else share))
            stack.append((name, len(elements) - 1))
            count[name] = count.get(name, 0) + 1
            article += is_article
    if at < len(html):
        pieces.append((unescape(html[at:]), link))
    close_block()
    around = around_elements(elements, found)
    for b in found:
        e = b.pop("element")
        b["around"] = e >= 0 and around[e]
    return found


def around_elements(elements: list[tuple[int, bool, float, float]], blocks: list[dict]) -> list[bool]:
    """Which elements stand around the article, or lie in one that does.

    Names and words weigh less the more of the page's prose (long blocks, without links) an element holds; where a page
    has no long block, all its text counts for words, and names hold. Beside an article with text, whole class names hold
    however much lies in the element. A wrapper of an article (but for
    cards, less than half as long as the longest one) stands around nothing.
    """
    long_ones = any(len(b["text"]) - b["linked"] >= LONG for b in blocks)
    chars = [0] * len(elements)
    total = 0
    for b in blocks:
        n = max(0, len(b["text"]) - b["linked"])
        own = n if n >= LONG or not long_ones else 0
        total += own
        if b["element"] >= 0:
            chars[b["element"]] += own
    for e in range(len(elements) - 1, -1, -1):
        if elements[e][0] >= 0:
            chars[elements[e][0]] += chars[e]
    longest = max((n for n, x in zip(chars, elements) if x[1]), default=0)
    wraps = [False] * len(elements)
    for e in range(len(elements) - 1, -1, -1):
        parent, is_article, _, _ = elements[e]
        if parent >= 0 and (wraps[e] or (is_article and 2 * chars[e] >= longest > 0)):
            wraps[parent] = True
    any_article = any(b["article"] and len(b["text"]) > b["linked"] for b in blocks)
    inside: list[bool] = []
    out: list[bool] = []
    for e, (parent, is_article, by_name, by_words) in enumerate(elements):
        inside.append(is_article or (parent >= 0 and inside[parent]))
        elsewhere = by_words == MOST_NAMED and any_article and not inside[e]
        said = (by_name > 0 and (not long_ones or elsewhere or chars[e] <= by_name * total)) or (by_words > 0 and (elsewhere or chars[e] <= by_words * total))
        out.append((said and not wraps[e]) or (parent >= 0 and out[parent]))
    return out


# The two passes ----------------------------------------------------------------------------------------------------------


def density(text: str) -> float:
    """Share of stop words among the words of a text."""
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _ends_a_sentence(text: str) -> bool:
    return text.rstrip("\"'»”’)]")[-1:] in (".", "!", "?", "…", "。")


def _menus(blocks: list[dict], linked: list[bool]) -> list[bool]:
    """Which linked blocks are of a menu: items of lists, and short ones that stand next to one another, short ones without links passed over."""
    out, last = [is_linked and b["item"] for b, is_linked in zip(blocks, linked)], None
    for k, b in enumerate(blocks):
        if not linked[k] and len(b["text"]) < LONG:
            continue
        if linked[k] and len(b["text"]) < LONG:
            if last is not None:
                out[last] = out[k] = True
            last = k
        else:
            last = None
    return out


def first_pass(blocks: list[dict]) -> list[tuple[bool | None, str]]:
    """(good, bad or None for open; the rule that said so) of each block, by what it holds and where it lies.

    - around: it stands around the article, or states a copyright. linked: most of it is in links. Inside an article
      only menus are bad for that; long blocks go by their words, other short ones stay open; outside, long ones with
      sentences stay open too.
    - dense: long, with many stop words, which is good anywhere. Where most of the long text of a page is not dense,
      it is in another language, and every long block is good (foreign), but outside an article that holds most of
      the long text it stays open.
    - sparse: long without any stop word. Bad if partly linked, or outside an article and not a sentence.
    """
    linked = [b["linked"] > MOST_LINKED * len(b["text"]) for b in blocks]
    dense = [density(b["text"]) for b in blocks]
    menu = _menus(blocks, linked)
    inside = outside = dense_chars = thin_chars = 0
    for b, is_linked, d in zip(blocks, linked, dense):
        n = len(b["text"])
        if b["around"] or is_linked:
            continue
        inside += n if b["article"] else 0
        if n >= LONG:
            outside += 0 if b["article"] else n
            dense_chars += n if d >= DENSE else 0
            thin_chars += n if d < DENSE else 0
    foreign = thin_chars > dense_chars
    against = inside >= outside and any(b["article"] and not b["around"] for b in blocks)
    out: list[tuple[bool | None, str]] = []
    for b, is_linked, d, of_menu in zip(blocks, linked, dense, menu):
        text, n, article = b["text"], len(b["text"]), b["article"]
        if b["around"] or (n < 2 * LONG and not article and ("©" in text or "all rights reserved" in text.lower())):
            out.append((False, "around"))
        elif is_linked and not (d >= DENSE and n >= LONG) and (of_menu or not article or n >= LONG):
            out.append((False, "linked"))
        elif n < LONG or (is_linked and not article):
            out.append((None, ""))
        elif d >= DENSE:
            out.append((True, "dense"))
        elif foreign:
            out.append((True, "foreign") if article or not against else (None, ""))
        elif not d and (b["linked"] > PARTLY_LINKED * n or not (article or _ends_a_sentence(text))):
            out.append((False, "sparse"))
        else:
            out.append((None, ""))
    return out


def main_blocks(blocks: list[dict]) -> list[tuple[bool, str]]:
    """(is it of the main text, the rule that said so) of each block: first_pass(), then open blocks by their neighbours.

    An open block takes the label of the nearest decided block: of that before and that after it, the one that it shares
    the inner element with, then the one with fewer blocks between, then, for a heading, the later. On a tie it is good if it
    lies in an article, is a heading, or has a stop word or the end of a sentence; so it must to follow good text that
    does not stand beside it and only the page itself holds together with it. In an article, what stands around does not count, and without any other decided block
    there it is good, but for a link. If all that leaves no block (short pages), those that are not bad are good: beside a first heading,
    only those from there on.
    """
    first = first_pass(blocks)
    counts = lambda k: first[k][0] is not None and not (blocks[k]["article"] and first[k][1] == "around")

    def nearest(order) -> list[tuple[int, int, int] | None]:
        """For each block the decided one met last: how deep the element lies that holds both, blocks between, place."""
        out: list[tuple[int, int, int] | None] = [None] * len(blocks)
        last, depth, before = None, 0, None
        for k in order:
            if before is not None:
                depth = min(depth, blocks[max(k, before)]["meet"])
            if last is not None:
                out[k] = (depth, -abs(k - last), last)
            if counts(k):
                last, depth = k, 1 << 30
            before = k
        return out

    before, after = nearest(range(len(blocks))), nearest(range(len(blocks) - 1, -1, -1))
    page = min((b["meet"] for b in blocks[1:]), default=0)
    out: list[tuple[bool, str]] = []
    for k, (b, (label, rule)) in enumerate(zip(blocks, first)):
        if label is None:
            said, rule = b["article"] or b["heading"] or density(b["text"]) > 0 or _ends_a_sentence(b["text"]), "neighbour"
            near = [x for x in (before[k], after[k]) if x is not None and (not b["article"] or blocks[x[2]]["article"])]
            if not near:
                label, rule = b["article"] and b["linked"] <= MOST_LINKED * len(b["text"]), "article"
            else:
                best = max(x[:2] for x in near)
                labels = [bool(first[x[2]][0]) for x in near if x[:2] == best]
                label = labels[-1] if b["heading"] else (any(labels) and (said or all(labels)))
                beside = any(x[:2] == best and b["level"] == blocks[x[2]]["level"] == best[0] for x in near)
                if label and not said and not beside and best[0] <= page:
                    label = False
        out.append((bool(label), rule))
    if any(label for label, _ in out):
        return out
    start = next((k for k, b in enumerate(blocks) if b["heading"] and first[k][0] is None), 0)
    return [(first[k][0] is None and k >= start, rule if first[k][0] is not None else "short page") for k, (_, rule) in enumerate(out)]


def extract_text(html: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks, number of blocks kept."""
    blocks = blocks_of(html or "")
    kept = [b["text"] for b, (good, _) in zip(blocks, main_blocks(blocks)) if good]
    return " ".join(kept), len(blocks), len(kept)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text, n_chars (code points), n_blocks and n_kept: one row for each page.

    - Null and empty html give an empty text. Pages cut off in a tag, comment or script are read up to there.
    - Repeated rows stay repeated; a null in a kept column is kept; other columns are ignored, whatever their names.
    - No rows give no rows. Pages of any length are read whole.
    """
    schema = pages.select(*[F.col(f"`{c}`") for c in keep]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, blocks, kept = [], [], []
            for html in batch.column(len(keep)):
                text, n, k = extract_text(html.as_py())
                texts.append(text)
                blocks.append(n)
                kept.append(k)
            own = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(blocks, pa.int32()), pa.array(kept, pa.int32())],
                names=[*keep, "text", "n_chars", "n_blocks", "n_kept"],
            )

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "text string", "n_chars long", "n_blocks int", "n_kept int"])
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col)).mapInArrow(run, out)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
