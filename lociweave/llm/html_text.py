"""Main text of HTML pages by minimum cut.

A page is cut into text blocks at block-level tags. A linear classifier gives each block a score for
being content: a positive score is its capacity from the source, a negative one its capacity to the
sink. Consecutive blocks, and blocks near each other below the same element, are joined by smoothness
edges. The minimum cut of that graph separates content (source side) from boilerplate.

What an element says of itself is evidence of three strengths, not a verdict: an element made for it (``nav``,
``article``) or a whole class name (``sidebar``) counts much, one word of a longer class name (``post-header``)
little, so that a long paragraph and its neighbours outweigh it. Below several such elements the costs add up no further.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociweave.llm.side_tables import sliced

#: Weights of the classifier, in units of log odds.
WEIGHTS = {"base": -0.6, "main": 3.0, "boilerplate": -6.0, "hint": -1.0, "heading": 1.2, "sentence": 0.5, "words": 0.06, "links": -3.0, "links in main": -1.5, "list": -0.4}
#: No more words than this count.
MOST_WORDS = 30
#: Scripts without spaces: Han, kana and bopomofo have about two letters a word; Thai, Lao, Myanmar and Khmer about four.
IN_TWOS = re.compile("[\u3005-\u3007\u3041-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af]")
IN_FOURS = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: Smoothness of consecutive blocks below the same element, of a heading and what follows, of others, and of blocks below one element that are 2 or 3 apart.
SAME, HEADED, OTHER, NEAR = 0.7, 1.0, 0.15, {2: 0.3, 3: 0.15}

BREAKS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio canvas iframe".split()
)
SKIPPED = frozenset("script style noscript template title textarea svg iframe head".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select div section article main nav aside footer header form body td th li blockquote".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog button select label fieldset option dir".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar sidenav widget related recommended recommendations share sharing social follow comment comments commentlist disqus reply replies respond discussion footer header masthead topbar nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar search copyright legal skip".split()
)
#: Of these, the words that mean the same in a longer class name.
CERTAIN_WORDS = frozenset("ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner widget related recommended recommendations comment cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login sidebar sidenav commentlist comments disqus respond discussion nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar copyright".split())
#: With one of these the others are certain too, as are two of them in one name.
WHOLE_PAGE = frozenset("site page global".split())
MAIN_WORDS = frozenset("article articlebody content maincontent post postbody entry story main body text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[/A-Za-z][^<>]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
ENDS = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in SKIPPED}
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("heading", "item", "linked", "mark", "parent", "size", "text")

    def __init__(self, text, linked, size, mark, parent, heading, item):
        self.text, self.linked, self.size, self.mark, self.parent, self.heading, self.item = text, linked, size, mark, parent, heading, item


#: Marks of an element: boilerplate, a hint of it, main text, main text with such a hint inside; nothing is 0.
BOILERPLATE, HINT, MAIN, MAIN_HINT = -2, -1, 1, 2


def _own_mark(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element says of what it holds, and whether it is a page header."""
    said = MAIN if tag in ("article", "main") else BOILERPLATE if tag in BOILERPLATE_TAGS else 0
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                whole = set(value.split())
                words = set(re.split(r"[^a-z]+", value))
                if tag not in ("body", "html", "article", "main"):
                    if whole & BOILERPLATE_WORDS or words & CERTAIN_WORDS or any(len(BOILERPLATE_WORDS.union(WHOLE_PAGE).intersection(re.split(r"[^a-z]+", w))) > 1 for w in whole):
                        return BOILERPLATE, False
                    if words & BOILERPLATE_WORDS:
                        said = min(said, HINT) if said <= 0 else said
                if words & MAIN_WORDS and not said:
                    said = MAIN
            elif name == "role" and value in BOILERPLATE_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return BOILERPLATE, False
            elif name == "role" and value == "main" or name == "itemprop" and value == "articlebody":
                said = MAIN
    return said, tag == "header"


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order. Broken markup ends where a browser would roughly end it; nothing raises."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, mark that holds below it, number of the element
    pieces: list[tuple[str, bool]] = []
    standing: Counter = Counter()  # tags on the stack
    anchors = elements = 0

    def cut_to(i):
        standing.subtract(s[0] for s in stack[i:])
        del stack[i:]

    def flush():
        nonlocal pieces
        if pieces:
            # References end where their run of text ends: markup between their letters makes them plain letters.
            text = SPACE.sub(" ", "".join(unescape(p) for p, _ in pieces)).strip()
            if text:
                linked = sum(len(p) for p, link in pieces if link)
                tags = [s[0] for s in stack[-2:]]
                out.append(Block(text, linked, max(1, sum(len(p) for p, _ in pieces)), stack[-1][1], stack[-2][2] if len(stack) > 1 and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li") else stack[-1][2], any(re.fullmatch("h[1-6]", t) for t in tags), "li" in tags))
            pieces = []

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            pieces.append((html[at:], anchors > 0))
            break
        if m.start() > at:
            pieces.append((html[at : m.start()], anchors > 0))
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in BREAKS:
                flush()
                anchors = 0
                if standing[tag]:
                    cut_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        if tag in SKIPPED:
            if tag in BREAKS or tag == "head":
                flush()
            if not m[3].rstrip().endswith("/"):
                closing = ENDS[tag].search(html, at)
                if closing is not None:
                    at = closing.end()
                elif tag in ("script", "style"):
                    at = end
            continue
        if tag == "br":
            pieces.append((" ", anchors > 0))
        elif tag == "a":
            anchors += 1
        elif tag in BREAKS:
            flush()
            anchors = 0
            if tag in EMPTY:
                continue
            closes = SELF_CLOSING.get(tag, {"p"})
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closes:
                    cut_to(i)
                    break
                if stack[i][0] in SCOPES:
                    break
            elements += 1
            said, header = _own_mark(tag, m[3])
            above = stack[-1][1]
            if header and above not in (MAIN, MAIN_HINT):  # within an article a header holds its title
                said = BOILERPLATE
            if BOILERPLATE in (above, said):
                mark = BOILERPLATE
            elif HINT in (above, said) or MAIN_HINT in (above, said):
                mark = MAIN_HINT if {above, said} & {MAIN, MAIN_HINT} else HINT
            else:
                mark = said or above
            stack.append((tag, mark, elements))
            standing[tag] += 1
    flush()
    return out


def score(block: Block) -> float:
    words = block.text.count(" ") + 1
    if not block.text.isascii():
        words += sum(1 for _ in IN_TWOS.finditer(block.text)) // 2 + sum(1 for _ in IN_FOURS.finditer(block.text)) // 4
    words = min(MOST_WORDS, words)
    s = WEIGHTS["base"] + words * WEIGHTS["words"] + WEIGHTS["links in main" if block.mark > 0 else "links"] * min(1.0, block.linked / block.size)
    if block.mark == BOILERPLATE:
        s += WEIGHTS["boilerplate"]
    if block.mark in (HINT, MAIN_HINT):
        s += WEIGHTS["hint"]
    if block.mark in (MAIN, MAIN_HINT):
        s += WEIGHTS["main"]
    if block.heading:
        s += WEIGHTS["heading"]
    if block.text[-1] in ".!?\"'…。！？":
        s += WEIGHTS["sentence"]
    if block.item:
        s += WEIGHTS["list"]
    return s


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges = []
    for i in range(1, len(blocks)):
        same = blocks[i].parent == blocks[i - 1].parent
        edges.append((i - 1, i, HEADED if blocks[i - 1].heading else SAME if same else OTHER))
        edges += [(i - d, i, w) for d, w in NEAR.items() if i >= d and blocks[i].parent == blocks[i - d].parent]
    return edges


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    A node whose terminal capacity is no less than that of all its edges together has its side in some
    minimum cut; fixing it moves its edges into its neighbours' capacities. What is left goes through
    augmenting paths.
    """
    n = len(scores)
    s, near = list(scores), [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    around = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if side[i] is None and abs(s[i]) >= around[i]:
            side[i] = s[i] > 0
            for j, w in near[i].items():
                if side[j] is None:
                    s[j] += w if side[i] else -w
                    around[j] -= w
                    queue.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        flow = {i: {j: w for j, w in near[i].items() if side[j] is None} for i in rest}
        give, take = {i: max(0.0, s[i]) for i in rest}, {i: max(0.0, -s[i]) for i in rest}
        while True:
            parent = {i: None for i in rest if give[i] > 1e-9}
            queue, found = deque(parent), None
            while queue:
                i = queue.popleft()
                if take[i] > 1e-9:
                    found = i
                    break
                for j, w in flow[i].items():
                    if w > 1e-9 and j not in parent:
                        parent[j] = i
                        queue.append(j)
            if found is None:
                break
            path = [found]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            root = path[-1]
            much = min([give[root], take[found], *(flow[b][a] for a, b in zip(path, path[1:], strict=False))])
            give[root] -= much
            take[found] -= much
            for a, b in zip(path, path[1:], strict=False):
                flow[b][a] -= much
                flow[a][b] = flow[a].get(b, 0.0) + much
        for i in rest:
            side[i] = i in parent
    return [bool(x) for x in side]


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    keep = minimum_cut([score(b) for b in blocks], smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars in place of the html; one row per input row.

    Null or empty html, or html without content, gives an empty text. Repeated rows give equal texts. Other
    columns pass through; those named text or n_chars are replaced. Pages of any length and nesting are read
    whole; of equally good cuts the one with least content is taken. An empty table gives an empty one.
    """
    pages = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars", html_col)], F.col(html_col).cast("string").alias("__html"))
    schema = T.StructType([*pages.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = schema.names

    def run(batches):
        for batch in sliced(batches):
            texts = [main_text(h or "") for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return pages.mapInArrow(run, schema)


def op3_html_text(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
