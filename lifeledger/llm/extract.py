"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: a block inside a part that is never main
text (navigation, advert, form and the like, by tag, role or class) is bad; outside an article element
a block whose words are mostly link text is bad; a long block with enough stop words, or inside an
article, is good; the rest is ambiguous. If a page has no article and no good block, its language may be
none of those known, and its long ambiguous blocks are good. Second pass: ambiguous blocks take the
label of the nearest decided blocks in page order, of the same part of the page if it has any: good if
both neighbours are, or the nearer one, or either of two as near; blocks of an article without a decided
neighbour are good, others bad. No class bans html, body, main, article or what holds a main or article.

Character references are decoded, white space inside a block becomes one space, and the good blocks are
joined by a line feed. Null or empty html gives an empty text. Tags that are cut off at the end of the
page, and unclosed elements, end with the page. Pages are handled one by one, so repeated rows give
repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lifeledger.llm.common import by_value

# Elements that open a block, that hold no text, whose content is never main text.
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg object xmp noembed noframes".split())
NEVER = set(
    "head nav footer aside form header menu button select dialog fieldset canvas audio video label legend".split()
)
MAIN = {"article", "main"}
#: Elements that no class bans.
FRAME = MAIN | {"html", "body"}
NEVER_ROLE = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Names of parts that are never main text, as whole tokens of a class or an id. Inside an article only those of the
#: first list count: the others may name a part of it.
_ANYWHERE = (
    r"ads?|advert(?:s|isements?|ising)?|ad-?(?:banner|box|container|slot|unit|wrapper)|sponsored|nav|navbar|navigation|"
    r"(?:main|site|page|top|footer|sub)-?(?:nav|navigation|menu|header|footer)|breadcrumbs?|cookies?|cookie-?(?:notice|banner|consent|bar)|"
    r"gdpr|newsletter|subscribe|signup|login|share|sharing|share-?(?:bar|buttons?|links)|social|social-?(?:bar|buttons?|icons|links|media|share)|"
    r"comments?|comments?-?(?:area|form|list|section|thread|wrapper)|disqus(?:_thread)?|replies|respond|skip-?link|hidden"
)
_OUTSIDE = (
    r"sponsors?|promo|promotions?|banner|menu|sidebar|side-bar|(?:left|right)-sidebar|aside|header|footer|masthead|consent|notices?|"
    r"alerts?|popup|modal|overlay|related|related-?(?:articles|content|links|posts)|recommended|recommendations?|reply|pagination|pager|"
    r"widgets?|toolbar|copyright|legal"
)
NEVER_TOKEN = re.compile(rf"(?:{_ANYWHERE}|{_OUTSIDE})", re.I)
NEVER_INSIDE = re.compile(rf"(?:{_ANYWHERE})", re.I)
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!|;|$)", re.I)
#: Headings over reader comments that no class or id names.
COMMENTS = re.compile(
    r"(?:\d+\s+)?(?:(?:reader|user)s?['’]?\s+)?(?:comments?|responses?|repl(?:y|ies)|kommentare?|commentaires?|comentarios?)(?:\s*\(\d+\))?:?|"
    r"leave a (?:comment|reply)", re.I,
)
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Elements whose start ends an open paragraph; and for others, what their start ends and where the search for that stops.
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul li dd dt".split()
)
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "caption"}, {"table"}),
    "thead": ({"caption", "tbody"}, {"table"}),
}
SCOPE = {"table", "td", "th", "caption", "button", "html", "object"}
STOP_WORDS = set(
    "the of and to in is that it for on was as be with by this from are or an not at have which "
    "der die und das den von zu mit sich des ist im dem nicht ein eine als auch es auf für "
    "le la les et de des du un une en que qui dans pour par sur est au avec pas ce il "
    "el los las y del que en un una por con para se es al lo como más".split()
)
#: Words of a long block, share of stop words in it, share of link text that makes a block bad.
LONG, STOP_SHARE, LINK_SHARE = 10, 0.15, 0.5
#: Characters of a long block in a script without spaces.
LONG_CHARS = 40

# A tag by the rules of HTML: a quotation mark opens a value only after an equals sign, elsewhere it belongs to a name.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|"
    r"</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+)*+(?:>|\Z)|"
    r"[^<]+|<", re.S,
)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+""")


def _banned(name: str, tag: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is never main text for its name, role or hiding, and whether for its class or id."""
    if name in NEVER:
        return True, False
    found: dict[str, str] = {}
    for key, value in ATTRIBUTE.findall(tag, NAME.match(tag).end()):
        value = value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value
        found.setdefault(key.lower(), entities.unescape(value).strip())
    role, hidden = found.get("role", "").lower(), found.get("aria-hidden", "").lower()
    if "hidden" in found or hidden == "true" or role in NEVER_ROLE or INVISIBLE.search(found.get("style", "")):
        return True, False
    never = NEVER_INSIDE if inside else NEVER_TOKEN
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    return False, name not in FRAME and any(never.fullmatch(t) for t in tokens)


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """Blocks in page order: text, its words, words inside links, in a banned part, in an article.

    A heading over reader comments bans what follows it, up to the next heading of its rank or the end of
    the element around it.
    """
    out, text, linked = [], [], []
    # What bans a part is a list of the open elements that do; one that a class bans is lifted by an article in it.
    stack: list[tuple[str, tuple[int, ...], bool]] = []
    banned: tuple[int, ...] = ()
    by_class: list[bool] = []
    lifted: set[int] = set()
    main = False
    links = 0
    # Open element count and rank of the heading over reader comments, while they last.
    readers: tuple[int, int] | None = None

    def close() -> None:
        nonlocal readers
        words = entities.unescape("".join(text)).split()
        if words:
            in_link = len(entities.unescape(" ".join(linked)).split())
            rank = next((HEADINGS[x[0]] for x in reversed(stack) if x[0] in HEADINGS), 0)
            if rank and readers and rank <= readers[1]:
                readers = None
            if rank and COMMENTS.fullmatch(" ".join(words)):
                around = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in HEADINGS)
                readers = (around, rank)
            out.append((" ".join(words), len(words), in_link, banned if readers is None else (*banned, -1), main))
        text.clear()
        linked.clear()

    def pop(k: int) -> None:
        """Close the open element ``k`` and all inside it."""
        nonlocal banned, main, links, readers
        close()
        _, banned, main = stack[k]
        if any(x[0] in BLOCK for x in stack[k:]):
            links = 0
        del stack[k:]
        if readers and len(stack) < readers[0]:
            readers = None

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        piece, at = m.group(), m.end()
        if piece[0] != "<" or piece == "<":
            text.append(piece)
            if links:
                linked.append(piece)
            continue
        name = NAME.match(piece)
        if not name:
            continue
        name = name.group(1).lower()
        if name == "a":
            links = max(0, links - 1) if piece[1] == "/" else links + 1
        if name in BLOCK or name in RAW:
            close()
        if piece[1] == "/":
            # An end tag closes the nearest open element of its name, and all inside it.
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop(k)
                    break
            continue
        if name in RAW and not piece.endswith("/>"):
            stop = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in ENDS_P:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in SCOPE), -1)
            if k >= 0 and stack[k][0] == "p":
                pop(k)
        if name in ENDS:
            ended, scope = ENDS[name]
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ended or stack[k][0] in scope), -1)
            if k >= 0 and stack[k][0] in ended:
                pop(k)
        if name in VOID or piece.endswith("/>"):
            continue
        inside = main or name in MAIN
        # An article's own heading group is no page header.
        bad = banned
        if not (name == "header" and main):
            always, for_class = _banned(name, piece, main)
            if always or for_class:
                bad = (*banned, len(by_class))
                by_class.append(for_class)
        if name in MAIN:
            lifted.update(k for k in banned if by_class[k])
        if (bad, inside) != (banned, main):
            close()
        if name in BLOCK or bad != banned or inside != main:
            stack.append((name, banned, main))
        banned, main = bad, inside
    close()
    return [(*block[:3], not lifted.issuperset(block[3]), block[4]) for block in out]


def labels(found: list[tuple[str, int, int, bool, bool]]) -> list[bool]:
    """Whether each block is main text."""
    first: list[bool | None] = []
    for text, n, in_link, banned, main in found:
        if banned or (in_link > LINK_SHARE * n and not main):
            first.append(False)
        elif n >= LONG:
            stop = sum(w.strip(".,;:!?\"'()").lower() in STOP_WORDS for w in text.split())
            first.append(True if stop >= STOP_SHARE * n or main else None)
        else:
            first.append(None)
    if True not in first and not any(main and not banned for *_, banned, main in found):
        for k, (text, n, *_) in enumerate(found):
            if first[k] is None and (n >= LONG or len(text) >= LONG_CHARS):
                first[k] = True
    # Nearest decided block before and after, inside runs of blocks of the same part.
    out: list[bool] = []
    size = len(found)
    before: list[int] = [-1] * size
    after: list[int] = [-1] * size
    for k in range(size):
        if k and found[k][3:] == found[k - 1][3:]:
            before[k] = k - 1 if first[k - 1] is not None else before[k - 1]
    for k in range(size - 2, -1, -1):
        if found[k][3:] == found[k + 1][3:]:
            after[k] = k + 1 if first[k + 1] is not None else after[k + 1]
    for k in range(size):
        if first[k] is not None:
            out.append(first[k])
            continue
        i, j = before[k], after[k]
        near = [x for x in (i, j) if x >= 0]
        if not near:
            out.append(found[k][4])
        elif len(near) == 2 and first[i] != first[j]:
            out.append(first[i] if k - i < j - k else first[j] if j - k < k - i else True)
        else:
            out.append(bool(first[near[0]]))
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, good in zip(found, labels(found)) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


by_value(__name__)
