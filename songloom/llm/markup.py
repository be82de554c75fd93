"""A small, forgiving reader of web pages: a tree of elements, and the text in it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from html import unescape

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
# A start tag of the key closes an open element of the value, inside the nearest container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# What may go where it recurs: parts that hold others; and outside articles and main parts texts, if in the same place.
CONTAINERS = frozenset("div section ul ol dl table figure details header footer nav aside".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre address hgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
LEVEL = {"main": 1, "article": 2}
# Bare text of so many characters counts as running text.
LONG_TEXT = 300
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button select textarea input"
    " menu dialog audio video map".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Words in class names and ids. Parts with a plain one are no article text; a hint needs
# more evidence; names of text outweigh hints; what a layout has or lacks says nothing of its content.
READERS = frozenset("ad ads adsense adslot advert adverts advertisement advertising comment comments commentlist consent cookie cookies disqus gdpr respond".split())
PLAIN = READERS | frozenset(
    "breadcrumb breadcrumbs footer menu menubar modal nav navbar navigation newsletter pagination popup sidebar signup skiplink subscribe toolbar".split()
)
HINTS = frozenset("alert banner notice notification promo related share sharing social sponsor sponsored widget".split())
OF_TEXT = frozenset("article body content copy entry main post prose story text".split())
OF_LAYOUTS = frozenset("disabled enabled has is layout no non page template theme with without".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_ENDS = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)


class Element:
    __slots__ = ("tag", "attributes", "children", "hash", "keys", "shape", "chars", "linked", "running", "holds", "vote", "_named")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Element | str] = []
        self.hash = self.shape = 0
        # What the element is counted by where it recurs; set by ``hash_subtrees``.
        self.keys: tuple[int, ...] = ()
        # Set by ``measure``: characters in all, in links, in running text; parts that it holds (1 main, 2 article); by ``hash_subtrees``: what it says of its shape.
        self.chars = self.linked = self.running = self.holds = self.vote = 0
        self._named: dict[str, str] | None = None

    def named(self) -> dict[str, str]:
        if self._named is None:
            found = reversed(_ATTRIBUTE.findall(self.attributes)) if self.attributes else ()
            self._named = {k.lower(): unescape(a or b or c) for k, a, b, c in found}
        return self._named

    def kind(self) -> str:
        """``main`` or ``article`` by tag or role, else the tag."""
        if self.tag in ("main", "article") or not self.attributes:
            return self.tag
        role = self.named().get("role", "").lower()
        return role if role in ("main", "article") else self.tag

    def hidden(self) -> bool:
        if self.tag in ("html", "body") or not self.attributes:
            return False
        named = self.named()
        return "hidden" in named or named.get("aria-hidden", "").lower() == "true" or bool(_NOT_SHOWN.search(named.get("style", "")))

    def name(self) -> str:
        """What class and id say: ``readers`` (adverts, comments), ``plain``, ``hint`` or nothing."""
        if self.tag in ("html", "body") or not self.attributes or self.kind() in ("main", "article"):
            return ""
        named = self.named()
        tokens = named.get("class", "").split()
        # Headings and paragraphs have ids as anchors.
        tokens += [] if self.tag in TEXTS else named.get("id", "").split()
        found = [frozenset(_WORDS.findall(_HUMPS.sub("-", token).lower())) for token in tokens]
        found = [words for words in found if not words & OF_LAYOUTS]
        for kind, listed in (("readers", READERS), ("plain", PLAIN)):
            if any(words & listed for words in found):
                return kind
        if any(words & HINTS for words in found) and not any(words & OF_TEXT for words in found):
            return "hint"
        return ""

    def furniture(self, inside: int, whole: int) -> bool:
        """Whether the element is no main text by its kind or names.

        ``inside`` a main part (1) or article (2); ``whole`` is how many characters the part has that
        the text is read from. What holds most of them goes only if its kind or name leaves no
        doubt.
        """
        if self.hidden():
            return True
        most = 2 * self.chars > whole
        if self.tag in DROPPED or self.tag == "header" and not inside:
            return not (self.tag in ("form", "header") and (self.holds or most and self.running))
        if self.attributes and self.named().get("role", "").lower() in ROLES:
            return not self.holds
        name = self.name()
        if not name or self.holds & 1:
            return False
        if name == "readers":
            return True
        # A name may be only that of a layout: what has it holds an article, and is in none.
        if self.holds & 2 and inside < 2:
            return False
        if self.tag in TEXTS and name == "hint":
            return False
        if not inside:
            return not (most and self.running)
        if most:
            return False
        return name == "plain" or not self.running or 2 * self.linked >= self.chars


_WORDS = re.compile(r"[a-z]+")
_HUMPS = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Open:
    """The open elements, and at what depths each kind is open."""

    def __init__(self, root: Element) -> None:
        self.stack, self.depths = [root], {}

    def push(self, element: Element) -> None:
        self.depths.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def deepest(self, tags: Iterable[str]) -> int:
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.depths[self.stack.pop().tag].pop()


def parse(page: str) -> Element:
    """The tree of a page; what is not closed ends with what is around it. Linear in the page."""
    root = Element("html")
    open_ = _Open(root)
    at, end = 0, len(page)
    while at < end:
        found = _TAG.search(page, at)
        if not found:
            open_.stack[-1].children.append(page[at:])
            break
        if found.start() > at:
            open_.stack[-1].children.append(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag, attributes = found[2].lower(), found[3].strip()
        if found[1]:
            if depth := open_.deepest((tag,)):
                open_.cut(depth)
            continue
        if tag == "html":
            continue
        if tag in BLOCKS and tag != "body" and (depth := open_.deepest(("p",))):
            # A block inside a paragraph ends it, with what is open in it.
            open_.cut(depth)
        if tag in CLOSES:
            closed, around = CLOSES[tag]
            depth, limit = open_.deepest(closed), open_.deepest(around)
            while depth > limit:
                outer = depth
                open_.cut(depth)
                depth = open_.deepest(closed)
                if depth >= outer:
                    break
        element = Element(tag, attributes.rstrip("/").strip())
        open_.stack[-1].children.append(element)
        if tag in RAW:
            close = _RAW_ENDS[tag].search(page, at)
            stop = close.start() if close else end
            element.children.append(page[at:stop])
            at = stop
            open_.push(element)
        elif tag not in VOID:
            open_.push(element)
    measure(root)
    return root


def measure(root: Element) -> None:
    """Count characters, those in links and in running text, and note held main parts and articles, from the leaves up."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Element))
    for node in reversed(order):
        if node.tag in RAW or node.tag == "head" or node.hidden():
            continue
        own = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
                continue
            node.chars += child.chars
            node.linked += child.linked
            node.running += child.running
            kind = child.kind()
            node.holds |= child.holds | ((kind == "main") + 2 * (kind == "article") if child.chars else 0)
        node.chars += own
        if node.tag == "a":
            node.linked = node.chars
        if node.tag in TEXTS:
            node.running = node.chars - node.linked
        elif own >= LONG_TEXT:
            node.running += own


def blocks(element: Element, dropped: frozenset[int] | set[int], inside: int = 0, lists: bool = True) -> Iterator[str]:
    """Texts of the blocks of a tree, in page order, without furniture and dropped hashes.

    Without ``lists`` only dropped hashes go, and what no reader sees.
    """
    held: list[str] = []
    # One stack instead of recursion: pages may nest without limit.
    stack: list[tuple[Element | str | None, int]] = [(element, inside)]
    while stack:
        node, inner = stack.pop()
        if isinstance(node, str):
            held.append(node)
            continue
        if node is not None:
            if node is not element and goes(node, dropped, inner, element.chars, lists):
                if node.tag in BLOCKS:
                    node = None
                else:
                    held.append(" ")
                    continue
            elif node.tag == "br":
                held.append("\n")
                continue
        if node is None or node.tag in BLOCKS:
            text = " ".join(unescape("".join(held)).split())
            if text:
                yield text
            held = []
        if node is not None:
            inner = max(inner, LEVEL.get(node.kind(), 0))
            if node.tag in BLOCKS:
                stack.append((None, inner))
            stack.extend((child, inner) for child in reversed(node.children))
    text = " ".join(unescape("".join(held)).split())
    if text:
        yield text


def goes(node: Element, dropped: frozenset[int] | set[int], inside: int, whole: int, lists: bool = True) -> bool:
    if dropped and (removable(node, inside) and not dropped.isdisjoint(node.keys) or node.shape in dropped and node.vote >= 0 and shaped(node, inside)):
        return True
    if lists:
        return node.furniture(inside, whole)
    return node.tag in RAW or node.tag == "head" or node.hidden()


def removable(node: Element, inside: int) -> bool:
    """Whether a recurring subtree may go: in an article or main part only parts that hold others.

    Headings, paragraphs and the like in an article are its text, also where a sentence
    recurs on many pages. Rows, items and words in a line go only with what is around them.
    """
    return not node.holds and (node.tag in CONTAINERS or not inside and (node.tag in TEXTS or node.tag in DROPPED))


def shaped(node: Element, inside: int) -> bool:
    """Whether a subtree may go because its shape recurs: in an article only if its name hints at it."""
    return node.tag in CONTAINERS and not node.holds and (not inside or node.name() == "hint")


def _vote(node: Element, page: int) -> int:
    """What a part says of its shape, on a page of so many characters, apart from its names.

    1: furniture, as it is mostly links, or a little text that does not run; -1: text, as it
    runs or is most of the page; 0: neither.
    """
    if node.chars and (2 * node.linked >= node.chars or not node.running and 5 * node.chars <= page):
        return 1
    return -1 if node.running or 2 * node.chars > page else 0


def main_parts(root: Element, dropped: frozenset[int] | set[int] = frozenset()) -> list[tuple[Element, int]]:
    """The parts that the text is read from: 1 main parts, 2 articles, 0 the page.

    The visible main parts; without any, the articles, unless the page has its heading and
    paragraphs, or more running text, outside of them (then they are teasers beside it); without
    these, the page. Parts inside furniture come after the others.
    """
    found: dict[tuple[bool, str], list[Element]] = {(far, kind): [] for far in (False, True) for kind in ("main", "article")}
    headings, running, outside = False, 0, 0
    stack = [(root, False, "")]
    while stack:
        node, far, within = stack.pop()
        if node is not root:
            if node.tag in RAW or node.tag == "head" or node.hidden():
                continue
            far = far or node.kind() not in ("main", "article") and goes(node, dropped, LEVEL.get(within, 0), root.chars)
        kind = node.kind()
        if kind in ("main", "article") and node.chars and within != kind and not (within and kind == "article"):
            if not (within == "main" and kind == "main"):
                found[far, kind].append(node)
            within = kind
        if not within and not far and node.tag in TEXTS:
            outside += node.running
            headings = headings or node.tag == "h1" and node.chars > 0
            running = running or node.tag not in HEADINGS and node.running > 0
        if within == "article":
            # An article in an article is part of it.
            continue
        stack.extend((c, far, within) for c in reversed(node.children) if isinstance(c, Element))
    for (far, kind), parts in found.items():
        if not any(True for p in parts for _ in blocks(p, dropped, LEVEL[kind])):
            continue
        if kind == "article" and not far:
            inner = sum(p.running for p in parts)
            titled = headings and not any(_has_heading(p) for p in parts)
            if running and (titled or outside > inner):
                return [(root, 0)]
        return [(p, LEVEL[kind]) for p in parts]
    return [(root, 0)]


def _has_heading(part: Element) -> bool:
    stack = [part]
    while stack:
        node = stack.pop()
        if node.tag == "h1":
            return True
        stack.extend(c for c in node.children if isinstance(c, Element))
    return False


def hash_subtrees(root: Element) -> None:
    """Give every element a hash of its kind, names, texts and children, and its keys.

    The key of a text outside a container is its hash with its place, once counted from the
    start and once from the end of what is around it: a short sentence may recur by chance,
    but not in one place.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Element))
    for node in reversed(order):
        h = hashlib.blake2b(f"{node.tag}\0{node.attributes}".encode("utf-8", "replace"), digest_size=8)
        for child in node.children:
            if isinstance(child, str):
                h.update(b"\1" + " ".join(child.split()).encode("utf-8", "replace"))
            else:
                h.update(b"\2" + child.hash.to_bytes(8, "little", signed=True))
        node.hash = int.from_bytes(h.digest(), "little", signed=True)
        node.keys = (node.hash,)
        if node.tag in INLINE:
            continue
        if node.tag in CONTAINERS:
            node.vote = _vote(node, root.chars)
        # What a subtree looks like without its texts; repeated items count once.
        inner: list[str] = []
        for child in node.children:
            if isinstance(child, Element) and child.tag not in INLINE:
                look = str(child.shape)
                if not inner or inner[-1] != look:
                    inner.append(look)
        named = node.named() if node.attributes else {}
        names = f"{' '.join(sorted(named))}|{' '.join(sorted(named.get('class', '').split()))}" if named else "|"
        node.shape = _mixed(0, f"{node.tag}|{names}|{' '.join(inner)}")
    paths: list[tuple[Element, str]] = [(root, "")]
    known: dict[tuple[str, str], str] = {}
    while paths:
        around, path = paths.pop()
        held = [c for c in around.children if isinstance(c, Element)]
        for at, node in enumerate(held):
            if node.tag in TEXTS:
                node.keys = tuple(_mixed(node.hash, f"{path} {place}") for place in (at, at - len(held)))
            # A shape counts in its place.
            if node.tag in CONTAINERS:
                node.shape = _mixed(node.shape, path)
            if node.children and node.tag not in INLINE:
                # Depth is cut to a digest, as pages may nest without limit.
                below = known.get((path, node.tag))
                if below is None:
                    below = known[path, node.tag] = _mixed_path(path, node.tag)
                paths.append((node, below))


def _mixed(number: int, place: str) -> int:
    h = hashlib.blake2b(number.to_bytes(8, "little", signed=True) + place.encode(), digest_size=8)
    return int.from_bytes(h.digest(), "little", signed=True)


def _mixed_path(path: str, tag: str) -> str:
    return hashlib.blake2b(f"{path}/{tag}".encode("utf-8", "replace"), digest_size=8).hexdigest()



def main_text(
    root: Element, dropped: frozenset[int] | set[int] = frozenset(), lists: bool = True,
    parts: list[tuple[Element, int]] | None = None,
) -> str:
    """The text of a page; without ``lists`` only dropped hashes go from it."""
    if parts is None:
        parts = main_parts(root, dropped) if lists else [(root, 0)]
    return "\n".join(b for part, inside in parts for b in blocks(part, dropped, inside, lists))


def candidates(root: Element) -> tuple[list[int], list[int], list[int]]:
    """Keys of all subtrees of the page that may be a template: navigation, adverts and footers too.

    Besides them, shapes that here hold running text or most of the page, which counts against
    them, and shapes of which this page says nothing.
    """
    seen: set[int] = set()
    shapes: dict[int, set[int]] = {1: seen, 0: set(), -1: set()}
    stack = [(root, 0)]
    while stack:
        node, inside = stack.pop()
        if node is not root:
            if node.tag in RAW or node.tag == "head" or node.hidden():
                continue
            if removable(node, inside):
                seen.update(node.keys)
            if shaped(node, inside):
                shapes[node.vote].add(node.shape)
        inside = max(inside, LEVEL.get(node.kind(), 0))
        stack.extend((c, inside) for c in node.children if isinstance(c, Element))
    return sorted(seen), sorted(shapes[-1]), sorted(shapes[0] - seen - shapes[-1])
