"""The block structure of a web page: elements that begin blocks as inner nodes, runs of text as leaves.

A small reader of tags for one page at a time, in time proportional to the page. Inline markup belongs to the run around it; scripts,
styles, the head's contents and comments are skipped; end tags may be missing, nesting beyond ``DEEPEST`` is flattened.
"""

from __future__ import annotations

import html as references
import re

#: Nesting levels that are told apart.
DEEPEST = 256
KINDS = ("#", "div", "p", "list", "item", "heading", "article", "main", "section", "nav", "aside", "header", "footer", "form", "control", "table", "cell", "quote", "pre", "inline", "other")
_TAGS = {
    "div": "div center", "p": "p", "list": "ul ol dl menu dir", "item": "li dd dt", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "article": "article", "main": "main", "section": "section details summary", "nav": "nav",
    "aside": "aside dialog", "header": "header", "footer": "footer address", "form": "form fieldset search", "control": "button select option label legend", "table": "table thead tbody tfoot tr caption", "cell": "td th",
    "quote": "blockquote figure figcaption", "pre": "pre", "other": "html body hr",
}
KIND_OF = {tag: KINDS.index(kind) for kind, tags in _TAGS.items() for tag in tags.split()}
SKIPPED = frozenset("script style noscript template iframe object svg math title textarea canvas video audio".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
#: What attribute values say about an element, by the words in them.
HINTS = {
    "text": "article content post entry story main body text hentry prose single",
    "nav": "nav menu navbar breadcrumb breadcrumbs pagination pager toc tabs navigation",
    "head": "header masthead banner logo topbar branding",
    "foot": "footer foot copyright colophon contentinfo legal",
    "side": "sidebar aside side widget widgets rail complementary",
    "ad": "ad ads advert advertisement adsense adsbygoogle sponsor sponsored promo promotion",
    "note": "cookie cookies consent notice alert popup modal gdpr newsletter subscribe",
    "share": "share sharing social related recommended tags popular trending",
    "comment": "comment comments commentlist reply replies discussion disqus respond",
    "form": "form login search searchbox signup",
}
_HINT_OF = {word: 1 << i for i, words in enumerate(HINTS.values()) for word in words.split()}
#: An inline element with any of these is a node of its own.
_AGAINST = sum(1 << i for i, name in enumerate(HINTS) if name != "text")

_TAG = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in SKIPPED}
_PUNCTUATION = re.compile(r"[.,;:!?]")


def hints(attributes: str) -> int:
    """A bit for each kind of hint among the words of an element's class, id, role, label and itemprop."""
    found = 0
    for value in _ATTRIBUTE.findall(attributes):
        for word in _WORD.findall(value):
            found |= _HINT_OF.get(word.lower(), 0)
    return found


class Page:
    """Nodes in page order, so that a subtree is a range: parent, depth, kind, hint, end (exclusive), chars, links, words, marks; text of runs."""

    def __init__(self, html: str) -> None:
        self.parent, self.depth, self.kind, self.hint, self.end = [-1], [0], [KINDS.index("other")], [0], [0]
        self.chars, self.links, self.words, self.marks = [0], [0], [0], [0]
        self.texts: dict[int, str] = {}
        self.controls = 0
        self._stack, self._tags = [0], ["#root"]
        self._run: list[str] = []
        self._run_links, self._link = 0, False
        self._read(html)
        self._flush()
        for node in self._stack:
            self.end[node] = len(self.parent)

    def _node(self, kind: int, hint: int) -> int:
        self.parent.append(self._stack[-1])
        self.depth.append(len(self._stack))
        self.kind.append(kind)
        self.hint.append(hint)
        self.end.append(len(self.parent))
        for numbers in (self.chars, self.links, self.words, self.marks):
            numbers.append(0)
        return len(self.parent) - 1

    def _flush(self) -> None:
        """Ends the run at hand; one without text is no node."""
        if self._run:
            words = "".join(self._run).split()
            if words:
                node, text = self._node(0, 0), " ".join(words)
                self.texts[node] = text
                self.chars[node], self.words[node] = len(text), len(words)
                self.links[node], self.marks[node] = min(self._run_links, len(text)), len(_PUNCTUATION.findall(text))
            self._run, self._run_links = [], 0

    def _pop(self, to: int) -> None:
        """Closes the elements from place ``to`` of the stack up."""
        self._flush()
        for node in self._stack[to:]:
            self.end[node] = len(self.parent)
        del self._stack[to:], self._tags[to:]

    def _last(self, tags: tuple[str, ...], within: tuple[str, ...]) -> int:
        """The place of the innermost open element of ``tags`` inside the innermost of ``within``, or 0."""
        for at in range(len(self._tags) - 1, 0, -1):
            if self._tags[at] in tags:
                return at
            if self._tags[at] in within:
                return 0
        return 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self._link = True
        if tag == "br":
            self._run.append(" ")
            return
        if tag == "input":
            self.controls += 1
        kind, hint = KIND_OF.get(tag), hints(attributes) if "=" in attributes else 0
        if kind is None:
            if tag in VOID or not hint & _AGAINST:
                return
            kind = KINDS.index("inline")
        elif kind != KINDS.index("control"):
            at = self._last(("p",), ("div", "td", "li", "section", "article"))
            if tag in ("li", "dd", "dt"):
                at = self._last(("li",) if tag == "li" else ("dd", "dt"), ("ul", "ol", "dl", "menu", "dir")) or at
            elif tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
                closed = {"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ("tbody", "thead", "tfoot"))
                at = self._last(closed, ("table",)) or at
            if at:
                self._pop(at)
        self._flush()
        if tag == "hr" or len(self._stack) >= DEEPEST:
            return
        self._stack.append(self._node(kind, hint))
        self._tags.append(tag)

    def _shut(self, tag: str) -> None:
        if tag == "a":
            self._link = False
        if tag == "br":
            self._run.append(" ")
        at = len(self._tags) - 1
        while at and self._tags[at] != tag:
            at -= 1
        if at:
            self._pop(at)
        elif tag in KIND_OF:
            self._flush()

    def _text(self, raw: str) -> None:
        text = references.unescape(raw) if "&" in raw else raw
        self._run.append(text)
        if self._link:
            self._run_links += len(text)

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while at < len(html):
            found = _TAG.search(html, at)
            begin = found.start() if found else len(html)
            if begin > at:
                self._text(html[at:begin])
            if not found:
                return
            if found[0] == "<!--":
                end = html.find("-->", begin + 2)  # "<!-->" is a whole comment
                at = end + 3 if end >= 0 else len(html)
            elif begin > last:  # a tag that never ends
                return
            elif found[0] in ("<!", "<?"):
                at = html.find(">", begin) + 1
            else:
                shut = found[0][1] == "/"
                name = _NAME.match(html, begin + 1 + shut)
                rest = _REST.match(html, name.end())
                end = rest.end() if rest else html.find(">", name.end()) + 1  # a quote that never ends
                if not end:
                    return
                tag, at = name[0].lower(), end
                if shut:
                    self._shut(tag)
                elif tag in SKIPPED:
                    if tag not in ("svg", "math") or not html.endswith("/>", begin, end):
                        close = _CLOSE[tag].search(html, end)
                        at = close.start() if close else len(html)
                else:
                    self._open(tag, html[name.end() : end])
