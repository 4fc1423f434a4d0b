"""A forgiving HTML reader: block elements as a tree, text in runs, in one pass over the page."""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Element kinds of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style title textarea noscript template iframe noembed noframes xmp object select button svg canvas audio video".split())
CLOSES_P = BLOCKS - frozenset("body html caption td th tr tbody thead tfoot legend summary".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"),
            "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BARRIERS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",)}


class Page:
    """Parallel lists of block nodes (0 is the document) and of text runs in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes, self.starts = ["#page"], [-1], [{}], [0]
        self.inline, self.controls = [0], [0]
        self.depths, self.orders, self.children = [0], [0], [0]
        self.runs: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self._stack, self._pieces, self._linked, self._link = [0], [], 0, -1
        self._where: dict[str, list[int]] = {}  # depths in the stack of the open elements of a tag, so that no tag searches the stack
        self._read(source)

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text:
                self.runs.append((self._stack[-1], text, min(self._linked, len(text))))
            self._pieces, self._linked = [], 0

    def _text(self, raw: str) -> None:
        self._pieces.append(raw)
        if self._link >= 0:
            self._linked += len(raw)

    def _close(self, depth: int) -> None:
        self._flush()
        for node in reversed(self._stack[depth:]):
            self._where[self.tags[node]].pop()
        del self._stack[depth:]
        if self._link >= depth:
            self._link = -1

    def _deepest(self, names: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these tags, 0 without one."""
        return max((self._where[name][-1] for name in names if self._where.get(name)), default=0)

    def _close_last(self, names: tuple[str, ...], barriers: tuple[str, ...] = ()) -> None:
        depth = self._deepest(names)
        if depth > self._deepest((*barriers, "table", "body")):
            self._close(depth)

    def _open(self, tag: str, raw: str, at: int) -> None:
        if tag in CLOSES_P:
            self._close_last(("p",), ("td", "th", "li", "div", "section", "article", "blockquote"))
        if tag in SIBLINGS:
            self._close_last(SIBLINGS[tag], BARRIERS.get(tag, ()))
        self._flush()
        values = {}
        if raw.strip(" /"):
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.attributes.append(values)
        self.starts.append(at)
        self.inline.append(0)
        self.controls.append(0)
        self.children.append(0)
        self.depths.append(self.depths[self._stack[-1]] + 1)
        self.orders.append(self.children[self._stack[-1]])
        self.children[self._stack[-1]] += 1
        if tag not in VOID:
            self._where.setdefault(tag, []).append(len(self._stack))
            self._stack.append(len(self.tags) - 1)

    def _read(self, source: str) -> None:
        at, in_head = 0, False
        lowered, unclosed = None, set()  # silent tags without a closing one further on are not looked for again
        while True:
            match = _TOKEN.search(source, at)
            if match is None:
                break
            if match.start() > at and not in_head:
                self._text(source[at:match.start()])
            at = match.end()
            name = match[2] or match[5]
            if not name:
                continue
            tag, closing, raw = name.lower(), bool(match[1] or match[4]), match[3] or match[6] or ""
            if tag in SILENT:
                self.controls[self._stack[-1]] += tag in ("select", "button", "textarea")
                if not closing and not raw.endswith("/"):
                    lowered = lowered or source.lower()
                    if tag in unclosed:
                        stop = -1
                    elif len(lowered) != len(source):  # lower-casing moved positions: look for the closing tag by pattern
                        end = re.compile(f"</{tag}", re.I).search(source, at)
                        stop = end.start() if end else -1
                    else:
                        stop = lowered.find(f"</{tag}", at)
                    if stop < 0:
                        unclosed.add(tag)
                        at = len(source) if tag in ("script", "style", "title", "textarea") else at
                    else:
                        stop = source.find(">", stop)
                        at = len(source) if stop < 0 else stop + 1
                    self._text(" ")
                continue
            if tag == "head":
                in_head = not closing
                continue
            if tag in BLOCKS:
                in_head = in_head and tag == "html"
                if closing:
                    if depth := self._deepest((tag,)):
                        self._close(depth)
                elif tag not in ("html", "body") or tag not in self._where:
                    self._open(tag, raw, match.start())
            elif tag == "br":
                self._text(" ")
            else:
                node = self._stack[-1]
                self.inline[node] += not closing
                if tag == "a":
                    self._link = -1 if closing else len(self._stack) - 1
                elif tag in ("input", "label", "option"):
                    self.controls[node] += not closing
        if at < len(source) and not in_head:
            self._text(source[at:])
        self._flush()
