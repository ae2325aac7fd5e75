"""A tolerant HTML tree with a CSS and an XPath subset, on the standard library's tokenizer.

Elements left open are closed where HTML implies it; script and style hold raw text; stray end tags are
ignored.  Unsupported selector syntax is an error, never an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: An opening tag closes these open elements, up to the given borders.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            else:
                stack.extend(reversed(c.children))

    def text(self, separator: str = "", strip: bool = True) -> str:
        """All strings joined; stripped ones that are empty are left out."""
        return separator.join(t for s in self.strings() if (t := s.strip() if strip else s))

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def find(self, selector: str) -> Node | None:
        return next(iter(self.select(selector)), None)

    def select(self, selector: str) -> list[Node]:
        """Descendants that match a CSS selector, in document order."""
        groups = parse_css(selector)
        return [n for n in self.walk() if any(_matches(n, g, self) for g in groups)]

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def _open(self) -> str:
        attrs = "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}/>" if self.tag in VOID else f"<{self.tag}{attrs}>"

    def html(self) -> str:
        """The element as HTML; a stack, not recursion, as pages nest without bound."""
        out: list[str] = []
        stack: list[tuple[Node | str, bool]] = [(self, False)]  # a text with its raw flag, or an element
        while stack:
            n, raw = stack.pop()
            if isinstance(n, str):
                out.append(n if raw else _escaped(n))
                continue
            if n.tag != "[document]":
                out.append(n._open())
            if n.tag in VOID:
                continue
            if n.tag != "[document]":
                stack.append((f"</{n.tag}>", True))
            stack.extend((c, n.tag in ("script", "style")) for c in reversed(n.children))
        return "".join(out)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Node("[document]", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._close({"p"}, {"button", "td", "th", "li", "div", "section", "article", "body"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.top)
        node.attrs = {k: node.attrs[k] for k, _ in attrs}
        self.top.children.append(node)
        if tag not in VOID:
            self.top = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.top = self.top.parent or self.root

    def handle_endtag(self, tag):
        n = self.top
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.top = n.parent

    def handle_data(self, data):
        self.top.children.append(data)

    def _close(self, tags: set[str], borders: set[str]) -> None:
        n, last = self.top, None
        while n is not None and n.tag not in borders:
            if n.tag in tags:
                last = n
            n = n.parent
        if last is not None:
            self.top = last.parent


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


# ---- CSS

_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")


@lru_cache(maxsize=512)
def parse_css(selector: str) -> tuple:
    """Groups of (combinator, tests) from left to right; combinators are descendant and child."""
    return tuple(_group(g.strip(), selector) for g in _split_commas(selector))


def _split_commas(selector: str) -> list[str]:
    out, depth, quote, cur = [], 0, "", ""
    for c in selector:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        if c == "," and not depth and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur]


def _group(text: str, whole: str) -> tuple:
    steps, at, how = [], 0, " "
    if not text:
        raise ValueError(f"empty selector in {whole!r}")
    while at < len(text):
        tests = []
        while m := _PART.match(text, at):
            if m["tag"]:
                if tests:
                    break
                tests.append(("tag", m["tag"].lower()))
            elif m["cls"]:
                tests.append(("class", m["cls"]))
            elif m["id"]:
                tests.append(("id", m["id"]))
            else:
                tests.append(("attr", m["attr"].lower(), m["op"], next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")))
            at = m.end()
        if not tests:
            raise ValueError(f"unsupported selector {whole!r} at {text[at:]!r}")
        steps.append((how, tuple(tests)))
        gap = re.compile(r"\s*>\s*|\s+").match(text, at)
        if at < len(text) and not gap:
            raise ValueError(f"unsupported selector {whole!r} at {text[at:]!r}")
        if gap:
            how, at = (">" if ">" in gap.group() else " "), gap.end()
    return tuple(steps)


def _passes(n: Node, tests: tuple) -> bool:
    for t in tests:
        if t[0] == "tag":
            ok = t[1] in ("*", n.tag)
        elif t[0] == "class":
            ok = t[1] in n.classes
        elif t[0] == "id":
            ok = n.attrs.get("id") == t[1]
        else:
            _, name, op, want = t
            have = n.attrs.get(name)
            ok = have is not None and (
                op is None or {"=": have == want, "*=": bool(want) and want in have, "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[op]
            )
        if not ok:
            return False
    return True


def _matches(n: Node, steps: tuple, top: Node) -> bool:
    if not _passes(n, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    how, rest, up = steps[-1][0], steps[:-1], n.parent
    while up is not None and up is not top.parent:
        if _matches(up, rest, top):
            return True
        if how == ">":
            return False
        up = up.parent
    return False


# ---- XPath

_STEP = re.compile(r"(?P<axis>//|/)(?:(?P<text>text\(\))|@(?P<attr>[\w:-]+)|(?P<tag>\*|[A-Za-z][\w-]*)(?P<preds>(?:\[[^\]]*\])*))")
_PRED = re.compile(r"""\[\s*(?:(?P<pos>\d+)|@(?P<attr>[\w:-]+)\s*(?:=\s*(?P<q>["'])(?P<eq>(?:(?!(?P=q)).)*)(?P=q))?|(?P<fn>starts-with|contains)\(\s*(?:@(?P<fattr>[\w:-]+)|(?P<ftext>text\(\)|\.))\s*,\s*(?P<fq>["'])(?P<fv>(?:(?!(?P=fq)).)*)(?P=fq)\s*\))\s*\]""")


@lru_cache(maxsize=512)
def parse_xpath(path: str) -> tuple:
    return tuple(_steps(p.strip(), path) for p in path.split("|"))


def _steps(text: str, whole: str) -> tuple:
    out, at = [], 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"unsupported xpath {whole!r} at {text[at:]!r}")
        preds, p = [], 0
        while m["preds"] and p < len(m["preds"]):
            q = _PRED.match(m["preds"], p)
            if not q:
                raise ValueError(f"unsupported predicate {m['preds'][p:]!r} in {whole!r}")
            preds.append(q.groupdict())
            p = q.end()
        out.append((m["axis"], m["text"], m["attr"], m["tag"], tuple(tuple(x.items()) for x in preds)))
        at = m.end()
    if not out:
        raise ValueError("empty xpath")
    return tuple(out)


def _holds(n: Node, pred: dict) -> bool:
    if pred["fn"]:
        have = n.attrs.get(pred["fattr"]) if pred["fattr"] else n.text(strip=False)
        return have is not None and (have.startswith(pred["fv"]) if pred["fn"] == "starts-with" else pred["fv"] in have)
    have = n.attrs.get(pred["attr"])
    return have is not None and (pred["eq"] is None or have == pred["eq"])


def xpath(root: Node, path: str) -> list[Node | str]:
    """Elements, or strings for text() and @attribute, in document order per union branch."""
    out: list[Node | str] = []
    for steps in parse_xpath(path):
        now: list[Node | str] = [root]
        for axis, text, attr, tag, preds in steps:
            new: list[Node | str] = []
            for n in now:
                if not isinstance(n, Node):
                    continue
                if text:
                    new += [s for s in (n.strings() if axis == "//" else (c for c in n.children if isinstance(c, str)))]
                elif attr:
                    held = [n, *n.walk()] if axis == "//" else [n]
                    new += [e.attrs[attr] for e in held if attr in e.attrs]
                else:
                    kids = n.walk() if axis == "//" else (c for c in n.children if isinstance(c, Node))
                    found = [k for k in kids if tag == "*" or k.tag == tag]
                    for p in map(dict, preds):
                        if p["pos"]:
                            found = [k for k in found if _place(k) == int(p["pos"])]
                        else:
                            found = [k for k in found if _holds(k, p)]
                    new += found
            seen: set[int] = set()
            now = [x for x in new if isinstance(x, str) or not (id(x) in seen or seen.add(id(x)))]
        out += now
    return out


def _place(n: Node) -> int:
    """Position among siblings of the same tag, from 1."""
    return [c for c in n.parent.children if isinstance(c, Node) and c.tag == n.tag].index(n) + 1 if n.parent else 1


def css_path(n: Node) -> str:
    """A selector that leads to an element: by id where there is one, else tags with places."""
    parts = []
    while n is not None and n.tag != "[document]":
        if n.attrs.get("id"):
            parts.append(f"#{n.attrs['id']}")
            break
        parts.append(f"{n.tag}:nth-of-type({_place(n)})")
        n = n.parent
    return " > ".join(reversed(parts))


def xpath_of(n: Node) -> str:
    parts = []
    while n is not None and n.tag != "[document]":
        if n.attrs.get("id"):
            return f'//*[@id="{n.attrs["id"]}"]' + "".join(f"/{p}" for p in reversed(parts))
        parts.append(f"{n.tag}[{_place(n)}]")
        n = n.parent
    return "/" + "/".join(reversed(parts))
