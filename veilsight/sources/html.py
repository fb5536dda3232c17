"""Stored HTML as frame snapshots: a tree, a small style cascade, holders, roots, selectors and links.

This tier knows what markup and style sheets say. It sees no scripts, no layout and no fonts, so places off
the screen and clipped boxes are told from declared lengths only. Supported selectors are ``tag``,
``.class``, ``tag.class`` and descendants of those; other rules are passed over. Of style properties it
reads those that hide text, with hex, ``rgb()`` and a few named colours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..functions import urls as U
from .tables import spread, stored

MOST_HOLDERS, OWN_TEXT, FULL_TEXT, MOST_LINKS, MOST_SCRIPT, MOST_JUMPS = 20000, X.OWN_TEXT, X.FULL_TEXT, 5000, 200000, 50
FONT_SIZE, OPACITY, ALPHA, CONTRAST, INDENT = 1.0, 0.1, 0.1, 1.1, 100.0
#: Declared places at or beyond these are off the screen; rows wider than the far right are.
OFF_LEFT, OFF_RIGHT = -300.0, 3300.0
# ---------------------------------------------------------------- fixed values
SKIP = frozenset("script style noscript template textarea select option title iframe object embed canvas audio video map head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
COLOURS = {"black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "gray": "#808080", "yellow": "#ffff00"}
INHERITED = ("color", "font-size", "visibility", "text-indent", "-webkit-text-fill-color", "-webkit-text-stroke-width", "text-shadow")
MENU = re.compile(r"(?:^|[\s_-])(gnb|lnb|snb|allmenu|sitemap|submenu|mega|depth[23]|[23]depth)(?=$|[\s_-]|\d)", re.I)
JUMP = re.compile(r"""(?:location(?:\.href)?\s*=\s*|location\.(?:assign|replace)\(\s*|window\.open\(\s*)['"]([^'"]+)['"]""")
NO_LINK = re.compile(r"^(javascript|mailto|tel|sms|data|blob|about):", re.I)
REFRESH = re.compile(r"""url\s*=\s*['"]?([^'";\s]+)""", re.I)
SAFE_CLASS = re.compile(r"-?[A-Za-z_][A-Za-z0-9_-]*$")

_SPACES = re.compile("[" + re.escape(T.BROWSER_SPACE) + "]+")
_INTERESTING = re.compile(X.INTERESTING)


def norm(s: str) -> str:
    return _SPACES.sub(" ", s).strip(" ")


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    parent: Element | None
    depth: int = 1
    number: int = 0
    children: list[Element] = field(default_factory=list)
    content: list[str | Element] = field(default_factory=list)
    style: dict[str, str] = field(default_factory=dict)

    @property
    def classes(self) -> list[str]:
        return list(dict.fromkeys(self.attrs.get("class", "").split()))

    def text(self) -> str:
        out: list[str] = []
        todo: list[str | Element] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo += reversed(x.content)
        return "".join(out)

    def ancestors(self):
        a = self.parent
        while a is not None:
            yield a
            a = a.parent

    def inside(self, tag: str) -> Element | None:
        return next((a for a in (self, *self.ancestors()) if a.tag == tag), None)


class Tree(HTMLParser):
    """Builds elements in document order; end tags that HTML lets out are put in."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.elements = [self.root]
        self.open = [self.root]
        self.feed(html)
        self.close()
        self.body = next((e for e in self.elements if e.tag == "body"), self.root)

    def _add(self, tag: str, attrs: dict[str, str]) -> Element:
        parent = self.open[-1]
        e = Element(tag, attrs, parent, parent.depth + 1, len(self.elements))
        parent.children.append(e)
        parent.content.append(e)
        self.elements.append(e)
        return e

    def _close_to(self, tags: set[str], stop: set[str]) -> None:
        """Closes the outermost open element of these tags, up to the nearest one that bounds them."""
        found = 0
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in stop:
                break
            if self.open[k].tag in tags:
                found = k
        if found:
            del self.open[found:]

    def handle_starttag(self, tag, attrs):
        named = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html":
            self.root.attrs |= named
            return
        if tag == "body" and len(self.open) > 1 and self.open[1].tag == "head":
            del self.open[1:]
        if tag in BLOCK:
            self._close_to({"p"}, {"div", "td", "th", "li", "body", "article", "section", "button"})
        if tag in CLOSES:
            self._close_to(CLOSES[tag], SCOPES[tag])
        e = self._add(tag, named)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].content.append(data)


# ---------------------------------------------------------------- style
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"(?:[a-zA-Z][\w-]*)?(?:\.[\w-]+)*$")


def declarations(css: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for d in css.split(";"):
        name, colon, value = d.partition(":")
        if colon:
            name, value = name.strip().lower(), value.replace("!important", "").strip().lower()
            out[name] = value
            if name == "background":
                out["background-color"] = next((p for p in re.findall(r"rgba?\([^)]*\)|#[0-9a-f]+|[a-z]+", value) if colour(p)), "")
                if "url(" in value or "gradient(" in value:
                    out["background-image"] = "url"
                if "text" in value.split():
                    out["background-clip"] = "text"
            elif name == "-webkit-text-stroke":
                out["-webkit-text-stroke-width"] = next((p for p in value.split() if length(p, 16.0) is not None), "1px" if value not in ("", "0", "none") else "0")
    return out


def rules(css: str) -> list[tuple[list[tuple[str, tuple[str, ...]]], int, dict[str, str]]]:
    """Chain of (tag, classes), specificity and declarations of each rule that can be read."""
    out = []
    css = re.sub(r"/\*.*?\*/", "", css, flags=re.S)
    for heads, body in _RULE.findall(css):
        for head in heads.split(","):
            parts = head.split()
            if not parts or not all(_SELECTOR.match(p) for p in parts):
                continue
            chain = [(p.split(".")[0].lower(), tuple(p.split(".")[1:])) for p in parts]
            weight = sum(len(c) * 100 + bool(t) for t, c in chain)
            out.append((chain, weight, declarations(body)))
    return out


def _fits(e: Element, part: tuple[str, tuple[str, ...]]) -> bool:
    return (not part[0] or e.tag == part[0]) and all(c in e.classes for c in part[1])


def _applies(e: Element, chain) -> bool:
    if not _fits(e, chain[-1]):
        return False
    rest = list(chain[:-1])
    for a in e.ancestors():
        if not rest:
            break
        if _fits(a, rest[-1]):
            rest.pop()
    return not rest


def colour(s: str) -> tuple[float, float, float, float] | None:
    s = COLOURS.get(s.strip(), s.strip())
    if s == "transparent":
        return (0.0, 0.0, 0.0, 0.0)
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", s):
        h = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        v = [int(h[i : i + 2], 16) for i in range(0, len(h), 2)]
        return (v[0], v[1], v[2], v[3] / 255 if len(v) > 3 else 1.0)
    if m := re.fullmatch(r"rgba?\(\s*([\d.]+)[,\s]+([\d.]+)[,\s]+([\d.]+)(?:\s*[,/]\s*([\d.]+)(%?))?\s*\)", s):
        a = 1.0 if m[4] is None else float(m[4]) / (100 if m[5] else 1)
        return (float(m[1]), float(m[2]), float(m[3]), a)
    return None


def over(fg, bg) -> tuple[float, float, float]:
    return tuple(f * fg[3] + b * (1 - fg[3]) for f, b in zip(fg[:3], bg))


def contrast(a, b) -> float:
    def light(c) -> float:
        v = [x / 255 / 12.92 if x / 255 <= 0.03928 else ((x / 255 + 0.055) / 1.055) ** 2.4 for x in c[:3]]
        return 0.2126 * v[0] + 0.7152 * v[1] + 0.0722 * v[2]

    low, high = sorted((light(a), light(b)))
    return (high + 0.05) / (low + 0.05)


def length(value: str, font: float) -> float | None:
    m = re.fullmatch(r"(-?\d*\.?\d+)(px|em|rem|pt|%|vw|vh)?", value)
    if not m:
        return None
    return float(m[1]) * {"em": font, "rem": 16.0, "pt": 4 / 3, "%": font / 100, "vw": 12.8, "vh": 7.2}.get(m[2] or "px", 1.0)


@dataclass
class Look:
    """What an element shows, with what it takes from those around it."""

    font: float
    opacity: float
    total: float
    hidden: int | None
    visible: bool
    fg: tuple
    colours: str
    bg: tuple
    bg_known: bool
    indent: float
    off: tuple[str, float, float] | None
    clip: str | None


def _looks(tree: Tree, css: str) -> list[Look]:
    sheet = css + "\n" + "\n".join(e.text() for e in tree.elements if e.tag == "style")
    by_order = sorted(enumerate(rules(sheet)), key=lambda r: (r[1][1], r[0]))
    out: list[Look] = []
    for e in tree.elements:
        style = {k: v for k, v in (e.parent.style if e.parent else {}).items() if k in INHERITED}
        for _, (chain, _, d) in by_order:
            if _applies(e, chain):
                style |= d
        if "hidden" in e.attrs:
            style.setdefault("display", "none")
        style |= declarations(e.attrs.get("style", ""))
        e.style = style
        up = out[e.parent.number] if e.parent else Look(16.0, 1.0, 1.0, None, True, (0, 0, 0, 1.0), "", (255, 255, 255), True, 0.0, None, None)
        own = e.attrs.get("style", "") or any(_applies(e, c) for _, (c, _, _) in by_order)
        declared = style if own else {}
        size = length(style["font-size"], up.font) if "font-size" in declared else None
        font = up.font if size is None else size
        style["font-size"] = f"{font}px"
        opacity = 1.0
        if re.fullmatch(r"-?[\d.]+%?", style.get("opacity", "")):
            v = style["opacity"]
            opacity = float(v.rstrip("%")) / (100 if v.endswith("%") else 1)
        if m := re.search(r"opacity\(\s*([\d.]+)(%?)\s*\)", style.get("filter", "")):
            opacity *= float(m[1]) / (100 if m[2] else 1)
        fill = colour(style.get("-webkit-text-fill-color", ""))
        fg = fill or colour(style.get("color", "")) or (0, 0, 0, 1.0)
        back, image = colour(style.get("background-color", "") or "transparent"), style.get("background-image", "none") != "none"
        if back is None:
            bg, known = up.bg, False
        elif back[3] >= 0.999:
            bg, known = back[:3], not image
        else:
            bg, known = (over(back, up.bg) if back[3] > 0 else up.bg), up.bg_known and not image
        place = style.get("position") in ("absolute", "fixed", "relative")
        x = next((v for k in ("left", "margin-left") if (k == "margin-left" or place) and (v := length(style.get(k, ""), font)) is not None), 0.0)
        y = next((v for k in ("top", "margin-top") if (k == "margin-top" or place) and (v := length(style.get(k, ""), font)) is not None), 0.0)
        if m := re.search(r"translate(x|y)?\(\s*(-?[\d.]+)px(?:\s*,\s*(-?[\d.]+)px)?", style.get("transform", "")):
            x, y = (x, y + float(m[2])) if m[1] == "y" else (x + float(m[2]), y + float(m[3] or 0))
        off = ("left", x, y) if x <= OFF_LEFT else ("top", x, y) if y <= OFF_LEFT else ("right", x, y) if x >= OFF_RIGHT else None
        clip = None
        w, h = length(style.get("width", ""), font), length(style.get("height", ""), font)
        cut = any(style.get(k, "") in ("hidden", "clip") for k in ("overflow", "overflow-x", "overflow-y"))
        if style.get("position") in ("absolute", "fixed") and re.match(r"rect\((0|0px|1px)[, ]+(0|0px|1px)[, ]+(0|0px|1px)[, ]+(0|0px|1px)\)$", style.get("clip", "")):
            clip = "clip:" + style["clip"]
        elif re.match(r"(inset\((50|100)%|circle\(0)", style.get("clip-path", "")):
            clip = "clip-path:" + style["clip-path"]
        elif cut and style.get("display") != "inline" and (w is not None and w <= 1.5 or h is not None and h <= 1.5):
            clip = f"overflow:hidden; {round(w or 0)}x{round(h or 0)}px"
        out.append(
            Look(
                font, opacity, up.total * opacity, e.number if style.get("display") == "none" else up.hidden, style.get("visibility", "visible") == "visible", fg,
                style.get("color", "") + "|" + style.get("-webkit-text-fill-color", ""), bg, known, length(style.get("text-indent", ""), font) or 0.0, off, clip,
            )
        )
    return out


def _text_clips(e: Element) -> bool:
    """Whether the letters show the background of the element or of one around it."""
    return any(a.style.get(k) == "text" for a in (e, *e.ancestors()) for k in ("background-clip", "-webkit-background-clip"))


# ---------------------------------------------------------------- selectors
def _segment(e: Element) -> str:
    classes = [c for c in e.classes if SAFE_CLASS.match(c)]
    s = e.tag + "".join("." + c for c in classes)
    if e.parent:
        same = [x for x in e.parent.children if x.tag == e.tag]
        if any(x is not e and set(classes) <= set(x.classes) for x in same):
            s += f":nth-of-type({next(k for k, x in enumerate(same) if x is e) + 1})"
    return s


def _matches(e: Element, segment: str) -> bool:
    name, _, nth = segment.partition(":nth-of-type(")
    tag, *classes = name.split(".")
    if e.tag != tag or not set(classes) <= set(e.classes):
        return False
    if nth:
        same = [x for x in e.parent.children if x.tag == e.tag] if e.parent else [e]
        return next(k for k, x in enumerate(same) if x is e) + 1 == int(nth[:-1])
    return True


def selector(tree: Tree, e: Element) -> str | None:
    """The shortest path of at least two steps that leads to this element alone."""
    alike = [(x, x) for x in tree.elements]
    parts: list[str] = []
    for cur in (e, *e.ancestors()):
        segment = cur.tag if cur is tree.root else _segment(cur)
        parts.insert(0, segment)
        alike = [(x, at.parent if at else None) for x, at in alike if at is not None and _matches(at, segment)]
        if (len(parts) >= 2 or cur is tree.body or cur is tree.root) and len(alike) == 1 and alike[0][0] is e:
            return " > ".join(parts)
    return None


def lookup(tree: Tree, path: str) -> list[Element]:
    """The elements that a path of child steps leads to, wherever it begins."""
    *outer, last = path.split(" > ")

    def fits(e: Element) -> bool:
        if not _matches(e, last):
            return False
        for step in reversed(outer):
            e = e.parent
            if e is None or not _matches(e, step):
                return False
        return True

    return [e for e in tree.elements if fits(e)]


def marks(tree: Tree) -> list[dict]:
    """What a page says should be found: elements with the techniques in ``data-expect`` and the extra types in ``data-expect-extra``."""
    said = lambda e, name: e.attrs.get(name, "").split()
    each = [(e.number, said(e, "data-expect") + ["ETC:" + x for x in said(e, "data-expect-extra")]) for e in tree.elements]
    return [{"e": n, "labels": list(dict.fromkeys(found))} for n, found in each if found]


def trees(html: str) -> Iterator[Tree]:
    """The page and its inline frames, in the order of ``frames``."""
    todo = [html]
    while todo:
        tree = Tree(todo.pop(0))
        yield tree
        todo += [e.attrs["srcdoc"] for e in tree.elements if e.tag in ("iframe", "frame") and "srcdoc" in e.attrs]


# ---------------------------------------------------------------- links
def links(tree: Tree, base: str) -> list[str]:
    """Absolute links in order: anchors, ``onclick``, ``data-`` attributes, refreshes, jumps in scripts."""
    out: dict[str, None] = {}
    head = next((e.attrs["href"] for e in tree.elements if e.tag == "base" and e.attrs.get("href")), "")
    base = urljoin(base, head)

    def add(u: str | None) -> None:
        u = (u or "").strip()
        if u and not u.startswith("#") and not NO_LINK.match(u):
            try:
                out[urljoin(base, u)] = None
            except ValueError:
                return

    for e in tree.elements:
        if e.tag in ("a", "area") and "href" in e.attrs and "download" not in e.attrs:
            add(e.attrs["href"])
    for e in tree.elements:
        if m := JUMP.search(e.attrs.get("onclick", "")):
            add(m[1])
    for e in tree.elements:
        add(e.attrs.get("data-href") or e.attrs.get("data-url") or e.attrs.get("data-link"))
    for e in tree.elements:
        if e.tag == "meta" and e.attrs.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.search(e.attrs.get("content", ""))):
            add(m[1])
    for e in tree.elements:
        if e.tag == "script" and "src" not in e.attrs and len(code := e.text()) <= MOST_SCRIPT:
            for m in [*JUMP.finditer(code)][:MOST_JUMPS]:
                add(m[1])
    return list(out)[:MOST_LINKS]


# ---------------------------------------------------------------- snapshots
def _climb(e: Element, body: Element, go) -> Element:
    while e.parent is not None and e.parent is not body and go(e.parent):
        e = e.parent
    return e


def in_menu(e: Element, body: Element, look: list[Look]) -> int:
    if e.inside("nav"):
        return 1
    for k, a in enumerate((e, *e.ancestors())):
        if a is body or k >= 25:
            break
        if MENU.search(a.attrs.get("class", "") + " " + a.attrs.get("id", "")):
            return 1
    item = e.inside("li")
    if item and any(x.tag == "a" and "href" in x.attrs for x in _below(e)):
        near = [c for c in item.children if c.tag in ("a", "button")] + [g for c in item.children for g in c.children if g.tag == "a"]
        for c in near:
            shown = look[c.number].hidden is None and look[c.number].visible and look[c.number].total > 0
            if shown and e not in (c, *c.ancestors()) and c not in e.ancestors():
                return 1
    return 0


def _below(e: Element):
    todo = [e]
    while todo:
        x = todo.pop()
        yield x
        todo += x.children


def snapshot(html: str, css: str = "") -> dict:
    """Holders, roots and selectors of one frame, with the fields of ``sources.snapshots``."""
    tree = Tree(html)
    look = _looks(tree, css)
    body = tree.body
    roots: dict[int, dict] = {}
    holders: list[dict] = []

    def root(e: Element) -> int:
        if e.number not in roots:
            t = norm(e.text())
            roots[e.number] = {"t": t[:OWN_TEXT], "n": len(t), "d": e.depth, "p": None, "m": in_menu(e, body, look)}
        return e.number

    truncated = False
    for e in tree.elements:
        if e.tag in SKIP or e is not body and body not in e.ancestors():
            continue
        pieces = [c for c in e.content if isinstance(c, str) and norm(c)]
        if not pieces or any(a.tag in SKIP for a in e.ancestors()):
            continue
        if len(holders) >= MOST_HOLDERS:
            truncated = True
            break
        k, own = look[e.number], norm(" ".join(pieces))
        h: dict = {"e": e.number, "t": own[:OWN_TEXT], "f": None, "ph": None, "dn": None, "fs": None, "off": None, "op": None, "ca": None, "sc": None, "vis": None, "clip": None, "clipHow": None}
        h["signal"] = False

        def found(**fields) -> None:
            h.update(fields, signal=True)

        if k.hidden is not None:
            found(dn=root(tree.elements[k.hidden]))
        if k.font <= FONT_SIZE:
            found(fs={"v": k.font, "r": root(_climb(e, body, lambda a: look[a.number].font <= FONT_SIZE)), "how": None})
        if k.hidden is None:
            chain = [a for a in (e, *e.ancestors()) if a is not body and a.tag != "html"]
            moved = next((a for a in chain if look[a.number].off), None)
            if moved:
                side, x, y = look[moved.number].off
                found(off={"r": root(moved), "how": side, "indent": False, "x": x, "y": y})
            elif k.indent <= -INDENT:
                r = _climb(e, body, lambda a: look[a.number].indent == k.indent)
                found(off={"r": root(r), "how": "left", "indent": True, "x": k.indent, "y": 0.0})
            elif cut := next((a for a in chain if look[a.number].clip), None):
                found(clip=root(cut), clipHow=look[cut.number].clip)
        if not k.visible:
            found(vis=root(_climb(e, body, lambda a: not look[a.number].visible)))
        if k.total <= OPACITY:
            chain = (e, *e.ancestors())
            r = next((a for a in chain if look[a.number].opacity <= OPACITY), None) or next((a for a in chain if look[a.number].opacity < 1), e)
            found(op={"v": k.total, "r": root(r), "how": None})
        if e.style.get("text-shadow", "none") == "none" and not (length(e.style.get("-webkit-text-stroke-width", ""), k.font) or 0) > 0 and not _text_clips(e):
            if k.fg[3] <= ALPHA:
                r = _climb(e, body, lambda a: look[a.number].colours == k.colours)
                found(ca={"v": k.fg[3], "r": root(r), "how": "-webkit-text-fill-color" if e.style.get("-webkit-text-fill-color") else "color"})
            elif k.bg_known:
                shown = over(k.fg, k.bg)
                ratio = contrast(shown, k.bg)
                if ratio <= CONTRAST:
                    r = _climb(e, body, lambda a: look[a.number].bg_known and look[a.number].colours == k.colours and look[a.number].bg == k.bg)
                    css_of = lambda c: "rgb(" + ", ".join(str(int(v + 0.5)) for v in c[:3]) + ")"
                    found(sc={"v": round(ratio, 3), "r": root(r), "fg": css_of(shown), "bg": css_of(k.bg)})
        full = norm(e.text()) if e.children else ""
        if h.pop("signal") or _INTERESTING.search(own) or full and _INTERESTING.search(full):
            if full and len(full) <= FULL_TEXT and full != own:
                h["f"] = full
            holders.append(h)
    kept = {h["e"] for h in holders}
    for h in holders:
        h["anc"] = [a.number for a in tree.elements[h["e"]].ancestors() if a.number in kept]
        h["ph"] = next(iter(h["anc"]), None)
    for i, r in roots.items():
        r["anc"] = [a.number for a in tree.elements[i].ancestors() if a.number in roots]
        r["p"] = next(iter(r["anc"]), None)
    named = {i: s for i in {*kept, *roots} if (s := selector(tree, tree.elements[i]))}
    return {"truncated": truncated, "holders": holders, "roots": roots, "selectors": named, "tree": tree}


def frames(html: str, url: str, css: str = "") -> list[dict]:
    """The page and its inline frames, each with the prefix of its selectors; sources of other frames in ``srcs``."""
    out: list[dict] = []

    todo = [(html, "")]

    def visit(text: str, prefix: str) -> None:
        snap = snapshot(text, css)
        tree = snap.pop("tree")
        snap |= {"frame_id": len(out), "prefix": prefix, "links": links(tree, url), "marks": marks(tree), "srcs": []}
        out.append(snap)
        inner = [e for e in tree.elements if e.tag in ("iframe", "frame")]
        addresses = [urljoin(url, e.attrs["src"]) for e in inner if e.attrs.get("src")]
        for e in inner:
            src = urljoin(url, e.attrs["src"]) if e.attrs.get("src") else ""
            path = f'iframe[src="{src}"]' if src and addresses.count(src) == 1 else selector(tree, e) or "iframe"
            if "srcdoc" in e.attrs:  # each lies inside the other, so they end
                todo.append((e.attrs["srcdoc"], f"{prefix}{path} >>> "))
            elif src:
                snap["srcs"].append({"src": src, "prefix": f"{prefix}{path} >>> "})

    while todo:
        visit(*todo.pop(0))
    return out


_VALUE = "struct<v:double,r:int,how:string>"
FRAME = (
    "struct<frame_id:int,prefix:string,truncated:boolean,"
    f"holders:array<struct<e:int,t:string,f:string,ph:int,dn:int,fs:{_VALUE},off:struct<r:int,how:string,indent:boolean,x:double,y:double>,op:{_VALUE},ca:{_VALUE},"
    "sc:struct<v:double,r:int,fg:string,bg:string>,vis:int,clip:int,clipHow:string,anc:array<int>>>,"
    "roots:array<struct<e:int,t:string,n:int,d:int,p:int,m:int,anc:array<int>>>,selectors:array<struct<e:int,location:string>>,"
    "links:array<string>,marks:array<struct<e:int,labels:array<string>>>,srcs:array<struct<src:string,prefix:string>>>"
)


def frames_udf(css: str = ""):
    @F.pandas_udf(f"array<{FRAME}>")
    def run(html: pd.Series, url: pd.Series) -> pd.Series:
        def one(text, address) -> list[dict]:
            out = frames(text or "", address or "", css)
            for f in out:
                f["roots"] = [{"e": e, **r} for e, r in f["roots"].items()]
                f["selectors"] = [{"e": e, "location": s} for e, s in f["selectors"].items()]
            return out

        return pd.Series([one(t, u) for t, u in zip(html, url)])

    return run


def read_frames(pages: DataFrame, css: str = "") -> DataFrame:
    """``page_id, url, frame_id, prefix, truncated, holders, roots, selectors, links, marks``: all frames of stored pages,
    with the page that holds each (``origin``) and its number among the inline frames there (``inner``).

    Frames with a source are found among the stored pages by their address (of several pages with one
    address, the one with the smallest ``page_id``), level by level until none is left. A page that stands
    in its own frames is not opened again below itself.
    """
    whole = spread(pages.select("page_id", "url", "html")).select("page_id", "url", F.explode(frames_udf(css)("html", "url")).alias("f")).select("page_id", "url", "f.*")
    whole = whole.withColumn("origin", F.col("page_id")).withColumn("inner", F.col("frame_id"))
    whole = stored(whole.withColumn("k", U.key("url")), "frames")  # parsed once, though the levels of frames below read it again
    first = whole.groupBy("k").agg(F.min("page_id").alias("page_id"))
    held = ("frame_id", "prefix", "truncated", "holders", "roots", "selectors", "links", "marks", "srcs", "origin", "inner")
    known = whole.join(first, ["k", "page_id"]).select("k", *[F.col(c).alias(f"in_{c}") for c in held])
    last = whole.withColumn("path", F.col("frame_id").cast("string")).withColumn("above", F.array("k")).withColumn("outer", F.lit("")).drop("k")
    out, columns = last, last.columns
    while True:
        wanted = last.select("page_id", "url", "path", "above", "outer", F.posexplode("srcs").alias("n", "s"))
        wanted = wanted.select("page_id", "url", F.concat_ws(".", "path", F.col("n").cast("string")).alias("path"), "above", F.concat("outer", "s.prefix").alias("outer"), U.key("s.src").alias("k"))
        wanted = wanted.where(~F.array_contains("above", F.col("k")))
        last = wanted.join(known, "k").select(
            "page_id", "url", *[F.col(f"in_{c}").alias(c) for c in held if c != "prefix"], F.concat("outer", "in_prefix").alias("prefix"),
            F.concat_ws("/", "path", F.col("in_frame_id").cast("string")).alias("path"), F.concat("above", F.array("k")).alias("above"), "outer",
        )
        last = stored(last.select(columns), "frames_below")
        if last.isEmpty():
            break
        out = out.unionByName(last)
    # one number per frame of a page: 64 bits of the path that leads to it, the page itself 0
    number = F.when(F.col("path") == "0", F.lit(0)).otherwise(F.xxhash64("path"))
    return out.withColumn("frame_id", number.cast("long")).drop("srcs", "path", "above", "outer")


def tables(frames_df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holders, roots and selectors (frame prefix included) of frames."""
    key = ["page_id", "frame_id"]
    holders = frames_df.select(*key, F.posexplode("holders").alias("ord", "h")).select(*key, "ord", "h.*")
    roots = frames_df.select(*key, F.explode("roots").alias("r")).select(*key, "r.*")
    selectors = frames_df.select(*key, "url", "prefix", F.explode("selectors").alias("s"))
    return holders, roots, selectors.select(*key, "url", F.col("s.e").alias("e"), F.concat("prefix", "s.location").alias("location"))
