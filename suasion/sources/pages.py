"""Pages as tables: the nodes of a page's HTML that a detector might care about, and what the page says of itself.

A page is parsed once, where its row lies, one Arrow batch at a time; nothing is shuffled and no page meets another.
There is no layout engine: styles are those of ``style`` and ``hidden`` attributes with their inheritance, and a box is
known only where a width and a height are written (in px, or as attributes); an unknown box counts as visible.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from suasion.functions.lexicons import TRIGGERS

# fixed values: subtrees that are never read, elements that always count, limits
REJECTED = frozenset(("script", "style", "noscript", "svg"))
ALWAYS = frozenset(("input", "button", "select", "a", "del", "s", "strike"))
MAX_NODES, MAX_DEPTH, MAX_TEXT, MAX_BODY = 4_000, 12, 400, 400_000
ROW_LEVELS, ROW_TEXT, BARE_TEXT, GROUND_HOPS, MARK_LEVELS, SUMMARY_TEXT, NAME_TEXT = 3, 140, 40, 8, 6, 90, 60
ROW_TAGS = frozenset(("li", "tr", "div", "article"))
PRICE_GLYPH = re.compile(r"[$£€¥₹]\s?\d")
PRICED = re.compile(r"[$£€¥₹]\s?\d[\d.,]*")
PER_UNIT = re.compile(r"[$£€¥₹]\s?[\d.,]+\s*(?:/|per|a)\s*(?:night|person|adult|guest|traveller|traveler|way|leg|ticket)\b")
MONEY_LABEL = re.compile(r"\b(?:sub-?totals?|totals?|amount due|you pay|taxe?s?|vat|gst|fees?|shipping|delivery|savings?|discounts?|promotions?|retail price|estimated price|handling|charges?)\b", re.IGNORECASE)
TOTAL_LABEL = re.compile(r"\b(?:totals?|amount due|you pay)\b", re.IGNORECASE)
REMOVE = re.compile(r"^(?:remove|delete|trash|bin|×|✕|x)$|\bremove\b|\bdelete\b")
QUANTITY_WORD = re.compile(r"\b(?:qty|quantity)\b", re.IGNORECASE)
CALLS = {
    "add_to_cart": (50, re.compile(r"\badd to (?:cart|bag|basket|order)\b|\bbuy now\b|\badd to my bag\b")),
    "checkout_cta": (20, re.compile(r"\bcheckout\b|\bcheck out\b|\bproceed to\b|\bcontinue to (?:payment|checkout)\b|\breserve\b")),
    "place_order": (20, re.compile(r"\bplace order\b|\bpay now\b|\bcomplete (?:order|purchase)\b|\bsubmit order\b")),
    "booking_cta": (
        50,
        re.compile(
            r"\bbook now\b|\breserve (?:now|room|table|seat)\b|\bselect (?:room|flight|fare|seats?|tickets?)\b|\bchoose (?:room|flight|dates?)\b"
            r"|\b(?:see|check) availability\b|\b(?:get|buy|find) tickets?\b|\bview deal\b|\bbook (?:this )?(?:room|flight|trip|stay)\b"
        ),
    ),
}
STEP = "(?:cart|bag|basket|flights?|bundle|seats?|extras|shipping|delivery|details|review|payment|checkout|place order|confirm)"
STEP_GLYPHS = ">›»→|•"
STEPS = re.compile(rf"{STEP}\s*[{STEP_GLYPHS}]\s*{STEP}")
CONTACT = {
    "email": re.compile(r"\bemail\b|e-mail"),
    "name": re.compile(r"first[\s_-]*name|last[\s_-]*name|given[\s_-]*name|family[\s_-]*name|surname|full[\s_-]*name"),
    "postal": re.compile(r"post(?:al)?[\s_-]*code|\bzip\b|\bpostcode\b"),
    "address": re.compile(r"address|street|\bcity\b|\btown\b|address-level|\bcountry\b|\bregion\b|\bstate\b"),
}
PRODUCT_DEPTH = 5
# end of fixed values
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
CLOSES = {"p": ("p",), "li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Sizes that elements have of themselves, as shares of their parent's.
SIZES = {"h1": 2.0, "h2": 1.5, "h3": 1.17, "small": 0.83, "sub": 0.83, "sup": 0.83}
BOLD = frozenset(("b", "strong", "h1", "h2", "h3", "h4", "h5", "h6", "th"))
RAW_TEXT = 4_000
#: How many texts (of MAX_TEXT characters at most) and start tags a worker remembers the findings of, as pages of a shop say the same again and again.
MEMO = 8_192
#: A text and the plain start tag, end tag, comment or doctype after it; pages that hold anything else go through HTMLParser whole.
_TOKEN = re.compile(
    r"""([^<]*)<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\r\n\f]+[a-zA-Z_][-a-zA-Z0-9_:.]*(?:="[^"]*"|='[^']*'|=[^\s"'<>=`/]+(?=[ \t\r\n\f>]))?)*)[ \t\r\n\f]*(/?)|!(?:--(?:.*?)--\s*|(?i:doctype)[^>]*))>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*)(?:="([^"]*)"|='([^']*)'|=([^\s"'<>=`/]+))?""")
_RAW_END = {tag: re.compile(rf"</\s*{tag}\s*>", re.IGNORECASE) for tag in HTMLParser.CDATA_CONTENT_ELEMENTS}
#: What is no part of a page's body, or never read as text.
UNSPOKEN = frozenset(("html", "head", "body", "title", "meta", "link", *REJECTED))
#: Font size, weight, colour, and whether shown and gone, above the first element.
TOP = (16.0, 400, "", True, False)
_WORTH = re.compile("[0-9$£€¥₹:%]|" + "|".join(re.escape(w) for w in TRIGGERS))
_CLEAR = re.compile(r"^(?:|transparent|rgba\(\s*0,\s*0,\s*0,\s*0\s*\))$")
_LENGTH, _NUMBER = re.compile(r"^([\d.]+)(px|em|rem|%)?$"), re.compile(r"^[\d.]+$")
_STRAIGHT = str.maketrans("‘’“”", "''\"\"")
_ID = re.compile(r"[a-zA-Z][\w-]*")

NODE = (
    "idx int, parent_idx int, tag_name string, role string, accessible_name string, text string, selector_path string, container_path string, container_text string, row_text string, has_progress boolean, in_dialog boolean, cents_child boolean, "
    "struck boolean, rendered boolean, area double, font_px double, weight int, color string, background string, input_type string, checked boolean, attrs map<string,string>"
)
META = (
    "title string, lang string, og_type string, json_ld array<string>, has_product_ld boolean, product struct<gtin:string,sku:string,id:string,title:string>, dom_sku string, has_cc_field boolean, has_postal boolean, has_address boolean, has_contact boolean, "
    "has_quantity boolean, has_remove boolean, has_total boolean, has_steps boolean, cart_rows int, summary_rows int, add_to_cart int, checkout_cta int, place_order int, booking_cta int, per_unit_rows int, priced_texts int, n_elements int"
)


def _tidy(text: str, most: int = MAX_TEXT) -> str:
    return " ".join(text.split())[:most]


class _Given:
    """What a start tag gives by its attributes. Equal tags share one, so nothing of it may be changed."""

    __slots__ = ("anchor", "area", "attrs", "ground", "items", "lined", "opaque", "quantity", "role", "style", "unseen")

    def __init__(self, attrs: dict[str, str]) -> None:
        self.attrs, self.role, self.items = attrs, attrs.get("role"), list(attrs.items())
        self.style: dict[str, str] = {}
        for part in attrs["style"].lower().split(";") if "style" in attrs else ():
            name, _, value = part.partition(":")
            if value:
                self.style[name.strip()] = value.strip().removesuffix("!important").strip()
        style = self.style
        self.anchor = f"#{attrs['id']}" if "id" in attrs and _ID.fullmatch(attrs["id"]) else None
        sides = [_pixels(style.get(k, attrs.get(k, "")), 0.0) for k in ("width", "height")]
        self.area = None if None in sides else sides[0] * sides[1]
        opacity = _NUMBER.match(style.get("opacity", "1"))
        self.opaque = (opacity is None or opacity[0].count(".") > 1 or float(opacity[0]) > 0.05) and (self.area is None or self.area > 0)
        self.lined = "line-through" in style.get("text-decoration", "") + style.get("text-decoration-line", "")
        own = style.get("background-color", style.get("background", ""))
        self.ground = None if _CLEAR.match(own) else own
        self.unseen = "hidden" in attrs or "inert" in attrs or attrs.get("aria-hidden") == "true" or style.get("display") == "none"
        self.quantity = self.says("class", "quantity")

    def says(self, name: str, *parts: str) -> bool:
        if name not in self.attrs:
            return False
        value = self.attrs[name].lower()
        return any(p in value for p in parts)


def _given(written: str) -> _Given:
    """The plain attributes of a start tag, as written."""
    attrs = {}
    for name, double, single, bare in _ATTRIBUTE.findall(written):
        value = double or single or bare
        attrs[name.lower()] = unescape(value) if "&" in value else value
    return _Given(attrs)


_known = lru_cache(MEMO)(_given)


class _Element:
    __slots__ = ("attrs", "content", "given", "kinds", "look", "nth", "parent", "place", "raw", "said", "steps", "tag")

    def __init__(self, tag: str, given: _Given, parent: _Element | None) -> None:
        self.tag, self.given, self.attrs, self.parent = tag, given, given.attrs, parent
        self.content: list[str | _Element] = []
        self.raw = self.place = ""
        self.steps = 0
        self.said: str | None = None
        self.kinds: dict[str, int] = {}
        self.look: tuple[float, int, str, bool, bool] = TOP
        self.nth = 1
        if parent is not None:
            self.nth = parent.kinds[tag] = parent.kinds.get(tag, 0) + 1
            parent.content.append(self)

    def locate(self) -> None:
        """Where it lies; of a parsed page, and after its parent."""
        up = self.parent
        if self.given.anchor is not None:
            self.place, self.steps = self.given.anchor, 1
            return
        step = f"{self.tag}:nth-of-type({self.nth})" if up is not None and up.kinds[self.tag] > 1 else self.tag
        if up is None:
            self.place, self.steps = step, 1
        elif up.steps < MAX_DEPTH:
            self.place, self.steps = f"{up.place}>{step}", up.steps + 1
        else:  # the outermost step goes
            self.place, self.steps = f"{up.place.split('>', 1)[1]}>{step}", MAX_DEPTH

    def joined(self) -> str:
        """The texts of its children, set apart by blanks; of a parsed page, so it is worked out once."""
        if self.said is None:
            c = self.content
            self.said = _tidy(" ".join([x if isinstance(x, str) else x.raw for x in c])) if c else ""
        return self.said

    def above(self, levels: int) -> Iterator[_Element]:
        at = self.parent
        while at is not None and levels:
            yield at
            at, levels = at.parent, levels - 1

    def is_button(self) -> bool:
        return self.tag in ("button", "a") or self.given.role == "button"


class _Tree(HTMLParser):
    """The elements of a page in document order, and the text of the subtrees that are never read as text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.open: list[_Element] = []
        self.shut = 0
        self.scripts: list[tuple[_Element, str]] = []

    def _pop(self) -> str:
        tag = self.open.pop().tag
        self.shut -= tag in REJECTED
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.begin(tag, _Given({k: v or "" for k, v in attrs}))

    def begin(self, tag: str, given: _Given) -> None:
        while self.open and self.open[-1].tag in CLOSES.get(tag, ()):
            self._pop()
        e = _Element(tag, given, self.open[-1] if self.open else None)
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)
            self.shut += tag in REJECTED

    def handle_endtag(self, tag: str) -> None:
        if any(e.tag == tag for e in self.open):
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.shut:
            self.scripts.append((self.open[-1], data))
        elif self.open:
            self.open[-1].content.append(data)


def _plain(html: str) -> _Tree | None:
    """The tree that HTMLParser makes of a page, if it holds nothing but plain tags, texts, comments and doctypes; else null."""
    tree, at = _Tree(), 0
    while (m := _TOKEN.match(html, at)) is not None:
        text, closes, tag, written, empty = m.groups()
        at = m.end()
        if text:
            tree.handle_data(unescape(text) if "&" in text else text)
        if tag is None:
            continue
        tag = tag.lower()
        if closes:
            if written or empty:
                return None
            if tree.open and tree.open[-1].tag == tag:
                tree._pop()
            else:
                tree.handle_endtag(tag)
            continue
        tree.begin(tag, _known(written) if len(written) <= MAX_TEXT else _given(written))
        if empty:
            tree.handle_endtag(tag)
        elif tag in _RAW_END:  # nothing in it is a tag but its end
            end = _RAW_END[tag].search(html, at)
            if end is None:
                return None
            if end.start() > at:
                tree.handle_data(html[at : end.start()])
            tree.handle_endtag(tag)
            at = end.end()
    if html.find("<", at) >= 0:
        return None
    if at < len(html):
        tree.handle_data(unescape(html[at:]))
    return tree


def parse(html: str) -> _Tree:
    tree = _plain(html)
    if tree is None:
        tree = _Tree()
        tree.feed(html)
        tree.close()
    for e in reversed(tree.elements):  # children before parents
        c = e.content
        if len(c) == 1:
            e.raw = c[0][:RAW_TEXT] if isinstance(c[0], str) else c[0].raw
        elif c:
            e.raw = "".join([x if isinstance(x, str) else x.raw for x in c])[:RAW_TEXT]
    for e in tree.elements:
        _dress(e)
    return tree


def _pixels(value: str, of: float) -> float | None:
    m = _LENGTH.match(value) if value else None
    try:
        n = float(m[1]) if m else None
    except ValueError:
        return None
    return None if n is None else n * {"em": of, "rem": 16.0, "%": of / 100}.get(m[2], 1.0)


def _dress(e: _Element) -> None:
    """Font size, weight, colour and visibility of an element, after its parent."""
    look, s = e.parent.look if e.parent is not None else TOP, e.given.style
    if not s and e.tag not in SIZES and e.tag not in BOLD and "hidden" not in e.attrs:
        e.look = look
        return
    size, weight, color, shown, gone = look
    own = _pixels(s.get("font-size", ""), size)
    size = own if own is not None else size * SIZES.get(e.tag, 1.0)
    heavy = s.get("font-weight", "")
    weight = int(heavy) if heavy.isdigit() else 700 if heavy == "bold" else 400 if heavy == "normal" else 700 if e.tag in BOLD else weight
    shown = s["visibility"] != "hidden" if "visibility" in s else shown
    gone = gone or s.get("display") == "none" or "hidden" in e.attrs
    e.look = (size, weight, s.get("color", color), shown, gone)


def _ground(e: _Element) -> str:
    """What a node is painted on: of controls the nearest colour within a few levels."""
    if e.given.ground is not None:
        return e.given.ground
    if e.tag in ("button", "a", "input", "label") or e.given.role in ("button", "link"):
        for up in e.above(GROUND_HOPS):
            if up.given.ground is not None:
                return up.given.ground
    return "rgb(255, 255, 255)"


@lru_cache(MEMO)
def _bare(text: str) -> bool:
    """Whether a text is a price and nothing else."""
    return bool(PRICE_GLYPH.search(text)) and not re.sub(r"[\d.,\s\-–—:•]", "", re.sub(r"[$£€¥₹]\s?[\d.,]+", "", text))


@lru_cache(MEMO)
def _normal(text: str) -> str:
    return " ".join(text.lower().translate(_STRAIGHT).split())


@lru_cache(MEMO)
def _worth(own: str) -> bool:
    """Whether a node's own text is worth a detector's time."""
    return _WORTH.search(own.lower()) is not None


@lru_cache(MEMO)
def _priced(text: str) -> bool:
    return PRICE_GLYPH.search(text) is not None


@lru_cache(MEMO)
def _labels(text: str) -> tuple[bool, bool, bool]:
    """Whether a text names a sum or charge and is short, names a total, and names a quantity."""
    return len(text) <= SUMMARY_TEXT and MONEY_LABEL.search(text) is not None, TOTAL_LABEL.search(text) is not None, QUANTITY_WORD.search(text) is not None


@lru_cache(MEMO)
def _calls(name: str) -> tuple[bool, tuple[str, ...]]:
    """Whether a control's name removes something, and the calls to action it makes."""
    return REMOVE.search(name) is not None, tuple(k for k, (_, p) in CALLS.items() if p.search(name))


def _row_text(e: _Element, own: str) -> str:
    """The nearest row around a bare price that says what it is the price of."""
    if not own or len(own) > BARE_TEXT or not _bare(own):
        return ""
    for up in e.above(ROW_LEVELS):
        t = _normal(up.joined())
        if 0 < len(t) <= ROW_TEXT and _priced(t) and not _bare(t):
            return t
    return ""


def _nodes(tree: _Tree) -> list[dict]:
    by_id = {e.attrs["id"]: e for e in reversed(tree.elements) if e.attrs.get("id")}
    rejected, place = set(), {}
    out: list[dict] = []
    progress: set[int] = set()
    for e in tree.elements:
        if e.tag == "progress" or e.given.role == "progressbar":
            at = e.parent
            while at is not None and id(at) not in progress:
                progress.add(id(at))
                at = at.parent
    for e in tree.elements:
        up, tag = e.parent, e.tag
        if tag in REJECTED or (rejected and up is not None and id(up) in rejected):
            rejected.add(id(e))
            continue
        e.locate()
        if tag not in ALWAYS:
            c = e.content
            own = c[0] if len(c) == 1 else "".join([x for x in c if isinstance(x, str)])
            if not isinstance(own, str) or not (own := _tidy(own)) or not _worth(own):
                continue
        if len(out) == MAX_NODES:
            break
        given, attrs = e.given, e.attrs
        size, weight, color, shown, gone = e.look
        name = e.raw
        if attrs:
            label = by_id.get(attrs.get("aria-labelledby", "")) if by_id else None
            name = attrs.get("aria-label") or (label.raw if label else "") or attrs.get("alt") or (attrs.get("value") if tag == "input" else "") or name
        text = e.joined()
        place[id(e)] = len(out)
        out.append({
            "idx": len(out), "parent_idx": place.get(id(up), -1), "tag_name": tag, "role": given.role, "accessible_name": _tidy(name), "text": text,
            "selector_path": e.place, "container_path": up.place if up is not None else "", "container_text": _normal(up.joined()) if up is not None else "", "row_text": _row_text(e, _normal(text)),
            "has_progress": id(e) in progress, "in_dialog": False, "cents_child": False, "struck": tag in ("del", "s", "strike") or given.lined,
            "rendered": shown and not gone and given.opaque, "area": given.area, "font_px": size, "weight": weight, "color": color, "background": _ground(e),
            "input_type": (attrs.get("type") or "text").lower() if tag == "input" else None, "checked": "checked" in attrs or attrs.get("aria-checked") == "true", "attrs": given.items,
        })
    for n in out:  # a dialog among itself and five accepted parents; cents set small below a price
        at = n
        for _ in range(MARK_LEVELS):
            if at["role"] in ("dialog", "alertdialog"):
                n["in_dialog"] = True
                break
            if at["parent_idx"] < 0:
                break
            at = out[at["parent_idx"]]
        if n["parent_idx"] >= 0 and len(n["text"]) == 2 and n["text"].isdecimal() and n["font_px"] < 0.8 * out[n["parent_idx"]]["font_px"]:
            out[n["parent_idx"]]["cents_child"] = True
    return out


def _products(block: object, depth: int = 0) -> Iterator[dict]:
    """Product and Offer objects of a JSON-LD block, outermost first."""
    if depth > PRODUCT_DEPTH:
        return
    if isinstance(block, list):
        for x in block:
            yield from _products(x, depth + 1)
    elif isinstance(block, dict):
        kind = block.get("@type")
        if {"Product", "Offer"} & set(kind if isinstance(kind, list) and all(isinstance(k, str) for k in kind) else [kind] if isinstance(kind, str) else []):
            yield block
        for x in block.values():
            yield from _products(x, depth + 1)


def _word(value: object) -> str | None:
    if isinstance(value, str) and value.strip():
        return value.strip()[:128]
    return str(value) if isinstance(value, int | float) and not isinstance(value, bool) else None


def _product(blocks: list[object]) -> dict | None:
    """The keys of the first product or offer that has any."""
    first = lambda p, *names: next((w for w in (_word(p.get(n)) for n in names) if w), None)
    for p in (p for b in blocks for p in _products(b)):
        keys = {"gtin": first(p, "gtin13", "gtin12", "gtin8", "gtin"), "sku": first(p, "sku", "productID", "mpn"), "id": first(p, "@id")}
        if any(keys.values()):
            return keys | {"title": _word(p.get("name"))}
    return None


def _contact(tree: _Tree) -> dict[str, bool]:
    said, addresses = set(), 0
    fields = [e for e in tree.elements if e.tag in ("input", "select")]
    for e in fields:
        kind = e.attrs.get("type", "").lower()
        hint = " ".join(filter(None, (e.attrs.get(k) for k in ("autocomplete", "name", "id", "placeholder", "aria-label")))).lower()
        if kind in ("hidden", "search", "password") or not (hint or kind == "email"):
            continue
        said |= {k for k, p in CONTACT.items() if p.search(hint)} | ({"email"} if kind == "email" else set())
        addresses += bool(CONTACT["address"].search(hint))
    completes = lambda *names: sum(bool(set(e.attrs.get("autocomplete", "").split()) & set(names)) for e in fields if e.tag == "input")
    return {"has_cc_field": completes("cc-number") > 0, "has_postal": completes("postal-code") > 0 or "postal" in said, "has_address": completes("address-line1", "address-level2", "country") >= 2 or addresses >= 2, "has_contact": {"name", "email"} <= said}


def _signals(tree: _Tree) -> dict:
    """Counted signs of carts, summaries, calls to action and steps."""
    els = tree.elements
    calls, quantity, removal, inside = Counter(), set(), set(), set()
    has_remove = has_quantity = False
    classed = any(e.given.quantity for e in els)

    def mark(e: _Element, into: set[int]) -> None:
        into.update(map(id, (e, *e.above(MARK_LEVELS - 1))))

    for e in els:
        if e.attrs:
            says = e.given.says
            counted = (e.tag == "input" and e.attrs.get("type") == "number") or (e.tag == "select" and says("name", "qty", "quant")) or says("aria-label", "quantity")
            if counted:
                mark(e, quantity)
            has_quantity = has_quantity or counted or says("data-testid", "qty")
        if classed and e.tag == "button":
            has_quantity = has_quantity or any(up.given.quantity for up in e.above(99))
        if e.is_button():
            name = _tidy(e.attrs.get("aria-label") or e.raw).lower()
            removes, called = _calls(name)
            if removes:
                mark(e, removal)
            if 0 < len(name) <= NAME_TEXT:
                has_remove = has_remove or removes
                calls.update(called)
    texts: dict[int, str] = {}
    for e in reversed(els):
        texts[id(e)] = _tidy(" ".join([x if isinstance(x, str) else texts.get(id(x), "") for x in e.content[:60]])) if e.content else ""
    blocks, hidden = set(), set()
    for e in els:
        if e.given.unseen or (hidden and e.parent is not None and id(e.parent) in hidden):
            hidden.add(id(e))
        if e.tag in ("div", "li", "tr", "section"):
            for up in e.above(MAX_NODES):
                if id(up) in blocks:  # and all above it
                    break
                blocks.add(id(up))
    unseen = lambda e: id(e) in hidden or not e.look[3]
    priced = [(e, t) for e in els if (t := texts[id(e)]) and e.tag not in UNSPOKEN and _priced(t)]
    summary = [t for e, t in priced if _labels(t)[0] and id(e) not in blocks and not unseen(e)]
    rows = [e for e, t in priced if e.tag in ROW_TAGS and (id(e) in quantity or id(e) in removal or _labels(t)[2])]
    for e in rows:
        inside.update(map(id, e.above(MAX_NODES)))
    whole: list[str] = []
    top = next((e for e in els if e.tag == "body"), None)
    stack: list[str | _Element] = [top] if top is not None else [e for e in els if e.parent is None]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            whole.append(at)
        else:
            stack.extend(reversed(at.content))
    text = _tidy("".join(whole), MAX_BODY).lower()
    return {
        "has_quantity": has_quantity, "has_remove": has_remove, "has_total": any(_labels(t)[1] for t in summary), "has_steps": any(g in text for g in STEP_GLYPHS) and bool(STEPS.search(text)),
        "cart_rows": min(50, sum(id(e) not in inside and not unseen(e) for e in rows)), "summary_rows": min(20, len(summary)), **{k: min(most, calls[k]) for k, (most, _) in CALLS.items()},
        "per_unit_rows": min(50, len(PER_UNIT.findall(text))), "priced_texts": min(200, len(PRICED.findall(text))),
    }


def _meta(tree: _Tree) -> dict:
    first = lambda tag: next((e for e in tree.elements if e.tag == tag), None)
    title, root = first("title"), first("html")
    og = next((e.attrs.get("content") for e in tree.elements if e.tag == "meta" and e.attrs.get("property") == "og:type"), None)
    raw, blocks = [d for e, d in tree.scripts if e.tag == "script" and e.attrs.get("type") == "application/ld+json"], []
    for text in raw:
        try:
            blocks.append(json.loads(text))
        except (ValueError, RecursionError):  # malformed blocks are common and say nothing
            continue
    marked = next((e for e in tree.elements if e.attrs.get("itemprop") == "sku" or "data-sku" in e.attrs or "data-product-id" in e.attrs), None)
    sku = next((v for v in (marked.attrs.get("content"), marked.attrs.get("data-sku"), marked.attrs.get("data-product-id"), marked.raw.strip()) if v is not None), "") if marked is not None else ""
    return {
        "title": _tidy(title.raw) if title else None, "lang": root.attrs.get("lang") if root else None, "og_type": og, "json_ld": raw, "has_product_ld": any("Product" in str(p.get("@type")) for b in blocks for p in _products(b)),
        "product": _product(blocks), "dom_sku": sku if 0 < len(sku) < 64 else None, "n_elements": len(tree.elements), **_contact(tree), **_signals(tree),
    }


def nodes_of(html: str) -> list[dict]:
    """The accepted nodes of one page: controls and struck text always, others when their own text holds something of interest."""
    return _nodes(parse(html))


def meta_of(html: str) -> dict:
    """What one page says of itself."""
    return _meta(parse(html))


_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}
_KINDS["struct<gtin:string,sku:string,id:string,title:string>"] = pa.struct([(k, pa.string()) for k in ("gtin", "sku", "id", "title")])


def _arrow(fields: str) -> pa.StructType:
    return pa.struct([(name, _KINDS[kind]) for name, kind in (f.split(" ", 1) for f in fields.split(", "))])


def _ddl(fields: str) -> str:
    return "struct<" + ",".join(":".join(f.split(" ", 1)) for f in fields.split(", ")) + ">"


def scan(pages: DataFrame, parts: tuple[str, ...] = ("meta", "nodes"), keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, meta, nodes) of each page (page_id, html), both from one parse; of ``parts`` only those named, and the columns of ``keep`` as they are.

    A null or empty page has no nodes.
    """
    makers = {"meta": (_meta, _arrow(META), _ddl(META)), "nodes": (_nodes, pa.list_(_arrow(NODE)), f"array<{_ddl(NODE)}>")}
    passed = ("page_id", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                trees = [parse((x.as_py() or b"").decode("utf-8", "replace")) for x in part.column(len(passed)).cast(pa.binary())]
                made = [pa.array([makers[name][0](t) for t in trees], makers[name][1]) for name in parts]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(passed))), *made], [*passed, *parts])

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in passed]
    return pages.select(*passed, "html").mapInArrow(run, ", ".join([*kinds, *(f"{name} {makers[name][2]}" for name in parts)]))


def harvest(pages: DataFrame) -> DataFrame:
    """One row for each accepted node of each page (page_id, html)."""
    return scan(pages, ("nodes",)).selectExpr("page_id", "inline(nodes)")


def page_meta(pages: DataFrame) -> DataFrame:
    """One row for each page (page_id, html): title, language, kind, JSON-LD, product keys, contact fields and counted signals."""
    return scan(pages, ("meta",)).selectExpr("page_id", "meta.*")
