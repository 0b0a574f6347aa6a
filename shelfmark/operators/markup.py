"""One pass over HTML: each page is parsed once, in Arrow batches, into a struct of what it says of a product.

A parser gives a page's elements with the ranges of text inside them; everything below is read off those ranges. What is
chosen among the finds (precedence, prices, descriptions) is left to column expressions: see `records`.

Elements nest as they are written: an end tag closes the nearest open element of its name and all inside it, an unmatched one is
ignored. Navigation, footers, asides and elements whose class names something related or recommended are left out, with all
in them. Broken JSON is skipped. Null HTML is an empty page. A page is held whole by its task.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template rt rp".split())
BLOCKS = frozenset("p div section li tr h1 h2 h3 h4".split())
#: Parts of a page that are not the product's, names of containers of technical data and of descriptions.
BOILERPLATE_TAGS, BOILERPLATE_CLASSES = frozenset(("nav", "footer", "aside")), ("related", "recommend")
SPEC_NAMES = ("spec", "technical", "caracteristic", "ficha")
DESCRIPTION_IDS = frozenset("description descricao product-description productDescription feature-bullets aplus".split())
DESCRIPTION_CLASSES = frozenset("ui-pdp-description__content shopee-product-detail__description".split())
DESCRIPTION_CLASS_PARTS = ("product-description", "description__content")
DESCRIPTION_TESTS = frozenset("product-description description rich-content-container".split())
TECHNICAL_PATHS = ("spec", "attribute", "characteristic", "feature", "technical", "ficha", "detail", "property", "properties")
LABEL_KEYS, VALUE_KEYS = ("name", "label", "title", "key"), ("value", "value_name", "text", "values")
#: Fixed limits of the contract: pairs of a page, letters of a name and of a value, rows and containers looked at, depth of linked data.
MOST_PAIRS, MOST_NAME, MOST_VALUE, MOST_ROWS, MOST_TERMS, MOST_CONTAINERS, MOST_LINES, MOST_LINE = 250, 160, 1000, 400, 250, 40, 300, 1200
MOST_JSON_PAIRS, MOST_JSON_VALUE, DEEPEST = 300, 1200, 16
#: Letters of HTML after which a batch is handed on.
BATCH_LETTERS = 4 << 20

PAGE = (
    "struct<heading string, named_heading string, h1 string, title string, has_product boolean, product_source string, "
    "product struct<name string, brand string, model string, mpn string, gtin string, description string, image string>, "
    "offers array<struct<price string, spec_price string, currency string, availability string>>, metas map<string, string>, canonical string, "
    "item_price string, item_image string, pairs array<struct<kind string, name string, value string>>, json_pairs array<struct<path string, name string, value string>>, "
    "sections array<string>, links array<struct<href string, label string>>, text string>"
)


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids", "first", "last", "raw", "gone", "silent", "aside")

    def __init__(self, tag: str, attrs: dict, parent: Element | None, first: int):
        self.tag, self.attrs, self.parent, self.first, self.last = tag, attrs, parent, first, first
        self.kids, self.raw = [], ""
        self.gone = parent is not None and parent.gone
        self.silent = tag in SILENT or (parent is not None and parent.silent)
        self.aside = tag in ("noscript", "iframe") or (parent is not None and parent.aside)

    def has(self, attr: str, *parts: str) -> bool:
        value = self.attrs.get(attr)
        return bool(value) and any(p in value for p in parts)

    @property
    def classes(self) -> set:
        return set((self.attrs.get("class") or "").split())

    def above(self) -> Iterator[Element]:
        at = self.parent
        while at is not None:
            yield at
            at = at.parent


class Document(HTMLParser):
    """A page's elements in order, and its text in pieces: (kind, text), of kind `t`, `n` (in noscript or iframe) or `b` (a line break)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements, self.pieces, self.scripts, self.open = [], [], [], Counter()
        self.root = self.at = Element("", {}, None, 0)
        self.joined = False
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):  # what was read up to a declaration that no parser takes
            pass
        while self.at is not self.root:
            self._leave()
        self.root.last = len(self.pieces)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def _break(self, element: Element) -> None:
        if element.tag in BLOCKS or element.tag == "br":
            self.pieces.append(("b", "\n"))

    def _leave(self) -> None:
        left = self.at
        left.last = len(self.pieces)
        if not left.gone:
            self._break(left)
        self.open[left.tag] -= 1
        self.at = left.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.joined = False
        found = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, 0)
        found.gone |= tag in BOILERPLATE_TAGS or found.has("class", *BOILERPLATE_CLASSES)
        if not found.gone:
            if tag != "br":
                self._break(found)
            self.elements.append(found)
            self.at.kids.append(found)
        elif tag == "script":
            self.scripts.append(found)
        if tag == "script" and not found.gone:
            self.scripts.append(found)
        found.first = len(self.pieces)
        self.open[tag] += 1
        self.at = found
        if tag in VOID:
            self._leave()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._leave()

    def handle_endtag(self, tag: str) -> None:
        self.joined = False
        if self.open[tag]:
            while self.at.tag != tag:
                self._leave()
            self._leave()

    def handle_comment(self, data: str) -> None:
        self.joined = False

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_data(self, data: str) -> None:
        if self.at.tag in SILENT:
            self.at.raw += data
        elif not self.at.gone and not self.at.silent:
            if self.joined:
                self.pieces[-1] = (self.pieces[-1][0], self.pieces[-1][1] + data)
            else:
                self.pieces.append(("n" if self.at.aside else "t", data))
            self.joined = True

    def strings(self, element: Element) -> list[str]:
        return [s for kind, piece in self.pieces[element.first : element.last] if kind != "b" and (s := piece.strip())]

    def text(self, element: Element) -> str:
        return " ".join(self.strings(element))

    def lines(self, element: Element) -> str | None:
        return tidy_lines("".join(piece for kind, piece in self.pieces[element.first : element.last] if kind != "n"))

    def all(self, *tags: str, **attrs: str) -> Iterator[Element]:
        """Elements in order, of one of the tags (any, if none is given), with these attributes; `_` stands for `-`."""
        for e in self.elements:
            if (not tags or e.tag in tags) and all(e.attrs.get(k.replace("_", "-")) == v for k, v in attrs.items()):
                yield e


def clean(value: object) -> str | None:
    return " ".join(str(value).split()) or None if value is not None else None


def tidy_lines(text: str) -> str | None:
    lines = (" ".join(line.split()) for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip() or None


def plain_lines(value: object) -> str | None:
    """A description as lines of text, from HTML or plain text; what is not text is none."""
    if not isinstance(value, str):
        return None
    if re.search(r"</?[a-zA-Z][^>]*>", value):
        inner = Document(value)
        return inner.lines(inner.root)
    return tidy_lines(value)


def single(value: object) -> object:
    """Of a list its first entry that says something."""
    return next((x for x in value if x not in (None, "", [], {})), None) if isinstance(value, list) else value


def said(value: object, *keys: str) -> str | None:
    """Text of a value; of an object the text under the first of the keys that it has."""
    value = single(value)
    if isinstance(value, dict):
        return next((t for k in keys if (t := said(value.get(k)))), None)
    return clean(value)


def is_kind(value: object, kind: str) -> bool:
    return any(isinstance(k, str) and re.search(rf"(?:^|/){kind}/?$", k) for k in (value if isinstance(value, list) else [value]))


class LinkedData:
    """The JSON-LD documents of a page: nodes with the same @id are one node, and a reference stands for the node."""

    def __init__(self, texts: list[str]):
        self.documents, self.nodes = [], {}
        for text in texts:
            try:
                self.documents.append(json.loads(text))
            except (ValueError, RecursionError):
                continue
        level = list(self.documents)
        for _ in range(DEEPEST):
            level = [child for x in level for child in (x if isinstance(x, list) else x.values() if isinstance(x, dict) else ()) if isinstance(child, (dict, list))]
            self._index(level)

    def _index(self, values: list) -> None:
        for x in (*values, *self.documents):
            if isinstance(x, dict) and isinstance(x.get("@id"), str):
                node = self.nodes.setdefault(x["@id"], {})
                if node is not x:
                    node.update(x)

    def whole(self, value: object, within: tuple = ()) -> object:
        """The value with its references resolved; a node inside itself keeps its plain values only."""
        if len(within) > DEEPEST:
            return None
        if isinstance(value, list):
            return [self.whole(x, (*within, None)) for x in value]
        if not isinstance(value, dict):
            return value
        name = value.get("@id")
        name = name if isinstance(name, str) else None
        if name is not None and name in within:
            return {k: v for k, v in value.items() if not isinstance(v, (dict, list))}
        return {k: self.whole(v, (*within, name)) for k, v in (self.nodes.get(name, {}) | value).items()}

    def products(self) -> list[dict]:
        """Distinct products that stand at the top, in a @graph or as a page's main entity."""
        found, todo = [], [(d, 0) for d in reversed(self.documents)]
        while todo:
            value, depth = todo.pop()
            if isinstance(value, dict):
                value = (self.nodes.get(value["@id"], {}) | value) if isinstance(value.get("@id"), str) else value
                if is_kind(value.get("@type"), "Product"):
                    product = self.whole(value)
                    found += [product] * (product not in found)
                    continue
                value = [value[k] for k in ("@graph", "mainEntity", "mainEntityOfPage") if k in value]
            if isinstance(value, list) and depth <= DEEPEST:
                todo += [(x, depth + 1) for x in reversed(value)]
        return found


def place(url: str, base: str = "") -> tuple | None:
    try:
        parts = urlsplit(urljoin(base, url))
    except ValueError:
        return None
    return parts.netloc, parts.path.rstrip("/")


def absolute(base: str, url: str | None) -> str | None:
    try:
        return urljoin(base, url) if url else None
    except ValueError:
        return None


def linked_product(doc: Document, canonical: str | None) -> dict:
    """The page's only product; of several the only one whose address is the canonical one, else none."""
    found = LinkedData([s.raw for s in doc.all("script", type="application/ld+json")]).products()
    if len(found) > 1 and canonical:
        found = [p for p in found if isinstance(a := p.get("url") or p.get("@id"), str) and place(a, canonical) == place(canonical)]
    return found[0] if len(found) == 1 else {}


def microdata_product(doc: Document) -> dict:
    """The properties of the page's only Product scope; a scope inside is an object, a property told again a list."""
    scopes = {id(e): {} for e in doc.elements if "itemscope" in e.attrs}
    products = [e for e in doc.elements if id(e) in scopes and is_kind(e.attrs.get("itemtype", "").split(), "Product")]
    if len(products) != 1:
        return {}
    for e in doc.elements:
        owner = next((a for a in e.above() if id(a) in scopes), None) if "itemprop" in e.attrs else None
        if owner is None:
            continue
        told = next((e.attrs[k] for k in ("content", "src", "href", "datetime") if e.attrs.get(k)), None)
        value = scopes[id(e)] if id(e) in scopes else told or doc.text(e)
        for name in e.attrs["itemprop"].split():
            held = scopes[id(owner)]
            if name not in held:
                held[name] = value
            else:
                held[name] = [*(held[name] if isinstance(held[name], list) else [held[name]]), value]
    return scopes[id(products[0])]


def property_pairs(product: dict) -> Iterator[tuple]:
    """Names and values with units of a product's additional properties."""
    listed = product.get("additionalProperty") or product.get("additionalProperties") or []
    for item in listed if isinstance(listed, list) else [listed]:
        if not isinstance(item, dict):
            continue
        value = item.get("valueReference") if item.get("value") is None else item["value"]
        holder = value if isinstance(value, dict) else item
        value = holder.get("value", "") if holder is value else value
        unit = holder.get("unitText") or holder.get("unitCode") or ""
        yield item.get("name"), None if value is None else f"{('Yes' if value else 'No') if isinstance(value, bool) and not unit else value} {unit}"


def page_pairs(doc: Document, product: dict) -> Iterator[tuple[str, object, object]]:
    """(kind, name, value) of linked properties, two-cell rows, terms with their definition, and lines of technical containers."""
    for name, value in property_pairs(product):
        yield "property", name, value
    for _, row in zip(range(MOST_ROWS), doc.all("tr")):
        cells = [k for k in row.kids if k.tag in ("th", "td")]
        if len(cells) >= 2:
            yield "row", doc.text(cells[0]), doc.text(cells[1])
    for _, term in zip(range(MOST_TERMS), doc.all("dt")):
        later = term.parent.kids[term.parent.kids.index(term) + 1 :]
        definition = next((k for k in later if k.tag == "dd"), None)
        if definition is not None:
            yield "term", doc.text(term), doc.text(definition)
    named = (e for e in doc.elements if e.has("class", *SPEC_NAMES) or e.has("id", *SPEC_NAMES))
    for _, container in zip(range(MOST_CONTAINERS), named):
        inside = (e for e in below(container) if e.tag in ("li", "p", "div"))
        for _, line in zip(range(MOST_LINES), inside):
            parts = [k for k in line.kids if k.tag in ("span", "div", "strong", "b")]
            if len(parts) == 2 and not any(e.tag in ("div", "li", "p") for p in parts for e in below(p)):
                yield "parts", doc.text(parts[0]), doc.text(parts[1])
            told = clean(doc.text(line)) or ""
            name, colon, value = told.partition(":")
            if colon and len(told) <= MOST_LINE and 1 <= len(name.strip()) <= MOST_NAME:
                yield "line", name, value


def below(element: Element) -> Iterator[Element]:
    todo = list(reversed(element.kids))
    while todo:
        e = todo.pop()
        yield e
        todo += reversed(e.kids)


def distinct_pairs(pairs: Iterator[tuple], most: int, longest: int) -> list[dict]:
    """The first `most` distinct pairs with a name and a value of allowed length."""
    kept = {}
    for kind, name, value in pairs:
        name, value = clean(name), clean(value)
        if name and value and len(name) <= MOST_NAME and len(value) <= longest:
            kept.setdefault((name.casefold(), value.casefold()), (kind, name, value))
            if len(kept) >= most:
                break
    return [dict(zip(("kind", "name", "value"), x)) for x in kept.values()]


def json_pairs(doc: Document) -> Iterator[tuple[str, object, object]]:
    """(path, name, value) of embedded JSON under paths that name technical data."""
    kinds = (lambda s: s.attrs.get("type") == "application/ld+json", lambda s: s.attrs.get("type") == "application/json", lambda s: s.attrs.get("id") == "__NEXT_DATA__")
    for raw in dict.fromkeys(s.raw.strip() for kind in kinds for s in doc.scripts if kind(s)):
        try:
            yield from technical_pairs(json.loads(raw), "")
        except (ValueError, RecursionError):
            continue


def technical_pairs(value: object, path: str) -> Iterator[tuple[str, object, object]]:
    if isinstance(value, list):
        for x in value:
            yield from technical_pairs(x, path)
    elif isinstance(value, dict):
        technical = any(word in path.casefold() for word in TECHNICAL_PATHS)
        labelled = any(k in value for k in LABEL_KEYS)
        if technical:
            name = next((value[k] for k in LABEL_KEYS if value.get(k)), None)
            told = next((value[k] for k in VALUE_KEYS if k in value), None)
            if name is not None and told is not None:
                yield path, name, flat(told)
        for k, child in value.items():
            if isinstance(child, (dict, list)):
                yield from technical_pairs(child, f"{path}.{k}" if path else str(k))
            elif technical and not labelled:
                yield path, k, flat(child)


def flat(value: object) -> object:
    of = lambda x: x.get("value") or x.get("name") if isinstance(x, dict) else x
    value = ", ".join(str(of(x) or "") if isinstance(x, dict) else str(x) for x in value) if isinstance(value, list) else of(value)
    return ("Sim" if value else "Não") if isinstance(value, bool) else value


def describes(e: Element) -> bool:
    return (
        e.attrs.get("itemprop") == "description" or e.attrs.get("id") in DESCRIPTION_IDS or bool(DESCRIPTION_CLASSES & e.classes)
        or e.attrs.get("data-testid") in DESCRIPTION_TESTS or e.has("class", *DESCRIPTION_CLASS_PARTS)
    )


def offers_of(product: dict) -> list[dict]:
    listed = product.get("offers")
    listed = [x for x in listed if isinstance(x, dict)] if isinstance(listed, list) else [listed] if isinstance(listed, dict) else []
    spec = lambda o: o["priceSpecification"] if isinstance(o.get("priceSpecification"), dict) else {}
    return [{"price": clean(o.get("price")), "spec_price": clean(spec(o).get("price")), "currency": clean(o.get("priceCurrency")), "availability": clean(o.get("availability"))} for o in listed]


def read_page(html: str | None, url: str | None) -> dict:
    """What a page says, as PAGE."""
    doc, url = Document(html or ""), url or ""
    first = lambda found: next(iter(found), None)
    text = lambda e: clean(doc.text(e)) if e is not None else None
    canonical = absolute(url, first(e.attrs.get("href") for e in doc.all("link", rel="canonical")))
    product, source = linked_product(doc, canonical), "JSON_LD"
    if not product:
        product, source = microdata_product(doc), "MICRODATA"
    metas = {}
    for e in doc.all("meta"):
        for attr in ("property", "name"):
            if e.attrs.get(attr):
                metas.setdefault(f"{attr}:{e.attrs[attr]}", clean(e.attrs.get("content")))
    for key in ("property:og:image", "name:twitter:image"):
        if metas.get(key):
            metas[key] = absolute(url, metas[key])
    price, image = first(doc.all(itemprop="price")), first(doc.all(itemprop="image"))
    image_told = next((v for k in ("content", "src", "data-src") if (v := image.attrs.get(k))), None) if image is not None else None
    labels = ((e.attrs["href"], " ".join(filter(None, (doc.text(e), e.attrs.get("title"), e.attrs.get("aria-label"))))) for e in doc.all("a") if "href" in e.attrs)
    return {
        "heading": text(first(doc.all("h1", "title"))), "h1": text(first(doc.all("h1"))), "title": text(first(doc.all("title"))),
        "named_heading": text(first(e for e in doc.elements if e.tag == "h1" or e.attrs.get("itemprop") == "name")),
        "has_product": bool(product), "product_source": source if product else None,
        "product": {
            "name": said(product.get("name")), "brand": said(product.get("brand"), "name"), "model": said(product.get("model"), "name"), "mpn": said(product.get("mpn")),
            "gtin": next((g for k in ("gtin13", "gtin12", "gtin14", "gtin") if (g := said(product.get(k)))), None),
            "description": plain_lines(single(product.get("description"))), "image": absolute(url, said(product.get("image"), "url")),
        },
        "offers": offers_of(product), "metas": list(metas.items()), "canonical": canonical,
        "item_price": (clean(price.attrs.get("content")) or text(price)) if price is not None else None, "item_image": absolute(url, clean(image_told)),
        "pairs": distinct_pairs(page_pairs(doc, product), MOST_PAIRS, MOST_VALUE),
        "json_pairs": [{"path": p["kind"], "name": p["name"], "value": p["value"]} for p in distinct_pairs(json_pairs(doc), MOST_JSON_PAIRS, MOST_JSON_VALUE)],
        "sections": [lines for e in doc.elements if describes(e) and (lines := doc.lines(e))],
        "links": [{"href": absolute(url, href), "label": label} for href, label in labels], "text": "\n".join(doc.strings(doc.root)),
    }


def parsed(pages: DataFrame, html: str = "html", url: str = "url", to: str = "page") -> DataFrame:
    """The rows with `to`, the struct PAGE of each, instead of the HTML. No shuffle; pages are handed on by BATCH_LETTERS of HTML."""
    kept = [c for c in pages.columns if c not in (html, to)]
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html).alias("_html"), F.col(url).alias("_url"))
    kind = pages.sparkSession.range(0).select(F.lit(None).cast(PAGE).alias(to)).schema[to].dataType
    schema = pages.select(*(F.col(f"`{c}`") for c in kept)).schema.add(to, kind)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html_of, url_of = batch.column("_html"), batch.column("_url")
            begun, held, size = 0, [], 0
            for i in range(batch.num_rows):
                text = html_of[i].as_py()
                held.append(read_page(text, url_of[i].as_py()))
                size += len(text or "")
                if size >= BATCH_LETTERS or i + 1 == batch.num_rows:
                    columns = [batch.column(c).slice(begun, len(held)) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(held, arrow)], [*kept, to])
                    begun, held, size = i + 1, [], 0

    return rows.mapInArrow(read, schema)
