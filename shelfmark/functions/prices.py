"""Prices, sellers, availability and kits as pages and shops' records tell them: what is said explicitly, in a fixed order of trust.

Column expressions only. A price is a positive amount; what is not one is as if it were not there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalars as S

_REAIS = r"R\$\s*([0-9.]+,[0-9]{2})"
#: How pages word a price by instant transfer, a price at once, a former price and the seller; what says that an item is or isn't sold.
PIX = (rf"(?iU){_REAIS}\s*no\s+pix", rf"(?iU)(?:pre[cç]o\s+no\s+pix|pix)\s*[:\-]?\s*{_REAIS}")
AT_ONCE = (rf"(?iU)(?:pre[cç]o|por)\s*[:\-]?\s*{_REAIS}(?!\s*(?:em|x|/))", rf"(?iU)[àa]\s+vista\s*[:\-]?\s*{_REAIS}")
FORMER = (rf"(?iU)(?:de|era)\s+{_REAIS}\s+(?:por|agora)", rf"(?iU)pre[cç]o\s+anterior\s*[:\-]?\s*{_REAIS}")
SOLD_BY = (r"(?isU)Vendido\s+por\s+(.+?)\s+e\s+entregue\s+por", r"(?isU)Vendido\s+e\s+entregue\s+por\s+(.+?)(?:\n|$)", r"(?isU)Vendido\s+por\s+(.+?)(?=\s+R\$|\s+Adicionar|\s+Comprar|\n|$)")
SOLD_OUT = ("produto indisponível", "produto indisponivel", "avise-me quando chegar")
ON_SALE = ("adicionar à sacola", "adicionar a sacola", "comprar agora")
KIT_WORDS = r"(?U)\b(?:kit|combo|conjunto)\b"
KIT_COUNTS = (r"(?U)\bkit\s+(?:com|de)\s+(\d+)\b", r"(?U)\b(\d+)\s*x\s*(?:8|16|24|32|48|64)\s*gb\b")
FAN_COUNT = r"(?U)\b(\d+)\s*(?:fans?|ventoinhas?)\b"
KIT_PARTS = (("TECLADO", r"(?U)\bteclado\b"), ("MOUSE", r"(?U)\bmouse\b"), ("VENTOINHA", r"(?U)\b(?:fan|ventoinha)"), ("MEMORIA_RAM", r"(?U)\b(?:mem[oó]ria\s+ram|ddr[345])\b"))
#: Fixed value: the source whose price is the one a buyer sees.
SEEN_SOURCE = "MERCADO_LIVRE_PDP"


def _amounts(text: Column, patterns: tuple[str, ...]) -> Column:
    """The first amount of the first pattern that has one."""
    def first(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), S.price_text)
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    return F.coalesce(*map(first, patterns))


def pix_price(text: Column) -> Column:
    return _amounts(text, PIX)


def price_at_once(text: Column) -> Column:
    """A price that is not followed by instalments."""
    return _amounts(text, AT_ONCE)


def former_price(text: Column) -> Column:
    """A former price named as one; null if its first mention is no amount."""
    return _amounts(text, FORMER)


def structured_price(entries: Column) -> Column:
    """Struct (price, previous) of an array of (best, full, regular): the first entry with an amount; previous is the largest above it."""
    def read(e: Column) -> Column:
        price = F.coalesce(*(S.positive(e[x]) for x in ("best", "full", "regular")))
        above = F.array_max(F.filter(F.array(e["full"], e["regular"]), lambda x: x > price))
        return F.struct(price.alias("price"), above.alias("previous"))

    return F.get(F.filter(F.transform(entries, read), lambda x: x.price.isNotNull()), F.lit(0))


def page_price(text: Column, entries: Column, generic: Column, generic_source: Column, marked: Column, generic_previous: Column) -> Column:
    """Struct (price, source, previous) of a page: by instant transfer, structured, any other reader's, named in the text.

    previous is the first of the price marked as original (if above the price), named in the text, structured, the other
    reader's; one that is not above the price is null, and the next one is not asked. entries as in `structured_price`.
    """
    def judge(x: Column) -> Column:
        sources = F.when(x.pix.isNotNull(), "MAGALU_PIX").when(x.own.price.isNotNull(), "MAGALU_ESTRUTURADO").when(x.generic.isNotNull(), x.generic_source).when(x.at_once.isNotNull(), "MAGALU_TEXTO_PRECO")
        return S.let(F.coalesce(x.pix, x.own.price, x.generic, x.at_once), lambda price: F.struct(price.alias("price"), sources.alias("source"), S.let(
            F.coalesce(F.when(price.isNull() | (x.marked > price), x.marked), x.former, x.own.previous, x.generic_previous), lambda p: F.when(price.isNull() | (p > price), p)
        ).alias("previous")))

    return S.let(F.struct(
        pix_price(text).alias("pix"), structured_price(entries).alias("own"), S.positive(generic).alias("generic"), generic_source.alias("generic_source"), price_at_once(text).alias("at_once"),
        S.positive(marked).alias("marked"), former_price(text).alias("former"), S.positive(generic_previous).alias("generic_previous"),
    ), judge)


def listing_price(sale: Column, prices: Column, item: Column, winner: Column, requested: Column) -> Column:
    """Struct (price, previous, currency, source) of a listing: its sale price, a promotion, the standard price, the listing's own, the catalogue's best offer.

    sale, item: (amount, regular, currency); prices: an array of these with a type; winner: the same with item_id. The best offer
    counts only if it is the requested listing's or one of the two ids is missing. The currency is BRL where none is told.
    Where no price is found all but the currency is null.
    """
    of = lambda kind: F.get(F.filter(prices, lambda p: (p["type"] == kind) & p["amount"].isNotNull()), F.lit(0))
    w_id = S.clean(winner["item_id"])
    ours = S.blank_to_null(requested).isNull() | w_id.isNull() | (w_id == requested)

    def found(amount: Column, previous: Column, currency: list[Column], source: str) -> Column:
        made = F.struct(amount.alias("price"), previous.alias("previous"), F.coalesce(*map(S.clean, currency), F.lit("BRL")).alias("currency"), F.lit(source).alias("source"))
        return F.when(amount.isNotNull(), made)

    none = F.struct(F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("previous"), F.coalesce(S.clean(item["currency"]), S.clean(sale["currency"]), F.lit("BRL")).alias("currency"), F.lit(None).cast("string").alias("source"))
    promotion, standard = of("promotion"), of("standard")
    return F.coalesce(
        found(sale["amount"], sale["regular"], [sale["currency"]], "SALE_PRICE"), found(promotion["amount"], promotion["regular"], [promotion["currency"]], "PRICES_PROMOTION"),
        found(standard["amount"], sale["regular"], [standard["currency"]], "PRICES_STANDARD"), found(item["amount"], item["regular"], [item["currency"], sale["currency"]], "ITEM_LEGACY_PRICE"),
        F.when(ours, found(winner["amount"], winner["regular"], [winner["currency"], item["currency"], sale["currency"]], "CATALOG_BUY_BOX")), none,
    )


def merged_price(price: Column, previous: Column, source: Column, other: Column, other_previous: Column, other_source: Column) -> Column:
    """Struct (price, previous, source) of two records of one listing: gaps are filled, but what a buyer sees wins; the least amount above it was its price before."""
    seen = other.isNotNull() & F.coalesce(S.clean(other_source) == SEEN_SOURCE, F.lit(False))
    above = F.array_min(F.filter(F.array(other_previous, price, previous), lambda x: x > other))
    wins = F.struct(other.alias("price"), above.alias("previous"), F.lit(SEEN_SOURCE).alias("source"))
    return F.when(seen, wins).otherwise(F.struct(F.coalesce(price, other).alias("price"), F.coalesce(previous, other_previous).alias("previous"), F.coalesce(S.blank_to_null(source), S.blank_to_null(other_source)).alias("source")))


def needs_more(title: Column, image: Column, price: Column, brand: Column, model: Column, mpn: Column, n_attributes: Column) -> Column:
    """Whether a record lacks a title, an image, a price, its identity or six attributes."""
    lacks = lambda c: F.coalesce(c, F.lit("")) == ""
    return lacks(title) | lacks(image) | price.isNull() | lacks(brand) | (lacks(model) & lacks(mpn)) | (F.coalesce(n_attributes, F.lit(0)) < 6)


def availability(text: Column, otherwise: Column) -> Column:
    """False or true by what a page says, else what another reader found."""
    told = F.lower(F.coalesce(text, F.lit("")))
    says = lambda words: F.greatest(*(F.contains(told, F.lit(w)) for w in words))
    return F.when(says(SOLD_OUT), False).when(says(ON_SALE), True).otherwise(otherwise)


def schema_availability(value: Column) -> Column:
    """Of a schema.org value; null if it is another one."""
    low = F.lower(value)
    return F.when(low.rlike("instock|in_stock"), True).when(low.rlike("outofstock|out_of_stock"), False)


def seller(text: Column, longest: int = 120) -> Column:
    """The seller whom a text names; a match that is too long is none."""
    found = [S.clean(F.regexp_extract(text, pattern, 1)) for pattern in SOLD_BY]
    return F.coalesce(*(F.when(F.length(x) <= longest, x) for x in found))


def kit(title: Column) -> Column:
    """Struct (is_kit, quantity, parts) of a title. A number of fans counts only if the title names a kit; parts only of kits."""
    def judge(low: Column) -> Column:
        number = lambda pattern: S.blank_to_null(F.regexp_extract(low, pattern, 1)).try_cast("int")
        parts = F.filter(F.array(*(F.when(low.rlike(pattern), F.lit(name)) for name, pattern in KIT_PARTS)), lambda x: x.isNotNull())
        counted = F.coalesce(*map(number, KIT_COUNTS))
        named = low.rlike(KIT_WORDS) | counted.isNotNull()
        is_kit = named | (F.size(parts) > 1)
        return F.struct(is_kit.alias("is_kit"), F.coalesce(counted, F.when(named, number(FAN_COUNT))).alias("quantity"), F.when(is_kit, parts).otherwise(F.array().cast("array<string>")).alias("parts"))

    return S.let(F.lower(F.coalesce(S.clean(title), F.lit(""))), judge)
