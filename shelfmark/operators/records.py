"""Product records of parsed pages: what is chosen among a page's finds, as column expressions over the struct of `markup.parsed`.

Every page stays one row and nothing is shuffled; attributes, links and detail pages are tables of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captured, prices
from ..functions import scalars as S

#: Headings of pages that show a check instead of a product; names under which attribute tables tell an identity.
BLOCKED = ("captcha", "access denied", "acesso negado", "robot check", "verify you are human", "verifique se", "verificação de segurança", "verificacao de seguranca")
NAMED = {"brand": ("marca", "brand", "producer", "manufacturer"), "model": ("modelo", "model"), "mpn": ("mpn", "part number"), "gtin": ("ean", "gtin", "upc")}
DETAIL_LABELS = r"\b(?:descricao|description|especificacoes|specifications|specs|ficha tecnica|caracteristicas|technical details)\b"
DETAIL_BARRED = r"(?i)/(?:cart|checkout|login|search|busca|carrinho|account)(?:/|$)"
#: Fixed limit of the contract: attributes of a record.
MOST_ATTRIBUTES = 250


def _meta(page: Column, *keys: str) -> Column:
    return F.coalesce(*(page["metas"][key] for key in keys))


def _told(page: Column, field: str) -> Column:
    """The last value that attributes give under the first of the field's names that they use."""
    last = lambda name: F.element_at(F.transform(F.filter(page["pairs"], lambda p: F.lower(p["name"]) == name), lambda p: p["value"]), -1)
    of = lambda name: F.when(F.exists(page["pairs"], lambda p: F.lower(p["name"]) == name), last(name))
    return F.coalesce(*map(of, NAMED[field]))


def offer(page: Column) -> Column:
    """The offer of a product; of several the first if they agree on the price, else none."""
    agreed = F.size(F.array_distinct(F.transform(page["offers"], lambda o: S.decimal_number(o["price"])))) == 1
    return F.when(agreed, F.get(page["offers"], F.lit(0)))


def price(page: Column) -> Column:
    """Struct (price, source): the offer's, its specification's, a meta tag's, an element's. A highest price of a range is none."""
    one = lambda value, source: S.let(S.decimal_number(value), lambda v: F.when(v.isNotNull(), F.struct(v.alias("price"), source.alias("source"))))
    meta, source = F.lit("META"), page["product_source"]
    return S.let(offer(page), lambda o: F.coalesce(
        one(o["price"], source), one(o["spec_price"], source),
        one(_meta(page, "property:product:price:amount", "property:og:price:amount"), meta), one(page["item_price"], F.lit("MICRODATA")),
    ))


def sections(found: Column) -> Column:
    """A page's description sections without those that stand inside another one; of equal ones the first stays."""
    inside = lambda x, i: F.exists(F.transform(found, lambda y, j: F.contains(y, x) & ((F.length(y) > F.length(x)) | (j < i))), lambda hit: hit)
    return F.filter(found, lambda x, i: ~inside(x, i))


def description(page: Column) -> Column:
    """Struct (text, source): the visible sections unless the structured text is longer; meta tags where there is neither."""
    meta = lambda key: S.blank_to_null(F.trim(page["metas"][key]))

    def choose(x: Column) -> Column:
        told = page["product"]["description"]
        visible = x.isNotNull() & (told.isNull() | (F.length(x) >= F.length(told)))
        metas = F.coalesce(meta("name:description"), meta("property:og:description"))
        made = lambda text, source: F.struct(text.alias("text"), F.lit(source).alias("source"))
        return F.when(visible, made(x, "PAGINA")).when(told.isNotNull(), made(told, "DADOS_ESTRUTURADOS")).when(metas.isNotNull(), made(metas, "META"))

    return S.let(S.blank_to_null(F.array_join(sections(page["sections"]), "\n\n")), choose)


def records(pages: DataFrame, page: str = "page", url: str = "url") -> DataFrame:
    """The rows without `page` but with ok, blocked, error, title, brand, model, mpn, gtin, description, description_source, canonical_url,
    image_url, price, price_source, currency, available and attributes. A blocked page has none of its product's fields."""
    p = F.col(page)
    heading = F.lower(F.coalesce(p["heading"], F.lit("")))
    blocked = ~p["has_product"] & F.greatest(*(F.contains(heading, F.lit(x)) for x in BLOCKED))
    product = p["product"]
    fields = {
        "title": F.coalesce(product["name"], _meta(p, "property:og:title", "name:twitter:title"), p["named_heading"]),
        "brand": F.coalesce(product["brand"], _meta(p, "property:product:brand"), _told(p, "brand")),
        "model": F.coalesce(product["model"], _told(p, "model")),
        "mpn": F.coalesce(product["mpn"], _told(p, "mpn")),
        "gtin": F.coalesce(product["gtin"], _told(p, "gtin")),
        "_description": description(p),
        "canonical_url": p["canonical"],
        "image_url": F.coalesce(product["image"], _meta(p, "property:og:image", "name:twitter:image"), p["item_image"]),
        "_price": price(p),
        "currency": F.coalesce(offer(p)["currency"], F.lit("BRL")),
        "available": prices.schema_availability(offer(p)["availability"]),
        "attributes": F.transform(p["pairs"], lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"))),
    }
    kept = [c for c in pages.columns if c != page and c not in ("ok", "blocked", "error", "price", "price_source", "description", "description_source", *fields)]
    out = pages.select(*kept, blocked.alias("blocked"), *(F.when(~blocked, c).alias(name) for name, c in fields.items()))
    error = F.when(F.col("blocked"), "PAGINA_BLOQUEADA").when(F.col("title").isNull(), "PAGINA_SEM_DADOS_DE_PRODUTO")
    return S.apart(out.select(
        *kept, F.col("title").isNotNull().alias("ok"), "blocked", error.alias("error"), "title", "brand", "model", "mpn", "gtin", F.col("_description.text").alias("description"),
        F.col("_description.source").alias("description_source"), "canonical_url", "image_url", F.col("_price.price").alias("price"), F.col("_price.source").alias("price_source"),
        "currency", "available", "attributes",
    ))


def attributes(pages: DataFrame, page: str = "page", key: str = "page_id") -> DataFrame:
    """key, pos, kind, name, value: the attribute pairs of each page in order."""
    return pages.select(key, F.posexplode(f"{page}.pairs").alias("pos", "_p")).select(key, "pos", "_p.kind", "_p.name", "_p.value")


def technical_pairs(pages: DataFrame, page: str = "page", key: str = "page_id") -> DataFrame:
    """key, pos, path, name, value: pairs of embedded JSON under technical paths, in order."""
    return pages.select(key, F.posexplode(f"{page}.json_pairs").alias("pos", "_p")).select(key, "pos", "_p.path", "_p.name", "_p.value")


def evidence(page: Column, html: Column) -> Column:
    """Whether a page shows a product: structured data, or a heading with a title or words of a shop. Very short pages show none."""
    sells = F.lower(F.coalesce(page["text"], F.lit(""))).rlike(r"adicionar\s+[àa]\s+sacola|comprar\s+agora|produto\s+indispon[ií]vel|avise-me\s+quando\s+chegar")
    titled = F.coalesce(F.length(page["title"]), F.lit(0)) >= 6
    return (F.length(F.trim(F.coalesce(html, F.lit("")))) >= 80) & (page["has_product"] | (page["h1"].isNotNull() & (titled | sells)))


def best_image(page: Column, html: Column, otherwise: Column) -> Column:
    """The largest variant of the main image that a page names: addresses that are alike but for a size like /600x400/; of equal ones the first."""
    sized = r"/(\d+)x(\d+)/"
    area = lambda u: F.coalesce(F.regexp_extract(u, sized, 1).try_cast("long") * F.regexp_extract(u, sized, 2).try_cast("long"), F.lit(0).cast("long"))
    free = lambda u: F.regexp_replace(u, r"^(.*?)/\d+x\d+/", "$1/{size}/")
    named = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)https://[^\"'<>\s]+\.(?:jpe?g|png|webp)"), 0), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))

    def choose(main: Column) -> Column:
        mine = F.concat(F.array(main), F.filter(named, lambda u: free(u) == free(main)))
        ranked = F.transform(mine, lambda u, i: F.struct(area(u).alias("area"), (-i).alias("i"), u.alias("u")))
        return F.when(main.isNotNull(), F.array_max(ranked)["u"])

    return S.let(F.coalesce(page["metas"]["property:og:image"], otherwise), choose)


def page_key(url: Column) -> Column:
    """Scheme, host with port, path without a slash at its end and query of an address: what makes two addresses one page."""
    plain = F.regexp_replace(url, "#.*$", "")
    origin = F.lower(F.regexp_extract(plain, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]+)", 1))
    origin = F.regexp_replace(F.regexp_replace(origin, "^(https://[^/]*):443$", "$1"), "^(http://[^/]*):80$", "$1")
    return F.when(origin != "", F.concat(origin, F.regexp_replace(F.regexp_extract(plain, "^[^?]*?://[^/?]+([^?]*)", 1), "/+$", ""), F.regexp_extract(plain, r"(\?.*)$", 1)))


def _origin(key: Column) -> Column:
    return F.regexp_extract(key, "^([^/]+://[^/?]+)", 1)


def detail_links(pages: DataFrame, most: int, page: str = "page", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, place, href, page_key: the first `most` distinct links of each page to further details of its product, on the same origin."""
    one = pages.select(key, page_key(F.col(url)).alias("_own"), F.posexplode(f"{page}.links").alias("_pos", "_l"))
    href = F.regexp_replace("_l.href", "#.*$", "")
    path = F.regexp_extract(href, "^[^?]*?://[^/?]+([^?]*)", 1)
    good = F.coalesce(S.fold(F.col("_l.label")), F.lit("")).rlike(DETAIL_LABELS) & (_origin(page_key(href)) == _origin(F.col("_own"))) & ~href.rlike("^[^/]*//[^/?]*@") & ~path.rlike(DETAIL_BARRED)
    found = one.where(good).select(key, "_own", "_pos", href.alias("href"), page_key(href).alias("page_key")).where(F.col("page_key") != F.col("_own"))
    first = found.groupBy(key, "page_key").agg(F.min_by("href", "_pos").alias("href"), F.min("_pos").alias("_pos"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_pos"))).where(F.col("place") <= most).select(key, "place", "href", "page_key")


def details_named(page: Column, url: Column, most: int) -> Column:
    """What `detail_links` gives of one page, inside its row: an array of (place, href, page_key)."""
    def pick(own: Column) -> Column:
        def judged(link: Column) -> Column:
            href = F.regexp_replace(link["href"], "#.*$", "")
            path = F.regexp_extract(href, "^[^?]*?://[^/?]+([^?]*)", 1)
            at = page_key(href)
            good = (_origin(at) == _origin(own)) & (at != own) & ~href.rlike("^[^/]*//[^/?]*@") & ~path.rlike(DETAIL_BARRED)
            return F.struct(href.alias("href"), at.alias("page_key"), F.coalesce(good, F.lit(False)).alias("good"))

        told = F.filter(page["links"], lambda link: F.coalesce(S.fold(link["label"]), F.lit("")).rlike(DETAIL_LABELS))
        good = F.filter(F.transform(told, judged), lambda x: x["good"])
        first = F.slice(captured.first_each(good, lambda x: x["page_key"]), 1, most)
        return F.transform(first, lambda x, i: F.struct((i + 1).alias("place"), x["href"].alias("href"), x["page_key"].alias("page_key")))

    return S.let(page_key(url), pick)


def same_product(seed: dict[str, Column], other: dict[str, Column]) -> Column:
    """Whether a detail page is of the seed's product: no identifier differs, and it names the seed's page as canonical, or tells its
    identity (GTIN, or brand with part number or model), or, where the seed has no identity, has its title."""
    differs = lambda f: F.coalesce(S.fold(S.clean(seed[f])) != S.fold(S.clean(other[f])), F.lit(False))
    equal = lambda f: F.coalesce(S.key(seed[f]) == S.key(other[f]), F.lit(False))
    told = F.concat_ws(" ", *(other[f] for f in ("title", "brand", "model", "mpn", "gtin")))
    names = lambda f: F.coalesce(F.contains(F.concat(F.lit(" "), S.spaced(told), F.lit(" ")), F.concat(F.lit(" "), S.spaced(seed[f]), F.lit(" "))), F.lit(False))
    strong = seed["gtin"].isNotNull() | (seed["brand"].isNotNull() & (seed["mpn"].isNotNull() | seed["model"].isNotNull()))
    identity = equal("gtin") | ((equal("brand") | names("brand")) & (equal("mpn") | names("mpn") | (seed["mpn"].isNull() & (equal("model") | names("model")))))
    canonical = F.coalesce(page_key(other["canonical_url"]) == page_key(F.coalesce(seed["canonical_url"], seed["url"])), F.lit(False))
    title = F.coalesce(S.fold(seed["title"]) == S.fold(other["title"]), F.lit(False))
    return ~(differs("mpn") | differs("gtin") | differs("model")) & (canonical | F.when(strong, identity).otherwise(title))


DETAIL_FIELDS = ("title", "brand", "model", "mpn", "gtin", "image_url")


def with_details(seeds: DataFrame, links: DataFrame | str, found: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Records with what their detail pages add: gaps are filled in the order of the links, the longest description wins, attributes
    come in whose names the record has not, up to MOST_ATTRIBUTES; price, currency and availability stay the record's own.

    seeds and found are of `records`; links of `detail_links`, or the name of a column of seeds with `details_named`: then seeds are read
    once, so that pages are parsed once. A page that many seeds link to is a hot key of the join by address, whose rows are as many as the
    links, and a seed without a link has a key of its own; each seed's links are few. n_details tells how many pages were used.
    """
    if not isinstance(links, str):
        seeds, links = seeds.join(links.groupBy(key).agg(F.collect_list(F.struct("place", "href", "page_key")).alias("_links")).hint("merge"), key, "left"), "_links"
    own = [c for c in seeds.columns if c != links]
    pages = found.groupBy(page_key(F.col(url)).alias("_at")).agg(F.min_by(F.struct(*found.columns), F.col(url)).alias("_d"))
    asked = seeds.select(F.monotonically_increasing_id().alias("_row"), F.struct(*own).alias("_s"), links).select("_row", "_s", F.explode_outer(links).alias("_l"))
    both = asked.withColumn("_at", F.coalesce("_l.page_key", F.concat(F.lit("\0"), F.col("_row").cast("string")))).join(pages.hint("merge"), "_at", "left")
    of = lambda c: {f: F.col(f"{c}.{f}") for f in ("title", "brand", "model", "mpn", "gtin", "canonical_url")} | {"url": F.col(f"{c}.{url}")}
    used = F.when(~F.col("_d.blocked") & same_product(of("_s"), of("_d")), F.struct(F.col("_l.place").alias("place"), "_d"))
    rows = both.groupBy("_row").agg(F.first("_s").alias("_s"), F.sort_array(F.collect_list(used)).alias("_ds")).select("_s.*", F.transform("_ds", lambda x: x["_d"]).alias("_ds"))
    first = lambda f: F.get(F.filter(F.transform("_ds", lambda d: d[f]), lambda v: v.isNotNull()), F.lit(0))
    mine = F.struct(F.col("description").alias("text"), F.col("description_source").alias("source"))
    longest = F.aggregate("_ds", mine, lambda held, d: F.when(F.coalesce(F.length(d["description"]), F.lit(0)) > F.coalesce(F.length(held["text"]), F.lit(0)), F.struct(d["description"].alias("text"), d["description_source"].alias("source"))).otherwise(held))
    token = lambda a: F.coalesce(S.fold(a["name"]), F.lit(""))

    def grown(held: Column, d: Column) -> Column:
        names = F.transform(held, token)
        fresh = F.filter(d["attributes"], lambda a, i: ~F.array_contains(names, token(a)))
        once = F.filter(F.transform(fresh, lambda a, i: F.struct(a.alias("a"), (F.array_position(F.transform(fresh, token), token(a)) == i + 1).alias("first"))), lambda x: x["first"])
        return F.slice(F.concat(held, F.transform(once, lambda x: x["a"])), 1, MOST_ATTRIBUTES)

    merged = F.aggregate("_ds", F.col("attributes"), grown)
    made = {f: F.coalesce(F.col(f), first(f)) for f in DETAIL_FIELDS} | {"description": longest["text"], "description_source": longest["source"], "attributes": merged}
    out = rows.withColumn("_made", F.struct(*(c.alias(f) for f, c in made.items())))
    return out.select(*(F.col(f"_made.{c}").alias(c) if c in made else F.col(c) for c in own), F.size("_ds").alias("n_details"))
