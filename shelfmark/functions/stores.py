"""Stores: which links are products' pages, what a search result really points to, and who the partner is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import folding
from . import scalars as S

#: Domains of stores, and what the path of a product's page looks like.
DOMAINS = {
    "AMAZON": ("amazon.com.br", "amazon.com"), "KABUM": ("kabum.com.br",), "PICHAU": ("pichau.com.br",), "TERABYTE": ("terabyteshop.com.br",), "ALIEXPRESS": ("aliexpress.com",),
    "MAGALU": ("magazineluiza.com.br", "magazinevoce.com.br", "magalu.com"), "MERCADO_LIVRE": ("mercadolivre.com.br", "mercadolivre.com", "mercadolibre.com"),
}
PATHS = {
    "AMAZON": r"(?i)/(?:dp|gp/(?:product|aw/d)|product)/[A-Z0-9]{10}(?:[/?]|$)", "KABUM": r"(?i)/produto/\d+(?:/|$)", "TERABYTE": r"(?i)/produto/\d+(?:/|$)", "ALIEXPRESS": r"(?i)/item/\d+\.html(?:/|$)",
    "MAGALU": r"(?i)/p/[^/]+", "MERCADO_LIVRE": r"(?i)/(?:p/MLB\d+|MLB-?\d{6,})(?:[-/]|$)",
}
NO_PRODUCT = ("busca", "search", "categoria", "categorias", "marca", "fabricante")
#: Names and domains of partners by platform.
PARTNERS = {
    "MERCADO_LIVRE": ("Mercado Livre", "mercadolivre.com.br"), "SHOPEE": ("Shopee", "shopee.com.br"), "MAGALU": ("Magazine Luiza", "magazineluiza.com.br"), "KABUM": ("KaBuM!", "kabum.com.br"),
    "PICHAU": ("Pichau", "pichau.com.br"), "TERABYTE": ("TerabyteShop", "terabyteshop.com.br"), "AMAZON": ("Amazon", "amazon.com.br"), "ALIEXPRESS": ("AliExpress", "aliexpress.com"),
}


def under(host: Column, domains: tuple[str, ...]) -> Column:
    """Whether a host is one of the domains or below it; false for null."""
    fits = F.lit(False)
    for d in domains:
        fits = fits | (host == d) | host.endswith("." + d)
    return F.coalesce(fits, F.lit(False))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def product_url(store: Column, url: Column) -> Column:
    """Whether a URL is a product's page of the store: http(s) without credentials, the store's host, its kind of path. False for null and unknown stores."""
    h, p = S.host(url), path(url)
    slug = F.regexp_replace(F.lower(p), "^/+|/+$", "")
    rules = {name: under(h, DOMAINS[name]) & p.rlike(pattern) for name, pattern in PATHS.items()}
    rules["PICHAU"] = under(h, DOMAINS["PICHAU"]) & ~slug.rlike("^(?:" + "|".join(NO_PRODUCT) + ")") & (F.length(slug) >= 12) & F.contains(slug, F.lit("-"))
    ids = folding.shopee_ids(url)
    rules["SHOPEE"] = F.coalesce(ids.shop.isNotNull() & ids.item.isNotNull() & (ids.shop != 0) & (ids.item != 0), F.lit(False))
    fit = F.coalesce(*(F.when(store == name, rule) for name, rule in rules.items()), F.lit(False))
    return F.coalesce(url.rlike(r"(?i)^\s*https?://[^/?#@]+(?:[/?#]|$)"), F.lit(False)) & fit


def partner(platform: Column, host: Column) -> Column:
    """Struct (name, domain): of a known platform, else the host's last label but one as a name; `Loja` where there is none."""
    known = F.create_map(*(x for k, (name, domain) in PARTNERS.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(domain).alias("domain")))))
    h = S.blank_to_null(F.lower(F.trim(host)))
    label = F.initcap(F.regexp_replace(F.regexp_extract(h, r"([^.]+)\.[^.]*$", 1), "-", "- "))
    own = F.struct(F.coalesce(F.when(F.contains(h, F.lit(".")), F.replace(label, F.lit("- "), F.lit("-"))), h, F.lit("Loja")).alias("name"), h.alias("domain"))
    return F.coalesce(F.try_element_at(known, F.upper(F.trim(platform))), own)


def result_target(href: Column) -> Column:
    """Where a search result's link leads: targets packed in a redirect (a `uddg` argument, or `u=a1` and base64) are unpacked; null if that is no http(s) URL."""
    whole = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/ck/a?"), F.concat(F.lit("https://www.bing.com"), href)).otherwise(href)

    def unpack(u: Column) -> Column:
        h = S.host(u)
        argument = lambda name: F.try_url_decode(F.regexp_extract(u, rf"[?&]{name}=([^&#]*)", 1))
        code = F.translate(F.substring(argument("u"), F.lit(3), F.length(u)), "-_", "+/")
        padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), F.lit("="))
        text = F.try_to_binary(padded, F.lit("base64")).cast("string")
        packed = F.when(argument("u").startswith("a1"), text).otherwise(argument("u"))
        out = F.when(under(h, ("duckduckgo.com",)), argument("uddg")).when(under(h, ("bing.com",)) & (path(u) == "/ck/a"), packed).otherwise(u)
        return F.when(out.rlike("(?i)^https?://"), out)

    return S.let(whole, unpack)
