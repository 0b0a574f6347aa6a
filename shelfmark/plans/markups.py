"""Registered queries of the HTML pass: on `pages` as they are, and on product pages that Spark renders from `part`, of which SQL knows the columns.

A rendered page takes one of eight layouts by its key; its texts, numbers and addresses are the part's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markup, records
from .catalogue import HEAVY_ROWS_A_TASK, query, rows

HOST = "https://shop.example.com"
FIELDS = f"""select p_partkey as key, p_name as name, p_brand as brand, p_type as type, p_size as size, p_retailprice as amount, concat('M-', cast(p_partkey as varchar(20))) as mpn,
  concat('X', cast(p_size as varchar(20)), '-', cast(p_partkey as varchar(20))) as model, concat('789', lpad(cast(p_partkey as varchar(20)), 10, '0')) as gtin, concat('{HOST}/p/', cast(p_partkey as varchar(20))) as url from part"""

_LD = '<script type="application/ld+json">{}</script>'
_SIZE = '{"name":"Size","value":{"value":{size},"unitText":"mm"}}'
#: A layout: its HTML, and SQL of what a record of it has (null where it is not named).
LAYOUTS: list[tuple[str, dict[str, str]]] = [
    (  # one product in linked data, with units and a description as HTML; navigation and a repeated pair are left out
        '<html><head><title>Shop</title><link rel="canonical" href="/p/{key}">' + _LD.format('{"@type":"https://schema.org/Product","name":" {brand}  {name} ","brand":{"@type":"Brand","name":"{brand}"},"mpn":"{mpn}","model":"{model}","gtin13":"{gtin}","description":"<p>{type}</p><div>size {size}<br>each</div>","image":["/i/{key}.jpg"],"offers":{"price":"{amount}","priceCurrency":"USD","availability":"https://schema.org/InStock"},"additionalProperty":[' + _SIZE + ',{"name":"Boxed","value":true}]}')
        + '</head><body><nav><table><tr><td>Nav</td><td>{key}</td></tr></table></nav><h1>{name}</h1><table><tr><th>Kind</th><td>{type}</td><td>x</td></tr><tr><th>KIND</th><td><b>{type}</b></td></tr></table><a href="/p/{key}/specs#top">Especifica&ccedil;&otilde;es</a><a href="/login/specs">Specs</a></body></html>',
        {"title": "brand || ' ' || name", "brand": "brand", "model": "model", "mpn": "mpn", "gtin": "gtin", "description": "type || chr(10) || chr(10) || 'size ' || size || chr(10) || 'each'", "description_source": "'DADOS_ESTRUTURADOS'", "canonical_url": "url", "image_url": f"'{HOST}/i/' || key || '.jpg'", "price": "amount", "price_source": "'JSON_LD'", "currency": "'USD'", "available": "true", "attributes": "['Size: ' || size || ' mm', 'Boxed: Yes', 'Kind: ' || type]"},
    ),
    (  # a graph whose brand and offers are references; offers agree on the price
        "<html><head>" + _LD.format('{"@graph":[{"@id":"#b","@type":"Brand","name":"{brand}"},{"@type":"WebPage","mainEntity":{"@id":"#p"}},{"@id":"#p","@type":["Thing","Product"],"name":"{name}","brand":{"@id":"#b"},"gtin12":"{gtin}","offers":[{"@id":"#o"},{"price":"{amount}"}]}]}')
        + _LD.format('{"@id":"#o","price":"{amount}","availability":"OutOfStock"}') + "</head><body><h1>Other</h1><dl><dt>Modelo</dt><p>-</p><dd>{model}</dd><dt>alone</dt></dl></body></html>",
        {"title": "name", "brand": "brand", "model": "model", "gtin": "gtin", "price": "amount", "price_source": "'JSON_LD'", "available": "false", "attributes": "['Modelo: ' || model]"},
    ),
    (  # two products: the canonical address tells which
        '<html><head><link rel="canonical" href="{url}/">' + _LD.format('[{"@type":"Product","name":"Wrong","url":"/p/0{key}"},{"@type":"Product","name":"{name}","url":"{url}","brand":"{brand}","offers":{"priceSpecification":{"price":"{amount}"}}}]') + "</head><body></body></html>",
        {"title": "name", "brand": "brand", "canonical_url": "url || '/'", "price": "amount", "price_source": "'JSON_LD'"},
    ),
    (  # two products and no canonical address: meta tags and a table of terms
        "<html><head>" + _LD.format('[{"@type":"Product","name":"A"},{"@type":"Product","name":"B"}]') + '<meta property="og:title" content="{brand} {name}"><meta property="product:brand" content="{brand}"><meta property="product:price:amount" content="{amount}"><meta name="description" content="{type} of {brand}"><meta property="og:image" content="/m/{key}.png"></head>'
        '<body><dl><dt>Modelo</dt><dd>{model}</dd><dt>EAN</dt><dd>{gtin}</dd></dl><div class="related-items"><dl><dt>EAN</dt><dd>0</dd></dl></div></body></html>',
        {"title": "brand || ' ' || name", "brand": "brand", "model": "model", "gtin": "gtin", "description": "type || ' of ' || brand", "description_source": "'META'", "image_url": f"'{HOST}/m/' || key || '.png'", "price": "amount", "price_source": "'META'", "attributes": "['Modelo: ' || model, 'EAN: ' || gtin]"},
    ),
    (  # microdata with scopes inside; technical lines; a description section that holds another
        '<html><body><div itemscope itemtype="http://schema.org/Product"><span itemprop="name">{name}</span><div itemprop="brand" itemscope itemtype="http://schema.org/Brand"><meta itemprop="name" content="{brand}"></div><meta itemprop="mpn" content="{mpn}"><div itemprop="offers" itemscope><meta itemprop="price" content="{amount}"><link itemprop="availability" href="http://schema.org/InStock"></div></div>'
        '<ul id="product-specs"><li>Size: {size}</li><li><span>Kind</span><b>{type}</b></li><li>no colon</li></ul><div id="description"><p>Made by {brand}</p><div class="product-description">{type}</div></div></body></html>',
        {"title": "name", "brand": "brand", "mpn": "mpn", "description": "'Made by ' || brand || chr(10) || chr(10) || type", "description_source": "'PAGINA'", "price": "amount", "price_source": "'MICRODATA'", "available": "true", "attributes": "['Size: ' || size, 'Kind: ' || type]"},
    ),
    (  # broken linked data, entities, a price element
        "<html><head>" + _LD.format('{"@type":"Product","name":') + '<title>{name}</title></head><body><h1>{name} &eacute; <i>co</i> &#38; &lt;{size}&gt;</h1><span itemprop="price">R$ {amount}</span><table><tr><td>Marca</td><td>{brand}</td></tr><tr><td>Part Number</td><td>{mpn}</td></tr><tr><td>Marca</td><td>{brand} Ltd</td></tr></table></body></html>',
        {"title": "name || ' é co & <' || size || '>'", "brand": "brand || ' Ltd'", "mpn": "mpn", "price": "amount", "price_source": "'MICRODATA'", "attributes": "['Marca: ' || brand, 'Part Number: ' || mpn, 'Marca: ' || brand || ' Ltd']"},
    ),
    (  # offers that differ; technical data in embedded JSON
        "<html><head>" + _LD.format('{"@type":"Product","name":"{name}","highPrice":"9999","offers":[{"price":"{amount}"},{"price":"1"}]}') + '<script type="application/json">{"props":{"technicalData":[{"label":"Size","value":[{size},{"value":"{type}"}]},{"key":"Boxed","value":false}],"other":{"name":"x","value":"y"}}}</script></head><body></body></html>',
        {"title": "name"},
    ),
    ("<html><head><title>Robot Check {key}</title></head><body><table><tr><td>Size</td><td>{size}</td></tr></table></body></html>", {}),
]
COLUMNS = {
    "title": "varchar", "brand": "varchar", "model": "varchar", "mpn": "varchar", "gtin": "varchar", "description": "varchar", "description_source": "varchar", "canonical_url": "varchar",
    "image_url": "varchar", "price": "double", "price_source": "varchar", "currency": "varchar", "available": "boolean", "attributes": "varchar[]",
}


def filled(template: str, names: tuple[str, ...] = ("key", "name", "brand", "type", "size", "amount", "mpn", "model", "gtin", "url")) -> Column:
    """The template with the columns of these names in the place of their names in braces; an amount is written with two decimals."""
    parts = re.split(r"\{(" + "|".join(names) + r")\}", template)
    shown = lambda c: F.format_string("%.2f", c) if c == "amount" else F.col(c).cast("string")
    return F.concat(*(shown(p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, url, html: a product page of each part."""
    parts = rows(spark, sf_dir, FIELDS, HEAVY_ROWS_A_TASK)
    layout = F.col("key") % len(LAYOUTS)
    html = F.coalesce(*(F.when(layout == i, filled(template)) for i, (template, _) in enumerate(LAYOUTS)))
    return parts.select("key", "url", html.alias("html"))


def _case(column: str, kind: str) -> str:
    default = {"attributes": "[]", "currency": "'BRL'"}.get(column, "null")
    cases = [f"when {i} then {told.get(column, default)}" for i, (_, told) in enumerate(LAYOUTS) if i < len(LAYOUTS) - 1]
    return f"(case key % {len(LAYOUTS)} {' '.join(cases)} else null end)::{kind} as {column}"


RECORDS_SQL = f"""select key, key % 8 <> 7 as ok, key % 8 = 7 as blocked, case when key % 8 = 7 then 'PAGINA_BLOQUEADA' end as error, {", ".join(_case(c, k) for c, k in COLUMNS.items())} from ({FIELDS})"""


def _listed(record: DataFrame) -> DataFrame:
    """Records with their attributes as lines."""
    return record.withColumn("attributes", F.transform("attributes", lambda a: F.concat(a["name"], F.lit(": "), a["value"])))


@query("part_page_records", f"select * replace (array_to_string(attributes, chr(10)) as attributes, round(price, 2) as price) from ({RECORDS_SQL})")
def _(spark, sf_dir):
    found = _listed(records.records(markup.parsed(part_pages(spark, sf_dir)))).drop("url")
    return found.withColumn("attributes", F.array_join("attributes", "\n"))


@query("part_page_attributes", f"""
select key, pos - 1 as pos, attributes[pos] as pair from (select key, case when key % 8 = 7 then ['Size: ' || size] else attributes end as attributes, unnest(range(1, len(case when key % 8 = 7 then ['Size: ' || size] else attributes end) + 1)) as pos
from (select r.*, f.size from ({RECORDS_SQL}) r join ({FIELDS}) f using (key)))""")
def _(spark, sf_dir):
    found = records.attributes(markup.parsed(part_pages(spark, sf_dir)), key="key")
    return found.select("key", F.col("pos").cast("long").alias("pos"), F.concat_ws(": ", "name", "value").alias("pair"))


@query("part_page_technical", f"""
with t as (select key, [['additionalProperty', 'Size', size::varchar], ['additionalProperty.value', 'value', size::varchar], ['additionalProperty.value', 'unitText', 'mm'], ['additionalProperty', 'Boxed', 'Sim']] as p from ({FIELDS}) where key % 8 = 0
           union all select key, [['props.technicalData', 'Size', size || ', ' || type], ['props.technicalData.value', 'value', type], ['props.technicalData', 'Boxed', 'Não']] from ({FIELDS}) where key % 8 = 6
           union all select key, [['offers.priceSpecification', 'price', printf('%.2f', amount)]] from ({FIELDS}) where key % 8 = 2)
select key, (i - 1)::bigint as pos, p[i][1] as path, p[i][2] as name, p[i][3] as value from (select *, unnest(range(1, len(p) + 1)) as i from t)""")
def _(spark, sf_dir):
    return records.technical_pairs(markup.parsed(part_pages(spark, sf_dir)), key="key").withColumn("pos", F.col("pos").cast("long"))


# Pages as they are: they hold no product data, so what regexes can tell is a record's title, the text, links and evidence.
_UNTAGGED = r"regexp_replace({}, '<[^>]*>', ' ', 'g')"
_ENTITIES = (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("amp", "&"))
_UNESCAPED = "regexp_replace(" * len(_ENTITIES) + "{}" + "".join(f", '&{name};?', '{char}', 'g')" for name, char in _ENTITIES)  # the semicolon may be missing
_SQUEEZED = r"nullif(trim(regexp_replace({}, '[\s\x{{a0}}]+', ' ', 'g')), '')"
_TEXT = lambda x: _SQUEEZED.format(_UNESCAPED.format(_UNTAGGED.format(x)))
_BARE = r"regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>|<aside[^>]*>.*?</aside>|<!--.*?-->', ' ', 'gs'), '<!DOCTYPE[^>]*>', ' ')"


@query("page_records", f"""
with t as (select page_id, url, {_TEXT("regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's')")} as h1 from pages)
select page_id, h1 is not null as ok, false as blocked, case when h1 is null then 'PAGINA_SEM_DADOS_DE_PRODUTO' end as error, h1 as title, null::varchar as brand, null::double as price, 'BRL' as currency, 0::bigint as n_attributes from t""")
def _(spark, sf_dir):
    found = records.records(markup.parsed(rows(spark, sf_dir, "select page_id, url, html from pages")))
    return found.select("page_id", "ok", "blocked", "error", "title", "brand", "price", "currency", F.size("attributes").cast("long").alias("n_attributes"))


@query("page_contents", f"""
select page_id, {_TEXT(_BARE)} as text, len(regexp_extract_all({_BARE}, '<a [^>]*href='))::bigint as n_links, length(trim(html)) >= 80 and regexp_matches(html, '<h1') and
       (length(coalesce({_TEXT("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's')")}, '')) >= 6 or regexp_matches(html, '(?i)adicionar [àa] sacola|comprar agora|produto indispon[ií]vel|avise-me quando chegar')) as evidence from pages""")
def _(spark, sf_dir):
    from ..functions import scalars as S

    pages = rows(spark, sf_dir, "select page_id, url, html, html as source from pages")
    found = markup.parsed(pages)
    return found.select("page_id", S.clean(F.col("page.text")).alias("text"), F.size("page.links").cast("long").alias("n_links"), records.evidence(F.col("page"), F.col("source")).alias("evidence"))


# Detail pages: of layouts 0 (which link to them). One in five is of another product, one in seven is blocked; others add what the page lacks.
_DETAIL = (
    '<html><head><title>Detail</title><link rel="canonical" href="{url}/specs"></head><body><h1>{brand} {name} {mpn}</h1><table><tr><td>Kind</td><td>other</td></tr><tr><td>Weight</td><td>{size} kg</td></tr><tr><td>Marca</td><td>{brand}</td></tr></table>'
    '<div id="description">A long text of {name}, longer than the summary of the page that links here.</div></body></html>'
)


@query("part_page_details", f"""
with r as ({RECORDS_SQL}),
d as (select r.*, f.name, f.size, r.key % 8 = 0 and r.key % 5 <> 0 and r.key % 7 <> 0 as used from r join ({FIELDS}) f using (key))
select key, title, case when used then 'A long text of ' || name || ', longer than the summary of the page that links here.' else description end as description,
       case when used then 'PAGINA' else description_source end as description_source, round(price, 2) as price,
       array_to_string(case when used then attributes || ['Weight: ' || size || ' kg', 'Marca: ' || brand] else attributes end, chr(10)) as attributes, (case when used then 1 else 0 end)::integer as n_details
from d where key % 8 <> 7""")
def _(spark, sf_dir):
    pages = markup.parsed(part_pages(spark, sf_dir))
    parts = rows(spark, sf_dir, FIELDS, HEAVY_ROWS_A_TASK)
    other = filled(_DETAIL.replace("{mpn}", "").replace("</table>", "<tr><td>Part Number</td><td>another</td></tr></table>"))
    html = F.when(F.col("key") % 5 == 0, other).when(F.col("key") % 7 == 0, "<html><title>Captcha</title></html>").otherwise(filled(_DETAIL))
    details = markup.parsed(parts.where("key % 8 = 0").select("key", F.concat("url", F.lit("/specs/")).alias("url"), html.alias("html")))
    named = pages.withColumn("details", records.details_named(F.col("page"), F.col("url"), 2))
    merged = _listed(records.with_details(records.records(named).where("ok"), "details", records.records(details), key="key"))
    return merged.select("key", "title", "description", "description_source", "price", F.array_join("attributes", "\n").alias("attributes"), "n_details")


@query("page_images", f"""select p_partkey as key, case p_partkey % 3 when 0 then '{HOST}/i/600x400/' || p_partkey || '.jpg' when 1 then '{HOST}/i/' || (100 + p_size) || 'x300/' || p_partkey || '.webp?a=1&b=2.png' end as image from part""")
def _(spark, sf_dir):
    main = f'<meta property="og:image" content="{HOST}/i/50x50/{{key}}.jpg">'
    first = f'<html><head>{main}</head><body><img src="{HOST}/i/600x400/{{key}}.jpg"><img src="{HOST}/i/300x900/{{key}}0.jpg"><img src="{HOST}/i/800x300/{{key}}.jpg"></body></html>'
    second = f'<meta property="og:image" content="{HOST}/i/50x50/{{key}}.webp?a=1&amp;b=2.png"><img src="{HOST}/i/99x300/{{key}}.webp?a=1&amp;b=2.png"><img src="{HOST}/i/@x300/{{key}}.webp?a=1&amp;b=2.png">'
    parts = rows(spark, sf_dir, FIELDS, HEAVY_ROWS_A_TASK)
    sized = F.concat(*(x for piece in second.split("@") for x in (filled(piece), (F.col("size") + 100).cast("string"))))
    html = F.when(F.col("key") % 3 == 0, filled(first)).when(F.col("key") % 3 == 1, sized).otherwise(filled("<h1>{name}</h1>"))
    found = markup.parsed(parts.select("key", "url", html.alias("html"), html.alias("source")))
    return found.select("key", records.best_image(F.col("page"), F.col("source"), F.lit(None).cast("string")).alias("image"))
