"""Registered queries of the feeds: JSON bodies that Spark writes from `orders`, `lineitem` and `part`; SQL works the answers out from the same columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import market_feeds
from .catalogue import query, rows

_pairs = lambda c: F.array_join(F.transform(c, lambda a: F.concat(a["name"], F.lit("="), a["value"])), "|")
_LINK = "case when l_linenumber % 5 = 0 then 'https://produto.example.com/MLB-123456789' else concat('https://produto.mercadolivre.com.br/MLB-', cast(1000000000 + l_partkey as varchar(20)), '-x') end"
# Searches: each order is one, its lines are what it found; orders of status P were refused, every 17th failed.
_LINES = f"select l_orderkey as search_id, l_linenumber as n, l_partkey as k, l_suppkey as s, l_extendedprice as price, case when l_returnflag = 'A' then l_extendedprice + l_tax end as was, l_quantity as q, l_linestatus as state, {_LINK} as link from lineitem"

# The order of a search's lines, then what parts lines that agree in it.
_ORDER = ("n", "k", "s", "price", "q", "was", "paused")


def _link(n, k):
    """_LINK of a line."""
    return F.when(n % 5 == 0, "https://produto.example.com/MLB-123456789").otherwise(F.concat(F.lit("https://produto.mercadolivre.com.br/MLB-"), (F.lit(1000000000) + k).cast("string"), F.lit("-x")))


def _searches(spark, sf_dir):
    """Lines are shuffled as their few numbers; the bodies are written of them behind the grouping."""
    attribute = lambda i, value: F.struct(F.lit(i).alias("id"), value.alias("value_name"), F.lit(None).cast("array<struct<name:string,struct:struct<number:int,unit:string>>>").alias("values"))

    def result(x):
        listed = F.struct(F.lit("MODEL").alias("id"), F.lit(None).cast("string").alias("value_name"), F.array(F.struct(F.concat(F.lit("M"), x["k"]).alias("name"), F.lit(None).cast("struct<number:int,unit:string>").alias("struct")), F.struct(F.lit(None).cast("string").alias("name"), F.struct(x["n"].alias("number"), F.lit("GB").alias("unit")).alias("struct"))).alias("values"))
        return F.struct(
            F.concat(F.lit("MLB"), x["k"]).alias("id"), F.concat(F.lit("Part "), x["k"]).alias("title"), x["link"].alias("permalink"), x["price"].alias("price"), x["was"].alias("original_price"), F.lit("BRL").alias("currency_id"), F.when(x["n"] != 3, F.floor(x["q"]) - 10).alias("available_quantity"),
            F.when(x["paused"], "paused").otherwise("active").alias("status"), F.struct(x["s"].alias("id")).alias("seller"), F.array(attribute("BRAND", F.lit("old")), attribute("BRAND", F.concat(F.lit(" Brand  "), x["s"])), listed, attribute("EAN", x["k"].cast("string"))).alias("attributes"),
        )

    line = rows(spark, sf_dir, _LINES).withColumn("paused", F.coalesce(F.col("state") == "F", F.lit(False)))
    found = line.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct(*_ORDER))).alias("lines"))  # the few lines of an order
    found = found.select("search_id", F.transform("lines", lambda x: result({c: x[c] for c in _ORDER} | {"link": _link(x["n"], x["k"])})).alias("results"))
    orders = rows(spark, sf_dir, "select o_orderkey as search_id, o_orderstatus as state from orders").join(found.hint("merge"), "search_id", "left")
    failed = (F.col("state") == "P") | (F.col("search_id") % 17 == 0)
    return orders.select("search_id", F.when(~failed, F.to_json(F.struct("results"))).alias("body"), F.when(F.col("state") == "P", "HTTP 403").alias("error"))


_HITS = f"with l as ({_LINES}), o as (select o_orderkey as search_id, o_orderstatus = 'P' as refused, o_orderkey % 17 = 0 as failed from orders)"


@query("market_search_offers", _HITS + """
select l.search_id, p::integer as pos, link as url, 'MLB' || k as item_id, 'Part ' || k as title, 'Brand ' || s as brand, 'M' || k || '; ' || n || ' GB' as model, null::varchar as mpn, k::varchar as gtin, price, was as previous_price, 'BRL' as currency, (n = 3 or floor(q) > 10) and state <> 'F' as available, s::varchar as seller_id, null::varchar as image_url
from (select *, row_number() over (partition by search_id order by n, k, s, price, q) - 1 as p from l) l join o using (search_id) where not refused and not failed and n % 5 <> 0""")
def _(spark, sf_dir):
    return market_feeds.market_search(_searches(spark, sf_dir))


@query("market_search_status", _HITS + """, h as (select search_id, count(*) filter (where n % 5 <> 0) as hits from l group by 1)
select search_id, case when refused then 'BLOQUEADO' when failed then 'FALHA_TEMPORARIA' when coalesce(hits, 0) > 0 then 'ENCONTRADO' else 'NAO_ENCONTRADO' end as status, case when refused or failed then 0 else coalesce(hits, 0) end::integer as found from o left join h using (search_id)""")
def _(spark, sf_dir):
    return market_feeds.market_search_status(_searches(spark, sf_dir))


# Items: of each part one, whose former price and attributes vary.
@query("market_items", """
select p_partkey as record_id, 'https://x.example/' || p_partkey as final_url, case when p_partkey % 2 = 0 then 'MLB' || p_partkey else 'asked' end as item_id, p_partkey % 5 <> 0 as fallback, p_retailprice * 3 as price,
  case p_partkey % 3 when 0 then p_retailprice * 4 when 1 then p_retailprice * 6 else p_retailprice * 3 end as previous_price, case p_partkey % 3 when 0 then 25.0 when 1 then 50.0 end::double as discount, p_partkey % 3 <> 2 as promotion,
  case when p_partkey % 4 = 0 then 'Own=' || p_name else 'Brand=' || p_brand || '|Size=' || p_size || '|Type=' || p_type end as attributes from part""")
def _(spark, sf_dir):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value_name"))
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    body = F.struct(
        F.when(k % 5 == 0, "MERCADO_LIVRE_API").otherwise("PAGINA").alias("source"), F.when(k % 2 == 0, F.concat(F.lit("MLB"), k)).alias("item_id"), (price * 3).alias("price"), F.when(k % 3 == 0, price * 4).when(k % 3 == 1, price * 6).otherwise(price * 3).alias("previous_price"),
        F.when(k % 4 == 0, F.array(pair("Own", F.col("p_name")))).alias("product_attributes"), F.array(pair("Brand", F.col("p_brand")), pair("Size", F.col("p_size")), pair("BRAND", F.lower("p_brand")), pair("", F.col("p_name")), pair("Type", F.concat(F.lit(" "), "p_type")), pair("Empty", F.lit(" "))).alias("attributes"),
    )
    items = rows(spark, sf_dir, "select * from part").select(k.alias("record_id"), F.concat(F.lit("https://x.example/"), k).alias("url"), F.lit("asked").alias("requested_id"), F.to_json(body).alias("body"))
    return market_feeds.market_items(items).select("record_id", "final_url", "item_id", "fallback", "price", "previous_price", "discount", "promotion", _pairs("attributes").alias("attributes"))


@query("affiliate_campaigns", """
select l_orderkey as feed_id, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) - 1)::integer as pos, 'Offer ' || l_partkey as name, case when l_linenumber % 2 = 0 then l_linenumber end::bigint as offer_type, l_suppkey::varchar as category_id, null::varchar as collection_id, null::varchar as image_url,
  'https://x.example/' || l_partkey as url, 'https://s.example/' || l_partkey as affiliate_url, case when l_returnflag = 'A' then 7.0 else l_quantity / 64 * 100 end as commission, epoch(l_shipdate)::bigint as starts, null::bigint as ends
from lineitem""")
def _(spark, sf_dir):
    lines = rows(spark, sf_dir, "select * from lineitem")
    rate = F.when(F.col("l_returnflag") == "A", "7").otherwise((F.col("l_quantity") / 64).cast("string"))
    node = F.struct(
        F.concat(F.lit("Offer "), "l_partkey").alias("offerName"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).otherwise("x").alias("offerType"), F.col("l_suppkey").alias("categoryId"), F.concat(F.lit("https://x.example/"), "l_partkey").alias("originalLink"),
        F.concat(F.lit("https://s.example/"), "l_partkey").alias("offerLink"), rate.alias("commissionRate"), F.unix_timestamp("l_shipdate").alias("periodStartTime"),
    )
    pages = lines.groupBy(F.col("l_orderkey").alias("feed_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
    return market_feeds.campaigns(pages.select("feed_id", F.to_json(F.struct(F.struct("nodes").alias("shopeeOfferV2"))).alias("body")))


@query("data_sheets", """
select p_partkey as record_id, p_partkey % 6 in (0, 1) as ok, case p_partkey % 6 when 2 then 'IDENTIDADE_DIVERGENTE' when 3 then 'MARCA_DIVERGENTE' when 4 then 'IDENTIDADE_INSUFICIENTE' when 5 then 'PRODUTO_NAO_ENCONTRADO' end as error,
  case when p_partkey % 6 in (0, 1) then p_name end as title, case when p_partkey % 6 in (0, 1) then p_brand end as brand, case when p_partkey % 6 in (0, 1) then (7890000000000 + p_partkey)::varchar end as gtin,
  case when p_partkey % 6 in (0, 1) then 'Size=' || p_size || ' cm|Type=' || p_type || '|Size=' || p_size end as attributes from part""")
def _(spark, sf_dir):
    feature = lambda n, shown, raw: F.struct(F.struct(F.struct(F.lit(n).alias("Value")).alias("Name")).alias("Feature"), shown.cast("string").alias("PresentationValue"), raw.cast("string").alias("RawValue"))
    k, how = F.col("p_partkey"), F.col("p_partkey") % 6
    gtin, mpn = (F.lit(7890000000000) + k).cast("string"), F.concat(F.lit("P-"), k)
    size, none = F.col("p_size"), F.lit(None)
    groups = F.array(F.struct(F.array(feature("Size", F.concat(size, F.lit(" cm")), size), feature("Type", F.lit(""), F.col("p_type")), feature("SIZE", none, F.concat(size, F.lit(" CM")))).alias("Features")), F.struct(F.array(feature("Size", none, size), feature("", size, size)).alias("Features")))
    info = F.struct(F.col("p_brand").alias("Brand"), mpn.alias("BrandPartCode"), F.array(F.lit("123456"), gtin).alias("GTIN"), F.col("p_name").alias("ProductName"))
    sheet = F.struct(info.alias("GeneralInfo"), groups.alias("FeaturesGroups"))
    body = F.when(how == 5, '{"message": "none"}').when(how == 1, F.to_json(sheet)).otherwise(F.to_json(F.struct(sheet.alias("data"))))
    asked = rows(spark, sf_dir, "select * from part").select(k.alias("record_id"), F.when(~how.isin(3, 4), F.when(how == 2, F.concat(gtin, F.lit("9"))).otherwise(gtin)).alias("gtin"), F.when(how == 3, F.lit("other")).otherwise(F.upper("p_brand")).alias("brand"), F.when(how != 4, F.lower(mpn)).alias("mpn"), body.alias("body"))
    return market_feeds.data_sheets(asked).select("record_id", "ok", "error", "title", "brand", "gtin", _pairs("attributes").alias("attributes"))


# Captured pages: of each part one, in one of five forms of identity.
@query("captured_products", """
select p_partkey as record_id, how <> 4 as ok, case when how <> 4 then p_brand || ' ' || p_name || tail end as title, case when how <> 4 then p_brand else 'Other' end as brand,
  case how when 0 then 'Line ' || p_size when 1 then 'Line RTX 4060 TI' when 2 then 'C' || p_partkey || 'x' when 3 then 'K' || p_partkey || 'y' else 'ZZ-' || p_partkey end as model, case when how in (0, 1) or (how = 4 and p_partkey >= 10) then 'ZZ-' || p_partkey end as mpn, p_retailprice as price, case when p_partkey % 2 = 0 then p_retailprice * 2 end as previous_price, p_partkey % 3 = 0 as available,
  case how when 0 then 'MPN=' || 'ZZ-' || p_partkey || '|Linha=Line ' || p_size when 1 then 'mpn=ZZ-' || p_partkey || '|Linha=Line' when 2 then 'Cor=' || p_type when 3 then 'Número do processador=K' || p_partkey || 'y' else 'Marca=Other|Modelo=ZZ-' || p_partkey || '|Referência=ZZ-' || p_partkey end as attributes
from (select *, p_partkey % 5 as how, case p_partkey % 5 when 1 then ' RTX 4060  Ti' when 2 then ' - C' || p_partkey || 'x' else '' end as tail from part) x""")
def _(spark, sf_dir):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    k, how, p = F.col("p_partkey"), F.col("p_partkey") % 5, F.col("p_retailprice")
    code = F.concat(F.lit("ZZ-"), k)
    of_sale = [pair("Frete", F.lit("x")), pair("12x de R$ 9,00", F.lit("y"))]
    listed = (
        F.when(how == 0, F.array(pair("Modelo", code), pair("MPN", code), pair("Linha", F.concat(F.lit("Line "), "p_size")), pair("Marca", F.lit("Other")), *of_sale)).when(how == 1, F.array(pair("mpn", code), pair("Linha", F.lit("Line")), *of_sale))
        .when(how == 2, F.array(pair("Cor", F.col("p_type")), *of_sale)).when(how == 3, F.array(pair("Número do processador", F.concat(F.lit("K"), k, F.lit("y"))), *of_sale)).otherwise(F.array(pair("Marca", F.lit("Other")), pair("Modelo", code), pair("Referência", code), *of_sale))
    )
    tail = F.when(how == 1, " RTX 4060  Ti").when(how == 2, F.concat(F.lit(" - C"), k, F.lit("x"))).otherwise("")
    body = F.struct(F.when(how != 4, F.concat("p_brand", F.lit(" "), "p_name", tail)).alias("productName"), F.col("p_brand").alias("brand"), p.alias("price"), F.when(k % 2 == 0, p * 2).otherwise(p / 2).alias("highPrice"), F.when(k % 3 == 0, "InStock").otherwise("https://schema.org/OutOfStock").alias("availability"), listed.alias("attributes"))
    raw = rows(spark, sf_dir, "select * from part").select(k.alias("record_id"), F.lit("https://x.example/").alias("url"), F.to_json(body).alias("body"))
    return market_feeds.captures(raw).select("record_id", "ok", "title", "brand", "model", "mpn", "price", "previous_price", "available", _pairs("attributes").alias("attributes"))
