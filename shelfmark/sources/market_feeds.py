"""Feeds of marketplaces, partners and data sheets: one JSON body a row in, flat typed rows out. Bodies are read with declared schemas, in one pass; what is no JSON gives no item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import captured, prices, stores
from ..functions import scalars as S
from ..operators import listings

#: Fixed limits of the contract: attributes of an item, letters of an attribute's name and value.
MOST_ATTRIBUTES, LONGEST_NAME, LONGEST_VALUE = 300, 180, 1500
_ATTRIBUTE = "struct<id:string,name:string,nome:string,valor:string,value:string,value_name:string,values:array<struct<name:string,value_name:string,struct:struct<number:string,unit:string>>>>"
SEARCH = f"results array<struct<id:string,title:string,permalink:string,price:double,original_price:double,currency_id:string,available_quantity:string,status:string,thumbnail:string,seller:struct<id:string>,attributes:array<{_ATTRIBUTE}>>>"
ITEM = f"""source string, api_used boolean, item_id string, catalog_product_id string, marketplace_product_code string, title string, brand string, model string, mpn string, gtin string, description string, url_final string, image_url string,
  price double, previous_price double, currency string, available boolean, seller_id string, category_id string, price_source string, selected_variants array<string>, product_attributes array<{_ATTRIBUTE}>, attributes array<{_ATTRIBUTE}>"""
_CAMPAIGN = "struct<offerName:string,offerType:string,categoryId:string,collectionId:string,imageUrl:string,originalLink:string,offerLink:string,commissionRate:string,periodStartTime:string,periodEndTime:string>"
_FEATURES = "array<struct<ID:string,Feature:struct<ID:string,Name:struct<Value:string>>,PresentationValue:string,RawValue:string,Value:string>>"
_SHEET = f"""struct<GeneralInfo:struct<Brand:string,BrandInfo:struct<BrandName:string>,BrandPartCode:string,GTIN:string,GTINs:string,Title:string,ProductName:string>,Image:struct<HighPic:string,Pic500x500:string,LowPic:string>,
  FeaturesGroups:array<struct<Features:{_FEATURES}>>>"""
_CAPTURED = """struct<finalUrl:string,final_url:string,productName:string,h1:string,title:string,description:string,brand:string,model:string,mpn:string,gtin:string,price:string,highPrice:string,previousPrice:string,priceCurrency:string,availability:string,
  sku:string,metaImage:string,image:string,image_url:string,attributes:array<struct<name:string,value:string,value_name:string>>,selectedVariants:array<string>>"""
#: Fixed patterns: rows of a captured table that tell of instalments, and what a choice of images is called.
INSTALMENT, CHOICE = r"(?i)^(?:\(Produto \+ Frete\)|\d{2}x\s+de\s+R\$|Numero de parcelas|Total$)", r"(?i)^Selecionar\s+(?:imagem|v[ií]deo)$"


def attribute_value(a: Column) -> Column:
    """An attribute's own value, else its distinct listed ones (names, or numbers with units) joined by `; `."""
    def listed(v: Column) -> Column:
        number = v["struct"]["number"]
        return F.coalesce(S.clean(v["name"]), S.clean(v["value_name"]), F.when(number.isNotNull(), S.clean(F.concat_ws(" ", number, v["struct"]["unit"]))))

    values = F.array_distinct(F.array_compact(F.transform(a["values"], listed)))
    return F.coalesce(S.clean(a["value_name"]), S.blank_to_null(F.array_join(values, "; ")))


def search_outcome(body: Column, error: Column) -> Column:
    """What became of a search before its items are looked at: null if it was answered with an object, else blocked or failed."""
    blocked = F.coalesce(error.rlike("HTTP (?:401|403|429)"), F.lit(False))
    return F.when(~F.coalesce(body.rlike(r"^\s*\{"), F.lit(False)), F.when(blocked, "BLOQUEADO").otherwise("FALHA_TEMPORARIA"))


def market_search(searches: DataFrame, store: str = "MERCADO_LIVRE") -> DataFrame:
    """search_id, pos, url and the fields of the offers that searches (search_id, body, error) found.

    Only links to products' pages count. Attributes tell brand, model, part number and GTIN; the last of an id counts. An offer is
    available if it is active and its quantity, if one is told, is above zero; a quantity that is no number is none.
    """
    found = searches.select("search_id", F.posexplode(F.from_json("body", SEARCH)["results"]).alias("pos", "r")).where(stores.product_url(F.lit(store), F.col("r.permalink")))
    last = lambda *ids: F.coalesce(*(S.let(F.filter("r.attributes", lambda a: a["id"] == i), lambda xs: attribute_value(F.get(xs, F.size(xs) - 1))) for i in ids))
    free = F.col("r.available_quantity").isNull() | F.coalesce(F.col("r.available_quantity").try_cast("double") > 0, F.lit(False))
    return found.select(
        "search_id", "pos", F.col("r.permalink").alias("url"), F.col("r.id").alias("item_id"), "r.title", last("BRAND").alias("brand"), last("MODEL").alias("model"), last("MPN").alias("mpn"), last("GTIN", "EAN").alias("gtin"), "r.price",
        F.col("r.original_price").alias("previous_price"), F.col("r.currency_id").alias("currency"), (free & (F.coalesce("r.status", F.lit("active")) == "active")).alias("available"), F.col("r.seller.id").alias("seller_id"), F.col("r.thumbnail").alias("image_url"),
    )


def market_search_status(searches: DataFrame, store: str = "MERCADO_LIVRE") -> DataFrame:
    """search_id, status, found of each search: its items counted inside the row, so nothing is shuffled."""
    hits = F.size(F.filter(F.from_json("body", SEARCH)["results"], lambda r: stores.product_url(F.lit(store), r["permalink"])))
    n = F.greatest(F.coalesce(hits, F.lit(0)), F.lit(0))
    return searches.select("search_id", F.coalesce(search_outcome(F.col("body"), F.col("error")), F.when(n > 0, "ENCONTRADO").otherwise("NAO_ENCONTRADO")).alias("status"), n.alias("found"))


def technical_attributes(own: Column, listed: Column) -> Column:
    """name, value of the product's own attributes, else of the listed ones: scalar values, each pair once whatever its case, cut and capped as the contract says."""
    rows = F.when(F.size(own) > 0, own).otherwise(listed)
    scalar = lambda v: F.when(~F.coalesce(v.rlike(r"^\s*[\[{]"), F.lit(False)), F.trim(v))
    one = lambda a: F.struct(F.trim(F.coalesce(S.blank_to_null(a["nome"]), S.blank_to_null(a["name"]), a["id"])).alias("name"), scalar(F.coalesce(S.blank_to_null(a["valor"]), S.blank_to_null(a["value_name"]), a["value"])).alias("value"))
    kept = F.filter(F.transform(rows, one), lambda a: (a["name"] != "") & (a["value"] != ""))
    once = F.slice(captured.first_each(kept, lambda a: F.struct(F.lower(a["name"]), F.lower(a["value"]))), 1, MOST_ATTRIBUTES)
    cut = F.transform(once, lambda a: F.struct(F.left(a["name"], F.lit(LONGEST_NAME)).alias("name"), F.left(a["value"], F.lit(LONGEST_VALUE)).alias("value")))
    return F.coalesce(cut, F.array().cast("array<struct<name:string,value:string>>"))


def market_items(items: DataFrame) -> DataFrame:
    """One flat offer of each item (record_id, url, requested_id, body). A discount, in percent to two places, needs a former price above a positive one."""
    x = items.select("record_id", "url", "requested_id", F.from_json("body", ITEM).alias("i"))
    price, before, item = F.col("i.price"), F.col("i.previous_price"), F.coalesce("i.item_id", "requested_id")
    discount = F.when((price > 0) & (before > price), F.round((before - price) / before * 100, 2))
    source = F.coalesce("i.source", F.lit("MERCADO_LIVRE"))
    return x.select(
        "record_id", source.alias("source"), F.coalesce("i.api_used", F.lit(False)).alias("official"), (source != "MERCADO_LIVRE_API").alias("fallback"), item.alias("item_id"), "i.catalog_product_id", F.coalesce("i.marketplace_product_code", item).alias("code"),
        "i.title", "i.brand", "i.model", "i.mpn", "i.gtin", "i.description", technical_attributes(F.col("i.product_attributes"), F.col("i.attributes")).alias("attributes"), F.coalesce("i.selected_variants", F.array().cast("array<string>")).alias("variants"),
        F.col("url").alias("original_url"), F.coalesce(S.blank_to_null(F.col("i.url_final")), "url").alias("final_url"), "i.image_url", price.alias("price"), before.alias("previous_price"), discount.alias("discount"), F.coalesce(discount > 0, F.lit(False)).alias("promotion"),
        F.coalesce("i.currency", F.lit("BRL")).alias("currency"), "i.available", "i.seller_id", "i.category_id", "i.price_source",
    )


def campaigns(feed: DataFrame) -> DataFrame:
    """feed_id, pos and the fields of each campaign of a partner's pages (feed_id, body: nodes under shopeeOfferV2): rates in percent, dates as seconds."""
    node = feed.select("feed_id", F.posexplode(F.from_json("body", f"shopeeOfferV2 struct<nodes:array<{_CAMPAIGN}>>")["shopeeOfferV2"]["nodes"]).alias("pos", "n"))
    whole = lambda c: F.col(c).try_cast("long")
    return node.where("n is not null").select(
        "feed_id", "pos", F.col("n.offerName").alias("name"), whole("n.offerType").alias("offer_type"), F.col("n.categoryId").alias("category_id"), F.col("n.collectionId").alias("collection_id"), F.col("n.imageUrl").alias("image_url"),
        F.col("n.originalLink").alias("url"), F.col("n.offerLink").alias("affiliate_url"), listings.percent(F.col("n.commissionRate").try_cast("double")).alias("commission"), whole("n.periodStartTime").alias("starts"), whole("n.periodEndTime").alias("ends"),
    )


def data_sheets(answers: DataFrame) -> DataFrame:
    """record_id, ok, error, title, brand, model, mpn, gtin, image_url, attributes of answers (record_id, gtin, brand, mpn, body) of a sheet service.

    A sheet counts only if it is of the product that was asked for: an identity needs a GTIN, or a brand and a part number; the GTIN told
    (the asked one, if it is among them) must be the asked one, the brand too where no GTIN was asked, and the part numbers, if both
    are known. The sheet stands under `data` or by itself. A feature's value is the one shown, else the raw one; each pair once, at most 300.
    """
    data = F.coalesce(F.from_json("body", f"data {_SHEET}")["data"], F.when(F.get_json_object("body", "$.GeneralInfo").isNotNull(), F.from_json("body", _SHEET)))
    x = answers.select("record_id", S.clean(F.col("gtin")).alias("g"), S.clean(F.col("brand")).alias("b"), S.clean(F.col("mpn")).alias("m"), data.alias("d"))
    info = F.col("d.GeneralInfo")
    codes = F.regexp_extract_all(F.coalesce(info["GTIN"], info["GTINs"], F.lit("")), F.lit(r"[0-9]{6,}"), 0)
    told = F.coalesce(F.get(F.filter(codes, lambda c: c == S.digits(F.col("g"))), F.lit(0)), F.get(codes, F.lit(0)))
    pair = lambda f: F.struct(F.coalesce(S.blank_to_null(f["ID"]), S.blank_to_null(f["Feature"]["ID"])).alias("id"), S.clean(f["Feature"]["Name"]["Value"]).alias("name"), S.clean(F.coalesce(S.blank_to_null(f["PresentationValue"]), S.blank_to_null(f["RawValue"]), f["Value"])).alias("value"))
    pairs = F.filter(F.flatten(F.transform("d.FeaturesGroups", lambda g: F.transform(F.coalesce(g["Features"], F.array().cast(_FEATURES)), pair))), lambda p: p["name"].isNotNull() & p["value"].isNotNull())
    x = x.select(
        "record_id", "g", "b", "m", F.col("d").isNotNull().alias("has"), F.coalesce(S.clean(info["Brand"]), S.clean(info["BrandInfo"]["BrandName"])).alias("brand"), S.clean(info["BrandPartCode"]).alias("mpn"), told.alias("gtin"),
        F.coalesce(S.clean(info["Title"]), S.clean(info["ProductName"])).alias("title"), F.coalesce(S.clean(info["ProductName"]), S.clean(info["BrandPartCode"])).alias("model"),
        F.coalesce(S.clean(F.col("d.Image.HighPic")), S.clean(F.col("d.Image.Pic500x500")), S.clean(F.col("d.Image.LowPic"))).alias("image_url"),
        F.slice(captured.first_each(pairs, lambda p: F.struct(F.lower(p["name"]), F.lower(p["value"]))), 1, MOST_ATTRIBUTES).alias("attributes"),
    )
    error = (
        F.when(F.col("g").isNull() & (F.col("b").isNull() | F.col("m").isNull()), "IDENTIDADE_INSUFICIENTE").when(~F.col("has"), "PRODUTO_NAO_ENCONTRADO").when(S.digits(F.col("g")) != F.col("gtin"), "IDENTIDADE_DIVERGENTE")
        .when(F.col("g").isNull() & (F.lower("b") != F.lower("brand")), "MARCA_DIVERGENTE").when(S.key(F.col("m")) != S.key(F.col("mpn")), "IDENTIDADE_DIVERGENTE")
    )
    good = x.withColumn("error", error).withColumn("ok", F.col("error").isNull() & F.coalesce("title", "mpn", "gtin").isNotNull())
    return good.select("record_id", "ok", "error", *(F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in ("title", "brand", "model", "mpn", "gtin", "image_url", "attributes")))


def captures(pages: DataFrame) -> DataFrame:
    """Raw products of pages that a browser captured (record_id, url, body with the fields it read): one row each, `ok` where there is a title.

    Rows of instalments are no attributes. A former price is one above the price; prices are positive. Identity, GTIN and the product's own
    attributes are told by `functions.captured`. The last code in the path `/p/` names the product where no sku is told.
    """
    x = pages.select("record_id", "url", F.from_json("body", _CAPTURED).alias("c"))
    first = lambda *names: F.coalesce(*(S.blank_to_null(F.trim(F.col(f"c.{n}"))) for n in names))
    rows = F.transform("c.attributes", lambda a: F.struct(F.trim(a["name"]).alias("name"), F.trim(F.coalesce(S.blank_to_null(a["value"]), a["value_name"])).alias("value")))
    money = lambda *names: S.price_text(F.trim(F.replace(first(*names), F.lit("R$"), F.lit(""))))
    x = x.select(
        "record_id", "url", F.coalesce(first("finalUrl", "final_url"), "url").alias("final_url"), first("productName", "h1", "title").alias("title"), F.col("c.description").alias("description"), "c.brand", "c.model", "c.mpn", "c.gtin",
        captured.present(F.filter(rows, lambda a: ~a["name"].rlike(INSTALMENT))).alias("attributes"), money("price").alias("price"), money("highPrice", "previousPrice").alias("before"), F.coalesce(first("priceCurrency"), F.lit("BRL")).alias("currency"),
        F.lower("c.availability").alias("told"), first("metaImage", "image", "image_url").alias("image_url"), first("sku").alias("sku"), F.filter(F.transform("c.selectedVariants", lambda v: F.trim(v)), lambda v: (v != "") & ~v.rlike(CHOICE)).alias("variants"),
    )
    x = x.withColumn("who", captured.refined(F.col("title"), F.col("brand"), F.col("model"), F.col("mpn"), F.col("attributes")))
    code = lambda c: S.clean(F.regexp_extract(stores.path(F.col(c)), r"(?i)/p/([^/]+)", 1))
    return S.apart(x.select(
        "record_id", F.col("title").isNotNull().alias("ok"), F.when(F.col("title").isNull(), "CAPTURA_LOCAL_SEM_DADOS_DE_PRODUTO").alias("error"), "url", "final_url", "title", "who.brand", "who.model", "who.mpn", captured.labelled_gtin(F.col("attributes"), F.col("gtin")).alias("gtin"),
        "description", "price", F.when(F.col("price").isNull() | (F.col("before") > F.col("price")), F.col("before")).alias("previous_price"), "currency",
        F.when(F.col("told").rlike("instock|in stock"), True).when(F.col("told").rlike("outofstock|out of stock"), False).alias("available"), F.coalesce("sku", code("final_url"), code("url")).alias("code"), "image_url",
        F.coalesce("variants", F.array().cast("array<string>")).alias("variants"), captured.of_product(F.col("attributes"), F.col("who")).alias("attributes"), prices.kit(F.col("title")).alias("kit"),
    ))
