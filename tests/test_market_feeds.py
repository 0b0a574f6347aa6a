"""Feeds: hard bodies, and identities refined from attributes on cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import captured
from shelfmark.sources import market_feeds as M

PAIRS = "array<struct<name:string,value:string>>"


def test_first_of_each_key_in_order(spark):
    rows = spark.createDataFrame([(1, ["b", "A", "B", "a", None, "c", None]), (2, []), (3, None)], "id int, v array<string>")
    got = {r.id: r.o for r in rows.select("id", captured.first_each(F.col("v"), F.lower).alias("o")).collect()}
    assert got == {1: ["b", "A", None, "c"], 2: [], 3: None}


IDENTITIES = [
    (("Placa-mãe Gigabyte B550M", "Gigabyte", None, None, [("Marca", "AMD"), ("Modelo", "B550M")]), ("Gigabyte", "B550M", None)),
    (("PC AMD", "AMD PCYES", None, None, [("marca", "AMD")]), ("AMD", None, None)),
    (("x", None, "m", "old", [("MPN", "90YV-1"), ("Referência", "ABC-12345")]), (None, "m", "90YV-1")),
    (("x", None, None, None, [("Referência", "90YV0MP2-M0NA00"), ("Modelo", "DUAL")]), (None, "DUAL", "90YV0MP2-M0NA00")),
    (("x", None, None, None, [("Referência", "B550M AORUS"), ("Modelo", "Y")]), (None, "Y", None)),
    (("Fonte 306-7ZP6B22-809", None, None, None, [("Características", "Cor: x | Modelo: 306-7ZP6B22-809"), ("Modelo", "MAG A600DN")]), (None, "MAG A600DN", "306-7ZP6B22-809")),
    (("x", None, None, None, [("Características", "a; P/N: QQ-1234; b")]), (None, None, "QQ-1234")),
    (("Processador AMD Ryzen 5 5600gt", "AMD", None, None, [("Modelo", "100-100001488BOX"), ("MPN", "100-100001488BOX")]), ("AMD", "5600GT", "100-100001488BOX")),
    (("Intel Core i5 12400F caixa", None, "BX8071512400F", "BX8071512400F", []), (None, "i512400F", "BX8071512400F")),
    (("cpu", None, None, None, [("Número do processador", "5600X"), ("Modelo", "100-100000065BOX")]), (None, "5600X", "100-100000065BOX")),
    (("Placa RTX 5060  Ti 8GB", None, "DUAL-RTX5060TI", "DUAL-RTX5060TI", [("Linha", "Dual")]), (None, "Dual RTX 5060 TI", "DUAL-RTX5060TI")),
    (("Teclado", None, "KB-100200", "KB-100200", [("line", "Pro")]), (None, "Pro", "KB-100200")),
    (("Mouse Gamer - M711", None, None, None, []), (None, "M711", None)),
    (("Monitor LS24-300", None, None, None, [("Modelo", "LS24-300")]), (None, "LS24-300", "LS24-300")),
    (("", None, None, None, None), (None, None, None)),
    ((None, " ", "", None, [(None, "x"), ("Modelo", None), ("modelo", "a"), ("MODELO", " b  c ")]), (None, "b c", None)),
]


@pytest.mark.parametrize("rename", [False, True])
def test_identity_from_attributes(spark, rename):
    given = [(i, *row) for i, (row, _) in enumerate(IDENTITIES)]
    rows = spark.createDataFrame(given, f"id int, title string, brand string, model string, mpn string, attributes {PAIRS}")
    rows = rows.withColumnRenamed("title", "name") if rename else rows
    who = captured.refined(F.col("name" if rename else "title"), F.col("brand"), F.col("model"), F.col("mpn"), F.col("attributes"))
    got = {r.id: tuple(r.who) for r in rows.select("id", who.alias("who")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(IDENTITIES)}


def test_attributes_of_the_product_itself(spark):
    listed = [("Marca", "AMD"), ("marca", "Gigabyte"), ("Modelo", "X-1"), ("mpn", "x-1"), ("Vendido por", "Loja"), ("Frete grátis", "sim"), ("Cor", "Preto"), ("COR", "preto"), ("Total de portas", "3"), ("", "x"), ("Peso", None)]
    rows = spark.createDataFrame([(listed, ("gigabyte", "B550", "X-1")), (listed, (None, "X-1", "X-1")), (None, (None, None, None))], f"a {PAIRS}, i struct<brand:string,model:string,mpn:string>")
    got = [[tuple(p) for p in r.o] for r in rows.select(captured.of_product(F.col("a"), F.col("i")).alias("o")).collect()]
    assert got[0] == [("marca", "Gigabyte"), ("MPN", "X-1"), ("Cor", "Preto")]
    assert got[1] == [("Marca", "AMD"), ("marca", "Gigabyte"), ("Modelo", "X-1"), ("mpn", "x-1"), ("Cor", "Preto")] and got[2] == []


def test_market_search(spark):
    link = "https://produto.mercadolivre.com.br/MLB-123456789-x"
    value = lambda i, **kw: {"id": i, **kw}
    body = {"results": [
        {"id": "MLB1", "title": "t", "permalink": link, "price": 10, "original_price": 12.5, "currency_id": "BRL", "available_quantity": 0, "attributes": [value("BRAND", value_name=" A  B "), value("BRAND", values=[{"name": "C"}, {"name": "C"}, {"struct": {"number": 16, "unit": "GB"}}]), value("EAN", value_name="789")], "seller": {"id": 7}},
        {"permalink": link, "status": "paused", "available_quantity": 3, "attributes": [value("GTIN", value_name=""), None]}, {"permalink": link, "available_quantity": "many"}, {"permalink": link, "seller": None}, {"permalink": "https://evil.example/MLB-123456789"}, {"title": "no link"}, None,
    ]}
    given = [(1, json.dumps(body), None), (2, None, "HTTP 403"), (3, "[]", "HTTP 500"), (4, "{}", None), (5, '{"results": null}', None), (6, "", None), (7, '{"results": []}', "HTTP 429")]
    rows = spark.createDataFrame(given, "search_id int, body string, error string")
    got = M.market_search(rows).orderBy("pos").collect()
    assert [(r.pos, r.brand, r.gtin, r.available) for r in got] == [(0, "C; 16 GB", "789", False), (1, None, None, False), (2, None, None, False), (3, None, None, True)]
    assert got[0].seller_id == "7" and got[0].previous_price == 12.5
    status = {r.search_id: (r.status, r.found) for r in M.market_search_status(rows).collect()}
    assert status == {1: ("ENCONTRADO", 4), 2: ("BLOQUEADO", 0), 3: ("FALHA_TEMPORARIA", 0), 4: ("NAO_ENCONTRADO", 0), 5: ("NAO_ENCONTRADO", 0), 6: ("FALHA_TEMPORARIA", 0), 7: ("NAO_ENCONTRADO", 0)}
    assert M.market_search(rows.limit(0)).count() == 0


def test_market_items(spark):
    many = [{"name": f"n{i}", "value_name": "v"} for i in range(400)]
    bodies = [
        {"price": 75, "previous_price": 100, "attributes": [{"name": "Cor", "value_name": "Azul"}, {"nome": "COR", "valor": "azul"}, {"id": "X", "value": 3}, {"name": "d", "value": {"a": 1}}, {"name": "", "value": "x"}, {"name": "n" * 200, "value_name": "v" * 2000}]},
        {"price": 100, "previous_price": 100, "product_attributes": many, "attributes": [{"name": "a", "value": "b"}], "source": "MERCADO_LIVRE_API", "api_used": True, "item_id": "I"}, {"price": 0, "previous_price": 5},
    ]
    rows = spark.createDataFrame([(i, "u", "R", json.dumps(b)) for i, b in enumerate(bodies)] + [(3, "u", "R", None), (4, "u", None, "no json")], "record_id int, url string, requested_id string, body string")
    got = {r.record_id: r for r in M.market_items(rows).collect()}
    assert [tuple(a) for a in got[0].attributes] == [("Cor", "Azul"), ("X", "3"), ("n" * 180, "v" * 1500)] and (got[0].discount, got[0].promotion, got[0].fallback, got[0].item_id) == (25.0, True, True, "R")
    assert len(got[1].attributes) == 300 and (got[1].discount, got[1].promotion, got[1].fallback, got[1].item_id, got[1].official) == (None, False, False, "I", True)
    assert [(got[i].discount, got[i].attributes, got[i].final_url, got[i].currency) for i in (2, 3, 4)] == [(None, [], "u", "BRL")] * 3


def test_data_sheets(spark):
    feature = lambda name, **kw: {"Feature": {"Name": {"Value": name}}, **kw}
    sheet = {"GeneralInfo": {"Brand": "ACME", "BrandPartCode": "P-1", "GTIN": ["111111", "7891234567895"], "ProductName": "One"}, "Image": {"LowPic": "l"}, "FeaturesGroups": [
        {"Features": [feature("A", PresentationValue="", RawValue="1"), feature("a", Value="1"), feature("B", PresentationValue="2 x", RawValue="2", ID=5), feature("", Value="3"), feature("C")]}, {}, {"Features": [feature("A", Value="9")]}]}
    wrapped, bare, other = json.dumps({"data": sheet}), json.dumps(sheet), json.dumps({"data": {"GeneralInfo": {"Brand": "OTHER", "GTINs": [{"GTIN": "222222"}]}}})
    given = [(1, "7891234567895", None, None, wrapped), (2, None, "acme", "p1", bare), (3, "999999", None, None, wrapped), (4, None, "x", "P-1", wrapped), (5, None, "ACME", "P-2", wrapped), (6, None, "ACME", None, wrapped), (7, "222222", "zzz", None, other),
             (8, "1", None, None, '{"message": "none"}'), (9, "1", None, None, None), (10, "222222", None, None, '{"data": {"GeneralInfo": {}}}')]
    got = {r.record_id: r for r in M.data_sheets(spark.createDataFrame(given, "record_id int, gtin string, brand string, mpn string, body string")).collect()}
    assert {i: (r.ok, r.error) for i, r in got.items()} == {
        1: (True, None), 2: (True, None), 3: (False, "IDENTIDADE_DIVERGENTE"), 4: (False, "MARCA_DIVERGENTE"), 5: (False, "IDENTIDADE_DIVERGENTE"), 6: (False, "IDENTIDADE_INSUFICIENTE"), 7: (True, None),
        8: (False, "PRODUTO_NAO_ENCONTRADO"), 9: (False, "PRODUTO_NAO_ENCONTRADO"), 10: (False, None),
    }
    assert [tuple(a) for a in got[1].attributes] == [(None, "A", "1"), ("5", "B", "2 x"), (None, "A", "9")] and (got[1].gtin, got[2].gtin, got[1].image_url, got[7].gtin, got[3].title) == ("7891234567895", "111111", "l", "222222", None)


def test_captures(spark):
    body = {"productName": " Mouse X ", "price": "R$ 1.234,56", "highPrice": "1.000,00", "availability": "https://schema.org/InStock", "attributes": [{"name": "12x de R$ 9,00", "value": "R$ 108,00"}, {"name": "Cor", "value": "", "value_name": "Azul"}, {"name": "EAN", "value": "4006381333931"}, {"name": "Pix", "value": "1"}, None],
            "selectedVariants": ["", "Selecionar imagem", "Azul", None]}
    given = [(1, "https://x.example/a/p/abc123/q/", json.dumps(body)), (2, "u", "{}"), (3, "u", None), (4, "u", json.dumps({"h1": "t", "price": 10, "previousPrice": 12.5, "availability": "out of stock", "sku": "S"}))]
    got = {r.record_id: r for r in M.captures(spark.createDataFrame(given, "record_id int, url string, body string")).collect()}
    r = got[1]
    assert (r.ok, r.title, r.price, r.previous_price, r.available, r.gtin, r.code, r.variants) == (True, "Mouse X", 1234.56, None, True, "4006381333931", "abc123", ["Azul"]) and [tuple(a) for a in r.attributes] == [("Cor", "Azul"), ("EAN", "4006381333931")]
    assert [(got[i].ok, got[i].error, got[i].attributes) for i in (2, 3)] == [(False, "CAPTURA_LOCAL_SEM_DADOS_DE_PRODUTO", [])] * 2
    assert (got[4].ok, got[4].price, got[4].previous_price, got[4].available, got[4].code) == (True, 10.0, 12.5, False, "S")


def test_campaigns(spark):
    nodes = [{"offerName": "n", "offerType": "2", "commissionRate": "0.05", "periodStartTime": 1700000000}, None, {"offerType": "x", "commissionRate": 7}]
    rows = spark.createDataFrame([(1, json.dumps({"shopeeOfferV2": {"nodes": nodes}})), (2, "{}"), (3, None), (4, '{"shopeeOfferV2": []}')], "feed_id int, body string")
    got = M.campaigns(rows).orderBy("pos").collect()
    assert [(r.feed_id, r.pos, r.name, r.offer_type, r.commission, r.starts) for r in got] == [(1, 0, "n", 2, 5.0, 1700000000), (1, 2, None, None, 7.0, None)]
