"""The HTML pass on hand-made pages: linked data, microdata, attribute tables, descriptions, links, broken input."""

import json

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import markup, records

URL = "https://shop.example/p"
LD = '<script type="application/ld+json">{}</script>'


def page(html, url=URL):
    return markup.read_page(html, url)


def pairs(html):
    return [(p["name"], p["value"]) for p in page(html)["pairs"]]


@pytest.fixture(scope="module")
def record(spark):
    def of(*htmls):
        rows = spark.createDataFrame([(i, URL, h) for i, h in enumerate(htmls)], "page_id int, url string, html string")
        return [r.asDict() for r in records.records(markup.parsed(rows)).orderBy("page_id").collect()]

    return of


def test_a_graph_resolves_references_across_scripts_and_cycles(record):
    product = {"@type": "https://schema.org/Product", "name": "SSD ABC 1TB", "brand": {"@id": "#brand"}, "offers": {"@id": "#offer"}, "image": {"@id": "#image"}, "additionalProperty": {"@id": "#spec"}}
    graph = [{"@id": "#brand", "name": "ABC", "subjectOf": {"@id": "#brand"}}, {"@id": "#offer", "priceSpecification": {"price": "399.90"}, "availability": "https://schema.org/InStock"}, {"@id": "#image", "url": "/ssd.jpg"}, {"@id": "#spec", "name": "Capacidade", "value": "1 TB"}]
    (r,) = record(LD.format(json.dumps(product)) + LD.format(json.dumps({"@graph": graph})))
    assert (r["brand"], r["price"], r["price_source"], r["image_url"], r["available"]) == ("ABC", 399.9, "JSON_LD", "https://shop.example/ssd.jpg", True)
    assert [tuple(a) for a in r["attributes"]] == [("Capacidade", "1 TB")]


def test_which_product_a_page_is_about(record):
    two = [{"@type": "WebPage", "mainEntity": {"@id": "#main"}}, {"@id": "#main", "@type": "Product", "name": "SSD ABC", "url": URL}, {"@type": "Product", "name": "SSD XYZ", "url": "/other"}]
    same = {"@id": "#p", "@type": "Product", "name": "Monitor ABC"}
    scopes = '<h1>Choose</h1><div itemscope itemtype="https://schema.org/Product"><meta itemprop="brand" content="ABC"></div><div itemscope itemtype="https://schema.org/Product"></div>'
    got = record(f'<link rel="canonical" href="{URL}">' + LD.format(json.dumps({"@graph": two})), LD.format(json.dumps([same, same])), LD.format(json.dumps({"@graph": two})) + "<h1>None</h1>", scopes, LD.format("{broken}") + '<div itemscope itemtype="x/Product"><meta itemprop="name" content="Micro"></div>')
    assert [r["title"] for r in got] == ["SSD ABC", "Monitor ABC", "None", "Choose", "Micro"]
    assert got[3]["brand"] is None


def test_microdata_with_scopes_inside_and_repeated_properties(record):
    html = '''<article itemscope itemtype="https://schema.org/Product"><meta itemprop="name" content="Notebook"><div itemprop="brand" itemscope><meta itemprop="name" content="ABC"></div>
      <meta itemprop="model" content="N16"><meta itemprop="gtin13" content="1234567890123"><div itemprop="description">Has 512 GB.</div><link itemprop="image" href="/a.jpg"><link itemprop="image" href="/b.jpg">
      <div itemprop="offers" itemscope><meta itemprop="price" content="2999.90"><link itemprop="availability" href="https://schema.org/OutOfStock"></div>
      <div itemprop="additionalProperty" itemscope><meta itemprop="name" content="Mem"><meta itemprop="value" content="16 GB"></div></article>'''
    (r,) = record(html)
    assert (r["title"], r["brand"], r["model"], r["gtin"], r["price"], r["price_source"], r["available"], r["image_url"]) == ("Notebook", "ABC", "N16", "1234567890123", 2999.9, "MICRODATA", False, "https://shop.example/a.jpg")
    assert r["description"] == "Has 512 GB." and r["attributes"][0]["value"] == "16 GB"


def test_prices(record):
    ld = lambda offers: LD.format(json.dumps({"@type": "Product", "name": "x", "offers": offers}))
    meta = '<meta property="product:price:amount" content="999">'
    got = record(ld({"price": 0}) + meta, ld([{"price": "1"}, {"price": "2"}]), ld([{"price": "1.234,50"}, {"price": 1234.5}]), ld({"highPrice": 5}) + meta, ld([]), ld("text"), "<h1>Monitor</h1>" + meta)
    assert [(r["price"], r["price_source"]) for r in got] == [(0, "JSON_LD"), (None, None), (1234.5, "JSON_LD"), (999, "META"), (None, None), (None, None), (999, "META")]


def test_attribute_pairs():
    assert pairs("<table><tr><th>A</th><td>1<br>2</td></tr><tr><td>a</td><td>1  2</td></tr><tr><td>one</td></tr></table>") == [("A", "1 2")]
    assert pairs("<table><tr><td>Out<table><tr><td>In</td><td>1</td></tr></table></td><td>2</td></tr></table>") == [("Out In 1", "2"), ("In", "1")]
    assert pairs("<dl><dt>D</dt><p>z</p><dd>d</dd><dt>no</dt></dl><div><dd>far</dd></div>") == [("D", "d")]
    assert pairs('<ul class="my-specs"><li>Cor: azul: claro</li><li><span>K</span><b>V</b></li><li>no</li></ul><p>Free: text</p>') == [("Cor", "azul: claro"), ("K", "V")]
    assert pairs("<nav><table><tr><td>a</td><td>b</td></tr></table></nav><div class='x related-y'><dl><dt>a</dt><dd>b</dd></dl></div>") == []
    assert pairs(f"<table><tr><td>{'n' * 161}</td><td>v</td></tr><tr><td>n</td><td>{'v' * 1001}</td></tr></table>") == []
    assert len(pairs("<table>" + "".join(f"<tr><td>{i}</td><td>v</td></tr>" for i in range(500)) + "</table>")) == 250
    unit = {"@type": "Product", "additionalProperty": [{"name": "W", "value": {"value": 5, "unitText": "kg"}}, {"name": "L", "value": 3, "unitCode": "MM"}, {"name": "B", "value": False}, {"name": "N"}, "x"]}
    assert pairs(LD.format(json.dumps(unit))) == [("W", "5 kg"), ("L", "3 MM"), ("B", "No")]


def test_technical_pairs_of_embedded_json():
    data = {"props": {"technicalData": [{"label": "Cores", "value": [4, {"value": 8}]}, {"wifi": True}], "other": {"name": "x", "value": "y"}}}
    found = page(f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script><script type="application/json">{json.dumps(data)}</script><script type="application/json">[1,</script>')["json_pairs"]
    assert [(p["path"], p["name"], p["value"]) for p in found] == [("props.technicalData", "Cores", "4, 8"), ("props.technicalData.value", "value", "8"), ("props.technicalData", "wifi", "Sim")]


def test_descriptions(record):
    html = '<div id="feature-bullets"><ul><li>One</li></ul></div><div id="aplus"><div itemprop="description">Maker &amp; co</div>more</div><aside><div id="description">Other</div></aside><div class="product-description">One</div>'
    told = '<p>Ryzen <b>5</b></p><ul><li>16 GB</li></ul><script>alert(1)</script>'
    long = LD.format(json.dumps({"@type": "Product", "name": "x", "description": told}).replace("</", "<\\/"))
    got = record(html, long, long + '<div id="descricao">short</div>', '<meta name="description" content="meta"><h1>x</h1>', "<h1>x</h1>")
    assert [(r["description"], r["description_source"]) for r in got] == [("One\n\nMaker & co\nmore", "PAGINA"), ("Ryzen 5\n\n16 GB", "DADOS_ESTRUTURADOS"), ("Ryzen 5\n\n16 GB", "DADOS_ESTRUTURADOS"), ("meta", "META"), (None, None)]


def test_pages_that_are_blocked_broken_or_empty(spark, record):
    got = record("<title>Access Denied</title>", None, "", "<p>no <b>end <td", "<h1>a</h2> &eacute;&#233; <x></b></h1></div>", "<![bad", "<h1>Captcha</h1>" + LD.format('{"@type":"Product","name":"Real"}'))
    assert [(r["ok"], r["blocked"], r["title"]) for r in got] == [(False, True, None), (False, False, None), (False, False, None), (False, False, None), (True, False, "a éé"), (False, False, None), (True, False, "Real")]
    deep = page("<div>" * 5000 + "x")
    assert deep["text"] == "x"
    assert page(LD.format("[" * 3000 + "]" * 3000))["has_product"] is False
    none = spark.createDataFrame([], "page_id int, url string, html string, page string")
    assert records.records(markup.parsed(none)).count() == 0


def test_detail_links_and_merging(spark):
    seed = '<h1>Mouse A1</h1><table><tr><td>MPN</td><td>A1</td></tr><tr><td>Cor</td><td>azul</td></tr></table><a href="/p/spec#x">Ficha técnica</a><a href="/p/spec/">Specs</a><a href="/login/specs">Specs</a><a href="https://other.example/s">Specs</a><a href="/p/more">Description</a><a href="/p/third">Specs</a><a href="/p#y">Specs</a>'
    found = {"/p/spec": '<h1>Mouse A1</h1><table><tr><td>cor</td><td>rosa</td></tr><tr><td>DPI</td><td>800</td></tr></table><div id="description">long</div>', "/p/more": "<h1>Mouse A1</h1><table><tr><td>Part Number</td><td>B2</td></tr></table>", "/p/third": "<h1>Mouse A1</h1>"}
    rows = lambda items: markup.parsed(spark.createDataFrame(items, "page_id int, url string, html string"))
    pages = rows([(1, URL, seed), (2, URL + "/x", "<h1>y</h1>")])
    links = records.detail_links(pages, 2)
    assert [(r.page_id, r.href) for r in links.orderBy("place").collect()] == [(1, "https://shop.example/p/spec"), (1, "https://shop.example/p/more")]
    details = records.records(rows([(10 + i, "https://shop.example" + u, h) for i, (u, h) in enumerate(found.items())]))
    one, other = records.with_details(records.records(pages), links, details).orderBy("page_id").collect()
    assert [tuple(a) for a in one.attributes] == [("MPN", "A1"), ("Cor", "azul"), ("DPI", "800")]
    assert (one.description, one.n_details, other.n_details, other.title) == ("long", 1, 0, "y")


def test_the_largest_image(spark):
    html = '<meta property="og:image" content="https://i.x/50x50/a.jpg"><img src="https://i.x/600x400/a.jpg"><img src="https://i.x/900x900/b.jpg">'
    rows = markup.parsed(spark.createDataFrame([(1, URL, html, html), (2, URL, "<p>", "<p>")], "page_id int, url string, html string, source string"))
    got = rows.select("page_id", records.best_image(F.col("page"), F.col("source"), F.lit(None).cast("string")).alias("i")).orderBy("page_id").collect()
    assert [r.i for r in got] == ["https://i.x/600x400/a.jpg", None]
