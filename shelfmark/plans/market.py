"""Registered queries of prices, stores and search intent: hard cases by part, answers by hand, and jobs over `pages` and `part` with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent, prices, stores
from .cases import cases
from .catalogue import query, rows

_cents = lambda c: F.round(c * 100).cast("long")

cases("page_price_mentions", ["text"], ["pix", "at_once", "former"], [
    ("R$ 1.234,56 no Pix", "123456", None, None), ("Preço no Pix: R$ 99,90", "9990", None, None), ("pix R$ 0,00 e R$ 10,00 no PIX", "1000", None, None), ("por R$ 50,00 em 10x", None, None, None), ("por R$ 50,00 x2; à vista R$ 45,00", None, "4500", None),
    ("Preço: R$ 3.000,00", None, "300000", None), ("de R$ 200,00 por R$ 150,00", None, "15000", "20000"), ("era R$ 70,00\nagora R$ 60,00", None, None, "7000"), ("PREÇO ANTERIOR - R$ 12,34", None, None, "1234"), ("por R$ 10,00/mês", None, None, None), ("", None, None, None), (None, None, None, None),
], lambda text: [_cents(prices.pix_price(text)), _cents(prices.price_at_once(text)), _cents(prices.former_price(text))])

_entry = lambda *xs: F.array(F.struct(*(x.cast("double").alias(n) for n, x in zip(("best", "full", "regular"), xs, strict=True))))
cases("page_price", ["text", "best", "full", "regular", "generic", "marked", "old"], ["price", "source", "previous"], [
    ("R$ 90,00 no pix", "100", "120", "110", "95", None, None, "9000", "MAGALU_PIX", "12000"), ("", "100", "120", "110", "95", "115", None, "10000", "MAGALU_ESTRUTURADO", "11500"), ("", None, None, "110", "95", None, "130", "11000", "MAGALU_ESTRUTURADO", "13000"),
    ("", None, None, None, "95", "90", "99", "9500", "OUTRO", "9900"), ("de R$ 80,00 por R$ 70,00", None, None, None, None, None, None, "7000", "MAGALU_TEXTO_PRECO", "8000"), ("de R$ 80,00 por x", "85", None, None, None, None, "99", "8500", "MAGALU_ESTRUTURADO", None),
    (None, "0", None, "5", None, None, None, "500", "MAGALU_ESTRUTURADO", None), (None, None, None, None, None, "9", None, None, None, "900"), (None, None, None, None, None, None, None, None, None, None),
], lambda text, best, full, regular, generic, marked, old: [(lambda p: (_cents(p.price), p.source, _cents(p.previous)))(
    prices.page_price(text, _entry(best, full, regular), generic.cast("double"), F.lit("OUTRO"), marked.cast("double"), old.cast("double"))
)[i] for i in range(3)])

_money = lambda a, r, c, *more: F.struct(a.cast("double").alias("amount"), r.cast("double").alias("regular"), c.alias("currency"), *more)
cases("listing_price", ["sale", "sale_was", "promotion", "standard", "item", "item_was", "best", "best_id"], ["price", "previous", "currency", "source"], [
    ("10", "12", "9", "8", "7", None, "6", None, "10", "12", "USD", "SALE_PRICE"), (None, "12", "9", "8", "7", None, "6", None, "9", "19", "BRL", "PRICES_PROMOTION"), (None, "12", None, "8", "7", None, "6", None, "8", "12", "BRL", "PRICES_STANDARD"),
    (None, None, None, None, "7", "9", "6", None, "7", "9", "USD", "ITEM_LEGACY_PRICE"), (None, None, None, None, None, None, "6", None, "6", None, "USD", "CATALOG_BUY_BOX"), (None, None, None, None, None, None, "6", "MLB1", "6", None, "USD", "CATALOG_BUY_BOX"),
    (None, None, None, None, None, None, "6", "MLB2", None, None, "USD", None), (None, None, None, None, None, None, None, None, None, None, "USD", None),
], lambda sale, sale_was, promotion, standard, item, item_was, best, best_id: [(lambda p: (p.price.cast("long"), p.previous.cast("long"), p.currency, p.source))(prices.listing_price(
    _money(sale, sale_was, F.lit(" USD ")), F.array(_money(standard, F.lit(None), F.lit(None).cast("string"), F.lit("standard").alias("type")), _money(promotion, promotion + 10, F.lit("BRL"), F.lit("promotion").alias("type"))),
    _money(item, item_was, F.lit(None).cast("string")), _money(best, F.lit(None), F.lit(None).cast("string"), best_id.alias("item_id")), F.lit("MLB1")))[i] for i in range(4)])

cases("merged_price", ["price", "previous", "source", "other", "other_previous", "other_source"], ["price_", "previous_", "source_"], [
    ("100", None, "API", "90", None, "MERCADO_LIVRE_PDP", "90", "100", "MERCADO_LIVRE_PDP"), ("100", "150", "API", "90", "95", "MERCADO_LIVRE_PDP", "90", "95", "MERCADO_LIVRE_PDP"), ("80", None, "API", "90", None, "MERCADO_LIVRE_PDP", "90", None, "MERCADO_LIVRE_PDP"),
    ("100", None, "API", "90", "120", "OUTRA", "100", "120", "API"), (None, None, "", "90", None, "OUTRA", "90", None, "OUTRA"), (None, None, None, None, None, "MERCADO_LIVRE_PDP", None, None, "MERCADO_LIVRE_PDP"),
], lambda a, b, c, d, e, f: [(lambda p: (p.price.cast("long"), p.previous.cast("long"), p.source))(prices.merged_price(a.cast("double"), b.cast("double"), c, d.cast("double"), e.cast("double"), f))[i] for i in range(3)])

cases("needs_more", ["title", "image", "price", "brand", "model", "mpn", "n"], ["more"], [
    ("t", "i", "1", "b", "m", None, "6", "false"), ("t", "i", "1", "b", None, "p", "6", "false"), ("t", "i", "1", "b", None, None, "6", "true"), ("t", "i", "1", "b", "m", None, "5", "true"), ("", "i", "1", "b", "m", None, "6", "true"), ("t", "i", None, "b", "m", None, "6", "true"), (None, None, None, None, None, None, None, "true"),
], lambda t, i, p, b, m, q, n: [prices.needs_more(t, i, p.cast("double"), b, m, q, n.cast("int"))])

cases("page_availability", ["text", "schema", "other"], ["told", "schema_told"], [
    ("Produto INDISPONÍVEL comprar agora", "https://schema.org/InStock", "true", "false", "true"), ("Adicionar à Sacola", "OutOfStock", None, "true", "false"), ("x", "in_stock", "false", "false", "true"), ("x", "PreOrder", None, None, None), (None, None, "true", "true", None), ("Avise-me quando chegar", None, None, "false", None),
], lambda text, schema, other: [prices.availability(text, other.cast("boolean")), prices.schema_availability(schema)])

cases("page_sellers", ["text"], ["seller"], [
    ("Vendido por  Loja Um e entregue por Magalu", "Loja Um"), ("vendido e entregue por Loja Dois\nx", "Loja Dois"), ("Vendido por Loja Três R$ 10,00", "Loja Três"), ("Vendido por Loja 4\nComprar", "Loja 4"), ("Vendido por " + "x" * 121, None), ("Entregue por A", None), ("", None), (None, None),
], lambda text: [prices.seller(text)])

cases("kit_titles", ["title"], ["is_kit", "quantity", "parts"], [
    ("Kit com 3 Ventoinhas", "true", "3", "VENTOINHA"), ("Memória RAM 2x16GB DDR5", "true", "2", "MEMORIA_RAM"), ("Teclado e Mouse", "true", None, "TECLADO,MOUSE"), ("Placa RTX 2 fans", "false", None, ""), ("Combo 3 fans RGB", "true", "3", "VENTOINHA"), ("Kit gamer", "true", None, ""),
    ("Mouse", "false", None, ""), ("Teclado, mouse e 2 fans", "true", None, "TECLADO,MOUSE,VENTOINHA"), ("Kitesurf", "false", None, ""), ("", "false", None, ""), (None, "false", None, ""),
], lambda title: [(lambda k: (k.is_kit, k.quantity, F.array_join(k.parts, ",")))(prices.kit(title))[i] for i in range(3)])

cases("store_product_urls", ["store", "url"], ["product"], [
    ("AMAZON", "https://www.amazon.com.br/x/dp/B0ABCDEF12/ref=1", "true"), ("AMAZON", "https://www.amazon.com.br/dp/B0ABC", "false"), ("AMAZON", "https://amazon.evil.com/dp/B0ABCDEF12", "false"), ("KABUM", "http://kabum.com.br/produto/123", "true"), ("KABUM", "https://www.kabum.com.br/produto/x", "false"),
    ("TERABYTE", "https://www.terabyteshop.com.br/produto/9/x", "true"), ("ALIEXPRESS", "https://pt.aliexpress.com/item/100.html?x=1", "true"), ("PICHAU", "https://www.pichau.com.br/placa-de-video-x", "true"), ("PICHAU", "https://www.pichau.com.br/busca/placa-de-video", "false"), ("PICHAU", "https://www.pichau.com.br/a-b", "false"),
    ("MAGALU", "https://www.magazinevoce.com.br/loja/x/p/abc123/in/", "true"), ("MAGALU", "https://www.magazineluiza.com.br/x", "false"), ("SHOPEE", "https://shopee.com.br/x-i.1.2", "true"), ("SHOPEE", "https://shopee.com.br/x", "false"), ("MERCADO_LIVRE", "https://produto.mercadolivre.com.br/MLB-123456-x", "true"),
    ("MERCADO_LIVRE", "https://www.mercadolivre.com.br/x/p/MLB1", "true"), ("MERCADO_LIVRE", "https://www.mercadolivre.com.br/MLB-12", "false"), ("KABUM", "https://u:p@kabum.com.br/produto/1", "false"), ("KABUM", "ftp://kabum.com.br/produto/1", "false"), ("OTHER", "https://a.example/p/1", "false"), (None, "https://kabum.com.br/produto/1", "false"), ("KABUM", None, "false"),
], lambda store, url: [stores.product_url(store, url)])

cases("partner_names", ["platform", "host"], ["name", "domain"], [
    ("kabum ", "www.kabum.com.br", "KaBuM!", "kabum.com.br"), ("OUTRO_SITE", "www.minhaloja.com", "Minhaloja", "www.minhaloja.com"), ("OUTRO_SITE", "loja-x.example", "Loja-X", "loja-x.example"), (None, "localhost", "localhost", "localhost"), (None, None, "Loja", None), ("AMAZON", None, "Amazon", "amazon.com.br"),
], lambda platform, host: [stores.partner(platform, host)["name"], stores.partner(platform, host)["domain"]])

cases("result_targets", ["href"], ["target"], [
    ("//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=2", "https://a.example/x?y=1"), ("/ck/a?!&&u=a1aHR0cHM6Ly9hLmV4YW1wbGUveA&ntb=1", "https://a.example/x"), ("https://www.bing.com/ck/a?u=https%3A%2F%2Fb.example%2F", "https://b.example/"), ("https://www.bing.com/search?u=1", "https://www.bing.com/search?u=1"),
    ("https://c.example/p", "https://c.example/p"), ("javascript:void(0)", None), ("/local", None), ("https://duckduckgo.com/l/?x=1", None), ("", None), (None, None), ("https://www.bing.com/ck/a?u=a1%%%", None),
], lambda href: [stores.result_target(href)])

cases("search_intent", ["wanted", "title"], ["sold", "fits"], [
    ("RTX 4060", "Placa de Vídeo RTX4060 8GB", None, "true"), ("RTX 4060", "Placa de Vídeo RTX4060Ti 8GB", None, "false"), ("rtx 4060 ti", "GeForce RTX 4060 Ti OC", None, "true"), ("RTX 4060", "Suporte para RTX 4060", "suporte", "false"), ("mouse logitech", "Mouse Gamer Logitech", "mouse", "true"),
    ("notebook dell", "Notebook Dell Inspiron", None, "true"), ("notebook dell", "Carregador Notebook Dell", "carregador", "false"), ("ssd 1tb", "SSD Kingston 1 TB", None, "true"), ("ssd 1tb", "SSD Kingston 2TB", None, "false"), ("ssd 1tb", "Processador 1tb ssd", None, "false"), ("", "x", None, "false"), ("x", None, None, "false"),
], lambda wanted, title: [intent.accessory(intent.search_text(title)), intent.matches(wanted, title)])
