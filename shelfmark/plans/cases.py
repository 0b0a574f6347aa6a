"""Registered queries of the folding rules: each part takes one of a list of hard cases by its key; SQL holds the answers.

The answers are worked out by hand from the rules' meaning, not by the code under test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories, folding, kinds
from ..functions import scalars as S
from ..operators import listings, matching, pages, sheets, usage
from .catalogue import CALLS, CALLS_SQL, PRICES, query, rows


def _lit(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def cases(name: str, inputs: list[str], outputs: list[str], table: list[tuple], work: Callable[..., list[Column]]) -> None:
    """Registers a query of id and outputs (as text) over part: part k takes row k mod n of the table (its inputs, then the answers)."""
    n = len(table)
    pick = lambda i: f"(list_value({', '.join(_lit(r[i]) for r in table)}))[(p_partkey % {n} + 1)::integer]::varchar"
    sql = "select p_partkey as id, " + ", ".join(f"{pick(len(inputs) + i)} as {o}" for i, o in enumerate(outputs)) + " from part"

    def run(spark, sf_dir) -> DataFrame:
        at = (F.col("id") % n + 1).cast("int")
        given = [F.element_at(F.array(*(F.lit(r[i]).cast("string") for r in table)), at).alias(c) for i, c in enumerate(inputs)]
        parts = rows(spark, sf_dir, "select p_partkey as id from part").select("id", *given)
        return parts.select("id", *(c.cast("string").alias(o) for c, o in zip(work(*map(F.col, inputs)), outputs, strict=True)))

    query(name, sql)(run)


cases("enum_folding", ["vocabulary", "text"], ["value"], [
    ("board_form", "Mini-ITX", "MINI_ITX"), ("board_form", "ITX", "MINI_ITX"), ("board_form", "Micro ATX", "MICRO_ATX"), ("board_form", "mATX", "MICRO_ATX"), ("board_form", "m-atx", "MICRO_ATX"), ("board_form", "E-ATX", "E_ATX"),
    ("board_form", "Extended ATX (12 x 13)", "E_ATX"), ("board_form", "ATX 30,5 cm", "ATX"), ("board_form", "formato ATX", None), ("board_form", "XL", None), ("psu_format", "SFX-L", "SFX_L"), ("psu_format", "SFX 12V", "SFX"),
    ("psu_format", "Flex ATX", "FLEX_ATX"), ("psu_format", "TFX", "TFX"), ("psu_format", "Fonte ATX 3.1", "ATX"), ("psu_format", "fonte atx", None), ("case_size", "Mid Tower", "MID_TOWER"), ("case_size", "midtower", "MID_TOWER"),
    ("case_size", "Full-Tower E-ATX", "FULL_TOWER"), ("case_size", "Small Form Factor", "SFF"), ("case_size", "sff plus", None), ("storage_type", "NVMe M.2", "SSD"), ("storage_type", "Disco Rígido", "HDD"), ("storage_type", "HDD 7200", None),
    ("storage_format", "M.2 2280", "M2"), ("storage_format", "2280", "M2"), ("storage_format", '2,5"', "POLEGADAS_2_5"), ("storage_format", '3.5 pol', "POLEGADAS_3_5"), ("storage_format", "Placa PCIe", "PLACA_PCIE"), ("storage_format", "SATA", None),
    ("storage_interface", "PCIe 4.0 x4", "NVME_PCIE"), ("storage_interface", "NVMe", "NVME_PCIE"), ("storage_interface", "SATA / PCIe", "SATA"), ("storage_interface", "SAS 12 Gb/s", "SAS"), ("storage_interface", "nvme_pcie", "NVME_PCIE"), ("storage_interface", "USB", None),
    ("modularity", "Não modular", "NAO_MODULAR"), ("modularity", "Semi-modular", "SEMI_MODULAR"), ("modularity", "Full Modular", "MODULAR"), ("modularity", "sim", "MODULAR"), ("modularity", "no", "NAO_MODULAR"), ("modularity", "cabos", None),
    ("cooler_type", "Air cooler 120", "AIR_COOLER"), ("cooler_type", "AIO", "WATER_COOLER"), ("cooler_type", "Water Cooler 240mm", "WATER_COOLER"), ("cooler_type", "aio 240", None), ("fan_connector", "4 pinos", "PWM_4_PINOS"), ("fan_connector", "3-pin", "DC_3_PINOS"),
    ("fan_connector", "Molex", "MOLEX"), ("fan_connector", "Conector proprietário", "PROPRIETARIO"), ("memory_form", "SO-DIMM", "SO_DIMM"), ("memory_form", "UDIMM", "DIMM"), ("memory_form", "CAMM2", None), ("m2_key", "Key B+M", "B_M"),
    ("m2_key", "M-Key", "M"), ("m2_key", "chave M", "M"), ("m2_key", "B Key", "B"), ("m2_key", "E", None), ("m2_key", "", None), ("board_form", None, None), ("board_form", "ＡＴＸ", "ATX"),
], lambda vocabulary, text: [F.coalesce(*(F.when(vocabulary == v, folding.enum(v, text)) for v in folding.ENUMS))])

cases("list_folding", ["kind", "text"], ["value"], [
    ("memory_types", "DDR4 / DDR5 e ddr-4", '["DDR4","DDR5"]'), ("memory_types", "DDR 3", '["DDR3"]'), ("memory_types", "LPDDR5", None), ("memory_types", "GDDR6", None), ("sockets", "FCLGA1700, AM5; am5", '["LGA1700","AM5"]'),
    ("sockets", "LGA 1200/TR4", '["LGA1200","TR4"]'), ("sockets", "sTRX4", '["STRX4"]'), ("sockets", "BGA", None), ("texts", " a | B;b\nc ,, A", '["a","B","c"]'), ("texts", " ", None), ("integers", "3, 5/5 7", '["3","5","7"]'), ("integers", "x", None),
    ("frequencies", "7600/7200 MHz DDR5 99999 100", '["7600","7200"]'), ("frequencies", "DDR5", None), ("m2_slots", "2", '[{"code":"M2_1","interfaces":[],"keys":[],"lengths_mm":[]},{"code":"M2_2","interfaces":[],"keys":[],"lengths_mm":[]}]'), ("m2_slots", "0", "[]"),
    ("m2_slots", "17", None), ("m2_slots", "2280", None), ("m2_slots", "2 slots", None), ("board_forms", "ATX, Micro-ATX / mini itx | atx", '["ATX","MICRO_ATX","MINI_ITX"]'), ("board_forms", "none", None), ("memory_type", "DDR4 DDR5", None), ("memory_type", "ddr5", "DDR5"), ("sockets", None, None),
], lambda kind, text: [F.coalesce(*(F.when(kind == k, rule(text)) for k, rule in sheets.KINDS.items() if k in ("memory_types", "sockets", "texts", "integers", "frequencies", "m2_slots", "board_forms", "memory_type")))])

cases("dates", ["text"], ["day"], [
    (text, day and f"{day}T00:00:00.000Z") for text, day in (
        ("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2023/05/25 10:11", "2023-05-25"), ("05/05/2023", None), ("05/06/2023", None), ("25/05/2023", "2023-05-25"), ("25-05-2023", "2023-05-25"), ("05/25/2023", "2023-05-25"), ("31/31/2023", None),
        ("25 May 2023", "2023-05-25"), ("25 maio 2023", "2023-05-25"), ("1st March 2020", "2020-03-01"), ("March 3rd, 2020", "2020-03-03"), ("mar 3 2020", "2020-03-03"), ("10 MARÇO 2021", "2021-03-10"), ("2023", None), ("05/2023", None), ("31 abril 2023", None), ("", None), (None, None),
    )
], lambda text: [S.iso_date(text)])

cases("decimal_numbers", ["text"], ["thousandths"], [
    ("1,234", "1234"), ("1.234", "1234"), ("R$ 1.234,56", "1234560"), ("1,234.56", "1234560"), ("-7", "-7000"), ("2.345,6", "2345600"), ("1-2", None), ("abc", None), ("", None), (None, None), ("10", "10000"), ("1.2.3", None), ("0,001", "1"), ("3.000.000,5", "3000000500"),
], lambda text: [F.round(S.decimal_number(text) * 1000).cast("long")])

_R = "true", "false"
cases("title_relevance", ["wanted", "title"], ["kind", "relevant"], [
    ("RTX 4060", "Placa de Video RTX4060 8GB", "GPU", "true"), ("RTX 4060", "RTX 4060 Ti 8GB", "GPU", "false"), ("rtx4060ti", "GeForce RTX 4060 Ti", "GPU", "true"), ("RX 7900 XT", "RX 7900 XTX", "GPU", "false"), ("monitor 24", "Suporte para monitor 24", "MONITOR", "false"),
    ("monitor 24", "Monitor Gamer 24 com cabo", "MONITOR", "true"), ("suporte monitor", "Suporte articulado monitor", "SUPPORT", "true"), ("suporte monitor", "Suporte para GPU", "SUPPORT", "false"), ("SSD 1TB", "SSD NVMe 1 TB", "SSD", "true"), ("SSD 1TB", "SSD 480GB", "SSD", "false"),
    ("memoria ddr4", "Memória RAM DDR5 16GB", "RAM", "false"), ("mouse logitech g502", "Mouse Gamer Logitech G502 Hero", "MOUSE", "true"), ("mouse logitech g502", "Mousepad Logitech G502", "MOUSE", "false"), ("pc gamer ryzen", "PC Gamer Intel i5", "PC", "true"), ("pc gamer ryzen", "Computador Ryzen 5 gamer", "PC", "true"),
    ("cafeteira", "Capa para cafeteira", None, "false"), ("cafeteira", "Cafeteira com cabo", None, "true"), ("cafeteira", "Chaleira", None, "false"), ("", "x", None, "true"), (None, "x", None, "true"), ("teclado mecânico gaming", "Teclado Gamer Mecanica RGB", "KEYBOARD", "true"), ("headset wireless", "Headset sem fio", "HEADSET", "true"),
    ("fonte 650 watts", "Fonte 650W 80 Plus", "PSU", "true"), ("fonte para notebook", "Fonte ATX", "CHARGER", "false"), ("fonte", None, "PSU", "false"), ("monitores full hd", "Monitor FHD", "MONITOR", "true"), ("placa mãe b550", "Placa-Mãe ASUS B550M", "MOTHERBOARD", "false"), ("placa mãe b550m", "Placa-Mãe ASUS B550M", "MOTHERBOARD", "true"),
], lambda wanted, title: [kinds.first_kind(wanted), kinds.relevant(wanted, title)])

cases("variants", ["wanted", "title"], ["same"], [
    ("RX 7900", "RX 7900 XTX", "false"), ("RX 7900 XTX", "Placa RX 7900 XTX 24GB", "true"), ("RTX 4060 Ti", "RTX 4060 TI", "true"), ("RTX 4060", "RTX4060Ti", "true"), ("SSD 980", "SSD 980 500GB", "true"), ("SSD 980 1TB", "SSD 980 500 GB", "false"), ("SSD 980 1TB", "SSD 980 1 tb", "true"),
    ("SSD 980 1TB", "SSD 980", "false"), ("Cafeteira 110V", "Cafeteira 220 V", "false"), ("Cafeteira 110 v", "Cafeteira 110V", "true"), ("iPhone 15 Pro Max", "iPhone 15 Max Pro", "true"), ("iPhone 15 Pro", "iPhone 15", "false"), ("iPhone SE", "iPhone", "true"), ("", None, "true"),
], lambda wanted, title: [listings.same_variant(wanted, title)])

cases("store_links", ["url"], ["platform", "mode", "item", "shop_item"], [
    ("https://www.kabum.com.br/produto/1", "KABUM", "PAGINA_ESTRUTURADA", None, None), ("https://produto.mercadolivre.com.br/MLB-1234567890-x-_JM", "MERCADO_LIVRE", "API_OFICIAL", "MLB1234567890", None), ("https://www.mercadolivre.com.br/p/MLB19999999?pdp_filters=item_id%3AMLB2222222", "MERCADO_LIVRE", "API_OFICIAL", "MLB2222222", None),
    ("https://www.mercadolivre.com.br/p/MLB19999999", "MERCADO_LIVRE", "API_OFICIAL", None, None), ("https://www.mercadolivre.com.br/x#wid=MLB3333333&y=1", "MERCADO_LIVRE", "API_OFICIAL", "MLB3333333", None), ("https://shopee.com.br/Nome-i.12.345", "SHOPEE", "API_OFICIAL", None, "12/345"), ("https://shopee.com.br/product/7/8", "SHOPEE", "API_OFICIAL", None, "7/8"),
    ("https://a.example/product/7/8", "OUTRO_SITE", "PAGINA_ESTRUTURADA", None, None), ("https://m.magazineluiza.com.br/x", "MAGALU", "EXTRATOR_ESPECIFICO", None, None), ("https://notkabum.com.br/", "OUTRO_SITE", "PAGINA_ESTRUTURADA", None, None), ("no url", "OUTRO_SITE", "PAGINA_ESTRUTURADA", None, None), ("HTTPS://PT.AliExpress.com/item/1", "ALIEXPRESS", "PAGINA_ESTRUTURADA", None, None),
], lambda url: [folding.site(url).platform, folding.site(url).mode, folding.mercadolivre_item(url), F.when(folding.shopee_ids(url).item.isNotNull(), F.concat_ws("/", folding.shopee_ids(url).shop, folding.shopee_ids(url).item))])

cases("source_outcomes", ["ok", "data", "error"], ["outcome"], [
    ("true", "true", None, "COLETADO"), ("true", "false", "", "SEM_DADOS"), ("false", "false", "http_403", "BLOQUEADO"), ("false", "true", "captcha page", "BLOQUEADO"), ("false", "false", "Read timeout", "FALHA_TEMPORARIA"), ("false", "false", "HTTP_503", "FALHA_TEMPORARIA"),
    ("false", "false", "identidade divergente", "MODELO_DIVERGENTE"), ("false", "false", "HTTP_404", "NAO_ENCONTRADO"), ("false", "false", "SEM_DADOS", "SEM_DADOS"), ("false", "false", None, "ERRO_COLETA"), ("false", "false", "other", "ERRO_COLETA"),
], lambda ok, data, error: [folding.outcome(ok.cast("boolean"), data.cast("boolean"), error)])

cases("description_lines", ["text"], ["kept"], [
    ("a\nCompre agora!!\nb", "a\nb"), ("a\n a \n\n\nb\na", "a\n\nb"), ("OFERTA IMPERDÍVEL\nx", "x"), ("clique aqui para ver", "clique aqui para ver"), ("", ""), (None, None), ("siga nossa loja.", ""),
], lambda text: [pages.without_calls(text)])


# A spec sheet: six fields a part, each of a kind of its own, the value by the part's key.
FIELDS = [
    ("CPU", "clock", "mhz", [("3.5 GHz", "3500"), ("4800 MHz", "4800"), ("fast", None)]), ("CPU", "socket", "socket", [("LGA 1700", "LGA1700"), ("AM4/AM5", None), ("am5", "AM5"), (None, None)]),
    ("BOARD", "form", "board_form", [("Micro-ATX", "MICRO_ATX"), ("ATX", "ATX"), ("?", None)]), ("BOARD", "forms", "memory_forms", [("SO-DIMM / UDIMM", '["SO_DIMM","DIMM"]'), ("none", None)]),
    ("RAM", "size", "gb", [("32 GB", "32"), ("1TB", "1024"), ("512 MB", "0.5"), ("", None)]), ("RAM", "ecc", "flag", [("Sim", "true"), ("não", "false"), ("talvez", None)]), ("BOX", "released", "date", [("25 maio 2023", "2023-05-25T00:00:00.000Z"), ("05/06/2023", None)]),
    ("BOX", "ean", "gtin", [("4006381333931", "4006381333931"), ("4006381333932", None)]), ("BOX", "other", None, [("x", None)]),
]


def _choice(i: int, column: int, dialect: str) -> str:
    _, _, _, values = FIELDS[i]
    arms = " ".join(f"when {k} then {_lit(v[column])}" for k, v in enumerate(values))
    return f"select p_partkey as record_id, '{FIELDS[i][0]}' as category, '{FIELDS[i][1]}' as field, {_lit(FIELDS[i][2])} as kind, cast(case p_partkey % {len(values)} {arms} end as {dialect}) as value from part"


@query("sheet_normalise", "select * from (" + " union all ".join(_choice(i, 1, "varchar") for i in range(len(FIELDS))) + ") where value is not null and kind is not null")
def _(spark, sf_dir):
    sheet = rows(spark, sf_dir, " union all ".join(_choice(i, 0, "string") for i in range(len(FIELDS)))).drop("kind")
    schema = spark.createDataFrame([f[:3] for f in FIELDS if f[2]], "category string, field string, kind string")
    return sheets.normalise(sheet, schema)


# Checks: numbers of five categories from the part's own columns, some of them wrong.
SHEET = " union all ".join(f"select p_partkey as record_id, '{c}' as category, '{f}' as field, {v} as value from part" for c, f, v in (
    ("PROCESSADOR", "frequenciaBaseMhz", "cast(p_size * 100 as varchar(9))"), ("PROCESSADOR", "frequenciaTurboMhz", "cast(p_partkey % 50 * 100 - 100 as varchar(9))"), ("PROCESSADOR", "nucleos", "cast(p_size as varchar(9))"),
    ("PLACA_MAE", "formato", "case p_partkey % 3 when 0 then 'MINI_ITX' else 'ATX' end"), ("PLACA_MAE", "slotsMemoria", "cast(p_partkey % 5 as varchar(9))"), ("MEMORIA_RAM", "quantidadeModulos", "cast(p_partkey % 19 as varchar(9))"),
    ("MEMORIA_RAM", "capacidadePorModuloGb", "'8'"), ("GABINETE", "alturaMm", "cast(p_size % 4 as varchar(9))"), ("GABINETE", "nome", "p_name"),
))


@query("sheet_check", f"""select s.record_id, category, field, value, case
  when field = 'frequenciaTurboMhz' and p_partkey % 50 = 0 then 'VALOR_NUMERICO_INVALIDO'
  when field = 'alturaMm' and p_size % 4 = 0 then 'DIMENSAO_NULA'
  when field in ('frequenciaBaseMhz', 'frequenciaTurboMhz') and p_partkey % 50 > 0 and p_size > p_partkey % 50 - 1 then 'INTERVALO_INCONSISTENTE'
  when field = 'slotsMemoria' and p_partkey % 3 = 0 and p_partkey % 5 > 2 then 'SLOTS_INCOMPATIVEIS_COM_FORMATO'
  when field = 'quantidadeModulos' and p_partkey % 19 not between 1 and 16 then 'QUANTIDADE_MODULOS_INVALIDA'
  when category = 'MEMORIA_RAM' and p_partkey % 19 between 1 and 16 and p_partkey % 2 = 0 and p_partkey % 19 <> 4 then 'CAPACIDADE_KIT_INCONSISTENTE' end as reason
from ({SHEET}) s join part on p_partkey = s.record_id""")
def _(spark, sf_dir):
    kits = rows(spark, sf_dir, "select p_partkey as record_id, cast(32 as double) as total_gb from part where p_partkey % 2 = 0")
    return sheets.check(rows(spark, sf_dir, SHEET), kits)


@query("partner_by_platform", r"""
with p as (select s_suppkey as partner_id, s_suppkey as pos, case s_suppkey % 4 when 0 then 'shop.site' || (s_suppkey % 5) || '.example' else 'site' || (s_suppkey % 5) || '.example' end as domain, case s_suppkey % 9 when 0 then 'Loja KaBuM!' when 1 then 'Magazine Luiza' else s_name end as name from supplier),
h as (select p_partkey as id, case p_partkey % 3 when 0 then 'shop.' else '' end || 'site' || (p_partkey % 7) || '.example' as host, case p_partkey % 4 when 0 then 'KABUM' when 1 then 'MAGALU' when 2 then 'SHOPEE' end as platform from part),
m as (select h.id, min_by(partner_id, pos) as partner_id from h join p on h.host = p.domain or h.host like '%.' || p.domain or p.domain like '%.' || h.host group by h.id),
w as (select platform, min(pos) filter (name like '%KaBuM%') as k, min(pos) filter (name like 'Magazine%') as z from p cross join (select distinct platform from h) group by 1)
select h.id, coalesce(m.partner_id, case h.platform when 'KABUM' then w.k when 'MAGALU' then w.z end) as partner_id from h left join m using (id) left join w on w.platform = h.platform""")
def _(spark, sf_dir):
    partners = rows(spark, sf_dir, "select s_suppkey as partner_id, s_suppkey as pos, concat(case s_suppkey % 4 when 0 then 'shop.' else '' end, 'site', cast(s_suppkey % 5 as string), '.example') as domain, case s_suppkey % 9 when 0 then 'Loja KaBuM!' when 1 then 'Magazine Luiza' else s_name end as name, cast(null as string) as slug from supplier")
    seen = rows(spark, sf_dir, "select p_partkey as id, concat('https://www.', case p_partkey % 3 when 0 then 'shop.' else '' end, 'site', cast(p_partkey % 7 as string), '.example/x') as url, case p_partkey % 4 when 0 then 'KABUM' when 1 then 'MAGALU' when 2 then 'SHOPEE' end as platform from part")
    return matching.partner_by_domain(seen, partners, platform="platform").select("id", "partner_id")


@query("usage_recent", f"""with c as (select * from ({CALLS_SQL}) where ts >= (select max(ts) - interval 30 day from events) and ts <= (select max(ts) from events))
select provider, model, count(*) as calls, sum(input_tokens + output_tokens)::bigint as tokens, round(sum((input_tokens * price_in + output_tokens * price_out) / 1e6), 8) as cost_usd, count(*) filter (price_in is null) as unknown_cost
from c left join ({PRICES}) using (model) group by 1, 2""")
def _(spark, sf_dir):
    now = rows(spark, sf_dir, "select max(ts) as now from events").first().now
    calls = usage.recent(rows(spark, sf_dir, CALLS), "ts", F.lit(now))
    return usage.usage_summary(usage.call_cost(calls, rows(spark, sf_dir, PRICES))).withColumn("cost_usd", F.round("cost_usd", 8))


cases("category_rules", ["text"], ["category"], [
    ("Memória RAM DDR5 para placa-mãe B650", "MEMORIA_RAM"), ("Kit de memória 2x16GB", "MEMORIA_RAM"), ("Placa de Vídeo RTX 4070", "PLACA_VIDEO"), ("Placa-mãe ASUS B650M", "PLACA_MAE"), ("ASUS TUF B650M-PLUS WiFi", "PLACA_MAE"), ("Gigabyte GeForce RTX 4060 8GB", "PLACA_VIDEO"),
    ("Monitor Gamer 27 para RTX 4090", "MONITOR"), ("Processador Ryzen 5 5600 AM4 B550", "PROCESSADOR"), ("Notebook Gamer RTX 3050 16GB DDR5 4800MHz", "NOTEBOOK"), ("Kit com 3 ventoinhas 120mm", "VENTOINHA"), ("Corsair Vengeance 32GB (2x16GB) 6000MHz", "MEMORIA_RAM"),
    ("Gabinete Mid Tower para placa-mãe ATX", "GABINETE"), ("Water Cooler 240mm ARGB", "COOLER"), ("Mouse Pad Gamer XL", "MOUSEPAD"), ("Mouse Gamer sem fio", "MOUSE"), ("Fone de ouvido com microfone headset P2", "HEADSET"), ("Fone bluetooth TWS", "FONE"), ("Apple AirPods 3", "FONE"),
    ("Samsung Galaxy S23 256GB", "CELULAR"), ("Robô aspirador inteligente", "ROBO_ASPIRADOR"), ("Aspirador de pó vertical", "ASPIRADOR_PO"), ("Câmera de segurança Wi-Fi", "CAMERA_SEGURANCA"), ("Amazon Kindle 11", "E_READER"), ("Impressora 3D Ender", "IMPRESSORA_3D"), ("Controle Xbox Series", "CONTROLE_VIDEO_GAME"),
    ("HD externo 2TB", "ARMAZENAMENTO"), ("Seagate HD externo 2TB", "ARMAZENAMENTO_EXTERNO"), ("Suporte articulado para monitor", "SUPORTE_MONITOR"), ("Kingston NV2 1TB NVMe", "ARMAZENAMENTO"), ("Corsair RM750 fonte modular 750W", "FONTE"), ("Intel Core i5-12400F", "PROCESSADOR"), ("LG OLED televisão 55", None), ("LG OLED televisão 55 4K", "TV"), ("LG televisão 55 OLED 4K", "TV"),
    ("Pichau PC Ryzen 5 5600 16GB RAM SSD 480GB", "PC_MONTADO"), ("PC Gamer i5 16GB", "PC_MONTADO"), ("SSD 1TB para PC gamer", "ARMAZENAMENTO"), ("Mini PC Intel N100 16GB RAM SSD 512GB", "MINI_COMPUTADOR"), ("Cabo HDMI 2.1", None), ("", None), (None, None), ("Ventilador de mesa", "VENTILADOR"), ("Repetidor de sinal Wi-Fi", "REPETIDOR_WIFI"),
], lambda text: [categories.category(text)])

cases("whole_computers", ["title"], ["whole"], [
    ("Computador de mesa Dell", "true"), ("Desktop Intel Celeron", "true"), ("PC i5-10400 completo", "true"), ("Placa de vídeo para PC gamer", "false"), ("Kit upgrade PC gamer Ryzen 5 5600", "false"), ("Loja PC com RTX 3060", "false"), ("Loja PC com RTX 3060 e SSD 1TB", "true"), ("Teclado para computador", "false"),
    ("Oferta notebook ou PC gamer", "false"), ("", "false"), (None, "false"), ("Mini-PC gamer", "false"),
], lambda title: [categories.whole_computer(title)])

cases("category_names", ["name"], ["category"], [
    ("cpu", "PROCESSADOR"), ("Placa-Mãe", "PLACA_MAE"), (" placa  de vídeo ", "PLACA_VIDEO"), ("PC-Montado", "PC_MONTADO"), ("smart speaker", "SMART_SPEAKER"), ("Robô Aspirador", "ROBO_ASPIRADOR"), ("fones de ouvido", "FONE"), ("Tv", "TV"), ("Câmera de ação", "CAMERA_ACAO"), ("qualquer coisa", "QUALQUER_COISA"), (" ", None), (None, None),
], lambda name: [categories.forced_category(name)])

cases("record_category", ["title", "label", "type", "sheet", "text", "url", "blocked", "forced"], ["category"], [
    ("Mouse X", None, None, None, None, None, None, "gpu", "PLACA_VIDEO"), ("Access denied notebook", None, None, None, None, "https://a.example/ssd-kingston-1tb/p/ABC", "true", None, "ARMAZENAMENTO"), (None, None, None, None, None, "https://a.example/x/smartphone_galaxy", "true", None, "CELULAR"),
    (None, None, None, None, None, "https://a.example/", "true", None, None), ("notebook", None, None, None, None, None, "true", None, None), (None, None, None, None, None, "https://a.example/pc-gamer-16-gb-ddr4-ram/p/1", "true", None, "PC_MONTADO"), ("Mouse Pad grande", "Tipo de produto", "Mouse", None, None, None, None, None, "MOUSEPAD"),
    ("Fone gamer", "tipo do produto", "Headset", None, None, None, None, None, "FONE"), ("Teclado com touchpad", " Product Type ", "Monitor", None, None, None, None, None, "MONITOR"), ("Teclado", "Cor", "Monitor", None, None, None, None, None, "TECLADO"), ("Modelo 9", "Cor", "Preto", "SSD 1TB", "mouse", None, None, None, "ARMAZENAMENTO"),
    ("Modelo 9", "Cor", "Preto", None, "Modelo 9 mouse", None, None, None, "MOUSE"), ("Modelo 9", None, None, None, "Modelo 9 mouse", None, None, None, None), (None, None, None, None, None, None, None, " ", None), (None, None, None, None, None, "https://a.example/c%C3%A2mera-x", "true", None, "CAMERA"),
], lambda title, label, type_, sheet, text, url, blocked, forced: [categories.record_category(
    title, F.when(label.isNotNull(), F.array(F.struct(label.alias("name"), type_.alias("value")))), sheet, text, url, blocked == "true", forced)])


@query("sheet_payload", """select p_partkey as record_id, case p_partkey % 3 when 0 then 'PROCESSADOR' when 1 then 'MONITOR' end as category,
case when p_partkey % 3 = 0 then case when p_partkey % 2 = 0 then '{"nucleos":"' || p_size || '","tiposMemoriaSuportados":"[\\"DDR5\\"]"}' else '{"nucleos":"' || p_size || '","tiposMemoriaSuportados":"[]"}' end
  when p_partkey % 3 = 1 and p_partkey % 2 = 0 then '{"altura":"' || p_size || '"}' else '{}' end as fields from part""")
def _(spark, sf_dir):
    records = rows(spark, sf_dir, "select p_partkey as record_id, case p_partkey % 3 when 0 then 'PROCESSADOR' when 1 then 'MONITOR' end as category, p_size from part")
    given = F.array(*(F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in (
        ("nucleos", F.col("p_size").cast("string")), ("nucleos", F.lit("n/d")), ("tiposMemoriaSuportados", F.when(F.col("record_id") % 2 == 0, F.lit("ddr5 5600")).otherwise(F.lit("?"))),
        ("altura", F.when(F.col("record_id") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" mm")))), ("outro", F.lit("1")))))
    sheet = records.select("record_id", "category", F.inline(given))
    schema = spark.createDataFrame([("PROCESSADOR", "nucleos", "integer"), ("PROCESSADOR", "tiposMemoriaSuportados", "memory_types"), ("MONITOR", "altura", "mm")], "category string, field string, kind string")
    return sheets.payload(records, sheets.normalise(sheet, schema)).withColumn("fields", F.to_json("fields"))
