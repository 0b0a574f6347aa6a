"""Registered queries of product identity and parts of listings: hard cases by part, answers by hand, and joins with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import products
from .cases import _lit, cases
from .catalogue import query, rows

BRANDS = ["Intel", "AMD", "NVIDIA", "ASUS", "MSI", "Gigabyte", "Cooler Master", "Corsair"]

cases("inferred_identities", ["category", "name", "hint"], ["brand", "model", "key"], [
    ("PLACA_VIDEO", "GeForce RTX 4060 Graphics Card | Shop", None, "NVIDIA", "GeForce RTX 4060", "nvidia|geforcertx4060"), ("PROCESSADOR", "Intel Core i5-12400 Processor", None, "Intel", "Core i5-12400", "intel|corei512400"), ("COOLER", "Cooler Master Hyper 212", None, "Cooler Master", "Hyper 212", "coolermaster|hyper212"),
    ("PLACA_MAE", "ASUS TUF Gaming - Specifications and more", None, "ASUS", "TUF Gaming", None), ("FONTE", "Corsair RM750 PSU", "Corsair", "Corsair", "RM750", "corsair|rm750"), ("MONITOR", "XPTO 24", None, None, "XPTO 24", None), ("FONTE", "psu", None, None, "psu", None), (None, None, None, None, None, None),
], lambda category, name, hint: [(lambda x: (x["brand"], x["model"], x["key"]))(products.inferred(name, category, hint, BRANDS))[i] for i in range(3)])

cases("research_identities", ["category", "name", "hint"], ["brand", "model", "scope"], [
    ("PROCESSADOR", "AMD Ryzen 5 5600X box", None, "AMD", "Ryzen 5 5600X", "MODELO_EXATO"), ("PROCESSADOR", "Processador i5-12400F", None, "Intel", "Core i5-12400F", "MODELO_EXATO"), ("PROCESSADOR", "Intel Core Ultra 7 265K", None, "Intel", "Core Ultra 7 265K", "MODELO_EXATO"), ("PLACA_VIDEO", "GeForce RTX 4060 Ti 8GB", None, "NVIDIA", "GeForce RTX 4060 Ti", "CHIP_GRAFICO"),
    ("PLACA_VIDEO", "Sapphire RX 7900 XTX", None, "AMD", "RX 7900 XTX", "CHIP_GRAFICO"), ("PLACA_VIDEO", "RTX 4060", "ASUS", None, None, None), ("MONITOR", "RTX 4060", None, None, None, None), (None, None, None, None, None, None),
], lambda category, name, hint: [(lambda x: (x["brand"], x["model"], x["scope"]))(products.research_identity(category, name, hint))[i] for i in range(3)])

cases("text_identities", ["method", "brand", "model", "mpn", "gtin", "text"], ["named"], [
    ("GTIN", None, None, None, "4006381333931", "EAN 4006381333931.", "true"), ("GTIN", None, None, None, "4006381333931", "94006381333931", "false"), ("MARCA_MPN", "Kingston", None, "KVR32N22S8/8", None, "Kingston kvr32n22s8 8 novo", "true"), ("MARCA_MPN", "Kingston", None, "KVR32N22S8/8", None, "Kingston KVR32N22S8/8G", "false"),
    ("MARCA_MPN", "Corsair", None, "X1", None, "Kingston X1", "false"), ("MARCA_MODELO", "ASUS", "TUF B550M-PLUS", None, None, "Placa ASUS TUF B550M Plus", "true"), ("MARCA_MODELO", "Corsair", "Vengeance 32GB Kit of 2", None, None, "Corsair 32GB DDR5 Vengeance", "true"), ("MARCA_MODELO", "Corsair", "Vengeance 32GB", None, None, "Corsair Vengeance 16GB", "false"),
    ("MARCA_MODELO", "A", "Gaming Kit", None, None, "A kit", "false"), ("MARCA_MODELO", None, "RX 580", None, None, "rx-580", "true"), ("NOME", "A", "B1", None, None, "A B1", "false"), (None, None, None, None, None, None, "false"),
], lambda method, brand, model, mpn, gtin, text: [products.text_names(method, brand, model, mpn, gtin, text)])

_struct = lambda names, cs: F.struct(*(c.alias(n) for n, c in zip(names, cs, strict=True)))
cases("page_identities", ["method", "brand", "model", "mpn", "title", "page_mpn", "text"], ["fits"], [
    ("MARCA_MODELO", "ASUS", "RTX 4060 Dual", None, "ASUS Dual RTX 4060", None, "", "true"), ("MARCA_MODELO", "ASUS", "RTX 4060 Dual", None, "ASUS Dual RTX 4060 Ti", None, "", "false"), ("MARCA_MODELO", "ASUS", "B550M WiFi", None, "ASUS B550M WiFi", None, "", "true"), ("MARCA_MODELO", "ASUS", "B550M WiFi", None, "ASUS B550M Wi-Fi", None, "", "false"), ("MARCA_MODELO", "ASUS", "B550M WiFi", None, "ASUS B550M", None, "", "false"),
    ("MARCA_MODELO", "G", "F5 2x16GB", None, "G F5 Kit 2", None, "", "false"), ("MARCA_MPN", "K", "M", "AB1", "other title", "ab-1", "", "true"), ("MARCA_MPN", "K", "M", "AB1", "x", "AB2", "K AB1", "false"), ("MARCA_MPN", "K", None, "AB1", "x", None, "K AB1", "true"), ("MARCA_MPN", "K", None, "AB1", None, None, "K AB12", "false"), (None, None, None, None, None, None, None, "false"),
], lambda method, brand, model, mpn, title, page_mpn, text: [products.page_fits(
    _struct(("method", "brand", "model", "mpn", "gtin"), (method, brand, model, mpn, F.lit(None).cast("string"))), _struct(("brand", "title", "model", "mpn", "gtin"), (F.lit(None).cast("string"), title, F.lit(None).cast("string"), page_mpn, F.lit(None).cast("string"))), text)])

cases("identical_offers", ["name", "brand", "model", "mpn", "gtin", "title", "o_model", "o_mpn", "o_gtin"], ["by"], [
    ("Mouse G502", "Logitech", "G502", None, "4006381333931", "Mouse x", None, None, "4006381333931", "GTIN"), ("Mouse G502", "Logitech", "G502", None, "4006381333931", "Mouse Logitech G502", None, None, "4006381333932", None), ("Mouse G502", "Logitech", "G502", "910-005469", None, "Mouse Logitech", None, "910005469", None, "MPN_MARCA"),
    ("Mouse G502", "Logitech", "G502", "910-005469", None, "Mouse", None, "910005469", None, None), ("Mouse G502", "Logitech", "G502", None, None, "Mouse Gamer Logitech G502 Hero", None, None, None, "MARCA_MODELO"), ("Mouse G502", "Logitech", "G502", None, None, "Mouse Gamer Logitech G502 Lite", None, None, None, None),
    ("Mouse G502", "Logitech", "G502", None, None, "Mouse Logitech", "G-502", None, None, "MARCA_MODELO"), ("Mouse G502", "Logitech", "G502", None, None, "Mouse Logitech G502", "G503", None, None, None), ("Mouse G502", "Logitech", "G502", None, None, "Cabo para mouse Logitech G502", None, None, None, None),
    ("Mouse G502", "Logitech", "G502", "910-005469", None, "Mouse Logitech 910-005469", None, None, None, "MPN_MARCA_TITULO"), ("Mouse G502", None, "G502", None, "40063813", "Mouse 40063813", None, None, None, "GTIN_TITULO"), ("Mouse X", "L", "X1", None, None, "Mouse L X1", None, None, None, None), ("x", None, None, None, None, None, None, None, None, None),
], lambda name, brand, model, mpn, gtin, title, o_model, o_mpn, o_gtin: [products.identical(
    _struct(("name", "brand", "model", "mpn", "gtin"), (name, brand, model, mpn, gtin)), _struct(("title", "brand", "model", "mpn", "gtin"), (title, F.lit(None).cast("string"), o_model, o_mpn, o_gtin)))])

cases("listing_types", ["title", "description", "parts"], ["type"], [
    ("Kit upgrade Ryzen 5", None, "PROCESSADOR,PLACA_MAE,GABINETE", "KIT_UPGRADE"), ("PC Gamer completo", "", "PROCESSADOR", "PC_MONTADO"), ("Computador", "i5", "PROCESSADOR", "HARDWARE_INDIVIDUAL"), ("Computador", "x", "PROCESSADOR,FONTE", "PC_MONTADO"), ("PC Gamer", "sem gabinete", "PROCESSADOR,PLACA_MAE,MEMORIA_RAM", "KIT_UPGRADE"),
    ("Conjunto", None, "PROCESSADOR,PLACA_MAE,GABINETE,FONTE", "PC_MONTADO"), ("Conjunto", None, "PROCESSADOR,PLACA_MAE,FONTE", "INDEFINIDO"), ("Mouse", None, "", "HARDWARE_INDIVIDUAL"), (None, None, "MEMORIA_RAM,FONTE", "INDEFINIDO"),
], lambda title, description, parts: [products.listing_type(title, description, F.filter(F.split(parts, ","), lambda p: p != ""))])

LISTINGS = [
    ("PC Ryzen 5 5600", "Processador Ryzen 5, placa-mãe B550M\nMemória RAM 16GB; SSD 480GB", ["PROCESSADOR=Processador Ryzen 5/PC Ryzen 5 5600", "PLACA_MAE=placa-mãe B550M", "MEMORIA_RAM=Memória RAM 16GB", "ARMAZENAMENTO=SSD 480GB"]),
    ("SSD Kingston A400", "SSD Kingston A400", ["ARMAZENAMENTO=SSD Kingston A400"]), ("Mouse", None, []), (None, "fonte 500W | gabinete | fonte 500W", ["FONTE=fonte 500W", "GABINETE=gabinete"]),
]


@query("listing_parts", f"select p_partkey as record_id, unnest(string_split((list_value({', '.join(_lit(';'.join(x[2])) for x in LISTINGS)}))[(p_partkey % {len(LISTINGS)} + 1)::integer], ';')) as found from part where p_partkey % {len(LISTINGS)} <> 2")
def _(spark, sf_dir):
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]).cast("string") for x in LISTINGS)), (F.col("record_id") % len(LISTINGS) + 1).cast("int"))
    found = products.parts_named(rows(spark, sf_dir, "select p_partkey as record_id from part").withColumns({"title": pick(0), "description": pick(1)}))
    return found.select("record_id", F.concat("category", F.lit("="), F.array_join("passages", "/")).alias("found"))


@query("source_order", """with a as (select l_orderkey as record_id, 'C' || (l_orderkey % 4) as category, 'f' || l_linenumber as field from lineitem),
h as (select 'C' || (n_nationkey % 4) as category, 'f' || (n_nationkey % 5) as field, n_nationkey as pos, 'S' || (n_nationkey % 6) as source from nation), b as (select 'C' || (r % 3) as category, r as pos, case r % 4 when 3 then 'PC_KOMBO' else 'S' || (r % 9) end as source from range(12) t(r)),
k as (select distinct record_id, category from a),
u as (select a.record_id, source, 1 as tier, pos from a join h using (category, field) union all select record_id, source, case source when 'PC_KOMBO' then 3 else 2 end, pos from k join b using (category) union all select record_id, 'FABRICANTE_OFICIAL', 0, 0 from k),
m as (select record_id, source, min(tier * 1000 + pos) as place from u group by 1, 2) select record_id, source, row_number() over (partition by record_id order by place, source)::integer as pos from m""")
def _(spark, sf_dir):
    asked = rows(spark, sf_dir, "select l_orderkey as record_id, concat('C', cast(l_orderkey % 4 as string)) as category, concat('f', cast(l_linenumber as string)) as field from lineitem")
    hints = rows(spark, sf_dir, "select concat('C', cast(n_nationkey % 4 as string)) as category, concat('f', cast(n_nationkey % 5 as string)) as field, n_nationkey as pos, concat('S', cast(n_nationkey % 6 as string)) as source from nation")
    base = spark.range(12).select(F.concat(F.lit("C"), F.col("id") % 3).alias("category"), F.col("id").alias("pos"), F.when(F.col("id") % 4 == 3, "PC_KOMBO").otherwise(F.concat(F.lit("S"), F.col("id") % 9)).alias("source"))
    return products.source_order(asked, hints, base)
