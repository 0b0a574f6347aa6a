"""Registered queries of arriving records: known items, captures that complete analyses, seeds of parts, memory rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrivals, products
from .catalogue import query, rows

# Arrivals: each line is one, told by GTIN, part number or model of its part, or by nothing that is known.
_BY = "l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as row_id, l_partkey as k, (l_orderkey + l_linenumber) % 5 as how"
_ITEM = "concat('Brand ', cast({k} % 5 as varchar(5))) as brand, concat('Mx', cast({k} as varchar(20)), 'z') as model, concat('P-', cast({k} as varchar(20)), '-Q') as mpn, concat('789', lpad(cast({k} as varchar(20)), 10, '0')) as gtin"


@query("preflight", f"""
with a as (select distinct {_BY} from lineitem), p as (select p_partkey as k, p_partkey % 3 = 0 as product, p_partkey % 3 = 1 or p_partkey % 6 = 0 as part from part)
select row_id, case when how < 3 and (product or part) then 'OFFER_ONLY' else 'FULL' end as route, case when how < 3 then case when product then 'PRODUTO' when part then 'HARDWARE' end end as kind,
  case when how < 3 and (product or part) then k end as item_id, case when how < 3 and (product or part) then case how when 0 then 'GTIN' when 1 then 'MPN' else 'MARCA_MODELO' end end as "by" from a left join p using (k)""")
def _(spark, sf_dir):
    a = rows(spark, sf_dir, f"select distinct {_BY} from lineitem")
    k, how = F.col("k").cast("string"), F.col("how")
    told = a.select(
        "row_id", F.when(how.isin(1, 2), F.concat(F.lit("BRAND  "), F.col("k") % 5)).alias("brand"), F.when(how == 2, F.concat(F.lit("mx-"), k, F.lit("Z"))).when(how == 4, k).alias("model"), F.when(how == 1, F.concat(F.lit("p"), k, F.lit("q"))).alias("mpn"),
        F.when(how == 0, F.concat(F.lit("789 "), F.lpad(k, 10, "0"))).when(how == 3, "0000000000000").alias("gtin"),
    )
    item = f"select p_partkey as id, {_ITEM.format(k='p_partkey')} from part"
    registered = rows(spark, sf_dir, item + " where p_partkey % 3 = 0")  # every third part is a product, every third another part of the catalogue
    return arrivals.preflight(told, registered, rows(spark, sf_dir, item + " where p_partkey % 3 = 1 or p_partkey % 6 = 0"))


# Analyses and captures of each part; a value's digit says whose it is.
_R = "select p_partkey as record_id, part, field, case when (p_partkey + n) % 3 = 0 then ' ' else concat('r', cast(n as varchar(5))) end as value from part cross join (select 'root' as part, 'nome' as field, 1 as n union all select 'root', 'marca', 2 union all select 'spec', 'a', 3 union all select 'spec', 'b', 4 union all select 'offer', 'preco', 5) f"
_L = "select p_partkey as record_id, part, field, case when (p_partkey + n) % 4 = 0 then null else concat('l', cast(n as varchar(5))) end as value from part cross join (select 'root' as part, 'nome' as field, 1 as n union all select 'root', 'gtin', 2 union all select 'spec', 'b', 3 union all select 'spec', 'c', 4 union all select 'offer', 'preco', 5) f"
_A = "select p_partkey as record_id, case when p_partkey % 5 = 0 then 'mouse' when p_partkey % 5 = 1 then 'FONTE' when p_partkey % 5 = 2 then null else 'MOUSE' end as category, case when p_partkey % 7 = 0 then 'MOUSE' end as forced from part"
_C = "select p_partkey as record_id, case when p_partkey % 8 = 0 then 'https://other.example/x' else 'https://www.amazon.com.br/dp/B0ABCDEF12' end as url, case when p_partkey % 9 = 0 then 'Mouse' when p_partkey % 2 = 0 then 'Mousepad gamer grande' else 'Mouse sem fio preto' end as page_name, p_partkey % 2 as n_attributes from part"


@query("hydrated_analyses", f"""
with a as (select record_id, upper(category) as had, forced from ({_A})), c as (select * from ({_C}) where url like '%amazon%' and length(page_name) >= 8), r as (select record_id, part, field, value as r from ({_R}) where trim(value) <> ''), l as (select record_id, part, field, value as l from ({_L}) where trim(value) <> ''),
w as (select record_id, bool_or(part = 'root' and field = 'nome') as named, bool_or(part = 'spec') as specified from r group by 1),
x as (select a.*, page_name, n_attributes, case when page_name like 'Mousepad%' and had = 'MOUSE' and forced is null then 'MOUSEPAD' end as corrected, case when page_name like 'Mousepad%' then 'MOUSEPAD' when page_name is not null then 'MOUSE' end as by_page, coalesce(named, false) as named, coalesce(specified, false) as specified from a left join c using (record_id) left join w using (record_id)),
y as (select *, coalesce(forced, corrected, had, by_page) as own from x), h as (select record_id, had, own, page_name is not null and own in ('MOUSE', 'MOUSEPAD') and not (coalesce(had in ('MOUSE', 'MOUSEPAD'), false) and named and specified and n_attributes = 0 and corrected is null) as takes from y),
j as (select coalesce(r.record_id, l.record_id) as record_id, coalesce(r.part, l.part) as part, coalesce(r.field, l.field) as field, r, l from r full join l using (record_id, part, field)),
k as (select record_id, case when takes then own else had end as category, part, field, case when takes then l end as lv, case when part = 'offer' or not takes or had is not distinct from own then r end as rv from j join h using (record_id))
select record_id, category, part, field, case when part = 'offer' then coalesce(lv, rv) else coalesce(rv, lv) end as value, case when lv is not null and (part = 'offer' or rv is null) then 'LOCAL' else 'REMOTE' end as origin from k where lv is not null or rv is not null""")
def _(spark, sf_dir):
    schemas = spark.createDataFrame([("MOUSE",), ("MOUSEPAD",)], "category string")
    a, r, c, l = (rows(spark, sf_dir, t) for t in (_A, _R, _C, _L))  # noqa: E741
    return arrivals.hydrated(a, r, c, l, schemas)


@query("component_seeds", """
with p as (select *, p_partkey % 8 as how from part)
select p_partkey as record_id, case when how in (0, 1, 2, 3) then 'PROCESSADOR' else 'PLACA_MAE' end as category, case how when 0 then 'item ' || p_partkey when 1 then 'AMD Ryzen 5 ' || (5000 + p_size) else 'ASUS TUF B550M-' || p_partkey end as name,
  case how when 0 then 'B' when 4 then 'ASUS' else 'AMD' end as brand, case how when 0 then 'M' when 1 then 'Ryzen 5 ' || (5000 + p_size) else 'TUF B550M-' || p_partkey end as model from p where how in (0, 1, 4)""")
def _(spark, sf_dir):
    parts, how, k = rows(spark, sf_dir, "select * from part"), F.col("p_partkey") % 8, F.col("p_partkey")
    cpu = F.concat(F.lit("Processador AMD Ryzen 5 "), F.lit(5000) + F.col("p_size"))
    board = F.concat(F.lit("Placa-mãe: ASUS TUF B550M-"), k)
    told = (
        F.when(how == 0, F.concat(cpu)).when(how == 1, F.concat(cpu, F.lit("\n"), cpu)).when(how == 2, F.concat(cpu, F.lit("\nProcessador AMD Ryzen 7 7700"))).when(how == 3, F.concat(cpu, F.lit(" ou similar")))
        .when(how == 4, board).when(how == 5, F.concat(board, F.lit(" e memória RAM DDR4"))).when(how == 6, F.lit("Placa-mãe: ASUS B550M")).otherwise(F.lit("Placa-mãe boa"))
    )
    wanted = F.when(how <= 3, "PROCESSADOR").otherwise("PLACA_MAE")
    named = products.parts_named(parts.select(k.alias("record_id"), F.lit(None).cast("string").alias("title"), told.alias("description")))
    named = named.join(parts.select(k.alias("record_id"), wanted.alias("category"), F.when(how == 0, k).alias("hardware_id")).hint("merge"), ["record_id", "category"])
    catalogue = parts.select(k.alias("hardware_id"), F.concat(F.lit("item "), k).alias("name"), F.lit("B").alias("brand"), F.lit("M").alias("model"))
    return arrivals.component_seeds(named, catalogue, ["AMD", "Intel", "ASUS", "MSI"])


@query("labelled_memory", """
select p_partkey as record_id, 'Size=' || p_size || case p_partkey % 4 when 0 then '|ddr5 - ' || (4000 + p_size) || '=x|DDR4-3200=y|Memory Types=DDR5-' || (4000 + p_size) when 1 then '|Memory type=z|DDR4-3200=y' when 2 then '|DDR4-3200 x=y' else '' end as attributes from part""")
def _(spark, sf_dir):
    pair = lambda n, v: F.struct((F.lit(n) if isinstance(n, str) else n).alias("name"), (F.lit(v) if isinstance(v, str) else v.cast("string")).alias("value"))
    how, size = F.col("p_partkey") % 4, pair("Size", F.col("p_size"))
    rate = F.concat(F.lit("ddr5 - "), F.lit(4000) + F.col("p_size"))
    listed = F.when(how == 0, F.array(size, pair(rate, "x"), pair("DDR4-3200", "y"))).when(how == 1, F.array(size, pair("Memory type", "z"), pair("DDR4-3200", "y"))).when(how == 2, F.array(size, pair("DDR4-3200 x", "y"))).otherwise(F.array(size))
    told = F.array_join(F.transform(arrivals.labelled_memory(listed), lambda a: F.concat_ws("=", a["name"], a["value"])), "|")
    return rows(spark, sf_dir, "select * from part").select(F.col("p_partkey").alias("record_id"), told.alias("attributes"))
