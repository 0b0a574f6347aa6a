"""Registered queries of the joins on names, of nested sheets and of the quality gate: catalogues, offers and claims come from `part`, `lineitem` and `orders`."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from ..operators import cross, gate, nested, products, usage
from .catalogue import query, rows

# Listings: of each part one that names it in one of six ways. Every tenth part stands in the catalogue twice.
_KINDS = ("PROCESSADOR", "PLACA_MAE", "MEMORIA_RAM", "PLACA_VIDEO")
_KIND = "case p_partkey % 4 when 0 then 'PROCESSADOR' when 1 then 'PLACA_MAE' when 2 then 'MEMORIA_RAM' else 'PLACA_VIDEO' end"
_WORD = "case p_partkey % 4 when 0 then 'Processador' when 1 then 'Placa-mãe' when 2 then 'Memória RAM' else 'Placa de vídeo' end"
_MODEL = "concat('Mx', cast(p_size as varchar(20)), ' ', cast(p_partkey as varchar(20)), 'Z')"
_TWIN = 10_000_000_000


@query("listing_components", f"""
with p as (select p_partkey as k, {_KIND} as category, p_partkey % 6 as how, p_partkey % 4 = 0 as cpu, p_partkey % 10 = 0 as twice from part),
f as (select *, how in (0, 1) or (cpu and how in (2, 3)) as found from p)
select k as record_id, category, case when found and not twice then k end as hardware_id, case when found and twice then k || ',' || (k + {_TWIN}) else '' end as candidates, how = 5 or (found and twice) as review from f""")
def _(spark, sf_dir):
    told = f"""case p_partkey % 6 when 0 then concat(p_brand, ' ', {_MODEL}) when 1 then concat(p_brand, ' linha nova ', {_MODEL}) when 2 then concat(p_brand, ' linha nova preta ', {_MODEL}) when 3 then {_MODEL}
      when 4 then concat(p_brand, ' ', {_MODEL}, ' Ti') else concat(p_brand, ' ', {_MODEL}, ' ou similar') end"""
    listings = rows(spark, sf_dir, f"select p_partkey as record_id, cast(null as string) as title, concat('Oferta\n', {_WORD}, ' ', {told}, ' | a vista') as description from part")
    catalogue = rows(spark, sf_dir, f"select p_partkey as hardware_id, {_KIND} as category, p_brand as brand, {_MODEL} as model from part")
    twins = catalogue.where("hardware_id % 10 = 0").withColumn("hardware_id", F.col("hardware_id") + _TWIN)
    found = cross.catalogue_parts(products.parts_named(listings), catalogue.union(twins))
    return found.withColumn("candidates", F.array_join("candidates", ","))


# Offers: of each part and supplier one, in one of six forms; its price is the least of its lines, and what came back is not on sale.
_WANTED = "select p_partkey as product_id, concat(p_brand, ' ', p_name, ' K', cast(p_partkey as varchar(20)), 'x') as name, p_brand as brand, concat('K', cast(p_partkey as varchar(20)), 'x') as model, concat('P-', cast(p_partkey as varchar(20)), '-Q') as mpn, concat('789', lpad(cast(p_partkey as varchar(20)), 10, '0')) as gtin from part"
_LINES = "select l_partkey as k, l_suppkey as s, min(l_extendedprice / l_quantity) as price, max(l_extendedprice / l_quantity) as previous_price, min(case when l_returnflag = 'R' then 0 else 1 end) as free from lineitem group by l_partkey, l_suppkey"
# The same of what is on sale, with the lines dealt by part once, which is how both the grouping and the join with parts want them; lines that came back need no price.
_DEALT = "select k, s, min(price) as price, max(price) as previous_price, min(free) as free from (select l_partkey as k, l_suppkey as s, case when l_returnflag = 'R' then null else l_extendedprice / l_quantity end as price, case when l_returnflag = 'R' then 0 else 1 end as free from lineitem distribute by k) group by k, s"


def _offers(spark, sf_dir):
    o = rows(spark, sf_dir, f"select /*+ merge(w) */ *, (k + s) % 6 as form from ({_DEALT}) join ({_WANTED}) w on product_id = k", sys.maxsize)
    form = F.col("form")
    title = F.when(form == 3, F.col("name")).when(form == 4, F.concat_ws(" ", "brand", "model", F.lit("pro"))).when(form == 5, F.concat(F.lit("Item "), F.col("gtin"))).when(form == 1, F.col("name")).otherwise(F.lit("Oferta"))
    return o.select(
        (F.col("k") * 1_000_000 + F.col("s")).alias("offer_id"), (F.col("s") % 5).alias("store"), F.concat(F.lit("https://x.example/"), F.col("k"), F.lit("/"), F.col("s")).alias("url"), title.alias("title"),
        F.when(form == 2, F.col("brand")).alias("brand"), F.lit(None).cast("string").alias("model"), F.when(form == 2, F.replace(F.lower("mpn"), F.lit("-"), F.lit(" "))).alias("mpn"),
        F.when(form == 0, F.col("gtin")).when(form == 1, "7899999999999").alias("gtin"), "price", "previous_price", F.lit("BRL").alias("currency"), (F.col("free") == 1).alias("available"),
    )


@query("identical_across_stores", f"""
with o as (select k as product_id, k * 1000000 + s as offer_id, s % 5 as store, price, previous_price, case (k + s) % 6 when 0 then 'GTIN' when 2 then 'MPN_MARCA' when 3 then case when length('k' || k || 'x') >= 4 then 'MARCA_MODELO' end when 5 then 'GTIN_TITULO' end as by_what from ({_LINES}) where free = 1 and k in (select p_partkey from part))
select product_id, store, place::integer as place, offer_id, by_what as "by", price, previous_price > price as promotion
from (select *, row_number() over (partition by product_id, store order by price, offer_id) as place from o where by_what is not null) where place <= 3""")
def _(spark, sf_dir):
    return cross.store_offers(rows(spark, sf_dir, _WANTED), _offers(spark, sf_dir))


# Nested sheets: a stored one and an incoming one of each part, three levels deep.
_STORED = """concat('{"name":"', p_name, '","spec":{"size":', cast(p_size as varchar(20)), ',"tags":["a"],"deep":{"x":null,"y":"Y"}},"id":1,"brand":""}')"""
_INCOMING = """concat('{"name":"', upper(p_name), '","brand":"', p_brand, '","spec":{"size":', cast(p_size + p_partkey % 2 as varchar(20)), ',"tags":["a","b"],"deep":{"x":"', p_type, '","z":{"w":1}}},"extra":{"k":[1,2]}}')"""


@query("merge_nested", """
select p_partkey as record_id, case when p_partkey % 7 = 0 then '{"name":"' || upper(p_name) || '","brand":"' || p_brand || '","spec":{"size":' || (p_size + p_partkey % 2) || ',"tags":["a","b"],"deep":{"x":"' || p_type || '","z":{"w":1}}},"extra":{"k":[1,2]}}'
  else '{"name":"' || p_name || '","spec":{"size":' || p_size || ',"tags":["a"],"deep":{"y":"Y","x":"' || p_type || '","z":{"w":1}}},"brand":"' || p_brand || '","extra":{"k":[1,2]}}' end as merged,
  case when p_partkey % 7 = 0 then 'brand,extra,name,spec' else 'brand,extra,spec.deep.x,spec.deep.z' end as filled,
  case when p_partkey % 7 = 0 then '' else case when p_partkey % 2 = 1 then 'spec.size:' || p_size || '/' || (p_size + 1) || ';' else '' end || 'spec.tags:["a"]/["a","b"]' end as conflicts from part""")
def _(spark, sf_dir):
    plain = lambda sql: sql.replace("{", "{{").replace("}", "}}")
    stored = rows(spark, sf_dir, f"select p_partkey as record_id, case when p_partkey % 7 = 0 then null else {plain(_STORED)} end as sheet from part")
    found = nested.merge_nested(stored, rows(spark, sf_dir, f"select p_partkey as record_id, {plain(_INCOMING)} as sheet from part"))
    told = F.transform("conflicts", lambda c: F.concat(c["path"], F.lit(":"), c["stored"], F.lit("/"), c["found"]))
    return found.select("record_id", "merged", F.array_join("filled", ",").alias("filled"), F.array_join(told, ";").alias("conflicts"))


# The gate: orders are records, their lines fields; one category in four has no schema.
_G = {
    "records": "select o_orderkey as record_id, concat('C', cast(o_orderkey % 4 as varchar(5))) as category, case when o_orderkey % 11 = 0 then 1 else 0 end as n_issues from orders",
    "schema": "select concat('C', cast(n_nationkey % 3 as varchar(5))) as category, concat('f', cast(cast(floor(n_nationkey / 3) as int) + 1 as varchar(5))) as field, n_nationkey as pos, 1 + (n_nationkey * 5) % 3 as weight, n_nationkey % 7 = 0 as required from nation where n_nationkey < 21",
    "values": "select l_orderkey as record_id, concat('f', cast(l_linenumber as varchar(5))) as field, max(case when l_tax > 0.06 then 'v' end) as original, max(case when l_discount >= 0.01 then 'v' end) as final from lineitem group by 1, 2",
    "scores": "select l_orderkey as record_id, concat('f', cast(l_linenumber as varchar(5))) as field, l_quantity / 50 as score from lineitem where l_returnflag <> 'A'",
    "confirmations": "select l_orderkey as record_id, concat('f', cast(l_linenumber as varchar(5))) as field, 0.5 + l_quantity / 100 as score from lineitem where l_linestatus = 'F' and l_returnflag <> 'N'",
    "conflicts": "select l_orderkey as record_id, concat('f', cast(l_linenumber as varchar(5))) as field, l_quantity < 2 as verified from lineitem where l_quantity < 6",
}


@query("quality_gate", f"""
with s as ({_G["schema"]}), r as ({_G["records"]}), keys as (select record_id, field from ({_G["values"]}) union select record_id, field from r join s using (category)),
v as ({_G["values"]}), sc as (select record_id, field, max(score) as score from ({_G["scores"]}) group by 1, 2), co as (select record_id, field, max(score) as confirmed from ({_G["confirmations"]}) group by 1, 2),
cf as (select record_id, field, count(*) filter (where not verified) as disputed, count(*) filter (where verified) as verified from ({_G["conflicts"]}) group by 1, 2),
e as (select k.record_id, k.field, s.pos, s.weight, s.required, coalesce(v.original, '') <> '' as own, coalesce(v.final, '') <> '' as has, score, confirmed, coalesce(disputed, 0) as disputed, coalesce(verified, 0) as verified
      from keys k join r using (record_id) left join (select category as c_, field as f_, pos, weight, required from s) s on s.c_ = r.category and s.f_ = k.field left join v using (record_id, field) left join sc using (record_id, field) left join co using (record_id, field) left join cf using (record_id, field)),
f as (select *, coalesce(weight = 3, false) as essential, not own and coalesce(confirmed >= 0.8, false) as closed from e),
g as (select *, (disputed > 0 and not closed) or verified > 0 as open, essential and has and not own and score is null and confirmed is null as unknown,
             essential and has and not own and not (score is null and confirmed is null) and greatest(coalesce(score, 0), coalesce(confirmed, 0)) < 0.8 as low from f),
m as (select record_id, count(*) filter (where required and not has) as lacking, count(*) filter (where essential and not has) as absent, count(*) filter (where unknown) as unknown, count(*) filter (where low) as low, count(*) filter (where open) as open,
             coalesce(sum(case when has then weight end), 0) as got, coalesce(sum(weight), 0) as of_, coalesce(sum(disputed) filter (where closed), 0) as resolved, string_agg(field, ',' order by pos) filter (where essential and (not has or unknown or low or open)) as review from g group by 1),
j as (select r.record_id, n_issues, coalesce(of_, 0) as of_, coalesce(resolved, 0) as resolved, coalesce(review, '') as review, case when of_ > 0 then round(got / of_, 4) else 0 end as coverage, lacking > 0 as lacks,
             [case when n_issues > 0 then 'PAYLOAD_INVALIDO_PARA_CADASTRO' end, case when lacking > 0 then 'CAMPOS_OBRIGATORIOS_AUSENTES' end, case when absent > 0 then 'CAMPOS_ESSENCIAIS_AUSENTES' end, case when unknown > 0 then 'CAMPOS_ESSENCIAIS_SEM_PROVENIENCIA' end,
              case when low > 0 then 'CAMPOS_ESSENCIAIS_COM_CONFIANCA_BAIXA' end, case when open > 0 then 'CONFLITOS_NAO_RESOLVIDOS' end, case when coalesce(got / nullif(of_, 0), 0) < 0.8 then 'COBERTURA_TECNICA_INSUFICIENTE' end] as held from r left join m using (record_id)),
k as (select *, array_to_string(list_filter(held, lambda x: x is not null), ',') as reasons from j),
z as (select *, case when of_ = 0 then 'SEM_SCHEMA' when n_issues > 0 or lacks then 'BLOQUEADO_POR_PAYLOAD' when reasons <> '' then 'PRECISA_REVISAO' else 'APROVADO' end as status from k)
select record_id, status, status = 'APROVADO' as ready, coverage, case when of_ = 0 then 'CATEGORIA_SEM_SCHEMA_TECNICO' else reasons end as reasons, case when of_ = 0 then '' else review end as review, (case when of_ = 0 then 0 else resolved end)::bigint as resolved from z""")
def _(spark, sf_dir):
    given = {name: rows(spark, sf_dir, sql) for name, sql in _G.items()}
    found = gate.quality_gate(given["records"], given["schema"], given["values"], given["scores"], given["confirmations"], given["conflicts"])
    return found.withColumns({c: F.array_join(c, ",") for c in ("reasons", "review")})


# A cache in front of searches: purchases store what they found (nothing, of even values), other events look up; a key is a user.
_CACHED = "select cast(user_id as varchar(20)) as cache_key, event_id, ts, case when event_type = 'purchase' then 'STORE' else 'LOOKUP' end as kind, case when event_type = 'purchase' and cast(floor(value) as int) % 2 = 1 then cast(value as varchar(30)) end as payload from events"


@query("cache_answers", f"""
with e as ({_CACHED}), s as (select l.cache_key, l.event_id, l.ts, max(struct_pack(ts := s.ts, id := s.event_id)) as at from e l left join e s on s.cache_key = l.cache_key and s.kind = 'STORE' and (s.ts < l.ts or (s.ts = l.ts and s.event_id < l.event_id)) where l.kind = 'LOOKUP' group by all),
j as (select s.*, e.payload as p, epoch(s.ts) - epoch(e.ts) <= case when e.payload is null then 30 else 1800 end as known from s left join e on e.event_id = s.at.id and s.at.id is not null)
select cache_key, event_id, case when known and p is not null then 'HIT' when known then 'NOTHING' else 'MISS' end as outcome, case when known then p end as payload from j""")
def _(spark, sf_dir):
    return usage.cache_answers(rows(spark, sf_dir, _CACHED)).drop("ts")
