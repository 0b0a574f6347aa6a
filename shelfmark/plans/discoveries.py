"""Registered queries of discovery: searches are orders, what they found are their lines, candidates and references come from `part`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answered, discovery
from .cases import cases
from .catalogue import dealt, query, rows

cases("bare_values", ["text"], ["value"], [
    ("1.11 ([asrock.com](https://www.asrock.com/x?a=1))", "1.11"), ("1.11 [asrock.com](https://www.asrock.com/)", "1.11"), ("1.11 (https://www.asrock.com/a)", "1.11"), ("1.11 【fonte】", "1.11"), ("AM5 - https://a.example/b 【1】 【2】", "AM5"),
    ("HDMI (2.1)", "HDMI (2.1)"), ("a, b", "a, b"), ("2x DDR5 | https://x.example", "2x DDR5"), ("https://x.example/only", ""), ("see https://x.example then", "see https://x.example then"), ("", ""), (None, None),
], lambda text: [discovery.bare_value(text)])


# Result pages: a keyword is a kind of part, its pages hold the parts of that kind in turn; each customer searches for one.
_WORDS = ("gpu", "RTX", "Radeon RX", "fonte ATX", "mouse", "monitor gamer")


@query("expanded_search")  # no SQL: a walk that stops where pages bring nothing new, and a relevance of some 40 patterns; tested against a plain walk
def _(spark, sf_dir):
    word = F.array(*map(F.lit, _WORDS))
    parts = rows(spark, sf_dir, "select p_partkey as k, p_size, p_brand from part")
    placed = parts.select("k", "p_size", "p_brand", (F.col("k") % len(_WORDS)).alias("w"), F.floor(F.col("k") / 50).alias("shelf"))
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Placa de video RTX 4060", "Placa de video RTX 4060", "Placa de video Radeon RX 6600", "Fonte ATX 500W", "Mouse sem fio", "Suporte de monitor gamer"))), F.col("w").cast("int") + 1), F.lit(" "), "p_brand")
    item = F.struct((F.col("k") % 7).alias("shop_id"), (F.col("k") - F.col("k") % 2).alias("item_id"), F.lit(None).cast("string").alias("url"), name.alias("name"), F.col("p_size").alias("sales"), (F.col("p_size") % 5).alias("rating"), (F.col("p_size") * 1.0).alias("discount"), (F.col("k") % 3 == 0).alias("promo"))
    pages = placed.select(F.get(word, F.col("w").cast("int")).alias("keyword"), (F.col("shelf") + 1).alias("page"), "k", item.alias("item")).groupBy("keyword", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda x: x["item"]).alias("items"))  # 50 parts a shelf
    searches = rows(spark, sf_dir, "select c_custkey as query_id from customer").select("query_id", F.get(word, (F.col("query_id") % len(_WORDS)).cast("int")).alias("query"), (5 + F.col("query_id") % 30).alias("most"), (F.col("query_id") % 4 == 0).alias("promotions_only"))
    found = discovery.expanded_search(searches, pages.withColumn("has_next", F.lit(True)))
    return found.select("query_id", "place", "score", "shop_id", "item_id", "name")


@query("reference_specs", """
with p as (select *, p_partkey % 4 as how, 3000 + p_size as chip, p_partkey % 4 in (0, 1) as hit from part), n as (select chip, min(p_partkey::varchar) as k from p where how = 0 group by 1),
u as (select p.*, n.k as ref from p left join n on n.chip = p.chip and p.hit)
select p_partkey as candidate_id, 'bits=' || case when ref is null then '' else '128' end || '|size=' || p_size || case when ref is null then '' else '|tdp=' || (p_size * 10) end as specs,
  case when ref is null then 'OWN:u' else 'OWN:u|CATALOGO_REFERENCIA:https://r.example/' || ref end as sources from u""")
def _(spark, sf_dir):
    parts, k = rows(spark, sf_dir, "select * from part"), F.col("p_partkey")
    number = (F.lit(3000) + F.col("p_size")).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("ASUS Dual RTX"), number, F.lit("TI-O8G"))).when(k % 4 == 1, F.concat(F.lit("Placa GeForce RTX "), number, F.lit(" Ti"))).when(k % 4 == 2, F.concat(F.lit("RTX "), number)).otherwise(F.col("p_name"))
    text = lambda c: F.lit(c) if isinstance(c, str) else c.cast("string")
    candidates = parts.select(k.alias("candidate_id"), name.alias("name"), F.create_map(F.lit("size"), text(F.col("p_size")), F.lit("bits"), text("")).alias("specs"), F.array(F.struct(F.lit("OWN").alias("source"), F.lit("u").alias("url"))).alias("sources"))
    refs = parts.where(k % 4 == 0).select(F.concat(F.lit("GeForce RTX "), number, F.lit(" Ti #"), k).alias("name"), F.concat(F.lit("https://r.example/"), k).alias("url"), F.create_map(F.lit("bits"), text("128"), F.lit("tdp"), text(F.col("p_size") * 10), F.lit("size"), text("0")).alias("specs"))
    found = discovery.with_reference(candidates, refs)
    told = F.array_join(F.transform(F.array_sort(F.map_entries("specs")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return found.select("candidate_id", told.alias("specs"), F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["url"])), "|").alias("sources"))


# Missing fields: the lines of an order; of the fields, some have two terms, some share one, some have none.
_MISSING = "select l_orderkey as record_id, l_linenumber * 1000000 + l_partkey as pos, concat('field', cast(l_partkey % 7 as varchar(5)), 'MaxGb') as field from lineitem"
_TERMS = "select concat('C', cast(n_nationkey % 3 as varchar(5))) as category, concat('field', cast(cast(floor(n_nationkey / 6) as int) as varchar(5)), 'MaxGb') as field, n_nationkey as pos, concat(case when n_nationkey % 2 = 0 then 'Term ' else 'term ' end, cast(n_nationkey % 5 as varchar(5))) as term from nation"
_BASES = "select o_orderkey as record_id, concat('c', cast(o_orderkey % 3 as varchar(5))) as category, case when o_orderkey % 13 = 0 then ' ' else concat('product ', cast(o_orderkey as varchar(20))) end as base from orders"


@query("focused_queries", f"""
with m as (select r.record_id, base, m.pos, m.field, coalesce(t.pos, -1) as nth, coalesce(t.term, regexp_replace(m.field, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) as term from ({_MISSING}) m join ({_BASES}) r using (record_id) left join ({_TERMS}) t on t.category = upper(r.category) and t.field = m.field where trim(base) <> ''),
o as (select record_id, base, lower(term) as k, min(struct_pack(p := pos, f := field, a := nth, t := term)) as f from m group by all), n as (select *, row_number() over (partition by record_id order by f.p, f.f, f.a, k) - 1 as i from o),
c as (select record_id, base, i // 4 as pos, base || ' ' || string_agg(f.t, ' ' order by i) as query from n where i < 8 group by record_id, base, i // 4)
select record_id, pos::bigint as pos, query from c union all select r.record_id, count(pos), r.base from ({_BASES}) r left join c using (record_id) where trim(r.base) <> '' group by 1, r.base""")
def _(spark, sf_dir):
    return discovery.focused_queries(rows(spark, sf_dir, _BASES), dealt(rows(spark, sf_dir, _MISSING), "record_id"), rows(spark, sf_dir, _TERMS), most=2)


# Citations: the lines of an order cite pages of suppliers; a brand is a nation, which owns two domains.
_URL = "concat(case when l_partkey % 5 = 0 then 'http' else 'https' end, '://', case when l_partkey % 7 = 0 then 'www.' when l_partkey % 7 = 1 then 'evil' when l_partkey % 7 = 2 then 'user@' else '' end, 'brand', cast(l_suppkey % 10 as varchar(5)), '.example', case when l_partkey % 11 = 0 then ':8443' else '' end, '/', cast(l_suppkey as varchar(10)))"
_CITED = f"select l_orderkey as record_id, l_linenumber * 1000000 + l_partkey as pos, {_URL} as url from lineitem"
_ASKING = "select o_orderkey as record_id, concat('Brand ', cast(o_custkey % 5 as varchar(5))) as brand, o_orderstatus <> 'P' as strong from orders"
_OWNED = "select concat('brand-', cast(n_nationkey % 5 as varchar(5))) as brand, concat('brand', cast(n_nationkey % 10 as varchar(5)), '.example') as domain from nation"
_TOLD = "select concat('https://', case when n = 7 then 'www.' else '' end, 'brand', cast(s_suppkey % 10 as varchar(5)), '.example/', cast(s_suppkey as varchar(10))) as url, concat('f', cast((s_suppkey + n) % 4 as varchar(5))) as field, case when s_suppkey % 6 = 0 then '' else concat('v', cast(s_suppkey as varchar(10))) end as value, concat('line ', cast(n as varchar(5))) as passage from supplier cross join (select 1 as n union all select 2 union all select 7)"


@query("official_evidence", f"""
with c as (select record_id, url, min(pos) as pos from ({_CITED}) c join ({_ASKING}) r using (record_id) where strong and url like 'https://%' and url not like '%@%' and url not like '%:8443%' and url not like '%evil%'
  and (regexp_extract(url, 'brand([0-9])', 1)::int) % 5 = regexp_extract(brand, '[0-9]')::int group by 1, 2), t as (select *, row_number() over (partition by record_id order by pos, url) as r from c qualify r <= 2),
j as (select * from t join ({_TOLD}) using (url) where value <> '')
select record_id, field, value, url, passage from j qualify row_number() over (partition by record_id, field order by r, passage, value) = 1""")
def _(spark, sf_dir):
    return discovery.official_evidence(*(rows(spark, sf_dir, t) for t in (_ASKING, _OWNED, _CITED, _TOLD)))


_SHEET = "select l_orderkey as record_id, concat('f', cast(l_linenumber as varchar(5))) as field, max(case when l_returnflag = 'A' then null when l_returnflag = 'N' then ' ' else concat('Value  ', cast(l_linenumber as varchar(5))) end) as value from lineitem where l_linenumber < 6 group by 1, 2"
_ANSWERS = "select l_orderkey as record_id, concat('f', cast(l_linenumber as varchar(5))) as field, max(case when l_linestatus = 'F' then concat('value ', cast(l_linenumber as varchar(5)), ' (https://x.example/a)') when l_tax > 0.04 then concat('other', cast(l_linenumber as varchar(5)), ' [x](https://x.example)') end) as value from lineitem where l_linenumber > 1 group by 1, 2"


@query("merged_answers", f"""
with j as (select coalesce(s.record_id, a.record_id) as record_id, coalesce(s.field, a.field) as field, nullif(trim(s.value), '') as v, regexp_replace(a.value, ' [\\[(].*$', '') as a from ({_SHEET}) s full join ({_ANSWERS}) a using (record_id, field))
select record_id, field, coalesce(v, a) as value, case when v is null then 'FILLED' when a like 'other%' then 'CONFLICT' else 'KEPT' end as outcome, case when v is not null and a like 'other%' then a end as answer from j where v is not null or a is not null""")
def _(spark, sf_dir):
    return discovery.merged_answers(rows(spark, sf_dir, _SHEET), rows(spark, sf_dir, _ANSWERS))


_SEARCHES = "select o_orderkey as search_id, cast(o_orderkey % 4 as int) as offset, 3 as page_size, cast(o_custkey % 12 as int) as candidates, 10 as most from orders"
_ITEMS = "select l_orderkey as search_id, l_linenumber as item_id, case when l_returnflag = 'A' then array('x', 'y') when l_returnflag = 'N' then array() end as issues from lineitem"
_SOURCES = "select l_orderkey as search_id, concat('S', cast(l_suppkey % 3 as varchar(5))) as source, l_linenumber as found, case when l_tax > 0.07 then 'TIMEOUT' when l_tax > 0.05 then 'NAO_ENCONTRADO' end as error from lineitem"


@query("discovery_roll_up", f"""
with i as (select l_orderkey as search_id, count(*) as returned, count(*) filter (where l_returnflag <> 'A') as registrable from lineitem group by 1), b as (select search_id, source, sum(found) as found, bool_or(error = 'TIMEOUT') as bad from ({_SOURCES}) group by 1, 2),
s as (select search_id, coalesce(bool_or(bad), false) as partial, string_agg(source || ':' || found::bigint, ',' order by source) as by_source from b group by 1)
select search_id, coalesce(returned, 0)::bigint as returned, coalesce(registrable, 0)::bigint as registrable, coalesce(returned - registrable, 0)::bigint as blocked, coalesce(partial, false) as partial, "offset" + 3 < candidates as has_more, candidates >= 10 as limit_met, coalesce(by_source, '') as by_source
from ({_SEARCHES.replace("as offset", 'as "offset"')}) left join i using (search_id) left join s using (search_id)""")
def _(spark, sf_dir):
    return discovery.roll_up(*(rows(spark, sf_dir, t) for t in (_SEARCHES, _ITEMS, _SOURCES)))


# Answers: of each part one, as lines, as a table, as an object, or as one inside a fence and a holder.
@query("answered_fields", """
select p_partkey as record_id, unnest(['marca', 'modelo', 'tamanhoGb']) as field, unnest([p_brand, p_name, p_size || case when p_partkey % 4 < 2 then ' GB' else '' end]) as value from part""")
def _(spark, sf_dir):
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    text = lambda *cs: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in cs))
    sheet = F.struct(brand.alias("Marca"), name.alias("MODELO"), F.col("p_size").alias("Tamanho"), F.lit("unknown").alias("Cor"), F.lit(None).cast("string").alias("x"))
    how = F.col("p_partkey") % 4
    told = (
        F.when(how == 0, text("Segue:\n1. **Marca**: ", brand, " [a](https://a.example/b)\n2) Modelo - ", name, "\n- Tamanho (GB): ", size, " GB\n* Cor: não informado\nMarca: outra"))
        .when(how == 1, text("| Campo | Valor |\n|---|:--|\n| **marca** | ", brand, " |\n| modelo | `", name, "` |\n| tamanho gb | ", size, " GB |\n| cor | - |"))
        .when(how == 2, F.to_json(sheet)).otherwise(text("```json\n", F.to_json(F.struct(F.lit("ok").alias("note"), sheet.alias("especificacoes"))), "\n```"))
    )
    aliases = spark.createDataFrame([("C", f, a) for f, names in (("marca", ("marca",)), ("modelo", ("modelo",)), ("tamanhoGb", ("tamanhoGb", "tamanho", "Tamanho (GB)")), ("cor", ("cor",))) for a in names], "category string, field string, alias string")
    responses = rows(spark, sf_dir, "select * from part").select(F.col("p_partkey").alias("record_id"), F.lit(" c").alias("category"), told.alias("response_text"))
    return answered.fields(responses, aliases)
