"""The registered queries of the product operators and their SQL.

Inputs are shaped from the given tables by plain SELECTs (`rows`), shared by query and SQL; what an operator does
with them is written twice, once as the operator and once as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import attributes, identity, listings, matching, offers, ordering, pages, planning, resolve, usage

TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|benchmark|labels|conversations"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Tables whose files are so small that few tasks would read them, though one row is many rows or much work; rows of them that a task takes.
SPREAD = {"part": "p_partkey", "customer": "c_custkey"}
ROWS_A_TASK = 10_000
#: The same where a row is a sheet, page or body that takes a millisecond and more.
HEAVY_ROWS_A_TASK = 1_000


def _table(spark: SparkSession, sf_dir: str, name: str, a_task: int = ROWS_A_TASK) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = -(-table.count() // a_task) if name in SPREAD else 1
    return table if n < 2 else table.repartition(n, SPREAD[name])


def dealt(table: DataFrame, *keys: str, most: int = 20 * ROWS_A_TASK) -> DataFrame:
    """A table whose work by key is dealt over tasks of some `most` rows, however few bytes these take where they are exchanged."""
    n = -(-table.count() // most)
    return table if n < 2 else table.repartition(n, *keys)


def rows(spark: SparkSession, sf_dir: str, sql: str, a_task: int = ROWS_A_TASK) -> DataFrame:
    """A SELECT over the parquet tables of sf_dir; a_task: rows of a table in SPREAD that a task takes."""
    used = set(re.findall(rf"\b(?:from|join) ({TABLES})\b", sql))
    text = re.sub(rf"\b(from|join) ({TABLES})\b", r"\1 {\2}", sql)
    return spark.sql(text, **{t: _table(spark, sf_dir, t, a_task) for t in used})


def query(name: str, sql: str | None = None):
    def add(func):
        QUERIES[name] = func
        if sql:
            ORACLES[name] = sql
        return func

    return add


# Offers: of each part and store the first line is the stored offer, the last the observed one.
LINE = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _offers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_partkey").alias("product_id"), (F.col("l_suppkey") % 5).alias("store"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "N", None).otherwise(F.col("l_returnflag") != "R").alias("available"), (F.col("l_linenumber") != 7).alias("ok"), F.struct(*LINE.split(", ")).alias("at"),
    )
    value = F.struct("ok", "price", "available")
    both = lines.groupBy("product_id", "store").agg(F.min_by(value, "at").alias("a"), F.max_by(value, "at").alias("b"))
    return both.select("product_id", "store", "a.price", "a.available"), both.select("product_id", "store", "b.*")


OFFERS_SQL = f"""
with l as (
  select l_partkey as product_id, l_suppkey % 5 as store, l_extendedprice / l_quantity as price, l_linenumber <> 7 as ok,
         case when l_returnflag = 'N' then null else l_returnflag <> 'R' end as available,
         row_number() over (partition by l_partkey, l_suppkey % 5 order by {LINE}) as up,
         row_number() over (partition by l_partkey, l_suppkey % 5 order by {LINE.replace(",", " desc,")} desc) as down
  from lineitem),
o as (
  select a.product_id, a.store, a.price, a.available, b.price as seen_price, b.available as seen_available, b.ok
  from l a join l b on a.product_id = b.product_id and a.store = b.store where a.up = 1 and b.down = 1),
c as (
  select *, ok and abs(seen_price - price) > 0.009 as moved, ok and seen_available is not null and seen_available is distinct from available as switched from o)
"""
CHANGES_SQL = OFFERS_SQL + """, d as (
  select product_id, store, case when not ok then 'ERROR' when moved or switched then 'UPDATE' else 'UNCHANGED' end as status,
         case when moved then seen_price end as new_price, case when switched then seen_available end as new_available from c)
"""


@query("price_changes", CHANGES_SQL + "select * from d")
def _(spark, sf_dir):
    return offers.price_changes(*_offers(spark, sf_dir), ["product_id", "store"])


@query("price_summary", CHANGES_SQL + "select count(*) as total, count(*) filter (status = 'UPDATE') as updates, count(*) filter (status = 'UNCHANGED') as unchanged, count(*) filter (status = 'ERROR') as errors from d")
def _(spark, sf_dir):
    return offers.price_summary(offers.price_changes(*_offers(spark, sf_dir), ["product_id", "store"]))


@query("offer_patch", OFFERS_SQL + """
select product_id, store, case when abs(seen_price - price) > 0.009 then seen_price end as patch_price,
       case when not seen_available and available is distinct from false then 'INDISPONIVEL' when seen_available and not available then 'ATIVA' end as patch_status from c""")
def _(spark, sf_dir):
    current, seen = _offers(spark, sf_dir)
    status = F.when(F.col("available"), "ATIVA").when(~F.col("available"), "INDISPONIVEL")
    both = current.select("product_id", "store", "price", status.alias("status")).join(seen.select("product_id", "store", F.col("price").alias("sp"), F.col("available").alias("sa")).hint("merge"), ["product_id", "store"])
    return offers.offer_patch(both, "price", "status", "sp", "sa").select("product_id", "store", "patch_price", "patch_status")


@query("price_order", OFFERS_SQL + """
select product_id, store, least(price, seen_price) as current, case when price <> seen_price then greatest(price, seen_price) end as previous,
       case when price <> seen_price then round_even((greatest(price, seen_price) - least(price, seen_price)) / greatest(price, seen_price) * 100, 0)::bigint end as discount from c""")
def _(spark, sf_dir):
    current, seen = _offers(spark, sf_dir)
    both = current.join(seen.select("product_id", "store", F.col("price").alias("seen_price")).hint("merge"), ["product_id", "store"])
    now, before = offers.ordered_prices(F.col("price"), F.col("seen_price"))
    return both.select("product_id", "store", now.alias("current"), before.alias("previous")).withColumn("discount", S.discount_percent(F.col("previous"), F.col("current")))


# Scalars: texts made of part columns, so that the columns are what must come back.
UNITS = """
select p_partkey, case p_partkey % 4 when 0 then concat(p_size, ' GHz') when 1 then concat(p_size * 100, ' MHz') when 2 then concat('DDR5-', 4000 + p_size) else cast(100 + p_size as varchar(9)) end as freq,
       case p_partkey % 4 when 0 then concat(p_size, ' TB') when 1 then concat(p_size, 'GB') when 2 then concat(p_size * 1024, ' MB') else cast(p_size as varchar(9)) end as cap,
       case p_partkey % 3 when 0 then concat(p_size, ' cm') when 1 then concat(p_size, 'mm') else cast(p_size as varchar(9)) end as len,
       case p_partkey % 3 when 0 then concat(p_size, ' kW') when 1 then concat(p_size, 'W') else cast(p_size as varchar(9)) end as pow,
       case p_partkey % 3 when 0 then concat(p_size, ' GB') when 1 then concat(p_size, ' MB') else concat(p_size * 1024, ' KB') end as mem,
       concat(p_size, ' x ', p_size + 1, ' x 7 ', case when p_partkey % 2 = 0 then 'cm' else 'mm' end) as dims
from part"""


@query("units", """
select p_partkey, (case p_partkey % 4 when 0 then p_size * 1000 when 1 then p_size * 100 when 2 then 4000 + p_size else 100 + p_size end)::bigint as mhz,
       (case p_partkey % 4 when 0 then p_size * 1024 else p_size end)::double as gb, (case p_partkey % 3 when 0 then p_size * 10 else p_size end)::double as mm,
       (case p_partkey % 3 when 0 then p_size * 1000 else p_size end)::bigint as watts, (case p_partkey % 3 when 0 then p_size * 1024 else p_size end)::double as mb,
       ((p_size + 1) * case when p_partkey % 2 = 0 then 10 else 1 end)::double as width from part""")
def _(spark, sf_dir):
    c = F.col
    return rows(spark, sf_dir, UNITS).select("p_partkey", S.mhz(c("freq")).alias("mhz"), S.gigabytes(c("cap")).alias("gb"), S.millimetres(c("len")).alias("mm"), S.watts(c("pow")).alias("watts"), S.megabytes(c("mem")).alias("mb"), S.triplet_mm(c("dims"))[1].alias("width"))


@query("locale_numbers", "select p_partkey, (case p_partkey % 5 when 4 then null else 1000 * p_size + case when p_partkey % 5 in (0, 1) then 0.25 else 0 end end)::double as n from part")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, "select p_partkey, case p_partkey % 5 when 0 then concat('R$ ', p_size, '.000,25') when 1 then concat('USD ', p_size, ',000.25') when 2 then concat(p_size, '.000') when 3 then concat('ca. ', p_size, ',000 g') else 'none' end as t from part")
    return t.select("p_partkey", S.number(F.col("t")).alias("n"))


@query("yes_no_words", "select p_partkey, case p_partkey % 6 when 0 then true when 1 then false when 2 then true when 3 then false when 4 then null else true end as flag from part")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, "select p_partkey, case p_partkey % 6 when 0 then ' SIM ' when 1 then 'Não' when 2 then 'Incluído' when 3 then 'not included' when 4 then 'maybe' else 'Supported' end as t from part")
    return t.select("p_partkey", S.yes_no(F.col("t")).alias("flag"))


@query("codes", """
select p_partkey, case p_partkey % 3 when 0 then '4.0' when 1 then '5.0' else '3.1' end as pcie, (case p_partkey % 4 when 0 then 80 when 1 then 42 end)::integer as m2,
       case p_partkey % 3 when 0 then '1920x1080' when 1 then '3840x2160' else '2560x1440' end as res,
       case p_partkey % 4 when 0 then '2024-01-02T00:00:00.000Z' when 1 then '2023-05-25T00:00:00.000Z' when 2 then '2023-07-14T00:00:00.000Z' end as day from part""")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, """
      select p_partkey, case p_partkey % 3 when 0 then 'PCIe 4.0 x16' when 1 then 'Gen5' else 'PCI Express 3.1' end as pcie,
             case p_partkey % 4 when 0 then 'M.2 2280' when 1 then '2242 key M' when 2 then '2242/2280' else 'SATA' end as m2,
             case p_partkey % 3 when 0 then 'Full HD' when 1 then '3840 x 2160' else 'QHD' end as res,
             case p_partkey % 4 when 0 then '2024-01-02' when 1 then '25/05/2023' when 2 then '7/14/2023' else '05/06/2023' end as day from part""")
    c = F.col
    return t.select("p_partkey", S.pcie_version(c("pcie")).alias("pcie"), S.m2_length(c("m2")).alias("m2"), S.resolution(c("res")).alias("res"), S.iso_date(c("day")).alias("day"))


# GTINs: twelve digits from the part key and a check digit; every third one is wrong.
WEIGHTED = " + ".join(f"cast(substr(b, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(1, 13))
GTIN = f"""select p_partkey, p_brand, p_name, p_size, concat(b, cast(((10 - ({WEIGHTED}) % 10) % 10 + case when p_partkey % 3 = 0 then 1 else 0 end) % 10 as varchar(1))) as gtin
from (select p_partkey, p_brand, p_name, p_size, concat('789', right(concat('000000000', cast(p_partkey as varchar(20))), 9)) as b from part)"""


@query("gtin_check", f"select p_partkey, case when p_partkey % 3 <> 0 then gtin end as gtin from ({GTIN})")
def _(spark, sf_dir):
    return rows(spark, sf_dir, GTIN).select("p_partkey", S.gtin(F.concat(F.lit("EAN "), F.col("gtin"))).alias("gtin"))


@query("urls", r"""
with u as (select page_id, url, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) as scheme, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\.', '') as host,
             regexp_extract(url, '://[^/?#:]+(:[0-9]+)?([^?#]*)', 1) as port, regexp_extract(url, '://[^/?#:]+(:[0-9]+)?([^?#]*)', 2) as path from pages)
select page_id, nullif(host, '') as host, case when host = '' then url else scheme || '://' || host || port || case when regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') = '' then '/' else regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') end end as canonical,
       lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) as url_key from u""")
def _(spark, sf_dir):
    u = F.col("url")
    return rows(spark, sf_dir, "select page_id, url from pages").select("page_id", S.host(u).alias("host"), S.canonical_url(u).alias("canonical"), S.url_key(u).alias("url_key"))


@query("text_keys", """
with t as (select doc_id, lower(strip_accents(regexp_replace(text, '\\s+', ' ', 'g'))) as x from documents)
select doc_id, nullif(regexp_replace(x, '[^a-z0-9]+', '', 'g'), '') as key, nullif(trim(regexp_replace(regexp_replace(x, '[^\\x00-\\x7F]+', '', 'g'), '[^a-z0-9]+', '_', 'g'), '_'), '') as token,
       nullif(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), '') as spaced from t""".replace("\\\\", "\\"))
def _(spark, sf_dir):
    t = F.col("t")
    return rows(spark, sf_dir, "select doc_id, text as t from documents").select("doc_id", S.key(t).alias("key"), S.token(t).alias("token"), S.spaced(t).alias("spaced"))


query("text_keys_whole", ORACLES["text_keys"])(QUERIES["text_keys"])  # the same: both read whole texts


# Catalogue records from part; incoming listings are the same records with some keys blanked or altered.
MODEL = "concat(replace(p_name, ' ', '-'), '-', cast(p_partkey as varchar(20)))"
RECORDS = f"select p_partkey as id, p_brand as brand, {MODEL} as model, concat('MPN-', cast(p_partkey as varchar(20))) as mpn, gtin, concat(p_brand, ' ', p_name, ' ', cast(p_partkey as varchar(20))) as name from ({GTIN})"
LISTINGS = f"""select id, case when id % 7 = 0 then null when id % 11 = 0 then 'Other' else brand end as brand, case when id % 5 = 0 then 'pro' else upper(model) end as model,
  case when id % 2 = 0 then null when id % 3 = 0 then lower(mpn) else mpn end as mpn, case when id % 4 = 0 then gtin end as gtin, name from ({RECORDS})"""


@query("identity_ladder", f"""
with k as (select *, regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g') as b, regexp_replace(lower(mpn), '[^a-z0-9]+', '', 'g') as p, regexp_replace(lower(model), '[^a-z0-9]+', '', 'g') as m from ({LISTINGS}))
select id, case when gtin is not null then 'GTIN' when brand is not null and mpn is not null then 'BRAND_MPN' when brand is not null and model <> 'pro' then 'BRAND_MODEL' end as id_method,
       case when gtin is not null or (brand is not null and mpn is not null) then 'VERY_HIGH' when brand is not null and model <> 'pro' then 'HIGH' else 'INSUFFICIENT' end as id_confidence,
       case when gtin is not null then gtin when brand is not null and mpn is not null then b || '|' || p when brand is not null and model <> 'pro' then b || '|' || m end as id_key from k""")
def _(spark, sf_dir):
    return identity.identity_ladder(rows(spark, sf_dir, LISTINGS)).select("id", "id_method", "id_confidence", "id_key")


@query("comparison_keys", f"select id, gtin as gtin_key, lower(brand) || '|' || lower(mpn) as mpn_key, lower(brand) || '|' || lower(model) as model_key from ({LISTINGS})")
def _(spark, sf_dir):
    return identity.comparison_keys(rows(spark, sf_dir, LISTINGS)).select("id", "gtin_key", "mpn_key", "model_key")


PAIRS_SQL = f"""
with n as (select 'a' as side, * from ({LISTINGS}) union all select 'b', * from ({RECORDS})),
k as (select side, id, nullif(regexp_replace(lower(brand), '[^a-z0-9]+', '', 'g'), '') as b, nullif(regexp_replace(lower(mpn), '[^a-z0-9]+', '', 'g'), '') as p, nullif(regexp_replace(lower(model), '[^a-z0-9]+', '', 'g'), '') as m, gtin as g from n),
j as (select x.id as a_id, y.id as b_id, x.g = y.g as eg, x.p = y.p as ep, x.b = y.b and x.m = y.m as em, x.b is null or y.b is null or x.b = y.b as fine
      from k x join k y on x.g = y.g or x.p = y.p or (x.b = y.b and x.m = y.m) where x.side = 'a' and y.side = 'b'),
r as (select a_id, b_id, case when eg then 100 when ep then 95 else 90 end as score, case when coalesce(eg, false) or coalesce(ep, false) then not fine else false end as conflict from j)
"""


@query("match_records", PAIRS_SQL + f""", s as (select a_id, count(*) filter (not conflict) as n, count(*) filter (conflict) as c, max(score) filter (not conflict) as score, min(b_id) filter (not conflict) as b from r group by a_id)
select l.id as a_id, case when coalesce(n, 0) = 1 then 'MATCH' when n > 1 then 'AMBIGUOUS' else 'NONE' end as status, case when n = 1 then b end as match_id, coalesce(score, 0)::integer as score, coalesce(n, 0)::bigint as n_candidates, coalesce(c, 0)::bigint as n_conflicts
from ({LISTINGS}) l left join s on s.a_id = l.id""")
def _(spark, sf_dir):
    return matching.match_records(rows(spark, sf_dir, LISTINGS), rows(spark, sf_dir, RECORDS))


@query("identity_conflicts", PAIRS_SQL + "select a_id, b_id, score::integer as score from r where conflict")
def _(spark, sf_dir):
    return matching.candidate_pairs(rows(spark, sf_dir, LISTINGS), rows(spark, sf_dir, RECORDS)).where("conflict").select("a_id", "b_id", "score")


@query("match_similar")
def _(spark, sf_dir):
    some = "select p_partkey as id, p_brand as brand, concat(p_name, case when p_partkey % 2 = 0 then ' II' else '' end) as name from part"
    return matching.similar_classes(rows(spark, sf_dir, some))


STORED = "select l_orderkey * 10 + l_linenumber as offer_id, l_partkey as product_id, l_suppkey % 5 as partner_id, concat('https://www.store', cast(l_suppkey % 5 as varchar(2)), '.example//p/', cast(l_partkey as varchar(20)), '/?q=', cast(l_linenumber as varchar(2))) as url from lineitem"
FOUND = "select p_partkey as row_id, p_partkey as product_id, cast(p_size % 5 as bigint) as partner_id, concat('HTTPS://store', cast(p_size % 5 as varchar(2)), '.example/p/', cast(p_partkey as varchar(20)), '#top') as url from part"


@query("match_offers", f"""with s as (select product_id, partner_id, count(*) as n, min(offer_id) as offer_id from ({STORED}) group by 1, 2)
select row_id, case when n = 1 then 'MATCH' when n > 1 then 'AMBIGUOUS' else 'NONE' end as status, case when n = 1 then offer_id end as offer_id from ({FOUND}) f left join s using (product_id, partner_id)""")
def _(spark, sf_dir):
    return matching.match_offers(rows(spark, sf_dir, FOUND), rows(spark, sf_dir, STORED))


query("match_offers_whole", ORACLES["match_offers"])(QUERIES["match_offers"])  # the same: both read all lines


@query("partner_by_domain", r"""
with p as (select s_suppkey as partner_id, s_suppkey as pos, 'site' || (s_suppkey % 5) || '.example' as domain from supplier),
h as (select p_partkey as id, case p_partkey % 3 when 0 then 'shop.' else '' end || 'site' || (p_partkey % 7) || '.example' as host from part),
m as (select h.id, min_by(partner_id, pos) as partner_id from h join p on h.host = p.domain or h.host like '%.' || p.domain group by h.id)
select h.id, m.partner_id from h left join m using (id)""")
def _(spark, sf_dir):
    partners = rows(spark, sf_dir, "select s_suppkey as partner_id, s_suppkey as pos, concat('site', cast(s_suppkey % 5 as string), '.example') as domain from supplier")
    seen = rows(spark, sf_dir, "select p_partkey as id, concat('https://www.', case p_partkey % 3 when 0 then 'shop.' else '' end, 'site', cast(p_partkey % 7 as string), '.example/x') as url from part")
    return matching.partner_by_domain(seen, partners).select("id", "partner_id")


@query("exclude_registered", f"select id from ({LISTINGS}) where id % 6 <> 0 and not (id % 9 = 0 and brand is not null and brand <> 'Other' and model <> 'pro')")
def _(spark, sf_dir):
    have = rows(spark, sf_dir, f"select case when id % 6 = 0 then name end as name, case when id % 9 = 0 then brand end as brand, case when id % 9 = 0 then model end as model from ({RECORDS}) where id % 6 = 0 or id % 9 = 0")
    return matching.exclude_registered(rows(spark, sf_dir, LISTINGS), have).select("id")


@query("linked_product", "select p_partkey as id, case when p_partkey % 3 = 0 then p_partkey + 1 else case when p_partkey % 2 = 0 then p_partkey end end as product_id from part")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, "select p_partkey as id, case when p_partkey % 3 = 0 then p_partkey + 1 end as linked_product_id, case when p_partkey % 2 = 0 then p_partkey end as matched_product_id from part")
    return matching.linked_product(t).select("id", "product_id")


# Claims: every line of a part is a source's word on three fields.
_NAMES = "case l_suppkey % 10 when 0 then 'FABRICANTE_OFICIAL' when 1 then 'ICECAT' when 2 then 'TECHPOWERUP' when 3 then 'CPU_MONKEY' when 4 then 'WIKICHIP' when 5 then 'GEIZHALS' when 6 then 'PC_KOMBO' when 7 then 'OPENAI_WEB_SEARCH' when 8 then 'OPENAI' else 'LOJA' end"
_SCORE = "case source when 'FABRICANTE_OFICIAL' then 0.98 when 'ICECAT' then 0.94 when 'TECHPOWERUP' then 0.93 when 'CPU_MONKEY' then 0.91 when 'WIKICHIP' then 0.88 when 'GEIZHALS' then 0.86 when 'PC_KOMBO' then 0.78 when 'OPENAI_WEB_SEARCH' then 0.80 when 'OPENAI' then 0.72 else 0.65 end::double"


def _claim(field: str, value: str) -> str:
    return f"select l_partkey as record_id, '{field}' as field, {_NAMES} as source, l_suppkey % 10 as rank, {value} as value from lineitem"


CLAIMS = " union all ".join((_claim("flag", "case when l_quantity < 10 then '' else l_returnflag end"), _claim("state", "case when l_linenumber > 2 then null else lower(l_linestatus) end"), _claim("line", "cast(l_linenumber as varchar(3))")))
FILL_SQL = f"with w as materialized (select *, row_number() over o as r, first_value(value) over o as kept from ({CLAIMS}) where value <> '' window o as (partition by record_id, field order by rank, source, value)), c as (select record_id, field, source, rank, value from w), g as (select record_id, field, value, source, rank from w where r = 1)"


@query("gap_fill", FILL_SQL + " select * from g")
def _(spark, sf_dir):
    return resolve.gap_fill(rows(spark, sf_dir, CLAIMS))


@query("conflicts", FILL_SQL + " select record_id, field, kept, value as other, source, rank from w where lower(kept) <> lower(value)")
def _(spark, sf_dir):
    return resolve.conflicts(rows(spark, sf_dir, CLAIMS))


@query("early_stop", f"""with c as (select * from ({CLAIMS})), f as (select record_id, field, min(rank) as rank from c where value <> '' group by 1, 2),
s as (select record_id, min(rank) as stop from (select record_id, rank, count(*) over (partition by record_id order by rank) as n from f) where n >= 2 group by 1)
select record_id, field, count(*) as n, max(c.rank) as last_rank from c left join s using (record_id) where stop is null or c.rank <= stop group by 1, 2""")
def _(spark, sf_dir):
    kept = resolve.early_stop(rows(spark, sf_dir, CLAIMS), 3, 0.6)
    return kept.groupBy("record_id", "field").agg(F.count("*").alias("n"), F.max("rank").alias("last_rank"))


@query("consensus", f"""with c as (select record_id, field, lower(value) as k, value, source, rank, {_SCORE} as c from ({CLAIMS}) where value <> ''),
s as (select record_id, field, k, source, max(c) as c, min(rank) as rank, min_by(value, rank) as value from c group by all),
v as (select record_id, field, k, count(*) as support, round(sum(c), 4) as total, max(c) as best, min(rank) as rank, min_by(value, rank) as value from s group by all),
r as (select *, row_number() over w as r, lead(total) over w as nt, lead(best) over w as nb from v window w as (partition by record_id, field order by total desc, support desc, best desc, rank, k))
select record_id, field, value, support, total, case when support >= 2 and total - coalesce(nt, 0) >= 0.08 then 'CONSENSUS' when best >= 0.85 and best - coalesce(nb, 0) >= 0.08 then 'STRONG_SOURCE' else 'OPEN' end as method from r where r = 1""")
def _(spark, sf_dir):
    return resolve.consensus(rows(spark, sf_dir, CLAIMS))


CONF_SQL = FILL_SQL + f""", x as (select distinct record_id, field from w where lower(kept) <> lower(value)),
b as (select g.record_id, g.field, g.source, x.field is not null as in_conflict, case when source = 'OPENAI_WEB_SEARCH' then 0.74 else {_SCORE} end as base from g left join x on x.record_id = g.record_id and x.field = g.field),
f as (select *, case when in_conflict then greatest(0.40, base - 0.12) else base end as raw from b)
"""


@query("field_confidence", CONF_SQL + "select record_id, field, source, in_conflict, round(raw, 2)::double as score, case when raw >= 0.95 then 'VERY_HIGH' when raw >= 0.85 then 'HIGH' when raw >= 0.70 then 'MEDIUM' else 'LOW' end as level from f")
def _(spark, sf_dir):
    claims = rows(spark, sf_dir, CLAIMS)
    return resolve.field_confidence(resolve.gap_fill(claims).select("record_id", "field", "source"), resolve.conflicts(claims))


SHEET = " union all ".join(f"select p_partkey as record_id, p_type as category, '{f}' as field, case when p_partkey % {m} = 0 then null else cast(p_size as varchar(5)) end as value from part" for f, m in (("a", 2), ("b", 3), ("c", 5), ("d", 7)))
WEIGHTS = "select distinct p_type as category, field, pos, weight from part cross join (select 'a' as field, 1 as pos, 3 as weight union all select 'b', 2, 2 union all select 'c', 3, 1 union all select 'd', 4, 1 union all select 'e', 5, 1)"


@query("coverage_status", """
with f as (select p_partkey as record_id, p_partkey % 2 <> 0 as a, p_partkey % 3 <> 0 as b, p_partkey % 5 <> 0 as c, p_partkey % 7 <> 0 as d from part),
s as (select *, (3 * a::int + 2 * b::int + c::int + d::int) / 8.0 as coverage from f)
select record_id, coverage::double as coverage, concat_ws(',', case when not a then 'a' end, case when not b then 'b' end, case when not c then 'c' end, case when not d then 'd' end, 'e') as missing,
       case when coverage < 0.55 then 'INCOMPLETE' when not a or coverage < 0.80 then 'REVIEW' else 'READY' end as status from s""")
def _(spark, sf_dir):
    share = resolve.coverage(rows(spark, sf_dir, SHEET), rows(spark, sf_dir, WEIGHTS))
    return share.select("record_id", "coverage", "missing", resolve.sheet_status(F.col("coverage"), F.col("essential_missing"), F.lit(0)).alias("status"))


OTHER = " union all ".join(f"select p_partkey as record_id, '{f}' as field, case when p_partkey % {m} = 0 then null when p_partkey % 4 = 0 then 'x' else concat(cast(p_size as varchar(5)), ' ') end as value from part" for f, m in (("a", 5), ("b", 2), ("z", 3)))


@query("merge_missing", f"""with o as (select record_id, field, value as old from ({SHEET})), n as (select record_id, field, value as new from ({OTHER})), j as (select * from o full join n using (record_id, field))
select record_id, field, coalesce(old, new) as value, case when old is null and new is not null then 'FILLED' when trim(old) <> trim(new) then 'CONFLICT' else 'KEPT' end as action from j""")
def _(spark, sf_dir):
    return resolve.merge_missing(rows(spark, sf_dir, SHEET), rows(spark, sf_dir, OTHER))


@query("newly_filled", f"select distinct n.record_id, n.field from ({OTHER}) n left join (select * from ({SHEET}) where value <> '') o using (record_id, field) where n.value <> '' and o.record_id is null")
def _(spark, sf_dir):
    return resolve.newly_filled(rows(spark, sf_dir, SHEET), rows(spark, sf_dir, OTHER))


@query("disagreeing_fields", f"select record_id, field, count(distinct value) as n_values from ({CLAIMS}) where value <> '' group by 1, 2 having count(distinct value) > 1")
def _(spark, sf_dir):
    return resolve.disagreeing(rows(spark, sf_dir, CLAIMS))


@query("verification", FILL_SQL + f""", v as (select g.record_id, g.field, count(*) filter (c.source <> g.source and c.value = g.value) as yes, count(*) filter (c.source <> g.source and c.value <> g.value and {_SCORE.replace("source", "c.source")} >= 0.85) as no from g join c using (record_id, field) group by 1, 2)
select record_id, field, case when yes > 0 then 'CONFIRMED' when no > 0 then 'CONTRADICTED' else 'UNVERIFIED' end as verdict from v""")
def _(spark, sf_dir):
    claims = rows(spark, sf_dir, CLAIMS)
    return resolve.verification(resolve.gap_fill(claims), claims)


# Order and limits.
LISTED = "select p_partkey as id, p_partkey % 3 as source, case when p_size % 5 = 0 then null else concat(p_brand, '|', cast(p_size as varchar(3))) end as k, p_retailprice, p_size, p_brand, p_name from part"


@query("dedup_key", f"select id from (select id, k, row_number() over (partition by k order by id) as r from ({LISTED})) where k is null or r = 1")
def _(spark, sf_dir):
    return ordering.dedup_by_key(rows(spark, sf_dir, LISTED), F.col("k"), "id").select("id")


@query("interleave", f"select id, source, row_number() over (order by turn, source)::integer as place from (select id, source, row_number() over (partition by source order by id) as turn from ({LISTED})) qualify place <= 50")
def _(spark, sf_dir):
    return ordering.interleave(rows(spark, sf_dir, LISTED), "source", "id", 50).select("id", "source", "place")


@query("page_slice", f"select id, true as has_more from ({LISTED}) order by p_retailprice desc, id limit 20 offset 40")
def _(spark, sf_dir):
    return ordering.page_slice(rows(spark, sf_dir, LISTED), [F.desc("p_retailprice"), "id"], 40, 20).select("id", "has_more")


@query("relevance_rank", f"""with s as (select id, p_brand, round((p_size % 4) / 3.0 * 100 + case when p_size % 2 = 0 then 100 else 0 end + least(20, 5 * log10(p_size + 1)) + least(10, 2 * (p_size % 6)) + least(15, p_size / 4.0), 6)::double as score from ({LISTED}))
select id, score, row_number() over (partition by p_brand order by score desc, id)::integer as rank from s""")
def _(spark, sf_dir):
    size = F.col("p_size")
    score = F.round(ordering.relevance((size % 4) / 3, size % 2 == 0, size, size % 6, size), 6)
    return rows(spark, sf_dir, LISTED).select("id", "p_brand", score.alias("score")).withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "id"))).drop("p_brand")


@query("per_store_limit", f"""with o as (select l_suppkey % 5 as store, l_partkey % 100 as k, l_extendedprice as price, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem),
d as (select *, row_number() over (partition by store, k order by price, l_orderkey, l_linenumber, l_partkey, l_suppkey) as r from o)
select store, k, price, row_number() over (partition by store order by price, l_orderkey, l_linenumber, l_partkey, l_suppkey)::integer as place from d where r = 1 qualify place <= 5""")
def _(spark, sf_dir):
    o = rows(spark, sf_dir, "select l_suppkey % 5 as store, l_partkey % 100 as k, l_extendedprice as price, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem")
    return ordering.per_store_limit(o, "store", F.col("k"), ["price", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5).select("store", "k", "price", "place")


@query("most_informative", f"select max_by(id, (case when k is null then 0 else 1 end + case when id % 2 = 0 then 1 else 0 end) * 1000000000000 - id) as id, p_brand from ({LISTED}) group by p_brand")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, f"select id, p_brand, k, case when id % 2 = 0 then 'x' else '' end as extra from ({LISTED})")
    return ordering.most_informative(t, "p_brand", ["k", "extra"], "id").select("id", "p_brand")


@query("greedy_dedup", """
with recursive t as (select *, row_number() over (order by pos) as i from (select p_partkey as pos, 'u' || (p_partkey * 7 % 97) as url, p_name || p_size as name from part)),
w as (select 0::bigint as i, []::varchar[] as urls, []::varchar[] as names, null::bigint as pos, null::varchar as url, null::varchar as name, false as kept
  union all select t.i, case when k then list_append(w.urls, t.url) else w.urls end, case when k then list_append(w.names, t.name) else w.names end, t.pos, t.url, t.name, k
  from w join t on t.i = w.i + 1, lateral (select not list_contains(w.urls, t.url) and not list_contains(w.names, t.name) as k) l)
select pos, url, name from w where kept""")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, "select p_partkey as pos, concat('u', cast(p_partkey * 7 % 97 as string)) as url, concat(p_name, cast(p_size as string)) as name from part")
    return ordering.greedy_dedup(t, "url", "name", "pos")


# Metering, on events.
CALLS = "select event_id, user_id as owner, ts, event_type as model, case when user_id % 2 = 0 then 'A' else 'B' end as provider, event_id % 1000 as input_tokens, event_id % 77 as output_tokens, cast(get_json_object(props, '$.k') as bigint) as k from events"
CALLS_SQL = CALLS.replace("cast(get_json_object(props, '$.k') as bigint)", "cast(props->>'$.k' as bigint)")
PRICES = "select 'view' as model, cast(1.5 as double) as price_in, cast(6.0 as double) as price_out union all select 'click', 0.25, 2.0 union all select 'signup', 3.0, 15.0"


@query("usage_summary", f"""select provider, model, count(*) as calls, sum(input_tokens + output_tokens)::bigint as tokens, round(sum((input_tokens * price_in + output_tokens * price_out) / 1e6), 6) as cost_usd, count(*) filter (price_in is null) as unknown_cost
from ({CALLS_SQL}) left join ({PRICES}) using (model) group by 1, 2""")
def _(spark, sf_dir):
    calls = usage.call_cost(rows(spark, sf_dir, CALLS), rows(spark, sf_dir, PRICES))
    return usage.usage_summary(calls).withColumn("cost_usd", F.round("cost_usd", 6))


@query("research_quality", "select o_orderpriority as category, count(*) as n, sum(o_custkey % 9)::bigint as filled, sum(o_orderkey % 3)::bigint as conflicts, avg(o_orderkey % 5000) as avg_ms from orders group by 1")
def _(spark, sf_dir):
    return usage.research_quality(rows(spark, sf_dir, "select o_orderpriority as category, o_custkey % 9 as filled, o_orderkey % 3 as conflicts, o_orderkey % 5000 as duration_ms from orders"))


@query("operations_by_state", "select event_type as state, count(*) as n, avg(event_id % 5000) as avg_ms from events group by 1")
def _(spark, sf_dir):
    return usage.operations_by_state(rows(spark, sf_dir, "select event_type as state, event_id % 5000 as duration_ms from events"))


@query("latest_state", "select user_id, max_by(event_type, (epoch_us(ts::timestamp)::hugeint * 1000000000 + event_id)) as state, count(*) as n_events from events group by 1")
def _(spark, sf_dir):
    return usage.latest_state(rows(spark, sf_dir, "select user_id, event_type, ts, event_id from events"), "user_id", "event_type", ["ts", "event_id"])


@query("illegal_moves", """select event_id, event_type, before from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events)
where before is not null and not ((before = 'view' and event_type in ('click', 'purchase')) or (before = 'click' and event_type = 'view'))""")
def _(spark, sf_dir):
    moves = {"view": ("click", "purchase"), "click": ("view",)}
    return usage.illegal_moves(rows(spark, sf_dir, "select event_id, user_id, event_type, ts from events"), "user_id", "event_type", ["ts", "event_id"], moves).select("event_id", "event_type", "before")


@query("daily_quota", "select event_id, ts::date::varchar as day, row_number() over (partition by user_id, ts::date order by ts, event_id) <= 2 as admitted from events")
def _(spark, sf_dir):
    return usage.daily_quota(rows(spark, sf_dir, "select event_id, user_id, ts from events"), ["user_id"], "ts", ["ts", "event_id"], 2).select("event_id", F.col("day").cast("string").alias("day"), "admitted")


@query("idempotent_intake", f"""with c as (select event_id, owner, k % 5 as request_key, model as fingerprint, ts from ({CALLS_SQL})), w as (select *, row_number() over x as r, first_value(fingerprint) over x as f from c window x as (partition by owner, request_key order by ts, event_id))
select event_id, case when r = 1 then 'ACCEPTED' when fingerprint = f then 'REPEATED' else 'CONFLICT' end as outcome from w""")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, f"select event_id, owner, k % 5 as request_key, model as fingerprint, ts from ({CALLS})")
    return usage.intake(t, ["ts", "event_id"]).select("event_id", "outcome")


# Pages and texts.
@query("page_links", """with l as (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as h from pages), u as (select page_id, unnest(h) as href, unnest(range(len(h))) as pos from l)
select page_id, href, row_number() over (partition by page_id order by min(pos))::integer as place from u group by page_id, href qualify place <= 10""")
def _(spark, sf_dir):
    return pages.distinct_links(rows(spark, sf_dir, "select page_id, html from pages"), 10)


@query("page_headings", r"""select page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1, 's'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '') as heading,
  nullif(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's'), '\s+', ' ', 'g')), '') as title from pages""")
def _(spark, sf_dir):
    return rows(spark, sf_dir, "select page_id, html from pages").select("page_id", pages.heading(F.col("html")).alias("heading"), pages.title(F.col("html")).alias("title"))


@query("page_status", """with t as (select page_id, lower(concat_ws(' ', html, url)) as x from pages)
select page_id, case when regexp_matches(x, 'captcha|access denied|verify you are human|unusual traffic') then 'BLOCKED' when regexp_matches(x, 'page not found|not found \\(404\\)|error 404') then 'ERROR' else 'OK' end as status from t""")
def _(spark, sf_dir):
    return rows(spark, sf_dir, "select page_id, url, html from pages").select("page_id", pages.status(F.lit(None).cast("string"), F.col("html"), F.col("url")).alias("status"))


@query("repeated_lines", "select doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: not list_contains(l[1:i - 1], l[i])), lambda i: l[i]), chr(10)) as text from (select doc_id, string_split(text, chr(10)) as l from documents)")
def _(spark, sf_dir):
    return rows(spark, sf_dir, "select doc_id, text from documents").select("doc_id", pages.drop_repeated_lines(F.col("text")).alias("text"))


@query("answers", """select p_partkey as record_id, unnest(['brand', 'model_name', 'size_gb']) as field, unnest([p_brand, p_name, p_size || ' GB']) as value from part""")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, r"select p_partkey as record_id, concat('Here:', chr(10), '- Brand: ', p_brand, chr(10), '* Model name : ', p_name, chr(10), 'Brand: other', chr(10), 'Size (GB): ', cast(p_size as string), ' GB', chr(10), 'Colour: n/a') as response_text from part")
    return pages.answers(t)


# Attributes: names in several spellings, made of part columns.
_PAIRS = (("Marca", "p_brand", 0), (" MODELO ", "concat(' ', p_name)", 1), ("marca", "'other'", 2), ("Part Number", "concat('P-', cast(p_partkey as varchar(20)))", 3), ("Avaliação", "'5'", 4), ("EAN", "gtin", 5), ("Size", "case when p_partkey % 2 = 0 then '' else cast(p_size as varchar(5)) end", 6))
PAIRS = " union all ".join(f"select p_partkey as record_id, {pos} as pos, '{name}' as name, {value} as value from ({GTIN})" for name, value, pos in _PAIRS)


@query("attribute_lookup", f"select p_partkey as record_id, unnest(['marca', 'modelo', 'part_number', 'avaliacao', 'ean']) as key, unnest([p_brand, p_name, 'P-' || p_partkey, '5', gtin]) as value from ({GTIN}) union all select p_partkey, 'size', p_size::varchar from part where p_partkey % 2 = 1")
def _(spark, sf_dir):
    return attributes.lookup(rows(spark, sf_dir, PAIRS))


@query("attribute_aliases", f"select p_partkey as record_id, unnest(['code', 'label']) as field, unnest([gtin, p_name]) as value from ({GTIN})")
def _(spark, sf_dir):
    aliases = spark.createDataFrame([("code", "gtin", 1), ("code", "EAN", 2), ("code", "Part number", 3), ("label", "modelo", 1), ("label", "marca", 2)], "field string, alias string, priority int")
    return attributes.by_alias(rows(spark, sf_dir, PAIRS), aliases)


@query("attribute_merge", f"select record_id, name, value from (select *, row_number() over (partition by record_id order by pos) as r from ({PAIRS}) where value <> '') where r <= 350")
def _(spark, sf_dir):
    pairs = rows(spark, sf_dir, PAIRS)
    return attributes.merge(pairs.where("pos < 3"), pairs, 350)


query("attribute_merge_whole", ORACLES["attribute_merge"])(QUERIES["attribute_merge"])  # the same


@query("technical_attributes", f"select record_id, pos from ({PAIRS}) where pos <> 4")
def _(spark, sf_dir):
    return attributes.technical_only(rows(spark, sf_dir, PAIRS)).select("record_id", "pos")


@query("identity_from_attributes", f"select p_partkey as record_id, p_brand as brand, p_name as model, 'P-' || p_partkey as mpn, case when p_partkey % 3 <> 0 then gtin end as gtin from ({GTIN})")
def _(spark, sf_dir):
    return attributes.identity_of(rows(spark, sf_dir, PAIRS))


@query("affiliate_items", "select p_partkey as item_id, p_retailprice as price_min, case when p_partkey % 3 = 0 then null else p_retailprice + 1 end as price_max, (case p_partkey % 3 when 0 then 25 when 1 then 40 else 0 end)::double as discount, p_size::bigint as sales, 4.5::double as rating, p_partkey % 3 <> 2 as promo from part")
def _(spark, sf_dir):
    t = "select p_partkey as item_id, cast(p_retailprice as string) as price_min, case when p_partkey % 3 = 0 then '-1' else cast(p_retailprice + 1 as string) end as price_max, case p_partkey % 3 when 0 then '0.25' when 1 then '40' else '0' end as discount_rate, cast(p_size as string) as sales, '4.5' as rating from part"
    return listings.affiliate_items(rows(spark, sf_dir, t))


@query("title_matches", "select p_partkey as id, p_partkey % 3 <> 0 as words, p_partkey % 4 <> 0 and p_partkey % 5 <> 0 as same from part")
def _(spark, sf_dir):
    t = rows(spark, sf_dir, "select p_partkey as id, concat('RTX4060 ', case when p_partkey % 3 = 0 then 'qqq' else '' end) as q, concat('Card rtx 4060 ', p_size, 'GB', case when p_partkey % 4 = 0 then ' Ti' else '' end) as a, concat('RTX 4060 ', p_size + case when p_partkey % 5 = 0 then 1 else 0 end, ' gb') as b from part")
    return t.select("id", listings.all_words(F.col("q"), F.col("a")).alias("words"), listings.same_variant(F.col("a"), F.col("b")).alias("same"))


@query("admissible_offers", "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_extendedprice > 0 and l_linestatus = 'O' and l_returnflag <> 'R' and l_linenumber <> 1")
def _(spark, sf_dir):
    t = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as price, case when l_linestatus = 'O' then 'BRL' else 'USD' end as currency, case l_returnflag when 'R' then false when 'A' then true end as available, case when l_linenumber = 1 then 'none' else 'https://a.example/p' end as url from lineitem"
    return listings.admissible(rows(spark, sf_dir, t)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("search_status", "select user_id as search_id, case when count(*) filter (value > 150) > 0 then 'FOUND' when bool_and(event_type <> 'error') then 'EMPTY' when bool_or(event_type <> 'error') then 'PARTIAL' else 'FAILED' end as status from events group by 1")
def _(spark, sf_dir):
    return listings.search_status(rows(spark, sf_dir, "select user_id as search_id, event_type <> 'error' as ok, case when value > 150 then 1 else 0 end as found from events"))


@query("source_agreement", "select l_partkey as item, count(distinct l_suppkey % 7) as n_sources, string_agg(distinct 's' || (l_suppkey % 7), ',' order by 's' || (l_suppkey % 7)) as sources from lineitem group by 1")
def _(spark, sf_dir):
    return listings.agreement(rows(spark, sf_dir, "select l_partkey as item, concat('s', cast(l_suppkey % 7 as string)) as source from lineitem"))


@query("base_patch", f"""with l as (select l.id, unnest(['brand', 'model', 'mpn', 'gtin']) as field, unnest([l.brand, l.model, l.mpn, l.gtin]) as old, unnest([r.brand, r.model, r.mpn, r.gtin]) as value from ({LISTINGS}) l join ({RECORDS}) r using (id))
select id, field, value, case when old is null then 'FILL' else 'CONFLICT' end as action, true as is_identity from l where value is not null and (old is null or lower(old) <> lower(value))""")
def _(spark, sf_dir):
    return planning.base_patch(rows(spark, sf_dir, LISTINGS), rows(spark, sf_dir, RECORDS), "id", ["brand", "model", "mpn", "gtin"])


@query("offer_payload", "select p_partkey as offer_id, case when p_partkey % 4 <> 0 then p_retailprice end as price, case when p_partkey % 4 <> 0 and p_partkey % 3 = 0 then p_retailprice + 5 end as previous, left('code ' || p_name || ' ' || p_name || ' ' || p_name, 20) as code, case when p_partkey % 2 = 0 then 'https://a.example/' || p_partkey end as url, case when p_partkey % 4 = 0 then 'NO_PRICE' end as error from part")
def _(spark, sf_dir):
    t = "select p_partkey as offer_id, case when p_partkey % 4 = 0 then 0 else p_retailprice end as price, p_retailprice + case when p_partkey % 3 = 0 then 5 else -5 end as previous, concat(' code  ', p_name, ' ', p_name, ' ', p_name) as code, concat('https://a.example/', case when p_partkey % 2 = 1 then repeat('x', 60) else '' end, cast(p_partkey as string)) as url from part"
    return planning.offer_payload(rows(spark, sf_dir, t))
