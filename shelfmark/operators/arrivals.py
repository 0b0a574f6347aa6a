"""What happens to a record that arrives: known items get an offer only, an analysis is completed by the page a browser captured, parts of a listing become seeds of research."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories, stores
from ..functions import scalars as S
from . import evidence, identity, matching, products

#: Platforms whose pages are captured, categories that a page's name may correct, fields of the root that a capture only fills.
CAPTURED = ("AMAZON", "KABUM", "PICHAU", "TERABYTE", "ALIEXPRESS", "MAGALU", "MERCADO_LIVRE", "SHOPEE")
CORRECTED, EARS, LEAST_NAME = ("MEMORIA_RAM", "PLACA_VIDEO", "PLACA_MAE"), ("FONE", "HEADSET"), 8
#: Fixed patterns: passages that leave a part open, processors' models, what is a measure or a chipset rather than a part's model, a label before a value.
OPEN, PROCESSOR = r"(?iU)\b(?:ou|opcional|opcionais|varia|variam|alternativas?)\b", r"(?i)\b(?:Ryzen|Core|i[3579])\b"
MEASURE, MEASURED = r"(?i)^(?:\d+\s*(?:GB|TB|W)|DDR[345]|[ABHXZ]\d{3}M?)(?:\s+.*)?$", ("MEMORIA_RAM", "ARMAZENAMENTO", "FONTE", "PLACA_MAE")
LABEL = r"^[^:]{1,40}:\s*"
MEMORY_LABELS, MEMORY_ROW = ("memory type", "memory types"), r"(?i)^(DDR[345])\s*[- ]\s*(\d{3,5})$"


def preflight(arrivals: DataFrame, registered: DataFrame, hardware: DataFrame) -> DataFrame:
    """row_id, route (OFFER_ONLY or FULL), kind, item_id, by: whether an arriving record is a registered product, else a known part; then it needs an offer only.

    All have id (row_id of arrivals), brand, model, mpn and gtin. One equal item makes a match; several leave the full way. Records that share
    a row_id are each judged by what they tell themselves.
    """
    identity = ["brand", "model", "mpn", "gtin"]
    told = arrivals.select("row_id", *identity, F.struct("row_id", *identity).alias("_row"))
    by = F.when(F.col("score") >= 100, "GTIN").when(F.col("score") >= 95, "MPN").otherwise("MARCA_MODELO")

    def known(items: DataFrame, kind: str) -> DataFrame:
        return matching.match_records(told.dropDuplicates(["_row"]), items, "_row").where("status = 'MATCH'").select(F.col("a_id").alias("_row"), F.struct(F.lit(kind).alias("kind"), F.col("match_id").alias("item_id"), by.alias("by")).alias(kind)).hint("merge")

    rows = told.select("row_id", "_row").join(known(registered, "PRODUTO"), "_row", "left").join(known(hardware, "HARDWARE"), "_row", "left").withColumn("m", F.coalesce("PRODUTO", "HARDWARE"))
    return rows.select("row_id", F.when(F.col("m").isNotNull(), "OFFER_ONLY").otherwise("FULL").alias("route"), "m.kind", "m.item_id", "m.by")


def captured_category(current: Column, page_name: Column, forced: Column) -> Column:
    """The category that a captured page's name gives an analysis instead of its own; null where it stays. A forced one always stays."""
    found = categories.category(page_name)
    other = ~F.upper(current).eqNullSafe(found)
    fits = ((F.upper(current) == "MOUSE") & (found == "MOUSEPAD")) | (found.isin(*CORRECTED) & other) | (found.isin(*EARS) & other)
    return F.when(F.coalesce(forced, F.lit("")) == "", F.when(F.coalesce(fits, F.lit(False)), found))


def hydrated(analyses: DataFrame, remote: DataFrame, captures: DataFrame, local: DataFrame, schemas: DataFrame) -> DataFrame:
    """record_id, category, part, field, value, origin (REMOTE or LOCAL): analyses completed by captures of the same pages.

    analyses: record_id, category, forced; captures: record_id, url, page_name, n_attributes, one row a record; remote, local: record_id,
    part (root, spec or offer), field, value; schemas: category. In root and spec the analysis wins and the capture fills, unless
    the capture's name corrects the category: then both are the capture's. In the offer the capture wins. An analysis stays as it is
    where no known platform's page was captured, its name has fewer than eight letters, the category has no schema, or a complete
    analysis (category, name and specs) meets a capture without attributes. Values that are blank are none.
    """
    named = lambda c: evidence.present(F.trim(c))
    whole = remote.where(named(F.col("value"))).groupBy("record_id").agg(F.bool_or((F.col("part") == "root") & (F.col("field") == "nome")).alias("named"), F.bool_or(F.col("part") == "spec").alias("specified"))
    platform = F.coalesce(*(F.when(stores.under(S.host(F.col("url")), domains), F.lit(name)) for name, domains in {**stores.DOMAINS, "SHOPEE": ("shopee.com.br",)}.items()))
    seen = captures.where(platform.isin(*CAPTURED) & (F.length(F.trim("page_name")) >= LEAST_NAME)).select("record_id", "page_name", "n_attributes")
    x = analyses.select("record_id", F.upper("category").alias("had"), F.upper("forced").alias("forced")).join(seen.hint("merge"), "record_id", "left").join(whole.hint("merge"), "record_id", "left")
    x = S.apart(x.withColumn("corrected", captured_category(F.col("had"), F.col("page_name"), F.col("forced"))))
    x = x.withColumn("own", F.coalesce(S.blank_to_null(F.col("forced")), "corrected", S.blank_to_null(F.col("had")), categories.category(F.col("page_name"))))
    known = schemas.select(F.upper("category").alias("own"), F.lit(True).alias("known")).distinct()
    had_schema = schemas.select(F.upper("category").alias("had"), F.lit(True).alias("had_known")).distinct()
    x = x.join(known, "own", "left").join(had_schema, "had", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    complete = flag("had_known") & flag("named") & flag("specified") & (F.coalesce("n_attributes", F.lit(0)) == 0) & F.col("corrected").isNull()
    takes = F.col("page_name").isNotNull() & flag("known") & ~complete
    head = x.select("record_id", F.when(takes, F.col("own")).otherwise(F.col("had")).alias("category"), takes.alias("takes"), (~takes | F.col("had").eqNullSafe(F.col("own"))).alias("same"))
    side = lambda df, name: df.where(named(F.col("value"))).select("record_id", "part", "field", F.col("value").alias(name))
    both = side(remote, "r").join(side(local, "l").hint("merge"), ["record_id", "part", "field"], "full").join(head.hint("merge"), "record_id")
    offer = F.col("part") == "offer"
    local_value, remote_value = F.when(F.col("takes"), F.col("l")), F.when(offer | F.col("same"), F.col("r"))
    ours = F.when(offer, local_value.isNotNull()).otherwise(remote_value.isNull())
    out = both.select("record_id", "category", "part", "field", F.when(ours, F.coalesce(local_value, remote_value)).otherwise(remote_value).alias("value"), F.when(ours & local_value.isNotNull(), "LOCAL").otherwise("REMOTE").alias("origin"))
    return out.where("value is not null")


def component_seeds(parts: DataFrame, catalogue: DataFrame, brands: list[str]) -> DataFrame:
    """record_id, category, name, brand, model: what to research of the parts (record_id, category, passages, hardware_id) of listings; parts without a seed give no row.

    A linked item (catalogue: hardware_id, name, brand, model) is its own seed. Else a processor's passages must agree on one model; of another
    part the first passage that speaks of it alone counts, if it gives a brand and a specific model that is no measure. Passages
    that leave the part open give none. Passages are judged as rows, so that their number costs no more than a shuffle of hints.
    """
    fixed = parts.where(~F.exists("passages", lambda p: F.coalesce(p.rlike(OPEN), F.lit(False))) | F.col("passages").isNull())
    link = lambda alone: F.struct(F.col("hardware_id").cast("string").alias("id"), alone.cast("string").alias("alone")).alias("_link")  # noqa: E731  (parts without a link are no hot key)
    items = catalogue.where("hardware_id is not null").select(link(F.lit(None)), F.struct("name", "brand", "model").alias("item"))
    linked = fixed.withColumn("_link", link(F.when(F.col("hardware_id").isNull(), F.col("record_id")))).join(items.hint("merge"), "_link", "left")
    direct = linked.where("item is not null").select("record_id", "category", "item.*")
    told = linked.where("item is null").select("record_id", "category", F.posexplode("passages").alias("pos", "p"))
    cpu = F.col("category") == "PROCESSADOR"
    alone = F.size(F.filter(F.array(*(F.when(F.col("p").rlike(pattern), F.lit(name)) for name, pattern in products.PARTS)), lambda n: n.isNotNull())) == 1
    fits = F.coalesce(*(F.when(F.col("category") == name, F.col("p").rlike(pattern)) for name, pattern in products.PARTS), F.lit(False))
    bare = S.clean(F.when(cpu, F.col("p")).otherwise(F.regexp_replace("p", LABEL, "")))
    maker = F.coalesce(*(F.when(F.col("name").rlike(rf"(?i)(?<![a-z0-9]){re.escape(b)}(?![a-z0-9])"), F.lit(b)) for b in brands), F.lit(None).cast("string"))
    named = S.apart(S.apart(told.where(cpu | (alone & fits)).withColumn("name", bare)).withColumn("maker", maker))
    exact = products.research_identity(F.col("category"), F.col("name"), F.col("maker"))
    rest = products.inferred(F.col("name"), F.col("category"), F.col("maker"), brands)
    hint = named.withColumn("h", F.when(exact.isNotNull(), F.struct(exact["brand"].alias("brand"), exact["model"].alias("model"))).otherwise(F.struct(rest["brand"].alias("brand"), rest["model"].alias("model"))))
    hint = S.apart(hint).where("h.brand is not null and h.model is not null")
    good = F.when(cpu, F.col("h.model").rlike(PROCESSOR)).otherwise(identity.model_is_specific(F.col("h.model")) & ~(F.col("category").isin(*MEASURED) & F.col("h.model").rlike(MEASURE)))
    best = hint.where(good).groupBy("record_id", "category").agg(F.min_by(F.struct("name", "h.brand", "h.model"), "pos").alias("s"), F.countDistinct(F.lower("h.model")).alias("n"))
    found = best.where(~cpu | (F.col("n") == 1)).select("record_id", "category", F.when(cpu, F.concat_ws(" ", "s.brand", "s.model")).otherwise(F.col("s.name")).alias("name"), "s.brand", "s.model")
    return direct.unionByName(found)


def labelled_memory(attributes: Column) -> Column:
    """Attributes (array of name, value) with a pair `Memory Types` after them where none is told and a row's name is a rate of memory: the first such row."""
    empty = F.array().cast("array<struct<name:string,value:string>>")

    def add(rows: Column) -> Column:
        has = F.exists(rows, lambda a: F.coalesce(F.lower(a["name"]).isin(*MEMORY_LABELS), F.lit(False)))
        first = F.get(F.filter(F.transform(rows, lambda a: F.trim(a["name"])), lambda n: n.rlike(MEMORY_ROW)), F.lit(0))
        made = F.struct(F.lit("Memory Types").alias("name"), F.concat(F.upper(F.regexp_extract(first, MEMORY_ROW, 1)), F.lit("-"), F.regexp_extract(first, MEMORY_ROW, 2)).alias("value"))
        return F.when(has | first.isNull(), rows).otherwise(F.concat(rows, F.array(made)))

    return S.let(F.coalesce(attributes, empty), add)
