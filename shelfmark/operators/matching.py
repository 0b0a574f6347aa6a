"""Matching records against a catalogue by keyed equi-joins; never by comparing every pair."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def _keyed(rows: DataFrame, id_column: str, prefix: str) -> DataFrame:
    c = lambda name: F.col(name)
    return rows.select(
        F.col(id_column).alias(f"{prefix}_id"), S.key(c("brand")).alias(f"{prefix}_brand"), S.key(c("model")).alias(f"{prefix}_model"),
        S.key(c("mpn")).alias(f"{prefix}_mpn"), S.digits(c("gtin")).alias(f"{prefix}_gtin"),
    )


def candidate_pairs(incoming: DataFrame, catalogue: DataFrame, incoming_id: str = "id", catalogue_id: str = "id") -> DataFrame:
    """a_id, b_id, score, conflict: of each pair that shares a key the first rung that holds.

    GTIN 100 and part number 95 hold for compatible brands (a missing brand is compatible), else the pair is an
    identity conflict and no match; brand and model 90. Different GTINs only pass the pair on to the next rung.
    Three equi-joins, unioned; a pair is judged once, by its strongest rung.
    """
    a, b = _keyed(incoming, incoming_id, "a"), _keyed(catalogue, catalogue_id, "b")
    compatible = F.col("a_brand").isNull() | F.col("b_brand").isNull() | (F.col("a_brand") == F.col("b_brand"))
    keys = lambda on, score: a.join(b.hint("merge"), on).select("a_id", "b_id", F.lit(score).alias("score"), (~compatible if score > 90 else F.lit(False)).alias("conflict"))
    found = keys(F.col("a_gtin") == F.col("b_gtin"), 100)
    found = found.union(keys(F.col("a_mpn") == F.col("b_mpn"), 95))
    found = found.union(keys((F.col("a_brand") == F.col("b_brand")) & (F.col("a_model") == F.col("b_model")), 90))
    return found.groupBy("a_id", "b_id").agg(F.max(F.struct("score", "conflict")).alias("top")).select("a_id", "b_id", "top.score", "top.conflict")


def match_records(incoming: DataFrame, catalogue: DataFrame, incoming_id: str = "id", catalogue_id: str = "id") -> DataFrame:
    """a_id, status (MATCH, AMBIGUOUS, NONE), match_id, score, n_candidates, n_conflicts: one row an incoming record."""
    pairs = candidate_pairs(incoming, catalogue, incoming_id, catalogue_id)
    fine = ~F.col("conflict")
    best = pairs.groupBy("a_id").agg(
        F.count_if(fine).alias("n_candidates"),
        F.count_if(F.col("conflict")).alias("n_conflicts"),
        F.min(F.when(fine, F.struct((-F.col("score")).alias("s"), F.col("b_id")))).alias("best"),
    )
    rows = incoming.select(F.col(incoming_id).alias("a_id")).join(best.hint("merge"), "a_id", "left")
    n = F.coalesce("n_candidates", F.lit(0))
    return rows.select(
        "a_id",
        F.when(n == 1, "MATCH").when(n > 1, "AMBIGUOUS").otherwise("NONE").alias("status"),
        F.when(n == 1, F.col("best.b_id")).alias("match_id"),
        F.coalesce(-F.col("best.s"), F.lit(0)).alias("score"),
        n.alias("n_candidates"),
        F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"),
    )


def match_offers(incoming: DataFrame, offers: DataFrame) -> DataFrame:
    """incoming (row_id, product_id, partner_id, url) with status and offer_id: one equal offer is a match, several are ambiguous."""
    k = ["product_id", "partner_id", "k"]
    keyed = S.apart(offers.select("offer_id", "product_id", "partner_id", S.canonical_url(F.col("url")).alias("k")))  # the join's filter on k is no second reading of each address
    found = keyed.groupBy(*k).agg(F.count("*").alias("n"), F.min("offer_id").alias("offer_id"))
    rows = incoming.withColumn("k", S.canonical_url(F.col("url"))).join(found.hint("merge"), k, "left")
    return rows.select("row_id", F.when(F.col("n") == 1, "MATCH").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NONE").alias("status"), F.when(F.col("n") == 1, F.col("offer_id")).alias("offer_id"))


#: Words that name a platform in a partner's name, slug or domain.
PLATFORM_WORDS = {"MERCADO_LIVRE": ("mercadolivre", "mercadolivrebrasil", "mercadolibre"), "MAGALU": ("magalu", "magazineluiza", "magazinevoce"), "SHOPEE": ("shopee",), "KABUM": ("kabum",), "PICHAU": ("pichau",), "TERABYTE": ("terabyte", "terabyteshop")}


def partner_by_domain(rows: DataFrame, partners: DataFrame, url: str = "url", platform: str | None = None) -> DataFrame:
    """rows with partner_id: the first partner (by pos) whose domain is a suffix of the row's host or the other way round.

    With `platform`, rows that have none get the first partner one of whose names (columns name, slug, domain) holds a word of
    their platform. Suffixes are equi-joined; the words are a fixed list laid beside each partner.
    """
    def suffixes(c: Column) -> Column:
        split = F.split(c, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(split)), lambda i: F.array_join(F.slice(split, i, F.size(split)), "."))

    known = partners.withColumn("d", S.host(F.concat(F.lit("https://"), F.col("domain")))).select("partner_id", "pos", "d")
    hosts = rows.select(S.host(F.col(url)).alias("h")).where("h is not null").distinct()
    shorter = hosts.select("h", F.explode(suffixes(F.col("h"))).alias("d")).join(known, "d")
    longer = known.where("d is not null").select("partner_id", "pos", F.explode(suffixes(F.col("d"))).alias("h")).join(hosts, "h")
    found = shorter.select("h", "partner_id", "pos").union(longer.select("h", "partner_id", "pos")).groupBy("h").agg(F.min_by("partner_id", "pos").alias("partner_id"))
    out = rows.withColumn("h", S.host(F.col(url))).join(found, "h", "left").drop("h")
    if platform is None:
        return out
    words = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(w).alias("w")) for p, ws in PLATFORM_WORDS.items() for w in ws))).alias("x")
    names = [F.coalesce(S.key(F.col(c)), F.lit("")) for c in ("name", "slug", "domain")]
    worded = partners.select("partner_id", "pos", *(n.alias(f"n{i}") for i, n in enumerate(names)), words).where("contains(n0, x.w) or contains(n1, x.w) or contains(n2, x.w)")
    by_word = worded.groupBy(F.col("x.p").alias("p")).agg(F.min_by("partner_id", "pos").alias("worded"))
    return out.join(by_word, out[platform] == by_word["p"], "left").withColumn("partner_id", F.coalesce("partner_id", "worded")).drop("p", "worded")


def exclude_registered(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """Candidates (name, brand, model) that are not registered under the same name or the same brand and model."""
    by_name = registered.select(S.key(F.col("name")).alias("_n")).where("_n is not null").distinct()
    by_model = registered.select(S.key(F.col("brand")).alias("_b"), S.key(F.col("model")).alias("_m")).where("_b is not null and _m is not null").distinct()
    rows = candidates.join(by_name.hint("merge"), S.key(F.col("name")) == F.col("_n"), "left_anti")
    return rows.join(by_model.hint("merge"), (S.key(F.col("brand")) == F.col("_b")) & (S.key(F.col("model")) == F.col("_m")), "left_anti")


def linked_product(rows: DataFrame) -> DataFrame:
    """rows with product_id: the linked product if there is one, else the matched one."""
    return rows.withColumn("product_id", F.coalesce("linked_product_id", "matched_product_id"))


def similar_names(rows: DataFrame, other: DataFrame, least: float = 0.94) -> DataFrame:
    """a_id, b_id, ratio of same-brand names whose matching-blocks ratio is at least `least`: candidates only, never matches.

    Blocked on brand and an exact bound: the ratio leaves at most d = (1 - least) * (both lengths) characters outside the
    matching blocks. A name a is cut into as many segments and one more, so one of them stands whole in b, moved by no
    more than d allows: an equi-join on length of a, segment number and segment. Then bags of characters are compared, then the ratio.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = (SequenceMatcher(None, x, y) for x, y in zip(a, b, strict=True))
        return pd.Series([m.ratio() if m.quick_ratio() >= least else 0.0 for m in pairs], dtype="float64")

    slack, longer = f"{1 - least!r}D", f"{(2 - least) / least!r}D"  # 1e-9 against rounding: never a pair too few
    n_parts = lambda n: f"(1 + cast(floor({slack} * ({n} + floor({n} * {longer} + 1e-9D)) + 1e-9D) as int))"
    side = lambda df, p: df.select(F.col("id").alias(f"{p}_id"), S.key(F.col("brand")).alias(f"{p}_brand"), S.key(F.col("name")).alias(f"{p}_name")).where(f"{p}_brand is not null and {p}_name is not null")
    a = side(rows, "a").withColumn("n", F.length("a_name")).withColumn("m", F.expr(n_parts("n")))
    a = a.withColumn("i", F.explode(F.expr("sequence(0, m - 1)"))).withColumn("part", F.expr("substring(a_name, n * i div m + 1, n * (i + 1) div m - n * i div m)"))
    b = side(other, "b").withColumn("nb", F.length("b_name"))
    b = b.withColumn("n", F.explode(F.expr(f"sequence(cast(ceil(nb / {longer} - 1e-9D) as int), cast(floor(nb * {longer} + 1e-9D) as int))"))).withColumn("m", F.expr(n_parts("n")))
    b = b.withColumn("d", F.expr(f"cast(floor({slack} * (n + nb) + 1e-9D) as int)")).withColumn("i", F.explode(F.expr("sequence(0, m - 1)")))
    b = b.withColumn("start", F.expr("n * i div m")).withColumn("size", F.expr("n * (i + 1) div m - start"))
    places = "filter(sequence(cast(ceil((nb - n - d) / 2) as int), cast(floor((nb - n + d) / 2) as int)), s -> start + s >= 0 and start + s + size <= nb)"
    b = b.withColumn("part", F.explode(F.expr(f"array_distinct(transform({places}, s -> substring(b_name, cast(start + s + 1 as int), cast(size as int))))")))
    on = (F.col("a_brand") == F.col("b_brand")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.part") == F.col("b.part"))
    pairs = a.alias("a").join(b.alias("b"), on).select("a_id", "a_name", "b_id", "b_name").distinct()
    return pairs.withColumn("ratio", ratio("a_name", "b_name")).where(F.col("ratio") >= least).select("a_id", "b_id", "ratio")


def similar_classes(rows: DataFrame, least: float = 0.94) -> DataFrame:
    """kind, a_id, b_id, ratio: a MEMBER row gives each id (b_id) its class, the smallest id (a_id) of the same brand and name;
    a SIMILAR row links two classes of similar names. Rows without brand or name are a class each."""
    named = rows.where("brand is not null and name is not null")
    classes = named.groupBy("brand", "name").agg(F.min("id").alias("id"))
    of = named.select("id", "brand", "name").join(classes.withColumnRenamed("id", "a_id").hint("merge"), ["brand", "name"]).select("a_id", F.col("id").alias("b_id"))
    alone = rows.where("brand is null or name is null").select(F.col("id").alias("a_id"), F.col("id").alias("b_id"))
    members = of.union(alone).select(F.lit("MEMBER").alias("kind"), "a_id", "b_id", F.lit(1.0).alias("ratio"))
    return members.union(similar_names(classes, classes, least).where("a_id < b_id").select(F.lit("SIMILAR"), "a_id", "b_id", "ratio"))


def rank_offers(pairs: DataFrame, by: list, keep: int) -> DataFrame:
    """The first `keep` rows of each a_id in the given order, with their rank."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy(*by))).where(F.col("rank") <= keep)
