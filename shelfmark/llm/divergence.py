"""How far the sources of a language differ in their words, exactly: every pair of sources, and the words that mark each.

Identical texts of a language are first collapsed to one row with the number of copies each source has of it, so that a text is
tokenised once however often it stands. Tasks add up, for (lang, source, term), occurrences and documents weighted by those
numbers in bounded dictionaries, and Spark sums them. Terms in at least MIN_DOCS documents of the language are kept.

A group's p of a term depends on its count only. So a pair of sources is summed sparsely: what each has is held against the
other's p of a count of 0 by distinct counts, what neither has is one product, and only terms that both have are met, by a
join on (lang, term) whose rows are added up where they are made. All is integer or decimal arithmetic.

Edge cases: null text, lang and source are ''. Texts without terms still make their group occur; a language that keeps no
terms has pairs of value 0 and no terms. Repeated rows are documents like all others. Ties are ordered by the item's UTF-8 bytes.
Other columns are not read. An empty table gives an empty result. A single text is held whole by a task.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces, release

MIN_DOCS = 30
MARKED_TERMS = 50
#: Entries of a task's dictionaries before they are handed on: some 150 bytes each.
HELD_TERMS = 300_000
#: Rows of groups are dealt over so many parts of a join by language, since languages are few and one may hold most rows.
SALTS = 32
_TERM = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """The runs of ASCII letters and non-ASCII characters, with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split()


def collapsed(docs: DataFrame) -> DataFrame:
    """lang, text and copies (source, n): each distinct text of a language once.

    The texts are shuffled once, copies of a task as one; the numbers come from a second pass that shuffles hashes only. A text's
    sources, never its copies, are gathered.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").alias("text"))
    rows = rows.withColumn("blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    by_source = rows.groupBy("lang", "blob", "source").agg(F.count("*").alias("n"))
    copies = by_source.groupBy("lang", "blob").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.groupBy("lang", "blob").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "blob"]).select("lang", "text", "copies")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (lang, source, term) of the texts of a task, handed on whenever HELD_TERMS are held."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), held in counts.items():
            docs = documents[lang, source]
            names = list(held)
            yield pa.record_batch({
                "lang": pa.array([lang] * len(names), pa.string()), "source": pa.array([source] * len(names), pa.string()), "term": pa.array(names, pa.binary()).cast(pa.string()),
                "n": pa.array(list(held.values()), pa.int64()), "docs": pa.array([docs[t] for t in names], pa.int64()),
            })
        counts.clear()
        documents.clear()

    size = 0
    for batch in pieces(batches):
        for lang, text, copies in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            found = terms(text)
            once = set(found)
            alone = len(copies) == 1 and copies[0]["n"] == 1
            tallied = None if alone else Counter(found)
            for copy in copies:
                held, docs = counts[lang, copy["source"]], documents[lang, copy["source"]]
                size -= len(held)
                if alone:
                    held.update(found)
                    docs.update(once)
                else:
                    held.update(tallied if copy["n"] == 1 else {t: copy["n"] * n for t, n in tallied.items()})
                    docs.update(once if copy["n"] == 1 else dict.fromkeys(once, copy["n"]))
                size += len(held)
            if size >= HELD_TERMS:
                yield from flush()
                size = 0
    yield from flush()
    release()


def _share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * kinds)), in decimals: counts of a large corpus leave no room in 64 bits. Null without kept terms."""
    whole = (total + F.lit(5) * kinds).cast("decimal(20,0)")
    scaled = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + F.lit(5)).cast("decimal(20,0)")
    return F.when(kinds > 0, F.call_function("div", scaled, whole) + F.lit(1))


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n and lang_n (the language's count) of the kept terms that a group has."""
    rows = collapsed(docs).mapInArrow(_counted, COUNTS)
    summed = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    both = summed.withColumns({"lang_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    return both.where(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, marked: int = MARKED_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: see the module."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    kept = cut(kept_counts(docs, min_docs))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    of_lang = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("v"))
    named = docs.select(blank("lang").alias("lang"), blank("source").alias("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = named.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *map(zero, ("total", "kinds", "lang_total", "v")))
    groups = cut(groups.withColumn("floor", _share(F.lit(0), F.col("total"), F.col("v"))))  # floor: p of a count of 0

    sized = kept.join(groups, ["lang", "source"])
    shares = cut(sized.select(
        "lang", "source", "term", "n", "floor", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("lang_p"),
    ))
    found = _pairs(shares, groups).unionByName(_terms(shares, marked))
    return found.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Every two sources of a language and the sum of |p - q| over all kept terms."""
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).alias("salt")
    others = groups.select("lang", F.col("source").alias("item"), F.col("floor").alias("floor_2"), F.col("kinds").alias("kinds_2"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    differ = F.col("source") != F.col("item")
    # What neither has, less what both have (added again below).
    neither = groups.withColumn("salt", salt("source")).join(others, ["lang", "salt"]).where(differ).select(
        "lang", "source", "item", F.coalesce((F.col("v") - F.col("kinds") - F.col("kinds_2")) * F.abs(F.col("floor") - F.col("floor_2")), F.lit(0)).alias("value"),
    )
    # What the source has against the other's p of a count of 0, by distinct p.
    by_p = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    against = by_p.withColumn("salt", salt("source", "p")).join(others, ["lang", "salt"]).where(differ)
    against = against.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("floor_2"))).alias("value"))
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    # What both have, each two sources once.
    a = shares.select("lang", "term", "source", "p", "floor")
    b = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("floor").alias("floor_2"))
    more = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("floor_2")) - F.abs(F.col("q") - F.col("floor")) + F.abs(F.col("floor") - F.col("floor_2"))
    both = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(F.sum(more).alias("value"))
    parts = neither
    for part in (against, turned(against), both, turned(both)):
        parts = parts.unionByName(part)
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _terms(shares: DataFrame, marked: int) -> DataFrame:
    """The `marked` terms of each source that stand furthest above its language. Tasks pass on no more than that of a group."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where(F.col("p") > F.col("lang_p")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("lang_p")).alias("value"))
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= marked)
