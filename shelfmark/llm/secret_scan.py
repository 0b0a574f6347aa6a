"""Secret scans over an incremental ledger of blobs (DataFrame functions only).

Every version of every text is addressed by the SHA-256 of its content: a blob. The ledger is one append-only Parquet table
in a shared folder; a row says of a blob which rules, in which versions, were run on it and what they found. `scan` reads
the texts of those blobs only that miss a rule version, once each, however many paths and versions hold them, and appends
what it finds in one write (so a lost executor or driver leaves no half-written scan). `report` joins the findings
to every path. A new rule, or a new version of one, scans the known blobs with that rule only.

A rule is a pattern and a least length; its matches are the leftmost ones that don't overlap, and those that are too short are
dropped. Where a match is a whole run of its letters, its least length stands in the pattern instead: a shorter run holds no other match. Places are found by splitting the text at the matches and adding up lengths, in code points.

Edge cases: a null text is an empty one, without findings. Repeated rows share their blob and each get its findings. Ties (spans that
begin together) are ordered by the rules' order. Columns beside `text` are carried by name, whatever their names; one with the name of a
result is replaced by it. An empty table appends nothing and reports nothing. Findings of a blob are one row: a single text's are held together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0  # the part of the match whose length counts

    @property
    def id(self) -> str:
        return f"{self.kind}/{self.version}"


BASE = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
FURTHER = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("userinfo", 1, r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + FURTHER
LEDGER = "blob binary, rules array<string>, findings array<struct<rule: string, start: long, end: long>>"
#: Up to so many blobs to scan are broadcast (32 bytes and the rules' names each) to keep the texts of all others out of the shuffle.
FEW_BLOBS = 100_000


def address(text: Column) -> Column:
    """The blob of a text: its SHA-256, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _matches(rule: Rule, text: Column, todo: Column) -> Column:
    """Null, or the rule's matches and the lengths of the pieces between them."""
    hit = F.array_contains(todo, rule.id) & text.rlike(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda piece: F.length(piece).cast("long"))
    value = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.struct(F.length(m).cast("long").alias("size"), (value(m) >= rule.least).alias("whole")))
    return F.when(hit, F.struct(F.lit(rule.id).alias("rule"), F.zip_with(sizes, gaps, lambda m, gap: F.struct(gap.alias("gap"), m["size"].alias("size"), m["whole"].alias("whole"))).alias("each")))


def found_in(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of the ledger for (blob, text, todo): todo's rules run on each text. Rows of a blob stay where they are."""
    hits = blobs.select("blob", "todo", F.array_compact(F.array(*(_matches(r, F.col("text"), F.col("todo")) for r in rules))).alias("_hits"))
    by_rule = hits.select("blob", "todo", F.explode_outer("_hits").alias("_hit"))
    one = by_rule.select("blob", "todo", F.col("_hit.rule").alias("rule"), F.posexplode_outer("_hit.each").alias("_i", "_m")).where("_m.size is not null or rule is null")
    so_far = Window.partitionBy("blob", "rule").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("end", F.sum(F.col("_m.gap") + F.col("_m.size")).over(so_far))
    span = F.struct("rule", (F.col("end") - F.col("_m.size")).alias("start"), "end")
    return placed.groupBy("blob").agg(F.first("todo").alias("rules"), F.collect_list(F.when(F.col("_m.whole"), span)).alias("findings"))


class Ledger:
    """The ledger in `folder`, which all executors share; made if there is none."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.range(0).selectExpr(*(f"cast(null as {kind}) as {name}" for name, kind in (c.split(" ", 1) for c in LEDGER.split(", ", 2)))).write.mode("append").parquet(folder)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def unseen(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and todo: the blobs of docs that miss rule versions, and which."""
        seen = self.rows().select("blob", F.explode("rules").alias("_rule")).groupBy("blob").agg(F.collect_set("_rule").alias("_seen"))
        blobs = docs.select(address(F.col("text")).alias("blob")).distinct()
        missing = F.array_except(F.array(*(F.lit(r.id) for r in rules)), F.coalesce("_seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").select("blob", missing.alias("todo")).where(F.size("todo") > 0)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Runs on every blob the rule versions that it misses and appends what they find."""
        texts = docs.select(address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        once = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
        if self.rows().isEmpty():
            blobs = once(texts).withColumn("todo", F.array(*(F.lit(r.id) for r in rules)))
        else:
            todo = cut(self.unseen(docs, rules))
            few = todo.count() <= FEW_BLOBS
            blobs = once(texts.join(F.broadcast(todo.select("blob")), "blob", "left_semi") if few else texts).join(todo, "blob")
        found_in(blobs, rules).write.mode("append").parquet(self.folder)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob and spans (kind, start, end, by start, then as the rules stand), one row a blob that has any."""
        flat = self.rows().where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f"))
        wanted = flat.where(F.col("f.rule").isin(*(r.id for r in rules)))
        rank = F.array_position(F.array(*(F.lit(r.id) for r in rules)), F.col("f.rule"))
        span = F.struct(F.col("f.start").alias("start"), rank.alias("rank"), F.substring_index("f.rule", "/", 1).alias("kind"), F.col("f.end").alias("end"))
        grouped = wanted.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))
        return grouped.select("blob", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))

    def report(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The carried columns of every row and `spans`, all findings of the rules in its text (scanned before).

        A blob that many rows share is a hot key of this left join; its side is short rows, and Spark splits it.
        """
        paths = docs.select(F.struct(*carry).alias("_carried"), address(F.col("text")).alias("blob"))
        none = F.array().cast("array<struct<kind: string, start: long, end: long>>")
        held = [F.col("_carried")[c].alias(c) for c in carry if c != "spans"]
        return paths.join(self.findings(rules), "blob", "left").select(*held, F.coalesce("spans", none).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
