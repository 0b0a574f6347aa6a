"""Fill-in-the-middle: each text is cut into prefix, middle and suffix by one counted-quantifier regex.

`regexp_count` gives the number n of units in the text, hashes of the row's key give two cuts a <= b, and a pattern made for
the row, `\\A(unit{a}+)(unit{b-a}+)(.*+)`, captures all three parts in one match: the quantifiers are counted and
possessive, so the match goes over the text once and never back. The replacement writes the parts in the order of the row's
form. Everything is a projection: no shuffle, and a text meets no other row.

Units are matched from left to right over code points: code points (the default), words with the blanks behind them, lines.
What no unit covers (blanks before the first word) falls to the part in which it stands last, the suffix, or stays before it.

Edge cases: a null text is empty; an empty text, and one that holds a mark, stays plain, since marks in it could not be
told from those put in. A null key counts as an empty one. Rows that share key and text are cut alike. Carried columns keep
their values; one with the name of a result is replaced by it. An empty table gives an empty table. While a row's units are counted
they are held one by one (some 60 bytes each), so the longest text must fit a task so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = "."
WORD = r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"
LINE = r"(?:[^\n]*\n|[^\n]+)"
MARKS = ("<P>", "<S>", "<M>")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


def _checked(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they are put: no end of one may begin another."""
    ends = {m[i:] for m in marks for i in range(1, len(m))}
    begins = {m[:i] for m in marks for i in range(1, len(m) + 1)}
    if len(set(marks)) < 3 or not all(marks) or ends & begins or any(a != b and a in b for a in marks for b in marks):
        raise ValueError(f"marks overlap: {marks}")


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def _holds(text: Column, marks: tuple[str, str, str]) -> Column:
    return text.contains(marks[0]) | text.contains(marks[1]) | text.contains(marks[2])


def transform(
    docs: DataFrame, key: str = "doc_id", carry: tuple[str, ...] = ("doc_id", "text"), unit: str = CODE_POINT, seed: int = 1,
    plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """The carried columns, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every text."""
    _checked(marks)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    number = lambda i: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long")
    counted = docs.select(
        F.struct(*(F.col(c) for c in carry)).alias("_carried"), text.alias("_text"), digest.alias("_digest"),
        F.regexp_count(text, F.lit(f"(?s){unit}")).cast("long").alias("n"),
    )
    plain = (F.col("_text") == "") | _holds(F.col("_text"), marks) | (number(2) % 100 >= 100 - plain_percent)
    cuts = counted.select(
        "_carried", "_text", "n",
        F.when(plain, "plain").when(number(3) % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        F.least(number(0) % (F.col("n") + 1), number(1) % (F.col("n") + 1)).alias("_a"),
        F.greatest(number(0) % (F.col("n") + 1), number(1) % (F.col("n") + 1)).alias("_b"),
    )
    pattern = F.concat(F.lit(rf"(?s)\A({unit}{{"), F.col("_a"), F.lit(rf"}}+)({unit}{{"), F.col("_b") - F.col("_a"), F.lit(r"}+)(.*+)"))
    p, s, m = (x.replace("\\", r"\\").replace("$", r"\$") for x in marks)
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    made = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    cut = F.col("form") != "plain"
    kept = [F.col("_carried")[c].alias(c) for c in carry if c not in RESULTS]
    return cuts.select(
        *kept, "n", "form", F.when(cut, F.col("_a")).alias("prefix_chars"), F.when(cut, F.col("_b") - F.col("_a")).alias("middle_chars"), made.alias("output")
    )


def restore(made: DataFrame, to: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """The rows with the text rebuilt, from output and form alone."""
    _checked(marks)
    p, s, m = map(_quoted, marks)
    psm = F.regexp_replace("output", F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)"), F.lit("$1$3$2"))
    spm = F.regexp_replace("output", F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)"), F.lit("$2$3$1"))
    return made.withColumn(to, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))
