"""Grounded claims against a plain search of every line, with one address that holds most of them."""

import random

from pyspark.sql import functions as F

from shelfmark.operators import evidence


def test_claims_stand_in_lines_of_their_address(spark):
    rng = random.Random(11)
    words = ["ram", "16", "gb", "ddr5", "socket", "am5", "x", "clock:"]
    lines = [(rng.choice(["hot", "hot", "hot", "cold", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for _ in range(150)] + [("hot", None), ("hot", ""), ("hot", "  RAM   16\tGB ")]
    claims = []
    for i in range(300):
        line = rng.choice(lines)[1] or "none"
        start = rng.randrange(len(line))
        claims.append((i, "f", "v", rng.choice(["hot", "hot", "cold", "none", None]), rng.choice([line[start : start + rng.randrange(1, 25)], line.upper(), line.replace(" ", "   "), "ram 16 gb ddr4", "", None])))
    norm = lambda s: " ".join(s.split()).lower()
    want = {i: bool(p and norm(p)) and any(u is not None and u == url and line is not None and norm(p) in norm(line) for u, line in lines) for i, _, _, url, p in claims}
    asked = spark.createDataFrame(claims, "claim_id int, field string, value string, url string, passage string")
    table = spark.createDataFrame(lines, "url string, line string")
    got = {r.claim_id: r.grounded for r in evidence.grounded(asked, table, lambda field, passage: F.lit("v")).collect()}
    assert got == want and 30 < sum(got.values()) < 290
    assert not any(r.grounded for r in evidence.grounded(asked, table.limit(0), lambda field, passage: F.lit("v")).collect())
