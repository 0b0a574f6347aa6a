"""Sheets as trees: what an incoming sheet adds to a stored one, at any depth down to DEEPEST, with dotted paths of gaps filled and of conflicts.

Both trees of a record meet in one join and are taken apart inside the row, level by level; nothing else is shuffled. Lists are
compared and taken whole: merging them item by item would make up slots and supports. System keys are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Keys that the store keeps for itself.
SYSTEM_KEYS = ("id", "hardwareId", "produtoId", "criadoEm", "atualizadoEm", "createdAt", "updatedAt", "slug", "_count")
#: Objects below this depth are values as a whole.
DEEPEST = 8
_DOT = "\u0001"
NODE = "struct<parent string, path string, key string, is_object boolean, missing boolean, json string>"


def _quoted(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def _children(parent: Column | None, value: Column) -> Column:
    """The nodes right below an object, an array of NODE."""
    entries = F.map_entries(F.from_json(value, "map<string,string>", {"allowUnquotedControlChars": "true"}))
    kinds = F.from_json(value, "map<string,variant>")

    def node(e: Column) -> Column:
        path = e["key"] if parent is None else F.concat_ws(_DOT, parent, e["key"])
        kind = F.schema_of_variant(F.try_element_at(kinds, e["key"]))
        json = F.when(e["value"].isNull(), "null").when(kind == "STRING", _quoted(e["value"])).otherwise(e["value"])
        missing = e["value"].isNull() | F.regexp_replace(json, r"\s+", "").isin('""', "[]", "null")
        return F.struct((F.lit("") if parent is None else parent).alias("parent"), path.alias("path"), e["key"].alias("key"), kind.startswith("OBJECT").alias("is_object"), missing.alias("missing"), json.alias("json"))

    kept = F.filter(entries, lambda e: ~e["key"].isin(*SYSTEM_KEYS) & ~e["key"].startswith("_"))
    return F.coalesce(F.transform(kept, node), F.array().cast(f"array<{NODE}>"))


def _levels(rows: DataFrame, sheet: str, to: str) -> DataFrame:
    """Adds to1 to toDEEPEST: the nodes of each depth."""
    rows = rows.withColumn(f"{to}1", _children(None, F.col(sheet)))
    for depth in range(2, DEEPEST + 1):
        rows = rows.withColumn(f"{to}{depth}", F.flatten(F.transform(F.filter(f"{to}{depth - 1}", lambda n: n["is_object"]), lambda n: _children(n["path"], n["json"]))))
    return rows


def merge_nested(stored: DataFrame, incoming: DataFrame, key: str = "record_id", sheet: str = "sheet") -> DataFrame:
    """key, merged, filled, conflicts of every record on either side (sheet: a JSON object as text; null is an empty one).

    filled: paths where nothing stood, the topmost of a branch; conflicts: (path, stored, found) of values that differ, of which the stored one
    stays. Texts that differ in case or white space only are the same.
    """
    both = stored.select(key, F.col(sheet).alias("_old")).join(incoming.select(key, F.col(sheet).alias("_new")).hint("merge"), key, "full_outer")
    rows = _levels(_levels(both, "_old", "_o"), "_new", "_n")
    depths = range(1, DEEPEST + 1)
    rows = S.apart(rows.select(key, *(f"{s}{d}" for s in ("_o", "_n") for d in depths)))
    filled, conflicts = [], []
    for d in depths:
        o, n = F.col(f"_o{d}"), F.filter(f"_n{d}", lambda x: ~x["missing"])
        at = F.map_from_entries(F.transform(o, lambda x: F.struct(x["path"], x)))
        open_ = F.transform(F.filter(f"_o{d - 1}", lambda x: x["is_object"]), lambda x: x["path"]) if d > 1 else F.array(F.lit(""))
        rows = rows.withColumns({f"_at{d}": at, f"_open{d}": open_})
        old = lambda x: F.try_element_at(f"_at{d}", x["path"])  # noqa: B023, E731
        here = F.filter(n, lambda x: F.array_contains(f"_open{d}", x["parent"]))  # noqa: B023
        gap = lambda x: F.coalesce(old(x)["missing"], F.lit(True))  # noqa: B023, E731
        plain = lambda j: F.lower(F.trim(F.regexp_replace(j, r"\s+", " ")))
        clash = lambda x: ~gap(x) & ~(old(x)["is_object"] & x["is_object"]) & (plain(old(x)["json"]) != plain(x["json"]))  # noqa: B023, E731
        rows = rows.withColumns({f"_f{d}": F.transform(F.filter(here, gap), lambda x: x["path"]), f"_c{d}": F.transform(F.filter(here, clash), lambda x: F.struct(x["path"].alias("path"), old(x)["json"].alias("stored"), x["json"].alias("found")))})  # noqa: B023
        filled.append(f"_f{d}")
        conflicts.append(f"_c{d}")
    rows = rows.withColumns({"_filled": F.concat(*filled), "_conflicts": F.concat(*conflicts)})
    rows = S.apart(rows.select(key, "_filled", "_conflicts", *(f"{s}{d}" for s in ("_o", "_n") for d in depths)))
    # Rebuilt from below: of each depth the stored nodes that say something (or are not filled) and the incoming ones on filled branches.
    under = lambda x: F.exists("_filled", lambda f: (x["path"] == f) | x["path"].startswith(F.concat(f, F.lit(_DOT))))
    below = F.array().cast("array<struct<parent string, key string, json string>>")
    for d in reversed(depths):
        nodes = F.concat(F.filter(f"_o{d}", lambda x: ~F.array_contains("_filled", x["path"])), F.filter(f"_n{d}", under))
        inner = lambda x: F.array_join(F.transform(F.filter("_below", lambda c: c["parent"] == x["path"]), lambda c: F.concat(_quoted(c["key"]), F.lit(":"), c["json"])), ",")
        whole = lambda x: x["json"] if d == DEEPEST else F.when(x["is_object"], F.concat(F.lit("{"), inner(x), F.lit("}"))).otherwise(x["json"])  # noqa: B023, E731
        rows = rows.withColumn("_below", below) if d == DEEPEST else rows
        made = F.transform(nodes, lambda x: F.struct(x["parent"].alias("parent"), x["key"].alias("key"), whole(x).alias("json")))  # noqa: B023
        rows = rows.withColumn("_below", made)
    tree = F.concat(F.lit("{"), F.array_join(F.transform("_below", lambda c: F.concat(_quoted(c["key"]), F.lit(":"), c["json"])), ","), F.lit("}"))
    dotted = lambda c: F.replace(c, F.lit(_DOT), F.lit("."))
    return rows.select(
        key, tree.alias("merged"), F.array_sort(F.transform("_filled", dotted)).alias("filled"),
        F.array_sort(F.transform("_conflicts", lambda c: F.struct(dotted(c["path"]).alias("path"), c["stored"].alias("stored"), c["found"].alias("found")))).alias("conflicts"),
    )
