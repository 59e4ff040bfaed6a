"""Unit texts as rows: symbols with prefix and power, joined to a table of units, dimensions summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes as powers of ten: fixed values of the international system.
PREFIXES = {"p": -12, "n": -9, "u": -6, "m": -3, "c": -2, "d": -1, "k": 3, "M": 6, "G": 9, "T": 12}
BASE = ("m", "kg", "s", "A", "K", "mol")
#: symbol, factor, power of ten, exponents of BASE: fixed values of the international system and units used beside it.
UNITS = (
    ("m", 1.0, 0, 1, 0, 0, 0, 0, 0), ("g", 1.0, -3, 0, 1, 0, 0, 0, 0), ("s", 1.0, 0, 0, 0, 1, 0, 0, 0), ("A", 1.0, 0, 0, 0, 0, 1, 0, 0), ("K", 1.0, 0, 0, 0, 0, 0, 1, 0), ("mol", 1.0, 0, 0, 0, 0, 0, 0, 1),
    ("N", 1.0, 0, 1, 1, -2, 0, 0, 0), ("J", 1.0, 0, 2, 1, -2, 0, 0, 0), ("W", 1.0, 0, 2, 1, -3, 0, 0, 0), ("Pa", 1.0, 0, -1, 1, -2, 0, 0, 0), ("Hz", 1.0, 0, 0, 0, -1, 0, 0, 0),
    ("C", 1.0, 0, 0, 0, 1, 1, 0, 0), ("V", 1.0, 0, 2, 1, -3, -1, 0, 0), ("F", 1.0, 0, -2, -1, 4, 2, 0, 0), ("ohm", 1.0, 0, 2, 1, -3, -2, 0, 0), ("S", 1.0, 0, -2, -1, 3, 2, 0, 0),
    ("H", 1.0, 0, 2, 1, -2, -2, 0, 0), ("T", 1.0, 0, 0, 1, -2, -1, 0, 0), ("Wb", 1.0, 0, 2, 1, -2, -1, 0, 0), ("rad", 1.0, 0, 0, 0, 0, 0, 0, 0),
    ("min", 60.0, 0, 0, 0, 1, 0, 0, 0), ("h", 3600.0, 0, 0, 0, 1, 0, 0, 0), ("L", 1.0, -3, 3, 0, 0, 0, 0, 0), ("t", 1.0, 3, 0, 1, 0, 0, 0, 0), ("bar", 1.0, 5, -1, 1, -2, 0, 0, 0),
    ("eV", 1.602176634, -19, 2, 1, -2, 0, 0, 0), ("cal", 4.184, 0, 2, 1, -2, 0, 0, 0),
)
_COLUMNS = ("symbol", "factor", "ten", *BASE)
#: An operator, a name, a power.
TOKEN = r"([*/.·]?)([A-Za-z]+)(?:\^?\(?([+-]?[0-9]+)\)?)?"


def tidied(unit: Column) -> Column:
    """Without white space, brackets around it, and with one spelling of micro and ohm."""
    bare = F.regexp_replace(F.regexp_replace(unit, r"\s+", ""), r"^[\[(]+|[\])]+$", "")
    return F.regexp_replace(F.regexp_replace(bare, "[μµ]", "u"), "Ω|[Oo]hms?", "ohm")


def symbols(units: DataFrame, unit: str) -> DataFrame:
    """unit, place, name, power: one row a symbol of each different unit; a unit that isn't made of symbols has one without a name."""
    text = tidied(F.col(unit))
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    whole = (F.array_join(tokens, "") == text) & ~text.rlike(r"^[*/.·]") & (text != "")
    rows = units.where(F.col(unit).isNotNull()).select(unit).distinct().select(F.col(unit).alias("unit"), F.posexplode(F.when(whole, tokens).otherwise(F.array(F.lit("")))).alias("place", "token"))
    digits = F.regexp_extract("token", TOKEN, 3)
    power = F.when(digits == "", 1).otherwise(digits.try_cast("int"))  # null for one that no integer holds
    return rows.select("unit", "place", F.regexp_extract("token", TOKEN, 2).alias("name"), F.when(F.col("token").startswith("/"), -power).otherwise(power).alias("power"))


def dimensions(units: DataFrame, unit: str) -> DataFrame:
    """unit, factor, ten (its value is factor * 10 ^ ten) and the exponents of BASE, for each different unit of which all symbols are known.

    A name is a unit, or else a prefix and a unit; both are joins with the table of units, which is a few rows and broadcast."""
    known = units.sparkSession.createDataFrame(list(UNITS), "symbol string, factor double, ten int, " + ", ".join(f"`{b}` int" for b in BASE))
    rows = symbols(units, unit)
    plain, prefixed = (known.toDF(*[f"{side}_{c}" for c in _COLUMNS]) for side in ("plain", "prefixed"))
    rows = rows.join(F.broadcast(plain), F.col("name") == F.col("plain_symbol"), "left")
    prefix = F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[F.substring("name", 1, 1)]
    rows = rows.join(F.broadcast(prefixed), (F.expr("substring(name, 2)") == F.col("prefixed_symbol")) & prefix.isNotNull(), "left")
    found = {c: F.coalesce(f"plain_{c}", f"prefixed_{c}") for c in _COLUMNS}
    found["ten"] = F.coalesce("plain_ten", F.col("prefixed_ten") + prefix)
    sums = [F.sum(found[c] * F.col("power")).cast("int").alias(c) for c in ("ten", *BASE)]
    out = rows.groupBy("unit").agg(F.bool_and(found["symbol"].isNotNull() & F.col("power").isNotNull()).alias("known"), F.product(F.pow(found["factor"], F.col("power"))).alias("factor"), *sums)
    return out.where("known").drop("known")


def converted(rows: DataFrame, unit: str, into: str) -> DataFrame:
    """rows with alike (both units are known and of one dimension; null where one is unknown or null), and what a number in unit is multiplied with
    to be one in into: ratio * 10 ^ ten (null unless alike). Each different unit is worked out once."""
    asked = rows.select(F.explode(F.array(unit, into)).alias("unit"))
    known = dimensions(asked, "unit")
    sides = [known.toDF(*[f"__{side}_{c}" for c in known.columns]) for side in ("a", "b")]
    both = rows.join(sides[0], F.col(unit) == F.col("__a_unit"), "left").join(sides[1], F.col(into) == F.col("__b_unit"), "left")
    same = F.struct(*[f"__a_{b}" for b in BASE]) == F.struct(*[f"__b_{b}" for b in BASE])
    alike = F.when(F.col("__a_unit").isNotNull() & F.col("__b_unit").isNotNull(), same)
    return both.select(*[f"`{c}`" for c in rows.columns], alike.alias("alike"), F.when(alike, F.col("__a_factor") / F.col("__b_factor")).alias("ratio"), F.when(alike, F.col("__a_ten") - F.col("__b_ten")).alias("ten"))
