"""JSON in free text: extraction, typed reads and repair of truncated replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(c: Column) -> Column:
    """The text as a variant; null if it is no JSON."""
    return F.try_parse_json(c)


def parses(c: Column) -> Column:
    """Whether the text is one value and nothing after it, which a parse alone would pass over."""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"value": '), c, F.lit(', "end": 0}'))), "$.end", "int").isNotNull()


def without_fence(c: Column) -> Column:
    """The text without a surrounding Markdown fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"(?s)^```(?:json)?\s*", ""), r"\s*```$", ""))


def fenced(c: Column) -> Column:
    """The body of the first Markdown fence, else null."""
    body = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body)


def outermost_object(c: Column) -> Column:
    """From the first { to the last }, else null."""
    body = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def any_object(c: Column) -> Column:
    """The first that parses: the fence's body, the outermost object, the text itself."""
    pick = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(pick(fenced(c)), pick(outermost_object(c)), pick(c))


def router_fields(c: Column) -> Column:
    """struct domains, multi_state: a scalar domain as a list, a non-boolean multi_state as false."""
    v = F.try_parse_json(any_object(c))
    many, one = F.try_variant_get(v, "$.domains", "array<string>"), F.try_variant_get(v, "$.domains", "string")
    state = F.schema_of_variant(F.try_variant_get(v, "$.multi_state", "variant")) == "BOOLEAN"
    return F.struct(F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>")).alias("domains"), F.coalesce(F.when(state, F.try_variant_get(v, "$.multi_state", "boolean")), F.lit(False)).alias("multi_state"))


def int_list(c: Column) -> Column:
    """The first [1, 2, 3] of a text."""
    return F.from_json(F.regexp_extract(c, r"\[[\d,\s]+\]", 0), "array<int>")


def pretty(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true"})


def explanation(c: Column) -> Column:
    """The sections of a solver's reply in reading order."""
    parts = F.from_json(any_object(c), "thought string, physics_analysis string, algebraic_reasoning string")
    return F.concat_ws("\n", parts["thought"], parts["physics_analysis"], parts["algebraic_reasoning"])


def usage(c: Column) -> Column:
    """struct input, output: token counts of a reply that may be an object or plain text."""
    v = F.try_parse_json(c)
    get = lambda *names: F.coalesce(*[F.try_variant_get(v, f"$.usage.{n}", "int") for n in names])
    return F.struct(get("prompt_tokens", "input_tokens").alias("input"), get("completion_tokens", "output_tokens").alias("output"))


def repaired(c: Column) -> Column:
    """The first object or array of a reply, with open strings and brackets closed where it was cut; null if there is none.

    One fold over the letters: the brackets still to be closed are a text that grows and shrinks at its start. Where nothing closes the first bracket, the
    first of these that parses is taken: the text as it is, without a last comma, with null after a last colon, without its last entry."""
    body = F.regexp_extract(c, r"(?s)[{\[].*", 0)
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        outside, rest = ~s["quoted"], F.substring(s["open"], 2, 1 << 30)
        closes = outside & x.isin("}", "]")
        quoted = F.when(outside, x == '"').otherwise(s["escaped"] | (x != '"'))
        left = F.when(outside & (x == "{"), F.concat(F.lit("}"), s["open"])).when(outside & (x == "["), F.concat(F.lit("]"), s["open"])).when(closes, rest).otherwise(s["open"])
        moved = F.struct(
            left.alias("open"), quoted.alias("quoted"), (s["quoted"] & ~s["escaped"] & (x == "\\")).alias("escaped"), (s["at"] + 1).alias("at"),
            F.when(closes & (rest == ""), s["at"] + 1).otherwise(0).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(moved)

    def closed(s: Column) -> Column:
        cut = F.concat(F.when(s["escaped"], F.regexp_replace(body, r"\\+$", "")).otherwise(body), F.when(s["quoted"], '"').otherwise(""))
        bare = F.rtrim(F.regexp_replace(cut, r"\s+$", ""))
        tries = [cut, F.regexp_replace(bare, ",+$", ""), F.when(bare.endswith(":"), F.concat(F.regexp_replace(bare, ":+$", ""), F.lit(": null"))), F.regexp_replace(cut, "(?s),[^,]*$", "")]
        whole = [F.concat(t, s["open"]) for t in tries]
        return F.when(s["end"] > 0, F.substring(body, F.lit(1), s["end"])).otherwise(F.coalesce(*[F.when(parses(t), t) for t in whole], whole[0]))

    return F.when(body != "", F.aggregate(F.split(body, ""), start, step, closed))
