"""Queries whose work is joins: chains with circles, numbers near each other, units."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import graphs, matching, units
from cairn.plans.catalog import query

#: Edges between 120 nodes; parts of size 50 make circles.
_EDGES = """select p_partkey % 120 as source, case when p_size = 50 and p_partkey % 120 % 7 = 3 then p_partkey % 120 - 2 else p_partkey % 120 + 1 + p_size % 5 end as target from part"""


@query(f"""with recursive e as (select distinct source as s, target as t from ({_EDGES})), n as (select s as v from e union select t from e),
  r(u, v) as (select s, t from e union select r.u, e.t from r join e on r.v = e.s),
  c as (select n.v as node, least(n.v, coalesce((select min(x.v) from r x join r y on x.v = y.u and y.v = x.u where x.u = n.v), n.v)) as component from n),
  g as (select distinct a.component as s, b.component as t from e join c a on e.s = a.node join c b on e.t = b.node where a.component <> b.component),
  d(node, depth) as (select distinct s, 1 from g union select g.s, d.depth + 1 from g join d on g.t = d.node)
  select node, c.component, (select count(*) from c o where o.component = c.component) as members, coalesce((select max(depth) from d where d.node = c.component), 0) as depth from c""")
def circle_depths(t):
    """Longest chains of a graph with circles: components, then ways put together."""
    here = F.col("p_partkey") % 120
    target = F.when((F.col("p_size") == 50) & (here % 7 == 3), here - 2).otherwise(here + 1 + F.col("p_size") % 5)
    return graphs.depths(t("part").select(here.alias("source"), target.alias("target")))


_LINE = "l_orderkey * 8 + l_linenumber"


@query(f"""with recursive l as (select l_suppkey as g, {_LINE} as k, l_extendedprice as x, l_returnflag as f from lineitem),
  p as (select a.g, a.k as "left", b.k as "right", abs(a.x - b.x) as gap from l a join l b on a.g = b.g and a.f = 'R' and b.f = 'A' and abs(a.x - b.x) <= 0.02 * abs(b.x)),
  c as (select *, row_number() over (partition by g order by gap, "left", "right") as i from p),
  m(g, i, ls, rs) as (select distinct g, 0::bigint, []::bigint[], []::bigint[] from c union all
    select m.g, c.i, case when free then list_append(ls, c."left") else ls end, case when free then list_append(rs, c."right") else rs end
    from m join c on c.g = m.g and c.i = m.i + 1, lateral (select not list_contains(ls, c."left") and not list_contains(rs, c."right") as free)),
  e as (select g, unnest(ls) as "left", unnest(rs) as "right" from (select *, row_number() over (partition by g order by i desc) as last from m) where last = 1)
  select e.g as l_suppkey, e."left", e."right", round(min(gap), 2) as gap from e join p on p.g = e.g and p."left" = e."left" and p."right" = e."right" group by 1, 2, 3""")
def price_matches(t):
    """Each supplier's returned lines matched one to one with accepted ones of nearly the same price."""
    lines = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_extendedprice", "l_returnflag")
    returned = lines.where("l_returnflag = 'R'").select("l_suppkey", F.col("line").alias("left"), F.col("l_extendedprice").alias("a"))
    accepted = lines.where("l_returnflag = 'A'").select("l_suppkey", F.col("line").alias("right"), F.col("l_extendedprice").alias("b"))
    return matching.matched_sides(returned, accepted, ["l_suppkey"], 0.02).withColumn("gap", F.round("gap", 2))


@query("""select count(*) as pairs, sum(a.l_orderkey * 8 + a.l_linenumber) as lefts, sum(b.l_orderkey * 8 + b.l_linenumber) as rights
  from lineitem a join lineitem b on a.l_suppkey = b.l_suppkey and a.l_returnflag = 'R' and b.l_returnflag = 'A' and abs(a.l_extendedprice - b.l_extendedprice) <= 0.02 * abs(b.l_extendedprice)""")
def price_band(t):
    """All pairs of returned and accepted lines of a supplier within 2 % of each other's price, counted."""
    lines = t("lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_extendedprice", "l_returnflag")
    returned = lines.where("l_returnflag = 'R'").select("l_suppkey", F.col("line").alias("left"), F.col("l_extendedprice").alias("a"))
    accepted = lines.where("l_returnflag = 'A'").select("l_suppkey", F.col("line").alias("right"), F.col("l_extendedprice").alias("b"))
    found = matching.band_pairs(returned, accepted, ["l_suppkey"], 0.02)
    return found.agg(F.count("*").alias("pairs"), F.sum("left").alias("lefts"), F.sum("right").alias("rights"))


UNIT_TEXTS = (
    "m", "km", "cm", "mm", "um", "µm", "s", "ms", "min", "h", "kg", "g", "mg", "t", "N", "kN", "kg*m/s^2", "g*cm/s^2", "J", "kJ", "N*m", "kg*m^2/s^2", "W*s", "kW*h", "eV", "MeV", "cal", "kcal",
    "W", "J/s", "V*A", "mW", "Pa", "bar", "N/m^2", "N/cm^2", "V", "J/C", "mV", "V/m", "N/C", "kV/cm", "ohm", "Ω", "kohm", "V/A", "S^-1", "T", "Wb/m^2", "Hz", "1/s", "MHz", "C/s", "F", "C/V", "L", "m^3", "parsec", "m//s", "[K]",
)
_LIST = "[" + ", ".join(f"'{u}'" for u in UNIT_TEXTS) + "]"
_VALUES = ", ".join(f"('{s}', {f}::double, {', '.join(map(str, rest))})" for s, f, *rest in units.UNITS)
_SUMS = ", ".join(f'sum(power * "{b}") as "{b}"' for b in units.BASE)


@query(rf"""with u(symbol, factor, ten, {", ".join(f'"{b}"' for b in units.BASE)}) as (values {_VALUES}), x(prefix, more) as (values {", ".join(f"('{p}', {n})" for p, n in {**units.PREFIXES, "": 0}.items())}),
  all_names as (select prefix || symbol as name, factor, ten + more as ten, {", ".join(f'"{b}"' for b in units.BASE)}, row_number() over (partition by prefix || symbol order by length(prefix)) as rank from u, x),
  names as (select * from all_names where rank = 1),
  w as (select unnest({_LIST}) as unit), y as (select unit, replace(replace(trim(unit, '[]'), 'µ', 'u'), 'Ω', 'ohm') as text from w),
  z as (select unit, text, regexp_extract_all(text, '[*/]?[A-Za-z]+(?:\^?-?[0-9]+)?') as tokens from y),
  s as (select unit, regexp_extract(token, '[A-Za-z]+') as name, (case when token[1] = '/' then -1 else 1 end) * coalesce(try_cast(regexp_extract(token, '-?[0-9]+$') as integer), 1) as power from (select unit, unnest(tokens) as token from z where array_to_string(tokens, '') = text)),
  d as (select unit, product(pow(factor, power)) as factor, sum(power * ten) as ten, {_SUMS} from s left join names using (name) group by unit having count(*) = count(names.factor)),
  p as (select p_partkey, {_LIST}[p_partkey % {len(UNIT_TEXTS)} + 1] as unit, {_LIST}[(p_partkey // {len(UNIT_TEXTS)}) % {len(UNIT_TEXTS)} + 1] as other from part)
  select p_partkey, p.unit, other, {" and ".join(f'a."{b}" = b."{b}"' for b in units.BASE)} as alike,
    case when {" and ".join(f'a."{b}" = b."{b}"' for b in units.BASE)} then round(a.factor / b.factor, 9) end as ratio, cast(case when {" and ".join(f'a."{b}" = b."{b}"' for b in units.BASE)} then a.ten - b.ten end as integer) as ten
  from p left join d a on a.unit = p.unit left join d b on b.unit = p.other""")
def unit_conversions(t):
    """Whether two of sixty units are of one dimension, and how one goes into the other, for every part."""
    n = len(UNIT_TEXTS)
    texts = F.array(*[F.lit(u) for u in UNIT_TEXTS])
    rows = t("part").select("p_partkey", F.element_at(texts, (F.col("p_partkey") % n + 1).cast("int")).alias("unit"), F.element_at(texts, (F.floor(F.col("p_partkey") / n) % n + 1).cast("int")).alias("other"))
    return units.converted(rows, "unit", "other").withColumn("ratio", F.round("ratio", 9))
