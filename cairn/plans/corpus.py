"""Queries over texts as they come: pairs of words of whole documents, and replies that were cut."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import jsons
from cairn.operators import profiling
from cairn.plans.catalog import query


@query(r"""with w as (select distinct doc_id, unnest(list_filter(regexp_split_to_array(lower(trim(text)), '[ \t\n\r]+'), lambda x: x <> '')) as t from documents)
  select x.t as a, y.t as b, count(*) as n from w x join w y on x.doc_id = y.doc_id and x.t < y.t group by 1, 2 order by n desc, a, b limit 100""")
def word_pairs(t):
    """The hundred pairs of words that most documents hold together."""
    return profiling.top_pairs(profiling.tokens(t("documents"), keep=["doc_id"]), "doc_id", "token", 100)


#: An event as a nested reply with words before and after it, cut at a place that the event's number gives; what is cut may be nothing.
_REPLY = """'So ' || '{"type": "' || event_type || '", "at": [' || props || ', {"user": ' || user_id || ', "none": null}], "end": {}}' || ' as asked.'"""
_BRACKETS = r"""regexp_replace(regexp_replace(cut, '"[^"]*("|$)', '', 'g'), '[^][{}]', '', 'g')"""
_PAIRED = r"""'\{\}|\[\]', '', 'g')"""


@query(rf"""with r as (select event_id, {_REPLY} as reply from events),
  c as (select event_id, left(reply, (event_id * 7 % (length(reply) + 1))::int) as reply from r),
  b as (select event_id, case when contains(reply, '{{') then substr(reply, strpos(reply, '{{')) end as cut from c),
  o as (select *, (length(cut) - length(replace(cut, '"', ''))) % 2 = 1 as quoted,
    reverse(translate({"regexp_replace(" * 4}{_BRACKETS}, {_PAIRED}, {_PAIRED}, {_PAIRED}, {_PAIRED}, '{{[', '}}]')) as closing from b),
  f as (select *, cut || case when quoted then '"' else '' end as body from o),
  x as (select *, [body || closing, rtrim(rtrim(body), ',') || closing, case when rtrim(body) like '%:' then rtrim(rtrim(body), ':') || ': null' || closing end, regexp_replace(body, ',[^,]*$', '') || closing] as tries from f)
  select event_id, case when cut is null then null when closing = '' then regexp_replace(cut, ' .?.?as.?asked\.?$|[^}}]*$', '') else coalesce(list_filter(tries, lambda z: json_valid(z) and not regexp_matches(z, ',\s*[}}\]]'))[1], tries[1]) end as json from x""")
def cut_replies(t):
    """What can be read of replies that end anywhere."""
    props = F.concat(F.lit('So {"type": "'), "event_type", F.lit('", "at": ['), "props", F.lit(', {"user": '), F.col("user_id").cast("string"), F.lit(', "none": null}], "end": {}} as asked.'))
    cut = F.substring(props, F.lit(1), (F.col("event_id") * 7 % (F.length(props) + 1)).cast("int"))
    return t("events").select("event_id", jsons.repaired(cut).alias("json"))
