"""The registered queries as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Sequence

from airmetrics.llm import urls
from airmetrics.llm.licenses import RULES, SENTENCES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    known = ", ".join(f"({_quoted(t)}, {_quoted('<' + n + '>')})" for n, ts in SENTENCES.items() for t in ts)
    steps = []
    for k, (licence, names) in enumerate(RULES):
        mark = _quoted("".join(f"<{n}>" for n in names))
        steps.append(
            f"r{k} as (select * exclude (rest), replace(rest, {mark}, '') as rest, "
            f"case when contains(rest, {mark}) then {_quoted(licence)} end as l{k} from "
            f"{'r' + str(k - 1) if k else 'start'})"
        )
    names = ", ".join(f"l{k}" for k in range(len(RULES)))
    return f"""
with known(sentence, mark) as (values {known}),
docs as (select row_number() over () as r, doc_id, text from documents),
cut as (select r, unnest(string_split_regex(lower(coalesce(text, '')), '\\n|\\r|[.!?;:][ \\t]')) as part,
               generate_subscripts(string_split_regex(lower(coalesce(text, '')), '\\n|\\r|[.!?;:][ \\t]'), 1) as pos
        from docs),
normal as (select r, pos, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) as sentence from cut),
found as (select r, string_agg(mark, '' order by pos) as sentences from normal join known using (sentence) group by r),
start as (select doc_id, coalesce(sentences, '') as sentences, coalesce(sentences, '') as rest
          from docs left join found using (r)),
{", ".join(steps)},
named as (select doc_id, sentences, rest, list_filter([{names}], lambda x: x is not null) as stated from r{len(RULES) - 1})
select doc_id, array_to_string(list_filter(stated, lambda x, i: list_position(stated, x) = i), ' AND ') as licences,
       sentences, rest
from named"""


def url_sql(rules: Sequence[urls.Rule]) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then "
        for r in ordered
    ]
    rule = "case " + " ".join(f"{fit}{_quoted(r.text)}" for fit, r in zip(fits, ordered)) + " end"
    verdict = "case " + " ".join(f"{fit}{_quoted(r.verdict)}" for fit, r in zip(fits, ordered)) + " end"
    levels = urls.LEVELS
    steps = []
    for level in range(levels):
        steps.append(f"""
k{level} as (select *, array_to_string(segs[1:{level}], '/') as parent, segs[{level + 1}] as child from t{level}),
c{level} as (select host, parent, child, sum(urls) as urls from k{level}
             where child is not null and child not in ('*', '**') group by all),
v{level} as (select host, parent from c{level} group by all
             having count(*) >= {urls.MANY_CHILDREN} and sum(urls) < {urls.FEW_URLS} * count(*)),
t{level + 1} as (select k.* exclude (parent, child, segs),
             case when v.host is not null and child is not null and child <> '**'
                  then segs[1:{level}] || ['*'] || segs[{level + 2}:] else segs end as segs
             from k{level} k left join v{level} v on v.host = k.host and v.parent = k.parent)""")
    return f"""
with rest as (select page_id, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest
              from pages),
cut as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls._UPPER}', '{urls._LOWER}') as host,
               regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path from rest),
shaped as (select *, string_split(path, '/') as every,
                  try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint) as label_id from cut),
seg as (select page_id, host, path, label_id,
               list_transform(every[2:{levels + 1}], lambda s: case when regexp_matches(s, '[0-9]') then '*' else s end)
               || case when len(every) > {levels + 1} then ['**'] else [] end as segs from shaped),
known as (select doc_id as label_id, max(1 - quality) as bad from labels
          where doc_id is not null and quality is not null group by all),
t0 as (select host, array_to_string(segs, '/') as shape, segs, count(*) as urls, count(bad) as labelled,
              coalesce(sum(bad), 0) as bad from seg left join known using (label_id) group by all),
{",".join(steps)},
tree as (select host, shape, array_to_string(segs, '/') as template, urls, labelled, bad from t{levels}),
own as (select host, template, regexp_replace(template, '[^/*]+', '?', 'g') as skeleton, sum(labelled) as n, sum(bad) as bad
        from tree group by all),
overall as (select (sum(bad) + 1) / (sum(n) + 2) as overall from own),
pooled as (select host, skeleton, sum(bad) / greatest(sum(n), 1) as share from own group by all),
tested as (select own.*, overall, abs(bad - n * share) <= {urls.SIMILAR_Z} * sqrt(n * share * (1 - share)) + 1e-9 as merged
           from own join pooled using (host, skeleton), overall),
kin as (select host, skeleton, sum(n) as kin_n, sum(bad) as kin_bad from tested where merged group by all),
rated as (select host, template, (case when merged then kin_bad else bad end + {urls.SMOOTHING} * overall)
                 / (case when merged then kin_n else n end + {urls.SMOOTHING}) as purity
          from tested left join kin using (host, skeleton))
select page_id, seg.host, path, {rule.replace('host', 'seg.host')} as rule,
       coalesce({verdict.replace('host', 'seg.host')}, case when purity >= {urls.REJECT} then 'block' else 'allow' end) as verdict,
       tree.template, purity
from seg join tree on tree.host = seg.host and tree.shape = array_to_string(segs, '/')
join rated on rated.host = tree.host and rated.template = tree.template"""


COLLOCATIONS = r"""
with lowered as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
pieces as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from lowered),
words as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
orders as (select unnest([1, 2, 3]) as size),
placed as (select lang, size, w, unnest(range(1, len(w) - size + 2)) as i from words, orders where len(w) >= size),
counted as (
  select lang, size, array_to_string(w[i : i + size - 1], ' ') as phrase, count(*)::hugeint as f
  from placed group by all),
totals as (select lang, sum(f)::bigint as n from counted where size = 1 group by lang),
candidates as (select *, string_split(phrase, ' ') as w from counted where size > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.f as a, k, l.f as l, r.f as r, (1000000 * c.f * c.f) // (l.f * r.f) as score
  from (select *, unnest(range(1, size)) as k from candidates) c
  join counted l on l.lang = c.lang and l.size = k and l.phrase = array_to_string(c.w[1 : k], ' ')
  join counted r on r.lang = c.lang and r.size = c.size - k and r.phrase = array_to_string(c.w[k + 1 : c.size], ' ')),
weakest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (
  select distinct p.lang, p.phrase from candidates p join candidates t
  on t.lang = p.lang and p.size = 2 and t.size = 3 and 100 * t.f >= 50 * p.f
  and p.phrase in (array_to_string(t.w[1 : 2], ' '), array_to_string(t.w[2 : 3], ' ')))
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from weakest anti join covered using (lang, phrase)) join totals using (lang)
where rank <= 2000
"""
