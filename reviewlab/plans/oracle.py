"""DuckDB text of the fixture tables, for the driver's side-by-side check.

Each registered query's oracle is ``fixture_sql(body)``: the fixture tables
as CTEs, then the query's own CTEs/select. Unused CTEs cost nothing.
"""

from __future__ import annotations

from reviewlab.sources.fixtures import STOP_WORDS


def _h(i: int) -> str:
    return f"cast(('0x' || substr(md5(word), {i}, 8)) as bigint)"


_STOP_VALUES = ", ".join("('" + w.replace("'", "''") + "')" for w in STOP_WORDS)

FIXTURE_CTES = f"""
reviews as (
  select d.doc_id as v1,
         cast(d.doc_id % 97 as int) as clothing_id,
         cast(case when d.doc_id % 41 = 0 then null
                   else 15 + (d.doc_id * 7919) % 85 end as int) as age,
         case when d.doc_id % 7 = 0 then '' else substr(d.text, 1, 20) end as title,
         case when d.doc_id % 29 = 0 then '' else d.text end as review_text,
         cast(case when l.quality = 1 and l.toxic = 0 then 4 + (d.doc_id * 31) % 2
                   when l.quality = 1 then 3
                   when l.toxic = 1 then 1
                   when l.quality = 0 then 2
                   else 1 + (d.doc_id * 31) % 5 end as int) as rating,
         l.quality as recommended,
         cast(d.n_chars % 23 as int) as positive_feedback,
         d.lang as devision,
         d.source as department,
         concat(d.lang, '-', cast(d.doc_id % 6 as varchar(20))) as class
  from documents d left join labels l on d.doc_id = l.doc_id
),
tokens as (
  select v1, unnest(regexp_extract_all(lower(review_text), '[\\p{{L}}\\p{{N}}]+(?:\\x27[\\p{{L}}\\p{{N}}]+)*')) as word
  from reviews
),
vocab as (
  select word from tokens where length(word) >= 3 group by word having count(*) >= 5
),
hv as (
  select word, {_h(1)} as h1, {_h(9)} as h9, {_h(17)} as h17, {_h(25)} as h25 from vocab
),
bing as (
  select word, case when h1 % 2 = 0 then 'positive' else 'negative' end as sentiment
  from hv where h1 % 4 in (0, 1)
  union all
  select word, case when h1 % 2 = 0 then 'negative' else 'positive' end as sentiment
  from hv where h1 % 4 in (0, 1) and h1 % 97 = 0
),
afinn as (
  select word, cast(h9 % 11 - 5 as int) as score from hv
  where h17 % 3 <> 0 and h9 % 11 <> 5
),
negators as (select word from hv where h25 % 211 = 0),
amplifiers as (select word from hv where h25 % 211 = 1),
stop_words as (select * from (values {_STOP_VALUES}) t(word)),
age_banded as (
  select *,
    case when age >= 18 and age < 30 then '18 ~ 29'
         when age >= 30 and age < 40 then '30 ~ 39'
         when age >= 40 and age < 50 then '40 ~ 49'
         when age >= 50 and age < 60 then '50 ~ 59'
         when age >= 60 and age < 70 then '60 ~ 69'
         when age >= 70 and age < 80 then '70 ~ 79'
         when age >= 80 and age < 90 then '80 ~ 89'
         when age >= 90 and age < 1000 then '90 ~ 99'
         when age is null then 'Unknown' end as age_div
  from reviews
),
complete as (
  select * from age_banded
  where v1 is not null and clothing_id is not null and age is not null
    and title is not null and review_text is not null and rating is not null
    and recommended is not null and positive_feedback is not null
    and devision is not null and department is not null and class is not null
)"""


def fixture_sql(body: str) -> str:
    """``body`` is either ``select ...`` or ``, extra as (...) select ...``."""
    body = body.strip()
    sep = "\n" if body.startswith(",") else "\n"
    return f"with {FIXTURE_CTES.strip()}{sep}{body if body.startswith(',') else ' ' + body}"
