"""DuckDB oracle SQL: independent re-statements of each query over the raw tables.

Everything is built as one chain of CTEs over the pre-registered views
(``documents``, ``labels``, ``orders``, ``part``, ``embeddings``); DuckDB only
evaluates the CTEs a query references.
"""

from __future__ import annotations

from corpuslab.functions.lists import CUSTOM_STOPWORDS, EXCLUDED_LEAD_TYPES, SNOWBALL_ENGLISH, sql_list

# Fixture thresholds (FIXTURES.md section 6).
CHANNEL_SHARE = 0.12
TOP_GROWTH = 60
LABEL_MIN_TERMFREQ_SHARE = 0.13
LABEL_MIN_DOCFREQ_SHARE = 0.125
LABEL_SPARSITY = 0.875
CORPUS_SPARSITY = 0.99
CORPUS_UPPER_SHARE = 0.3

URL = r"' ?(f|ht)(tp)(s?)(://)(.*)[.|/](.*)'"
EMAIL = r"'[^\s]*@[^\s]*'"


def clean_word_sql(tok: str) -> str:
    return (
        f"lower(regexp_replace(regexp_replace(regexp_replace({tok}, {URL}, ' ', 'g'), {EMAIL}, ' ', 'g'), "
        f"'[^a-zA-Z]', '', 'g'))"
    )


def strip_sql(text: str) -> str:
    return rf"concat(regexp_replace(substring({text}, 1, 20), '.*\p{{Pd}}', '', 'g'), substring({text}, 21))"


ARTICLES = r"""
articles AS (
select concat('http://example.com/', d.source, '/', cast(d.doc_id as varchar)) as url,
  cast(floor(o.o_totalprice) as bigint) as shares,
  case when d.doc_id % 4 = 3 then concat(p.p_name, ' ', cast(d.doc_id as varchar)) else p.p_name end as title,
  case when d.doc_id % 14 = 4 then concat('Instagram iphone Reddit ', d.text) else case d.doc_id % 7 when 0 then concat('LAS VEGAS — ', d.text)
    when 1 then concat('AB', chr(13), 'C - http://x.example/y', chr(9), 'me.s@x.org ', d.text)
    when 2 then concat('Wi-Fi ', d.text) else d.text end end as text,
  case d.doc_id % 6 when 0 then concat('Ann ', d.source, ' and Bob Ray')
    when 1 then concat('Cy ', d.source, ' & Di Fox, Ed Lee')
    when 2 then concat('Flo ', d.source, ', Gus Orr')
    when 3 then null else concat('Hal ', d.source) end as author,
  strftime(o.o_orderdate, '%m/%d/%Y') as date,
  lower(p.p_type || ',' || replace(p.p_name, ' ', ',') || ',uncategorized') as topics,
  case when d.doc_id % 10 = 9 then null else d.lang end as channel,
  'article' as content_type,
  case when l.toxic = 1 then 'Longform' when l.quality = 0 then 'Full Width'
    when l.doc_id is null and d.doc_id % 3 = 0 then null
    when d.doc_id % 4 = 0 then 'Default Video' when d.doc_id % 4 = 1 then 'Default'
    else 'Gallery' end as post_lead_type,
  'us' as geo, 'src' as sourced_from, d.doc_id as doc_id
from documents d left join labels l on d.doc_id = l.doc_id
  left join orders o on o.o_orderkey = d.doc_id
  left join part p on p.p_partkey = o.o_orderkey % (select count(*) from part)
)"""

FEATURES = (
    rf"""
chan_freq AS (
  select channel, count(*) as n from articles group by channel
  having count(*) > {CHANNEL_SHARE} * (select count(*) from articles)
),
scoped0 AS (
  select a.*, (c.n is not null)
    and coalesce(a.post_lead_type not in ({sql_list(EXCLUDED_LEAD_TYPES)}), false)
    and a.text is not null and length(a.text) > 0 as top_OK
  from articles a left join chan_freq c on a.channel is not distinct from c.channel
),
ided AS (
  select *, cast(row_number() over (order by url) as varchar) as _rn from scoped0
),
feat1 AS (
  select url, shares, title, text, lower(author) as author, date, topics, channel, content_type,
    post_lead_type, geo, sourced_from, doc_id, top_OK,
    case when length(_rn) >= 5 then _rn else lpad(_rn, 5, '0') end as my_id,
    coalesce(strpos(lower(author), ' and ') > 0 or strpos(lower(author), ' & ') > 0
      or strpos(lower(author), ', ') > 0, false) as top_partner
  from ided
),
dmin AS (
  select strftime(min(try_strptime(date, '%m/%d/%Y')), '%m/%d/%Y') as date_min_chronological,
         min(date) as date_min_lexicographic
  from feat1 where top_OK
),
feat2 AS (
  select f.*,
    case when f.top_OK then m.date_min_chronological end as date_min,
    case when f.top_OK then cast(date_diff('day', try_strptime(m.date_min_chronological, '%m/%d/%Y'),
       try_strptime(f.date, '%m/%d/%Y')) as double) end as nb_days,
    cast(length(f.text) as bigint) as nb_char_text,
    cast(length(f.topics) - length(replace(f.topics, ',', '')) - 1 as bigint) as nb_topics,
    regexp_replace(regexp_replace(regexp_replace(f.author, ' and .*', ''), ' & .*', ''), ', .*', '') as first_author,
    case when coalesce(strpos(f.post_lead_type, 'Video') > 0, false) then 'Video'
         when coalesce(strpos(f.post_lead_type, 'Default') > 0, false) then 'Article'
         else 'Gallery' end as post_lead_type2
  from feat1 f cross join dmin m
),
series_titles AS (
  select distinct title, true as hit from (select title, author from feat2 group by title, author having count(*) > 2)
),
feat3 AS (
  select f.*, coalesce(s.hit, false) as top_series
  from feat2 f left join series_titles s on f.title is not distinct from s.title
),
len_pr AS (
  select my_id, percent_rank() over (order by length(text)) as pr from feat3 where text is not null
),
features AS (
  select f.* exclude (top_OK), f.top_OK and coalesce(length(f.text) > 200 and p.pr < 0.95, false) as top_OK
  from feat3 f left join len_pr p on f.my_id = p.my_id
),
scoped AS (
  select * exclude (text), {strip_sql('text')} as text,
    coalesce(regexp_matches(substring(text, 1, 20), '[ ]+\p{{Pd}}'), false) as top_city
  from features where top_OK
)"""
)

TOKENS = (
    rf"""
tok_lists AS (
  select my_id, list_filter(string_split(translate(text, chr(10) || chr(9) || chr(13), '   '), ' '), lambda x: x <> '') as l
  from scoped
),
tokens AS (
  select my_id, cast(generate_subscripts(l, 1) as integer) as "order", unnest(l) as token from tok_lists
),
tokwords AS (
  select my_id, "order", token, {clean_word_sql('token')} as word from tokens
),
words AS (
  select * from tokwords where length(word) > 3
),
fx_toks AS (
  select doc_id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as tok from (
    select doc_id, string_split(regexp_replace({strip_sql('text')}, '[\n\t\r]', ' ', 'g'), ' ') as l from articles)
),
fx_words AS (
  select doc_id, pos, word from (select doc_id, pos, {clean_word_sql('tok')} as word from fx_toks)
  where length(word) > 3
),
lexicon AS (
  select distinct word, regexp_replace(word, '(ing|ed|s)$', '') as lemma from fx_words where length(word) % 3 <> 0
),
joined1 AS (
  select w.*, x.lemma from words w left join lexicon x on w.word = x.word
),
growth AS (
  select word, count(*) as n from joined1 where lemma is null group by word order by n desc, word limit {TOP_GROWTH}
),
lexicon2 AS (
  select word, lemma from lexicon union all select word, word as lemma from growth
),
joined2 AS (
  select w.*, x.lemma from words w left join lexicon2 x on w.word = x.word
),
texts AS (
  select my_id, string_agg(word, ' ' order by "order", word) as clean_word_text,
    string_agg(case when length(lemma) > 3 then lemma end, ' ' order by "order", lemma) as lemma_text
  from joined2 group by my_id
)"""
)

STOPWORDS = f"""
stopwords AS (
  select unnest([{sql_list(SNOWBALL_ENGLISH)}]) as term union select unnest([{sql_list(CUSTOM_STOPWORDS)}])
)"""


def with_base(body: str, *extra: str) -> str:
    """Full CTE chain plus ``body`` (a final SELECT)."""
    ctes = [ARTICLES, FEATURES, TOKENS, STOPWORDS, *extra]
    return "WITH " + ",".join(ctes) + "\n" + body


def _spline_basis(degree: int = 3, inner: int = 7) -> str:
    """CTEs ``b0 .. b3``: the B-spline basis of ``nb_days`` as rows ``(my_id, x, i, v)``, one degree after the other, over the knots of ``kn``."""
    ends = degree + 1
    knots = ["lo"] * ends + [f"k{i}" for i in range(1, inner + 1)] + ["hi"] * ends
    last = len(knots)
    ctes = [
        f"knots AS (select [{', '.join(knots)}] as t from kn)",
        f"""b0 AS (select my_id, x, i, case when t[i] < t[i + 1] and x >= t[i] and (x < t[i + 1] or (x = t[{last}] and t[i + 1] = t[{last}])) then 1.0 else 0.0 end as v
            from (select my_id, nb_days::double as x from features where top_OK), knots, unnest(range(1, {last})) as g(i))""",
    ]
    for p in range(1, degree + 1):
        ctes.append(
            f"""b{p} AS (select a.my_id, a.x, a.i, coalesce((a.x - t[a.i]) / nullif(t[a.i + {p}] - t[a.i], 0) * a.v, 0)
            + coalesce((t[a.i + {p + 1}] - a.x) / nullif(t[a.i + {p + 1}] - t[a.i + 1], 0) * n.v, 0) as v
            from b{p - 1} a join b{p - 1} n on n.my_id = a.my_id and n.i = a.i + 1, knots)"""
        )
    return ", ".join(ctes)


SPLINE_BASIS = _spline_basis()
