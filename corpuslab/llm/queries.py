"""The registered queries of this subpackage: each reads its whole table through its operator and derives the result's columns."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslab.llm import conversation_repair, decontaminate, langid, lm, metric_join, ngram_join, packing, quality, ranked_search, sharding, token_counts, toxicity, warc
from corpuslab.llm.stage import id_remainder, read
from corpuslab.session import stage_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; CORPUSLAB_VOCABULARY overrides where it lies."""
    given = os.environ.get("CORPUSLAB_VOCABULARY")
    if given:
        return given
    import public_tokenizers

    return public_tokenizers.path(name)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@register("op1_hierarchical_packing")
def q_packing(spark, sf):
    return packing.pack(read(spark, sf, "documents"), vocabulary_path())


@register("op2_ngram_jaccard_join")
def q_ngram_join(spark, sf):
    return ngram_join.jaccard_classes(read(spark, sf, "documents"), n=4, percent=85)


def id_text(docs):
    """(doc_id, text) of a table of documents."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


@register("op3_convolutional_toxicity")
def q_toxicity(spark, sf):
    docs = read(spark, sf, "documents")
    held_out = id_remainder(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, read(spark, sf, "labels"), ~held_out)
    scored = toxicity.predict(id_text(docs), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op4_feistel_sharding")
def q_sharding(spark, sf):
    placed = sharding.shuffle_into_shards(read(spark, sf, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )


@register("op5_spaced_seed_decontamination")
def q_decontaminate(spark, sf):
    return decontaminate.overlaps(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@register("op6_brown_class_lm")
def q_lm(spark, sf):
    docs = read(spark, sf, "documents")
    held_out = id_remainder(F.col("doc_id"), 7) == 2
    model, counts = lm.fit(docs.where(~held_out))
    return lm.score(docs, model, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


OP7_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select html, max(page_id) as keeper from p where strlen(html) >= 1000 group by html)
select p.page_id, cast(strlen(p.html) as bigint) as payload_bytes, sha1(p.html) as payload_digest,
  case when k.keeper <> p.page_id then 'revisit' else 'response' end as record_type,
  case when k.keeper <> p.page_id then k.keeper end as refers_to
from p left join k on p.html = k.html
"""


@register("op7_content_addressed_warc", OP7_SQL)
def q_warc(spark, sf):
    path = stage_dir(spark, f"llm-warc-{uuid.uuid4().hex}")
    warc.write_archive(read(spark, sf, "pages"), path)
    return warc.read_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op8_compression_quality")
def q_quality(spark, sf):
    docs = read(spark, sf, "documents")
    held_out = id_remainder(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, read(spark, sf, "labels"), ~held_out)
    scored = quality.predict(id_text(docs), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op10_language_filters")
def q_langid(spark, sf):
    docs = read(spark, sf, "documents")
    held_out = id_remainder(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.predict(id_text(docs), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


OP9_SQL = """
with recursive ok as (select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a, min(b) as b from reach group by a), deg as (select a, count(*) as n from link group by a)
select v.vec_id, cast(coalesce(deg.n, 0) as bigint) as n_links, least(v.vec_id, coalesce(low.b, v.vec_id)) as component_id,
  v.vec_id = least(v.vec_id, coalesce(low.b, v.vec_id)) as kept
from embeddings v left join low on low.a = v.vec_id left join deg on deg.a = v.vec_id
"""


@register("op9_metric_range_join", OP9_SQL)
def q_vectors(spark, sf):
    return metric_join.near_vectors(read(spark, sf, "embeddings"), threshold=0.93)


@register("op12_heap_token_counts")
def q_token_counts(spark, sf):
    return token_counts.token_counts(read(spark, sf, "documents"), vocabulary_path(), limit=1024)


OP13_SQL = r"""
with recursive crc_table as (select list_transform(range(256), lambda b: list_reduce(range(8),
    lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, b)) as tab),
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint) as bytes from conversations),
marked as (select g.*, xor(list_reduce(bytes, lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1]), 4294967295), 4294967295) % 20 as hurt from given g, crc_table),
rows_ as (select conv_id, turn, case when hurt = 4 then 'user' else role end as role,
    case hurt when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
    from marked, unnest(range(case hurt when 0 then 0 when 3 then 2 else 1 end)) where hurt <> 0),
seen as (select *, md5(length(role)::varchar || ':' || role || text) as digest, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as vis from rows_),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, digest) as rn,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, digest) || left(role, 1) as pair from seen),
firsts as (select *, min(rn) over (partition by conv_id, role, text) as lead_rn from placed),
faulty as (select *, vis = '' as blank, vis <> '' and rn > lead_rn as dup, vis <> '' and rn = lead_rn and right(vis, 1) not in ('.', '!', '?') as cut, left(role, 1) as ini from firsts),
counted as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::bigint) as blank,
    sum(dup::bigint) as duplicate, sum(cut::bigint) as truncated, sum((pair not in ('su', 'ua', 'au'))::bigint) as illegal from faulty group by conv_id),
steps(q, ini, q2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3), (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3)),
forced(q, q2) as (values (0, 2), (1, 2), (2, 3), (3, 2)),
inserts(q, more, q2) as (values (0, '', 0), (1, '', 1), (2, '', 2), (3, '', 3), (0, 'I', 2), (0, 'II', 3), (1, 'I', 2), (1, 'II', 3), (2, 'I', 3), (3, 'I', 2)),
edits as (select conv_id, rn, q, q as q2, 'D' as edit, 4 as cost from faulty, (select distinct q from forced)
    union all select f.conv_id, f.rn, s.q, s.q2, 'K', 3 * f.cut::int from faulty f join steps s on s.ini = f.ini where not f.blank and not f.dup
    union all select f.conv_id, f.rn, s.q, s.q2, 'R', 3 + 3 * f.cut::int from faulty f, forced s where not f.blank and not f.dup),
search(conv_id, i, q, best) as (select conv_id, 0::bigint, 0, {'cost': 0, 'audit': ''} from counted
    union all select s.conv_id, s.i + 1, e.q2, min({'cost': s.best.cost + 3 * length(x.more)::int + e.cost, 'audit': s.best.audit || x.more || e.edit})
    from search s join inserts x on x.q = s.q join edits e on e.conv_id is not distinct from s.conv_id and e.rn = s.i + 1 and e.q = x.q2 group by s.conv_id, s.i, e.q2),
ended as (select s.conv_id, min({'cost': s.best.cost + 3 * length(x.more)::int, 'audit': s.best.audit || x.more}) as best
    from search s join counted c on c.conv_id is not distinct from s.conv_id and c.n = s.i join inserts x on x.q = s.q and x.q2 in (0, 3) group by s.conv_id),
letters as (select conv_id, p, substr(best.audit, p::int, 1) as edit from ended, unnest(range(1, length(best.audit) + 1)) as t(p)),
numbered as (select *, sum((edit <> 'I')::int) over w as rn, sum((edit <> 'D')::int) over w as place from letters window w as (partition by conv_id order by p)),
lines as (select b.conv_id, b.p, b.edit, b.place, f.role, f.text, f.ini from numbered b left join faulty f on f.conv_id is not distinct from b.conv_id and f.rn = b.rn and b.edit <> 'I' where b.edit <> 'D'),
led as (select *, max(case when place = 1 and edit = 'K' and ini = 's' then 1 else 0 end) over (partition by conv_id) as lead from lines),
told as (select conv_id, sha256(string_agg(case when edit = 'K' then role when (place - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''),
    chr(10) order by p)) as sha from led group by conv_id)
select i.conv_id, coalesce(c.gaps, 0)::bigint as gaps, coalesce(c.blank, 0)::bigint as blank, coalesce(c.duplicate, 0)::bigint as duplicate,
  coalesce(c.truncated, 0)::bigint as truncated, coalesce(c.illegal, 0)::bigint as illegal, coalesce(e.best.cost, 0)::bigint as cost,
  coalesce(e.best.audit, '') as audit, coalesce(t.sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) i left join counted c on c.conv_id is not distinct from i.conv_id
left join ended e on e.conv_id is not distinct from i.conv_id left join told t on t.conv_id is not distinct from i.conv_id
"""


@register("op13_conversation_repair", OP13_SQL)
def q_conversation_repair(spark, sf):
    return conversation_repair.damage_and_repair(read(spark, sf, "conversations"))


OP11_SQL = r"""
with terms as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term, row from (select doc_id, text, row_number() over () as row from documents)),
tf as (select row, doc_id, term, count(*) as tf from terms group by all),
size as (select row, sum(tf)::bigint as n from tf group by row),
total as (select count(*) as n, sum(n)::bigint as l from size),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
weight as (select term, floor(1000 * ln((2 * t.n + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, total t where term in (select term from asked) group by term, t.n),
scored as (select a.item_id, f.row, f.doc_id, sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * s.n * t.n) // t.l))))::bigint as score
    from asked a join weight w on a.term = w.term join tf f on f.term = a.term join size s on s.row = f.row, total t group by all),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


@register("op11_geometric_blocks_search", OP11_SQL)
def q_ranked_search(spark, sf):
    return ranked_search.search(read(spark, sf, "documents"), read(spark, sf, "benchmark"), k=10)
