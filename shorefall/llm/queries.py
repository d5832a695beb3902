"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import components

    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages"))


def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import repeated

    # a row for each repeated stretch, with the number of earlier documents it is linked to and the smallest of them (links are in order)
    found = repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_hash", "start", "end", F.col("links")[0]["of_doc"].alias("of_doc"), F.col("links")[0]["similarity"].alias("similarity"), F.size("links").cast("long").alias("n_docs"))


def op3_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .voronoi import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP3_SQL = """
with v as (
  select vec_id, [floor(256 * x::double) for x in embedding]::double[] as q from embeddings
  where vec_id is not null and embedding is not null
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
s as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP9_SQL = f"""
with w as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as ws from documents),
i as (select distinct item_id::varchar as item, {_WORDS.format("text")} as ws from benchmark where item_id is not null and text is not null),
n as (select item, ws, least(10, len(ws)) as n from i where len(ws) > 0),
g as (select distinct item, n, array_to_string(ws[k : k + n - 1], ' ') as g from (select *, unnest(range(1, len(ws) - n + 2)) as k from n)),
d as (select r, k, n, array_to_string(ws[k : k + n - 1], ' ') as g
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as k from w, (select distinct n from n) where len(ws) >= n)),
h as (select r, k, n, item from d join g using (n, g)),
hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(k, k + n)) as place from h) group by 1),
its as (select r, count(distinct item) as n_items, sha256(string_agg(distinct item, ',' order by item)) as items from h group by 1)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hit using (r) left join its using (r)
"""


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transducer import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spchunks import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dac import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


_TERMS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_TERMS.format("coalesce(text, '')")} as ts from documents),
size as (select count(*)::bigint as docs, sum(len(ts))::bigint as terms from d where len(ts) > 0),
f as (select r, doc_id, n, t, count(*)::bigint as tf from (select r, doc_id, len(ts)::bigint as n, unnest(ts) as t from d) group by all),
df as (select t, count(*)::bigint as df from f group by 1),
i as (select row_number() over () as i, item_id, list_distinct({_TERMS.format("text")}) as ts from benchmark where text is not null),
q as (select i, item_id, t, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select i, item_id, unnest(ts) as t from i) join df using (t), size),
s as (select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::bigint as score
  from q join f using (t), size group by all),
k as (select *, row_number() over (partition by i order by score desc, doc_id nulls last)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from k where rank <= 50
"""


def op11_dualtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dualtree import ranked

    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


_SIGNS = "'[\\x21-\\x40\\x5B-\\x60\\x7B-\\x7E]+'"
OP12_SQL = f"""
with d as (select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    case when length(text) > 0 then greatest(0.01::double, length(regexp_replace(text, {_SIGNS}, '', 'g'))::double / length(text)) else 0.01::double end as q,
    (('0x' || substr(md5('12|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double as u from documents),
z as (select source, sum(size)::bigint as size, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3]::bigint as w from d group by 1),
a as (select sum(size)::bigint as words, sum(w)::bigint as ws from z),
l as (select z.*, row_number() over (order by size::double / w, source nulls last) as o, size::double / w as ratio,
    words * 1.5::double - 2 * coalesce(sum(size) over (order by size::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as rest,
    ws - coalesce(sum(w) over (order by size::double / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as lft from z, a),
e as (select o, rest, lft from l where rest * w <= size * 2.0::double * lft order by o limit 1),
t as (select l.source, l.size as source_size, least(size * 2.0::double, case when l.o >= e.o then e.rest * w / e.lft::double else size * 2.0::double end) as target from l left join e on true),
p as (select r, doc_id, d.size, source_size, target, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as full_,
    coalesce(sum(d.size) over (partition by d.source order by -ln(u) / q, doc_id nulls first, d.size, r rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (full_ * size + greatest(0, least(size, floor(target - full_ * source_size)::bigint - before)))::bigint as taken from p
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("key")


_BITS = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, _: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
_CRC32 = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::varchar, ''), lambda ch: ascii(ch)::bigint)), lambda a, b: {_BITS}), 4294967295)"
OP13_SQL = f"""
with t as (select conv_id as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select c, row_number() over (partition by c order by turn nulls first, md5(role), md5(text)) as pos, role, text from t),
z as (select c, count(*) as n, {_CRC32} % 6 as h, c - c % 100 as b from n group by c),
w as (select z.*, least(h, coalesce(y.n, 0)) as taken from z left join (select c as b, n from z) y using (b)),
r as (select w.c, pos, role, text from w join n on n.c = w.b where pos <= taken union all select w.c, pos - h + taken, role, text from w join n using (c) where pos > h),
q as (select c, pos, text, string_agg(role || chr(1) || text, chr(2)) over (partition by c order by pos rows between unbounded preceding and current row) as path from r),
p as (select c, pos, path, length(text)::bigint as cps, taken + greatest(n - h, 0) as len from q join w using (c) union all select c, 0, '', 0, taken + greatest(n - h, 0) from w),
v as (select pos as depth, path, min(c) as conv_id, count(*) as n_convs, min(cps) as cps, coalesce(string_agg(c::varchar, ',' order by c) filter (len = pos), '') as ends from p group by 1, 2),
u as (select a.depth, a.path, x.depth as below, (x.n_convs - 1) * x.cps as saved, not exists (select 1 from v k where k.depth = x.depth + 1 and (x.depth = 0 or starts_with(k.path, x.path || chr(2)))) as leaf
  from v a join v x on a.depth = 0 or a.path = x.path or (x.depth > a.depth and starts_with(x.path, a.path || chr(2)))),
s as (select depth, path, count(*) filter (below = depth + 1) as n_children, count(*) filter (leaf) as n_leaves, sum(saved) as saved_tokens from u group by 1, 2)
select v.conv_id, v.depth::bigint as depth, o.conv_id as parent_conv_id, v.n_convs::bigint as n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(v.ends) as ends_sha256
from v join s using (depth, path) left join v o on o.depth = v.depth - 1 and (o.depth = 0 or starts_with(v.path, o.path || chr(2)))
"""


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import forked_trie

    return forked_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {"op1_quality": op1_quality, "op2_html": op2_html, "op7_windows": op7_windows, "op10_urls": op10_urls, "op4_token_counts": op4_token_counts, "op6_sentencepiece": op6_sentencepiece, "op8_dac": op8_dac, "op3_voronoi": op3_voronoi, "op5_simhash": op5_simhash, "op9_decontam": op9_decontam, "op11_dualtree": op11_dualtree, "op12_mixing": op12_mixing, "op13_trie": op13_trie}


def oracle_sql() -> dict[str, str]:
    return {"op3_voronoi": OP3_SQL, "op9_decontam": OP9_SQL, "op11_dualtree": OP11_SQL, "op12_mixing": OP12_SQL, "op13_trie": OP13_SQL}
