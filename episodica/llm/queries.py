"""The operators as registered queries: each applied, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import licenses
from episodica.llm.alignment import align
from episodica.llm.common import table
from episodica.llm.fingerprints import compare_with_edits
from episodica.llm.html_text import extract
from episodica.llm.langid import identify
from episodica.llm.minhash import near_duplicates
from episodica.llm.mixing import mix, shuffled
from episodica.llm.packing import pack
from episodica.llm.rolling import rolling_features
from episodica.llm.setjoin import similar_sets
from episodica.llm.sharding import shard_by_size
from episodica.llm.tokens import count_tokens
from episodica.llm.topk import top_k


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_size(table(spark, sf_dir, "documents"), 24)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the square roots of their sizes, as many rows as there are, in random order."""
    return shuffled(mix(table(spark, sf_dir, "documents"))).withColumn("rate", F.round("rate", 9))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_setjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), size=3, percent=90)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


def op13_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_features(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_html": op2_html,
    "op3_licenses": op3_licenses,
    "op4_langid": op4_langid,
    "op5_fingerprints": op5_fingerprints,
    "op6_topk": op6_topk,
    "op7_mixing": op7_mixing,
    "op8_minhash": op8_minhash,
    "op9_packing": op9_packing,
    "op10_tokens": op10_tokens,
    "op11_setjoin": op11_setjoin,
    "op12_alignment": op12_alignment,
    "op13_rolling": op13_rolling,
}

#: The checksum is written out, for the engine has no crc32: a table of the 256 bytes, then a fold over each text's bytes.
OP1_SQL = """
    with t as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
                      lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
    b as (select doc_id, text, list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::bigint)) as bytes from documents),
    d as (select doc_id, (coalesce(octet_length(encode(text)), 0) + 8)::bigint as size, coalesce(('0x' || substr(md5(text), 1, 15))::bigint, -1) as key,
          xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::bigint as text_crc32 from b, t),
    o as (select *, row_number() over w as rank, sum(size) over w - size as start, sum(size) over () as total from d window w as (order by key, doc_id nulls first)),
    p as (select *, least(23, (start * 2 + size) * 24 // (2 * total))::int as shard from o)
    select doc_id, size, text_crc32, 'bytes' as law, shard, (row_number() over (partition by shard order by rank) - 1)::bigint as slot, null::int as grown_shard from p"""

OP6_SQL = """
    with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
               where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
    select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20"""

OP7_SQL = """
    with s as (select source, count(*) as n from documents group by 1),
    r as (select source, sqrt(n) * (select sum(n) from s) / (select sum(sqrt(n)) from s) / n as rate from s),
    p as (select source, rate, greatest(1, ceil(rate / 16))::int as parts from r),
    t as (select source, rate, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) over (partition by source order by k) as c
          from p cross join (select unnest(range(64)) as k)),
    f as (select source, any_value(rate) as rate, any_value(parts) as parts, list(c order by k) as c from t group by 1),
    u as (select d.*, f.rate, f.c, unnest(range(1, f.parts + 1)) as part from documents d join f on d.source is not distinct from f.source),
    m as (select doc_id, sum(len(list_filter(c, lambda x: x <= ('0x' || substr(md5('mix0|' || doc_id || '|' || part), 1, 13))::bigint / 4503599627370496.0::double)))::int as n_copies
          from u group by 1),
    e as (select d.*, m.n_copies, round(f.rate, 9) as rate, unnest(range(1, m.n_copies + 1))::int as copy
          from documents d join m using (doc_id) join f on d.source is not distinct from f.source)
    select *, ('0x' || substr(md5('order0|' || doc_id || '|' || copy), 1, 15))::bigint as mix_key from e"""

OP8_SQL = """
    with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from w where w is not null),
    n as (select doc_id, count(*) as n from s group by 1),
    c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.n + q.n - c)),
    e as (select x, y from l union all select y, x from l),
    t as (select doc_id as x, doc_id as y from documents union select t.x, e.y from t join e on e.x = t.y),
    m as (select x as doc_id, min(y) as component_id from t group by 1)
    select m.doc_id, coalesce(n, 0) as n_shingles, component_id, m.doc_id = component_id as kept from m left join n using (doc_id)"""

OP11_SQL = """
    with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
    s as (select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s from w where w is not null),
    n as (select doc_id, count(*) as n from s group by 1),
    c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
    l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 90 * (p.n + q.n - c)),
    e as (select x, y from l union all select y, x from l),
    t as (select doc_id as x, doc_id as y from documents union select t.x, e.y from t join e on e.x = t.y),
    m as (select x as doc_id, min(y) as component_id from t group by 1)
    select m.doc_id, coalesce(n, 0) as n_shingles, component_id from m left join n using (doc_id)"""

OP13_SQL = """
    with t as (select list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
                      lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
    b as (select doc_id, source, lang, length(text)::bigint as chars,
          list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(doc_id::varchar)), '..'), lambda h: ('0x' || h)::bigint)) as bytes from documents),
    h as (select doc_id, source, lang, chars, doc_id + xor(list_reduce(bytes, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::bigint % 1000 as x from b, t),
    d as (select doc_id, source, lang, chars, row_number() over () as r, ((x - ((x % 6) + 6) % 6) * 10)::bigint as event_s from h),
    w as (select r, doc_id, source, event_s, unnest([1800, 86400])::bigint as window_s from d),
    j as (select w.r, w.window_s, any_value(w.doc_id) as doc_id, any_value(w.event_s) as event_s, count(o.r) as n_events, coalesce(sum(o.chars), 0)::bigint as sum_chars,
          count(distinct o.lang) as n_langs, count(o.chars) as m, list_sort(list(o.chars) filter (o.chars is not null)) as c
          from w left join d o on w.source is not distinct from o.source and o.event_s >= w.event_s - w.window_s and o.event_s < w.event_s group by 1, 2)
    select doc_id, window_s, event_s, n_events, sum_chars, n_langs, c[(m + 1) // 2] as median_chars, c[(99 * m + 99) // 100] as high_chars from j"""

#: The other operators are trained, sampled by hashes SQL engines don't share, or encode text; the tests compare them with brute force.
ORACLES: dict[str, str] = {"op1_sharding": OP1_SQL, "op3_licenses": licenses.oracle_sql(), "op6_topk": OP6_SQL, "op7_mixing": OP7_SQL, "op8_minhash": OP8_SQL, "op11_setjoin": OP11_SQL, "op13_rolling": OP13_SQL}
