"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, jaccard_join, line_dedup, minhash, quality, sharding, token_files, topk, toxicity, trie, yinyang
from .base import id_of, table

SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, slot_map = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    version = slot_map.select("vslot", "version")
    return placed.join(F.broadcast(version), "vslot").select(  # one row for each virtual slot
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"), F.col("version").alias("map_version")
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(id_of("d").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.clusters(table(spark, sf_dir, "embeddings"))[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_sharding, op2_byte_bpe, op3_decontamination, op4_quality, op5_jaccard_join, op6_html_text, op7_token_files, op8_line_dedup, op9_exact_topk, op10_toxicity, op11_minhash, op12_prefix_trie, op13_yinyang)
    return {f.__name__: f for f in own}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select cast(item_id as varchar) item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
lens as (select distinct least(len(w), 13) n from b where len(w) > 0),
bw as (select distinct item, least(len(w), 13) n, list_aggregate(w[i : i + least(len(w), 13) - 1], 'string_agg', ' ') g
       from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from b where len(w) > 0)),
dw as (select doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') g
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d cross join lens where len(w) >= n)),
hit as (select doc_id, item, i, dw.n from dw join bw using (n, g)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hit) group by 1),
items as (select doc_id, count(distinct item) n_items, string_agg(distinct item, ',' order by item) l from hit group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
from d left join pos using (doc_id) left join items using (doc_id)
"""

def _duplicates_sql(shingle: int, percent: int, more: str = "") -> str:
    return rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, list_aggregate(w[i : i + least(len(w), {shingle}) - 1], 'string_agg', ' ') g
      from (select doc_id, w, unnest(range(1, len(w) - least(len(w), {shingle}) + 2)) i from d where len(w) > 0)),
n as (select doc_id, count(*) c from s group by 1),
link as (select p.x, p.y from (select a.doc_id x, b.doc_id y, count(*) shared from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2) p
         join n nx on nx.doc_id = p.x join n ny on ny.doc_id = p.y where 100 * shared >= {percent} * (nx.c + ny.c - shared)),
reach as (select doc_id x, doc_id y from d union select reach.x, link.y from reach join link on reach.y = link.x)
select x doc_id, cast(coalesce(c, 0) as bigint) n_shingles, min(y) component_id{more} from reach left join n on n.doc_id = x group by x, c
"""


OP5_SQL = _duplicates_sql(5, 75)
OP11_SQL = _duplicates_sql(4, 80, ", x = min(y) kept")

OP9_SQL = """
with v as (select cast(vec_id as bigint) vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id query_id, c.vec_id vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank from p)
select query_id, rank, vec_id, score from r where rank <= 10
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295)"""

OP12_SQL = rf"""
with own as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, role, text) r, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) m from conversations where conv_id is not null),
l as (select c, max(r) n, any_value({_CRC32} % 4) h from own group by c),
b as (select l.c, l.h, least(l.h, coalesce(z.n, 0)) k, l.c - l.c % 20 base from l left join l z on z.c = l.c - l.c % 20),
t as (select b.c, r d, m from b join own on own.c = b.base where r <= h union all select b.c, k + r - h d, m from b join own using (c) where r > h),
s as (select b.c, coalesce(q, []) q from b left join (select c, list(m order by d) q from t group by c) using (c)),
p as (select c, q, unnest(range(0, len(q) + 1)) d from s),
n as (select d, q[1 : d] k, min(c) conv_id, count(*) n_convs, coalesce(string_agg(c, ',' order by c) filter (len(q) = d), '') ends from p group by 1, 2),
o as (select *, case when d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(k[d].t, '[^\x20\x09-\x0D]+')) end own from n),
kids as (select d - 1 d, k[1 : d - 1] k, count(*) n_children from n where d > 0 group by 1, 2),
sub as (select a.d, k[1 : a.d] k, sum(o.own) saved, count(*) filter (kids.n_children is null) leaves from o left join kids using (d, k), unnest(range(0, o.d + 1)) a(d) group by 1, 2)
select n.conv_id, n.d as depth, up.conv_id parent_conv_id, n.n_convs, cast(coalesce(n_children, 0) as bigint) n_children, cast(leaves as bigint) n_leaves, cast(saved as bigint) saved_tokens, sha256(n.ends) ends_sha256
from n join sub using (d, k) left join kids using (d, k) left join n up on up.d = n.d - 1 and up.k = n.k[1 : n.d - 1]
"""

_NEAR = "arg_min(c, struct_pack(d := list_sum(list_transform(list_zip(e, x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), n := c))"
_ROUND = """a{r} as (select k, any_value(e) e, {near} c from v, c{r} group by k),
s{r} as (select c, i, sum(e[i]) s, count(*) n from (select c, e, unnest(range(1, 65)) i from a{r}) group by c, i),
m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) x from s{r} group by c),
c{q} as (select c, coalesce(m.x, c{r}.x) x from c{r} left join m{r} m using (c)),"""

OP13_SQL = f"""
with v as (select row_number() over () k, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) e from embeddings
           where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as (select row_number() over (order by sha256('1:' || vec_id), e) - 1 c, e x from v qualify c < 16),
{"".join(_ROUND.format(r=r, q=r + 1, near=_NEAR) for r in range(3))}
a as (select k, {_NEAR} c from v, c3 group by k),
d as (select vec_id, c, x, list_sum(list_transform(list_zip(e, x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from a join v using (k) join c3 using (c))
select vec_id, cast(c as integer) as cluster, cast(d as bigint) distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(x, ',')) centroid_sha256 from d
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op5_jaccard_join": OP5_SQL, "op9_exact_topk": OP9_SQL, "op11_minhash": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_yinyang": OP13_SQL}
