"""Registered queries over the driver's tables, and the same in DuckDB SQL.

Roles: documents are articles (up to 4000 characters) and books, user and assistant turns are question-answer pairs,
benchmark items are queries, an item that a document holds word for word is relevance, and vec_id = doc_id or item_id
gives documents and queries their vectors.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import ann, augment, blockmax, chunking, dense, embed, evaluate, language, quality, rag, ratings, retrieval, search, sparse, training
from ..operators import labels as ml
from ..sources import html, records, scratch, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables whose rows cost far more to work on than to move, should they come in one piece.
TEXTS = ("documents", "pages")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return records.spread(rows) if name in TEXTS else rows


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Dirty text that the tables lack; the same rows in both engines.
DIRTY = [
    (1, "اUﻛﺜﺮ من ذلك اUحوال"),
    (2, "قال Uن هذا Uزمات و ا%ولية"),
    (3, "سطر  أول \t\n\n\n\n  سطر ثان  \n"),
    (4, "(cid:12)نص (cid:7)  مكسور"),
    (5, "مُدَرِّسَةٌ إلى آخرى أنا"),
    (6, "a b c d e f g h i j k l m"),
    (7, ""),
    (8, "UUن U%U كلمة"),
]
_DIRTY_SQL = "(values " + ", ".join(f"({i}, {chr(39)}{t}{chr(39)})" for i, t in DIRTY) + ") v(id, text)"
_ALL_SQL = f"(select doc_id id, text from documents union all select -id, text from {_DIRTY_SQL})"


def _all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = spark.createDataFrame(DIRTY, "id long, text string")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(dirty.withColumn("id", -F.col("id")))


def _hashed(texts: DataFrame, new: Column) -> DataFrame:
    return texts.select("id", new.alias("t")).select("id", F.length("t").cast("long").alias("n"), F.md5("t").alias("md5"))


def _hashed_sql(new: str) -> str:
    return f"select id, length(t) n, md5(t) md5 from (select id, {new} t from {_ALL_SQL})"


_NORMAL = r"translate(regexp_replace(text, '[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06ED}]', '', 'g'), 'آأإىيی', 'ااايييي')".replace("ااايييي", "ااا" + "ييي")
_TOKENS = rf"list_filter(regexp_split_to_array({_NORMAL}, '\s+'), lambda x: x <> '')"
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _repair_sql(text: str) -> str:
    for pattern, new in T.REPAIRS:
        pattern, new = pattern.replace(T.ARABIC, r"([\x{0600}-\x{06FF}])"), new.replace("$1", r"\1")
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


def _tidy_sql(text: str) -> str:
    text = rf"regexp_replace({text}, '[ \t\r\f\v]*\n[ \t\r\f\v]*', chr(10), 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '\A[ \t\r\f\v]+|[ \t\r\f\v]+\z', '', 'g'), '\n{{2,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({text}, '[ \t]+', ' ', 'g'), '(?m)[ \t\r\f\v]+$', '', 'g')"


@_query(_hashed_sql(_NORMAL))
def normalize_text(spark, d):
    return _hashed(_all_texts(spark, d), T.normalize_arabic(F.col("text")))


@_query(_hashed_sql(_repair_sql("text")))
def repair_text(spark, d):
    return _hashed(_all_texts(spark, d), T.repair(F.col("text")))


@_query(_hashed_sql(r"regexp_replace(regexp_replace(regexp_replace(text, '\(cid:\d+\)', '', 'g'), ' {2,}', ' ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g')"))
def cid_clean(spark, d):
    return _hashed(_all_texts(spark, d), T.strip_cid(F.col("text")))


@_query(_hashed_sql(_STRIP.format(r"regexp_replace(regexp_replace(" + _tidy_sql(_repair_sql("text")) + r", '\n{3,}', chr(10) || chr(10), 'g'), '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]', '', 'g')")))
def clean_text(spark, d):
    return _hashed(_all_texts(spark, d), T.clean_for_rag(F.col("text")))


@_query(_hashed_sql(_STRIP.format(_tidy_sql("text"))))
def ocr_clean(spark, d):
    return _hashed(_all_texts(spark, d), T.clean_ocr(F.col("text")))


@_query(f"select id, cast(len({_TOKENS}) as bigint) n_tokens, cast(len(list_distinct({_TOKENS})) as bigint) n_distinct, cast(len({_WORDS}) as bigint) n_words from {_ALL_SQL}")
def token_counts(spark, d):
    tokens = T.tokenize(F.col("text"))
    return _all_texts(spark, d).select("id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"), T.word_count(F.col("text")).alias("n_words"))


@_query(
    rf"""select id, case when length(text) > 300 then substr(text, 1, 297) || '...' else text end cut, translate(substr(text, 1, 200), chr(10), ' ') preview,
    length(regexp_replace(text, '[^\x{{0600}}-\x{{06FF}}]', '', 'g')) arabic,
    len({_WORDS}) > 10 and len(list_filter({_WORDS}, lambda w: regexp_full_match(w, '\p{{L}}'))) > 0.4 * len({_WORDS}) corrupt,
    len({_WORDS}) > 20 and len(list_distinct({_WORDS})) < 0.3 * len({_WORDS}) repetitive,
    regexp_matches(text, '\p{{N}}') and regexp_matches(text, '[-:]') date_like, substr(regexp_replace(text, '[^\p{{L}}\p{{N}}_-]', '', 'g'), 1, 50) ident from {_ALL_SQL}"""
)
def text_features(spark, d):
    t = F.col("text")
    return _all_texts(spark, d).select(
        "id", T.truncate(t).alias("cut"), T.preview(t).alias("preview"), T.arabic_chars(t).alias("arabic"), T.is_heavily_corrupt(t).alias("corrupt"),
        T.is_repetitive(t).alias("repetitive"), T.looks_like_date(t).alias("date_like"), T.identifier(t).alias("ident"),
    )


_QA_SQL = "(select conv_id || '_' || turn id, text question, answer from (select *, lead(role) over w r, lead(text) over w answer from conversations window w as (partition by conv_id order by turn)) where role = 'user' and r = 'assistant')"


@_query(f"select 'qa_' || id doc_id, substr(question, 1, 200) title, answer clean_text, 'qa_pair' kb_family from {_QA_SQL}")
def qa_pairs(spark, d):
    return records.qa_documents(records.conversation_pairs(_table(spark, d, "conversations"))).select("doc_id", "title", "clean_text", "kb_family")


def _knowledge_base(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.col("n_chars") <= 4000, "article").otherwise("book")
    docs = _table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("text").alias("clean_text"), family.alias("kb_family"), family.alias("content_type"), F.concat(F.lit("https://example.org/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.substring("text", 1, 60).alias("title"), F.col("lang").alias("language"))
    qa = records.qa_documents(records.conversation_pairs(_table(spark, d, "conversations"))).select("doc_id", "title", "clean_text", "kb_family", "content_type")
    return records.load_documents(("article", docs), ("qa_pair", qa))


_KB_SQL = f"""(select 'doc_' || doc_id doc_id, text clean_text, case when n_chars <= 4000 then 'article' else 'book' end kb_family, 'https://example.org/' || source || '/' || doc_id url, substr(text, 1, 60) title from documents
union all select 'qa_' || id, answer, 'qa_pair', null, substr(question, 1, 200) from {_QA_SQL})"""


@_query(f"select kb_family, count(*) n from {_KB_SQL} group by 1")
def kb_family_counts(spark, d):
    return quality.family_counts(_knowledge_base(spark, d))


def _window_sql(text: str, size: str = "1200", overlap: str = "200") -> str:
    return f"unnest(range(0, case when length({text}) <= {size} then (length({text}) > 0)::int else 1 + cast(ceil((length({text}) - {size})::double / ({size} - {overlap})) as int) end)) i"


_CHUNKS_SQL = f"""(select doc_id, i chunk_index, i * 1000 char_start, least(i * 1000 + 1200, length(t)) char_end, {_STRIP.format("substr(t, i * 1000 + 1, 1200)")} text
from (select doc_id, t, {_window_sql("t")} from (select doc_id, {_STRIP.format("text")} t from documents)))"""


@_query(f"select doc_id, cast(chunk_index as integer) chunk_index, char_start, char_end, text from {_CHUNKS_SQL}")
def char_chunks(spark, d):
    return chunking.char_chunks(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "char_start", "char_end", "text")


_KB_CHUNKS_SQL = f"""(with k as (select *, {_STRIP.format("clean_text")} t from {_KB_SQL}),
c as (select doc_id, kb_family, t, 0 i, true whole from k where kb_family = 'qa_pair' and length(t) between 1 and 4000
union all select doc_id, kb_family, t, {_window_sql("t")}, false from k where not (kb_family = 'qa_pair' and length(t) <= 4000))
select doc_id || '_chunk_' || i chunk_id, doc_id parent_doc_id, kb_family, i chunk_index, count(*) over (partition by doc_id) num_chunks_total,
case when whole then 0 else i * 1000 end char_start, case when whole then length(t) else least(i * 1000 + 1200, length(t)) end char_end,
case when whole then t else {_STRIP.format("substr(t, i * 1000 + 1, 1200)")} end text from c)"""


@_query(f"select chunk_id, parent_doc_id, kb_family, cast(chunk_index as bigint) chunk_index, num_chunks_total, cast(char_start as bigint) char_start, cast(char_end as bigint) char_end, text from {_KB_CHUNKS_SQL}")
def kb_chunks(spark, d):
    return chunking.kb_chunks(_knowledge_base(spark, d)).select("chunk_id", "parent_doc_id", "kb_family", "chunk_index", "num_chunks_total", "char_start", "char_end", "text")


@_query(f"select kb_family, count(*) n_chunks, count(distinct parent_doc_id) n_docs, round(avg(length(text)), 6) avg_size from {_KB_CHUNKS_SQL} group by 1")
def chunk_stats(spark, d):
    return chunking.kb_chunks(_knowledge_base(spark, d)).groupBy("kb_family").agg(F.count("*").alias("n_chunks"), F.countDistinct("parent_doc_id").alias("n_docs"), _r(F.avg(F.length("text"))).alias("avg_size"))


@_query(f"select count(*) n_chunks, count(distinct kb_family) n_families, count(distinct parent_doc_id) n_docs from {_KB_CHUNKS_SQL}")
def index_stats(spark, d):
    return quality.index_stats(chunking.kb_chunks(_knowledge_base(spark, d)))


def _strategy_query(name: str, strategy: str, sql: str | None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return chunking.chunk_rows(_table(spark, d, "documents"), strategy)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _last(mark: str, low: str, high: str) -> str:
    """Place (from 0) of the last mark that lies inside [low, high) of t, or -1."""
    part = f"substr(t, {low} + 1, {high} - {low})"
    return f"case when contains({part}, {mark}) then {high} - strpos(reverse({part}), reverse({mark})) - length({mark}) + 1 else -1 end"


_TEXTS_SQL = "d as (select doc_id, text t, length(text) n from documents where text is not null)"
_PIECES_SQL = f"""select doc_id, row_number() over (partition by doc_id order by s) chunk_number, s as start, e as "end", text
from (select doc_id, s, e, {_STRIP.format("substr(t, s::int + 1, (e - s)::int)")} text from w join d using (doc_id)) where text <> ''"""


def _walk_sql(cut: str, following: str) -> str:
    """Windows from s: cut gives the end e for a start s, following the next start."""
    return f"""with recursive {_TEXTS_SQL}, w(doc_id, s, e) as (select doc_id, s, {cut} e from (select *, 0::bigint s from d) where n > 0
union all select doc_id, s, {cut} from (select doc_id, t, n, {following} s from w join d using (doc_id)) where s < n) {_PIECES_SQL}"""


_DOT, _ASK = "'.' || chr(10)", "chr(1567)"
_BOUNDARY_SQL = _walk_sql(f"case when s + 800 < n and greatest({_last(_DOT, 's + 600', 's + 800')}, {_last(_ASK, 's + 600', 's + 800')}, {_last(chr(39) + '!' + chr(39), 's + 600', 's + 800')}) >= 0 then greatest({_last(_DOT, 's + 600', 's + 800')}, {_last(_ASK, 's + 600', 's + 800')}, {_last(chr(39) + '!' + chr(39), 's + 600', 's + 800')}) + 1 else s + 800 end", "case when e < n then e - 100 else e end").replace("s + 600 + 1", "(s + 600)::int + 1").replace("s + 800 - s + 600", "200")
_MARKED = "translate(t, chr(10) || chr(1567), '..')"
_BACKWARD_SQL = _walk_sql(f"case when s + 800 < n and contains(substr({_MARKED}, (s + 701)::int + 1, 100), '.') then s + 801 - strpos(reverse(substr({_MARKED}, (s + 701)::int + 1, 100)), '.') + 1 else s + 800 end", "e")


def _recursive_sql() -> str:
    low, cut = "(s + 151)", "least(s + 800, n)"
    tries = "".join(f" when s + 800 < n and contains(substr(t, {low}::int + 1, 649), {m}) then s + 800 - strpos(reverse(substr(t, {low}::int + 1, 649)), reverse({m})) + 1" for m in ("chr(10) || chr(10)", "chr(10)", "'. '", "chr(1567)", "'!'", "' '"))
    blank = "strpos(substr(t, (b + 1)::int, (e - b)::int), ' ')"
    after = f"case when {blank} > 0 then b + {blank} else b end"
    return f"""with recursive {_TEXTS_SQL}, w(doc_id, s, e) as (select doc_id, s, case{tries} else {cut} end e from (select *, 0::bigint s from d) where n > 0
union all select doc_id, s, case{tries} else {cut} end from (select doc_id, t, n, {after} s from (select doc_id, t, n, e, greatest(s + 1, e - 150) b from w join d using (doc_id) where e < n))) {_PIECES_SQL}"""


# sentences as a list, p: their lengths summed up (with a blank after each in the windows)
def _parts_sql(split: str, joint: int) -> str:
    return f"""p as (select doc_id, x, len(x) n, list_transform(range(0, len(x) + 1), lambda i: coalesce(list_sum(list_transform(x[1:i], lambda y: length(y) + {joint})), 0)::bigint) u
from (select doc_id, list_filter(list_transform({split}, lambda y: {_STRIP.format("y")}), lambda y: y <> '') x from documents where text is not null and {_STRIP.format("text")} <> ''))"""


_SENTENCES = r"regexp_split_to_array(regexp_replace(text, '([.!?\x{061F}])\s+', '\1' || chr(1), 'g'), '" + "\x01" + "')"
_LINES = r"regexp_split_to_array(regexp_replace(text, '([.!?\x{061F}])\s+', '\1' || chr(10), 'g'), '\n+')"
_END = "coalesce(list_min(list_filter(range({m}, n), lambda i: u[i + 2] - u[f + 1] > 1201)), n)"
_SENTENCE_WINDOWS_SQL = f"""with recursive {_parts_sql(_LINES, 1)},
g(doc_id, f, z, pl) as (select doc_id, 0::bigint, {_END.replace("u[f + 1]", "u[1]").format(m="1")}, 0::bigint from p where n > 0
union all select doc_id, f, {_END.format(m="z + 1")}, pl from (select doc_id, n, u, z, coalesce(list_min(list_filter(range(f, z), lambda i: u[i + 1] >= u[z + 1] - 201)), z) f, pl + u[z + 1] - u[f + 1] - 1 - (u[z + 1] - u[coalesce(list_min(list_filter(range(f, z), lambda i: u[i + 1] >= u[z + 1] - 201)), z) + 1]) pl from g join p using (doc_id) where z < n))
select doc_id, row_number() over (partition by doc_id order by z) chunk_number, pl as start, pl + length(array_to_string(x[f + 1 : z], ' ')) as "end", array_to_string(x[f + 1 : z], ' ') text from g join p using (doc_id)"""
# one step for each sentence i: first a flush before it (b to i), then one after it
_SENTENCE_GROUPS_SQL = f"""with recursive {_parts_sql(_SENTENCES, 0)},
g(doc_id, i, f, pl, e1, e2, b1) as (select doc_id, -1::bigint, 0::bigint, 0::bigint, null::bigint, null::bigint, null::bigint from p
union all select doc_id, i + 1, case when u[i + 3] - u[h + 1] >= 800 then greatest(h, i) else h end, pl1 + case when u[i + 3] - u[h + 1] >= 800 then u[i + 3] - u[h + 1] else 0 end,
case when before then i + 1 end, case when u[i + 3] - u[h + 1] >= 800 then i + 2 end, case when before then f end
from (select *, case when before then greatest(f, i - 1) else f end h, pl + case when before then u[i + 2] - u[f + 1] else 0 end pl1
from (select g.*, p.u, p.n, i + 1 > f and u[i + 2] - u[f + 1] + length(x[i + 2]) > 1500 before from g join p using (doc_id) where i + 1 < n))),
st as (select *, lag(f) over (partition by doc_id order by i) f0, lag(pl) over (partition by doc_id order by i) pl0 from g),
c as (select doc_id, i, 0 o, b1 f, e1 z, pl0 as start from st where e1 is not null
union all select st.doc_id, i, 1, case when e1 is not null then greatest(f0, i - 2) else f0 end, e2, pl0 + case when e1 is not null then u[e1 + 1] - u[b1 + 1] else 0 end from st join p using (doc_id) where e2 is not null
union all select doc_id, i + 1, 2, f, n, pl from g join p using (doc_id) where i + 1 = n and length(array_to_string(x[f + 1 : n], ' ')) >= 200)
select doc_id, row_number() over (partition by doc_id order by i, o) chunk_number, start, start + u[z + 1] - u[f + 1] as "end", array_to_string(x[f + 1 : z], ' ') text from c join p using (doc_id)"""

for _n, _s, _q in (
    ("sentence_chunks", "sentence_window", _SENTENCE_WINDOWS_SQL), ("sentence_group_chunks", "sentence", _SENTENCE_GROUPS_SQL), ("paragraph_chunks", "paragraph", None),
    ("boundary_chunks", "boundary", _BOUNDARY_SQL), ("backward_chunks", "backward", _BACKWARD_SQL), ("recursive_chunks", "recursive", _recursive_sql()),
):
    _strategy_query(_n, _s, _q)


_GRAMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')"
_LANG_SQL = f"""w as (select doc_id, lang, doc_id % 5 = 0 held, '_' || substr(unnest({_GRAMS}), 1, 64) || '_' w from documents),
g as (select doc_id, lang, held, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) gram from w),
c as (select gram, lang, count(*) c from g where not held and lang is not null group by 1, 2), top as (select gram from c group by 1 order by sum(c) desc, gram limit 20000),
l as (select distinct lang from c), t as (select lang, sum(c) t from c semi join top using (gram) group by 1),
p as (select gram, l.lang, ln((coalesce(c, 0) + 1) / (t + (select count(*) from top))) s from top cross join l left join c using (gram, lang) join t on t.lang = l.lang),
s as (select doc_id, p.lang guess, sum(s) s from g join p using (gram) where held group by 1, 2),
b as (select doc_id, guess from (select *, row_number() over (partition by doc_id order by s desc, guess) r from s) where r = 1)"""


@_query(f"with {_LANG_SQL} select lang, count(*) n, count(*) filter (guess = lang) n_right from documents left join b using (doc_id) where doc_id % 5 = 0 and lang is not null group by 1")
def detected_languages(spark, d):
    """Languages of a fifth of the documents, by profiles of the others."""
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang").where("lang is not null")
    found = language.detect(docs.where("doc_id % 5 = 0"), language.learn(docs.where("doc_id % 5 <> 0")), "doc_id").withColumnRenamed("lang", "guess")
    return docs.where("doc_id % 5 = 0").select("doc_id", "lang").join(found, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("guess") == F.col("lang")).alias("n_right"))


@_query()
def book_chunks(spark, d):
    return chunking.book_chunks(_knowledge_base(spark, d).where("kb_family = 'book'"))


@_query()
def strategy_comparison(spark, d):
    return chunking.compare_strategies(_table(spark, d, "documents"), ["sentence", "paragraph", "recursive"])


_CHECKED_SQL = f"""(select *, list_filter([case when coalesce(title, '') = '' then 'Missing or empty required field: title' end, case when coalesce(url, '') = '' then 'Missing or empty required field: url' end,
 case when coalesce(clean_text, '') = '' then 'Missing or empty required field: clean_text' end, case when coalesce(clean_text, '') = '' then 'No text content (clean_text is empty)' end], lambda x: x is not null) issues,
 list_filter([case when length(title) between 1 and 2 then 'Title very short (' || length(title) || ' chars)' end, case when length(clean_text) between 1 and 49 then 'Text content very short (' || length(clean_text) || ' chars)' end,
 case when length(clean_text) between 50 and 99 then 'Text content short (' || length(clean_text) || ' chars)' end, case when length(clean_text) > 0 and len(w) < 10 then 'Very few words (' || len(w) || ' words)' end,
 case when len(w) > 20 and len(list_distinct(w)) < 0.3 * len(w) then 'Possible repetitive content detected' end], lambda x: x is not null) warnings
 from (select *, list_filter(regexp_split_to_array(clean_text, '\\s+'), lambda x: x <> '') w from {_KB_SQL}))"""


@_query(f"select doc_id, cast(len(issues) as integer) n_issues, cast(len(warnings) as integer) n_warnings, array_to_string(list_sort(issues), '; ') issues, array_to_string(list_sort(warnings), '; ') warnings from {_CHECKED_SQL}")
def validate_docs(spark, d):
    rows = quality.validate_articles(_knowledge_base(spark, d))
    return rows.select("doc_id", F.size("issues").alias("n_issues"), F.size("warnings").alias("n_warnings"), F.array_join(F.sort_array("issues"), "; ").alias("issues"), F.array_join(F.sort_array("warnings"), "; ").alias("warnings"))


@_query(
    f"""select count(*) total, count(*) filter (len(issues) = 0) valid, count(*) filter (len(issues) > 0) with_issues, count(*) filter (len(warnings) > 0) with_warnings, count(url) - count(distinct url) duplicate_urls,
    min(coalesce(length(clean_text), 0)) min_text, max(coalesce(length(clean_text), 0)) max_text, round(avg(coalesce(length(clean_text), 0)), 6) avg_text, round(avg(coalesce(length(title), 0)), 6) avg_title,
    round(100.0 * count(*) filter (len(issues) = 0) / greatest(count(*), 1), 6)::double valid_percent, count(*) filter (len(issues) > 0) = 0 passed from {_CHECKED_SQL}"""
)
def validation_summary(spark, d):
    return quality.validation_summary(quality.validate_articles(_knowledge_base(spark, d)))


@_query(f"select message, count(*) n from (select unnest(warnings) message from {_CHECKED_SQL}) group by 1 order by n desc, message limit 10")
def top_warnings(spark, d):
    return quality.top_messages(quality.validate_articles(_knowledge_base(spark, d)))


# Books that the tables lack: without a text, a title, a URL or a PDF; the same rows in both engines.
BOOKS = [
    ("b1", "book", "http://e.org/b1", "A title", "", "a.pdf"), ("b2", "book", "http://e.org/b2", "A title", "", ""), ("b3", "book", "no url", "T", "short text", ""),
    ("", "book", "", "", "x" * 50, "a.pdf"), ("b5", "", "http://e.org/b5", "Ti", "x" * 49, ""), ("b6", "book", "http://e.org/b6", "Tit", "   ", "a.pdf"),
]
_BOOKS_SQL = f"""(select doc_id, kb_family content_type, url, title, clean_text, null pdf_path from {_KB_SQL} where kb_family = 'book'
union all select * from (values {", ".join(str(b) for b in BOOKS)}) v(doc_id, content_type, url, title, clean_text, pdf_path))"""


@_query(
    f"""select doc_id, array_to_string(list_sort(list_filter([case when coalesce(doc_id, '') = '' then 'Missing or empty required field: doc_id' end, case when coalesce(content_type, '') = '' then 'Missing or empty required field: content_type' end,
 case when coalesce(url, '') = '' then 'Missing or empty required field: url' end, case when coalesce(title, '') = '' then 'Missing or empty required field: title' end,
 case when coalesce(url, '') <> '' and not regexp_matches(url, '^https?://[^/]') then 'Invalid URL format: ' || url end], lambda x: x is not null)), '; ') issues,
 array_to_string(list_sort(list_filter([case when coalesce(clean_text, '') = '' and coalesce(pdf_path, '') = '' then 'No text content and no PDF path' end,
 case when coalesce(clean_text, '') = '' and coalesce(pdf_path, '') <> '' then 'No extracted text (PDF might need manual processing)' end,
 case when length(clean_text) between 1 and 49 then 'Text content very short (' || length(clean_text) || ' chars)' end,
 case when length(title) between 1 and 2 then 'Title very short (' || length(title) || ' chars)' end], lambda x: x is not null)), '; ') warnings from {_BOOKS_SQL}"""
)
def validate_books(spark, d):
    made = spark.createDataFrame(BOOKS, "doc_id string, content_type string, url string, title string, clean_text string, pdf_path string")
    books = _knowledge_base(spark, d).where("kb_family = 'book'").unionByName(made, allowMissingColumns=True)
    rows = quality.validate_books(books)
    return rows.select("doc_id", F.array_join(F.sort_array("issues"), "; ").alias("issues"), F.array_join(F.sort_array("warnings"), "; ").alias("warnings"))


@_query("select page_id, url from (select page_id, url, row_number() over (partition by url order by page_id) n from pages where url is not null) where n > 1")
def duplicate_urls(spark, d):
    return quality.repeats_after_first(_table(spark, d, "pages").select("page_id", "url"), "url", "page_id")


@_query(f"select doc_id from (select doc_id, row_number() over (partition by array_to_string({_WORDS}, ' ') order by doc_id) n from documents) where n = 1")
def dedup_text(spark, d):
    docs = _table(spark, d, "documents")
    return quality.first_of(docs, F.sha2(T.collapsed(F.col("text")), 256), "doc_id").select("doc_id")


@_query(f"select sum(length(text)) chars_before, sum(length(t)) chars_after, count(*) filter (text <> t) changed from (select text, {_repair_sql('text')} t from {_ALL_SQL})".replace("sum(length(text))", "cast(sum(length(text)) as bigint)").replace("sum(length(t))", "cast(sum(length(t)) as bigint)"))
def repair_report(spark, d):
    return quality.change_report(_all_texts(spark, d).withColumn("t", T.repair(F.col("text"))), "text", "t")


# BM25 over the character chunks, one chunk id for each piece
_BM25_SQL = f"""c as (select doc_id * 100000 + chunk_index id, text from {_CHUNKS_SQL}), tok as (select id, unnest({_TOKENS}) token from c),
len as (select id, len({_TOKENS}) dl from c), st as (select count(*) n, avg(dl) avgdl from len), tf as (select id, token, count(*) tf from tok group by 1, 2),
df as (select token, count(*) df from tf group by 1), raw as (select token, ln((n - df + 0.5) / (df + 0.5)) i from df, st),
idf as (select token, case when i < 0 then 0.25 * (select avg(i) from raw) else i end idf from raw),
q as (select item_id query_id, token, count(*) times from (select item_id, unnest({_TOKENS}) token from benchmark) group by 1, 2),
bm as (select query_id, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from q join idf using (token) join tf using (token) join len using (id), st group by 1, 2)"""


def _chunked(spark: SparkSession, d: str, *rest: str) -> DataFrame:
    return chunking.char_chunks(_table(spark, d, "documents").select("doc_id", "text", *rest)).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("id"), "doc_id", "text", *rest)


_INDEXES: dict[tuple[str, str, str, str], blockmax.BlockIndex | ann.CellIndex] = {}


def _version(spark: SparkSession, path: str) -> str:
    """Changes when a file of the table does."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return str(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def _held(spark: SparkSession, d: str, what: str, make: Callable[[], object]):
    """An index over documents or embeddings, held for the queries that share it; those of another session, another folder,
    or files that have changed since are let go."""
    own = (spark.sparkContext.applicationId, d, _version(spark, f"{d}/documents.parquet") + _version(spark, f"{d}/embeddings.parquet"))
    for key in [k for k in _INDEXES if k[:3] != own]:
        gone = _INDEXES.pop(key)
        if key[0] == own[0]:
            gone.release()
    if (*own, what) not in _INDEXES:
        _INDEXES[*own, what] = make()
    return _INDEXES[*own, what]


def _blocks(spark: SparkSession, d: str, what: str) -> blockmax.BlockIndex:
    """Block-max postings of the chunks or of whole documents; a block's rows are of one language."""

    def make() -> blockmax.BlockIndex:
        rows = _chunked(spark, d, "lang") if what == "chunks" else _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
        return blockmax.build(rows, "id", near=[F.col("lang")])

    return _held(spark, d, f"{what} in blocks", make)


@_query(f"with {_BM25_SQL} select n n_chunks, round(avgdl, 6) avgdl, (select count(*) from df) n_terms, (select cast(sum(tf) as bigint) from tf) n_tokens from st")
def bm25_stats(spark, d):
    return sparse.counted(_chunked(spark, d)).select(F.col("n").alias("n_chunks"), _r("avgdl").alias("avgdl"), "n_terms", "n_tokens")


_TOP = "row_number() over (partition by query_id order by round({s}, 9) desc, id)"


def _top(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Ranks by scores rounded to 9 places, so that sums in another order rank alike."""
    return sparse.top(scored.withColumn("__s", F.round(score, 9)), k, "__s").drop("__s")


@_query(f"with {_BM25_SQL} select query_id, id, cast(rank as integer) rank, round(score, 6) score from (select *, {_TOP.format(s='score')} rank from bm) where rank <= 10")
def bm25_topk(spark, d):
    found = blockmax.search(_blocks(spark, d, "chunks"), _table(spark, d, "benchmark"), "item_id", "text", 10, places=9)
    return found.select("query_id", "id", "rank", _r("score").alias("score"))


_SHORT_SQL = """qs as (select item_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[3:5], ' ') text from benchmark)"""


@_query(f"with {_SHORT_SQL}, {_BM25_SQL.replace('from benchmark)', 'from qs)')} select query_id, id, cast(rank as integer) rank, round(score, 6) score from (select *, {_TOP.format(s='score')} rank from bm) where rank <= 10")
def bm25_short_topk(spark, d):
    """Three words of each item, pruned by bounds."""
    items = _table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(T.words(F.col("text")), 3, 3), " ").alias("text"))
    return blockmax.search(_blocks(spark, d, "chunks"), items, "item_id", "text", 10, places=9).select("query_id", "id", "rank", _r("score").alias("score"))


_DENSE_SQL = """e as (select vec_id, cast(embedding as double[]) v, label from embeddings), qv as (select item_id query_id, v qv from benchmark join e on vec_id = item_id),
de as (select query_id, vec_id id, label, greatest(0, list_sum(list_transform(list_zip(qv, v), lambda z: z[1] * z[2]))) score from qv, e)"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    items = _table(spark, d, "benchmark").join(rows, F.col("item_id") == F.col("id")).select(F.col("item_id").alias("query_id"), F.col("v").alias("qv"))
    return rows, items


@_query(f"with {_DENSE_SQL} select query_id, id, cast(rank as integer) rank, round(score, 6) score from (select *, {_TOP.format(s='score')} rank from de) where rank <= 10")
def dense_topk(spark, d):
    rows, items = _vectors(spark, d)
    return ann.nearest(rows, items, 10, clamp=True, places=9).select("query_id", "id", "rank", _r("score").alias("score"))


@_query(f"with {_DENSE_SQL} select query_id, id, cast(rank as integer) rank, round(score, 6) score from (select *, {_TOP.format(s='score')} rank from de where label = 1) where rank <= 10")
def dense_topk_filtered(spark, d):
    rows, items = _vectors(spark, d)
    return ann.nearest(rows.where("label = 1"), items, 10, clamp=True, places=9).select("query_id", "id", "rank", _r("score").alias("score"))


@_query(f"with {_DENSE_SQL} select query_id, count(*) n, round(min(score), 6) min_score, round(max(score), 6) max_score, round(avg(score), 6) avg_score from de group by 1")
def dense_score_range(spark, d):
    rows, items = _vectors(spark, d)
    return dense.score_range(dense.scores(rows, items, clamp=True)).select("query_id", "n", *[_r(c).alias(c) for c in ("min_score", "max_score", "avg_score")])


#: The recall that ``ann_topk`` asks of its index, on a sample of the index's own rows.
RECALL = 0.95


@_query()
def ann_topk(spark, d):
    """The ten best rows by cells, as many of which are read as reach RECALL."""
    rows, items = _vectors(spark, d)
    index = _held(spark, d, "cells", lambda: ann.build(rows, f"{scratch.folder(spark)}/cells-{uuid.uuid4().hex}"))
    nprobe, _ = ann.calibrate(index, RECALL)
    return ann.search(index, items, 10, nprobe).select("query_id", "id", "rank", _r("score").alias("score"))


@_query()
def hashed_embeddings(spark, d):
    return dense.hashed_vectors(_table(spark, d, "documents"), "doc_id", "text").select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@_query()
def learned_embeddings(spark, d):
    """Every chunk of the knowledge base by the leading directions of all of them."""
    chunks = scratch.stored(chunking.kb_chunks(_knowledge_base(spark, d)).select("chunk_id", "text"), "chunks")
    return embed.fit(chunks)(chunks, "chunk_id", "text").select(F.col("id").alias("chunk_id"), F.transform("v", lambda x: F.round(x, 4)).alias("v"))


@_query()
def embedding_recall(spark, d):
    """How many of the documents that hold an item word for word are among the ten nearest of its vector: hashed and learned."""
    docs, items = _table(spark, d, "documents").select("doc_id", "text"), _table(spark, d, "benchmark")
    truth = scratch.stored(evaluate.containment(docs, items, "doc_id", "text", "item_id", "text"), "truth")
    parts = []
    for name, embedder in (("hashed", dense.hashed_vectors), ("learned", embed.fit(docs))):
        asked = embedder(items, "item_id", "text").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
        judged = evaluate.judge(ann.nearest(embedder(docs, "doc_id", "text"), asked, 10, places=9), truth)
        per = judged.groupBy("query_id").agg((F.sum("rel") / F.first("n_rel")).alias("r"))
        parts.append(per.agg(F.lit(name).alias("method"), F.count("*").alias("n_queries"), _r(F.avg("r")).alias("recall_10")))
    return parts[0].unionByName(parts[1])


@_query(f"select kb_family, count(*) n, count(distinct parent_doc_id) n_docs, 64 * count(*) n_cells, count(*) n_unit from {_KB_CHUNKS_SQL} group by 1")
def collection_rows(spark, d):
    """What a vector collection of the knowledge base's chunks holds."""
    rows = vectors.embedded(chunking.kb_chunks(_knowledge_base(spark, d)))
    unit = F.abs(dense.dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-5
    return rows.groupBy("kb_family").agg(F.count("*").alias("n"), F.countDistinct("parent_doc_id").alias("n_docs"), F.sum(F.size("embedding")).alias("n_cells"), F.count_if(unit).alias("n_unit"))


# documents as wholes for hybrid search: BM25 over documents, vectors by id
_DOC_BM25_SQL = _BM25_SQL.replace(f"c as (select doc_id * 100000 + chunk_index id, text from {_CHUNKS_SQL})", "c as (select doc_id id, text from documents)")
_MINMAX = "case when max({s}) over w - min({s}) over w < 1e-8 then 0.5 else ({s} - min({s}) over w) / (max({s}) over w - min({s}) over w) end"


def _hybrid_sql(alpha: float, k: int = 10) -> str:
    return f"""{_DOC_BM25_SQL}, {_DENSE_SQL}, s as (select query_id, id, {_MINMAX.format(s="score")} score_sparse from (select *, {_TOP.format(s="score")} r from bm) where r <= {2 * k} window w as (partition by query_id)),
n as (select query_id, id, {_MINMAX.format(s="score")} score_dense from (select *, {_TOP.format(s="score")} r from de) where r <= {2 * k} window w as (partition by query_id)),
f as (select query_id, id, coalesce(score_sparse, 0) score_sparse, coalesce(score_dense, 0) score_dense, {alpha} * coalesce(score_sparse, 0) + {1 - alpha} * coalesce(score_dense, 0) score_hybrid from s full outer join n using (query_id, id)),
u as (select f.*, row_number() over (partition by query_id, coalesce(array_to_string({_WORDS}, ' '), cast(f.id as varchar)) order by round(score_hybrid, 9) desc, f.id) dup from f left join documents on doc_id = f.id),
h as (select *, {_TOP.format(s="score_hybrid")} rank from u where dup = 1)"""


def _sides(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The best n sparse and dense candidates, and the texts."""
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    a = blockmax.search(_blocks(spark, d, "documents"), _table(spark, d, "benchmark"), "item_id", "text", n, places=9).drop("rank")
    rows, items = _vectors(spark, d)
    b = ann.nearest(rows, items, n, clamp=True, places=9).drop("rank")
    return a.withColumn("score", F.round("score", 9)), b.withColumn("score", F.round("score", 9)), docs


def _hybrid(spark: SparkSession, d: str, alpha: float, k: int = 10) -> DataFrame:
    return retrieval.hybrid(*_sides(spark, d, 2 * k), k=k, alpha=alpha)


def _alpha_query(name: str, alpha: float) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _hybrid(spark, d, alpha).select("query_id", "id", *[F.round(c, 5).alias(c) for c in ("score_sparse", "score_dense", "score_hybrid")])

    QUERIES[name] = run
    SQL[name] = f"with {_hybrid_sql(alpha)} select query_id, id, round(score_sparse, 5) score_sparse, round(score_dense, 5) score_dense, round(score_hybrid, 5) score_hybrid from h where rank <= 10"


for _n, _a in (("hybrid_topk", 0.7), ("hybrid_topk_04", 0.4), ("hybrid_topk_sparse", 1.0), ("hybrid_topk_dense", 0.0)):
    _alpha_query(_n, _a)


@_query(f"with {_DOC_BM25_SQL} select query_id, id, round({_MINMAX.format(s='score')}, 5) score_norm from bm window w as (partition by query_id)")
def minmax_scores(spark, d):
    a, ends = blockmax.scores(_blocks(spark, d, "documents"), _table(spark, d, "benchmark"), "item_id", "text")
    ends = scratch.stored(ends.select("query_id", F.round("low", 9).alias("low"), F.round("high", 9).alias("high")), "ranges")
    score = retrieval.between(F.round("score", 9), F.col("low"), F.col("high"))
    return a.join(F.broadcast(ends), "query_id").select("query_id", "id", F.round(score, 5).alias("score_norm"))  # a row for each query


@_query(f"""with {_hybrid_sql(0.7, 5)}, m as (select 'sparse' as method, query_id, id, round(score, 9) score from bm union all select 'dense', query_id, id, round(score, 9) from de union all select 'hybrid', query_id, id, score_hybrid from h where rank <= 5)
select method, query_id, cast(rank as integer) rank, id, round(score, 6) score from (select *, row_number() over (partition by method, query_id order by score desc, id) rank from m) where rank <= 5""")
def compare_methods(spark, d):
    a, b, docs = _sides(spark, d, 10)
    fused = retrieval.hybrid(a, b, docs, 5).select("query_id", "id", F.col("score_hybrid").alias("score"))
    return retrieval.compare(5, sparse=a, dense=b, hybrid=fused).withColumn("score", _r("score"))


_RERANK_SQL = f"""{_hybrid_sql(0.7, 30)}, rr as (select query_id, id, len(list_intersect(qw, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '')))) / greatest(len(qw), 1) s
from h join documents d on d.doc_id = h.id join (select item_id query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) qw from benchmark) using (query_id) where rank <= 30)"""


@_query(f"with {_RERANK_SQL} select query_id, id, cast(rank as integer) rank, round(s, 6) score_rerank, round(1 / (1 + exp(-s)), 6) score_rerank_norm from (select *, row_number() over (partition by query_id order by s desc, id) rank from rr) where rank <= 10")
def reranked_topk(spark, d):
    asked = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.hybrid(*_sides(spark, d, 60), scorer=retrieval.overlap_scorer(asked)).select("query_id", "id", "rank", _r("score_rerank").alias("score_rerank"), _r("score_rerank_norm").alias("score_rerank_norm"))


_LATE_SQL = f"""{_hybrid_sql(0.7, 30)}, cand as materialized (select query_id, id from h where rank <= 30),
qt as (select item_id query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) q from benchmark),
dt as materialized (select doc_id id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) t from documents where doc_id in (select id from cand)),
gr as (select w, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('<' || w || '>', i, 3))) g from (select q w from qt union select t from dt)),
cells as (select w, ('0x' || substr(md5(g), 1, 4))::int % 64 cell, count(*) n from gr group by 1, 2), tv as materialized (select w, cell, n / sqrt(sum(n * n) over (partition by w)) x from cells),
pairs as materialized (select a.w q, b.w t, sum(a.x * b.x) s from tv a join tv b using (cell) where a.w in (select q from qt) and b.w in (select t from dt) group by 1, 2),
best as (select query_id, id, q, coalesce(max(s), 0) s from cand join qt using (query_id) join dt using (id) left join pairs using (q, t) group by 1, 2, 3), late as (select query_id, id, avg(s) s from best group by 1, 2)"""


@_query(f"with {_LATE_SQL} select query_id, id, cast(rank as integer) rank, round(s, 6) score_rerank from (select *, row_number() over (partition by query_id order by round(s, 9) desc, id) rank from late) where rank <= 10")
def late_reranked_topk(spark, d):
    """Thirty hybrid candidates of each item, reranked by late interaction."""
    asked = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scorer = retrieval.late_interaction_scorer(asked)
    best = retrieval.hybrid(*_sides(spark, d, 60), scorer=lambda c: scorer(c).withColumn("score_rerank", F.round("score_rerank", 9)))
    return best.select("query_id", "id", "rank", _r("score_rerank").alias("score_rerank"))


@_query(f"with {_hybrid_sql(0.7, 5)} select query_id, cast(rank as integer) rank, id, length(coalesce(text, '')) n_chars, md5(coalesce(text, '')) content_md5, round(score_hybrid, 5) score, round(score_sparse, 5) score_sparse from h left join documents on doc_id = id where rank <= 5")
def retriever_documents(spark, d):
    found = retrieval.documents(_hybrid(spark, d, 0.7, 5))
    return found.select("query_id", "rank", "metadata.id", F.length("page_content").cast("long").alias("n_chars"), F.md5("page_content").alias("content_md5"), F.round("score", 5).alias("score"), F.round("metadata.score_sparse", 5).alias("score_sparse"))


@_query()
def search_json(spark, d):
    return retrieval.as_json(_hybrid(spark, d, 0.7), 0.7, 10)


@_query(f"with {_hybrid_sql(0.7)} select query_id, count(*) filter (a is not null and b is not null) in_both, count(*) filter (b is null) only_sparse, count(*) filter (a is null) only_dense from (select query_id, id, score_sparse a from s) full outer join (select query_id, id, score_dense b from n) using (query_id, id) group by 1")
def candidate_overlap(spark, d):
    a, b, _ = _sides(spark, d, 20)
    return retrieval.overlap(a, b)


_TRUTH_SQL = "t as (select distinct item_id query_id, doc_id id from benchmark b join documents d on contains(d.text, b.text))"
_JUDGED_SQL = f"""{_DOC_BM25_SQL}, {_TRUTH_SQL}, r as (select *, {_TOP.format(s="score")} rank from bm), j as (select r.query_id, r.id, rank, score, (t.id is not null)::int rel, n_rel from r left join t using (query_id, id) join (select query_id, count(*) n_rel from t group by 1) using (query_id) where rank <= 10),
k as (select *, sum(rel) over (partition by query_id order by rank) / rank p from j)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    docs, items = _table(spark, d, "documents"), _table(spark, d, "benchmark")
    a = blockmax.search(_blocks(spark, d, "documents"), items, "item_id", "text", 10, places=9).drop("rank")
    truth = evaluate.containment(docs, items, "doc_id", "text", "item_id", "text")
    return evaluate.judge(_top(a, 10), truth)


def _metrics_sql() -> str:
    cols = []
    for k in evaluate.CUTS:
        hits = f"sum(case when rank <= {k} then rel else 0 end)"
        ideal = f"list_sum(list_transform(range(1, least(max(n_rel), {k})::int + 1), lambda i: 1 / log2(i + 1)))"
        cols += [f"round({hits} / {k}, 6) precision_{k}", f"round({hits} / max(n_rel), 6) recall_{k}", f"({hits} > 0)::double hit_{k}", f"round(sum(case when rank <= {k} and rel = 1 then 1 / log2(rank + 1) else 0 end) / {ideal}, 6) ndcg_{k}"]
    return f"select query_id, {', '.join(cols)}, round(coalesce(1 / min(case when rel = 1 then rank end), 0), 6) rr, round(coalesce(sum(case when rel = 1 then p end) / nullif(sum(rel), 0), 0), 6) ap from k group by 1"


@_query(f"with {_JUDGED_SQL} {_metrics_sql()}")
def retrieval_metrics(spark, d):
    m = evaluate.metrics(_judged(spark, d))
    return m.select("query_id", *[_r(c).alias(c) for c in m.columns if c != "query_id"])


@_query(f"with {_JUDGED_SQL}, m as ({_metrics_sql()}), l as (unpivot m on columns(* exclude query_id) into name metric value value) select metric, round(avg(value), 4) mean, round(stddev_pop(value), 4) std, count(*) n from l group by 1")
def eval_summary(spark, d):
    s = evaluate.summary(retrieval_metrics(spark, d))
    return s.select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


_GAIN = ", ".join(f"round(sum(case when rank <= {k} and rel = 1 then score / log2(rank + 1) else 0 end) / list_sum(list_transform(range(1, least(max(n_rel), {k})::int + 1), lambda i: 1 / log2(i + 1))), 5) ndcg_{k}" for k in evaluate.CUTS)


@_query(f"with {_JUDGED_SQL} select query_id, {_GAIN} from k group by 1")
def score_gain_ndcg(spark, d):
    """NDCG with the score as the gain of a relevant row."""
    m = evaluate.metrics(_judged(spark, d), gain="score")
    return m.select("query_id", *[F.round(f"ndcg_{k}", 5).alias(f"ndcg_{k}") for k in evaluate.CUTS])


# truth with its fields filled by turns: an id, three places for an answer, some of them empty or absent
_TRUTH_FIELDS = """select nullif(doc_id // 2, 0) id, case doc_id % 4 when 0 then text when 1 then '' end text, case when doc_id % 3 = 0 then source else '' end label_answer, case when doc_id % 5 > 0 then lang end answer from documents"""


@_query(f"select query_id, max(answer) answer from (select id query_id, coalesce(nullif(text, ''), nullif(label_answer, ''), nullif(answer, '')) answer from ({_TRUTH_FIELDS})) where query_id is not null and answer is not null group by 1")
def truth_rows(spark, d):
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, F.col("text")).when(k % 4 == 1, "")
    rows = _table(spark, d, "documents").select(F.nullif(F.expr("doc_id div 2"), F.lit(0)).alias("id"), text.alias("text"), F.when(k % 3 == 0, F.col("source")).otherwise("").alias("label_answer"), F.when(k % 5 > 0, F.col("lang")).alias("answer"))
    return evaluate.load_truth(rows)


_CONTEXT_SQL = f"""{_hybrid_sql(0.7)}, bl as (select query_id, rank, {_STRIP.format("text")} t, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') w from h join documents on doc_id = id where rank <= 10),
ok as (select query_id, rank, {_STRIP.format("'[source ' || rank || ']' || chr(10) || t")} b from bl where length(t) >= 20 and not (len(w) > 10 and len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}'))) > 0.4 * len(w))),
j as (select query_id, rank, case when row_number() over v = 1 then '' else chr(10) || chr(10) || '---' || chr(10) || chr(10) end || b b from ok window v as (partition by query_id order by rank)),
cut as (select query_id, rank, substr(b, 1, (4000 - coalesce(sum(length(b)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0))::int) b, 4000 - coalesce(sum(length(b)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) left_ from j)
select query_id, {_STRIP.format("string_agg(b, chr(10) order by rank)")} context, count(*) n_blocks from cut where left_ > 0 group by 1"""


@_query(f"with {_CONTEXT_SQL}")
def context_pack(spark, d):
    return rag.pack_context(_hybrid(spark, d, 0.7))


@_query(f"with {_hybrid_sql(0.7)} select query_id, round(max(case when rank = 1 then score_hybrid end), 5) top_score, round(avg(case when rank <= 3 then score_hybrid end), 5) avg_top_score, avg(case when rank <= 3 then score_hybrid end) >= 0.5 used_kb from h where rank <= 10 group by 1")
def relevance_gate(spark, d):
    g = rag.relevance(_hybrid(spark, d, 0.7))
    return g.select("query_id", F.round("top_score", 5).alias("top_score"), F.round("avg_top_score", 5).alias("avg_top_score"), "used_kb")


@_query()
def batch_answers(spark, d):
    asked = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rag.answer(asked, _hybrid(spark, d, 0.7, 5)).select("query_id", "query", "answer", "used_kb", _r("top_score").alias("top_score"), _r("avg_top_score").alias("avg_top_score"))


@_query("select doc_id, i - 1 as start, i + 1 as \"end\", substr(text, greatest(i - 100, 1), least(i + 101, length(text)) - greatest(i - 101, 0)) context from (select doc_id, text, unnest(range(1, length(text) + 1)) i from documents where contains(lower(text), 'zz')) where lower(substr(text, i, 2)) = 'zz'")
def find_in_doc(spark, d):
    return search.find(_table(spark, d, "documents"), "zz")


@_query(r"select page_id, regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's') title from pages")
def page_title(spark, d):
    return _table(spark, d, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


@_query(r"select distinct page_id, rtrim(regexp_extract(url, '^[a-z]+://[^/]*') || replace(href, '&amp;', '&'), '/') link from (select page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]+)\"', 1)) href from pages)")
def page_links(spark, d):
    return html.page_links(_table(spark, d, "pages"))


_PIECES = "array_to_string(list_filter(list_transform(regexp_split_to_array({}, '<[^>]*>'), lambda x: trim(replace(replace(replace(replace(x, '&quot;', chr(34)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> ''), {})"


@_query(f"""select page_id, nullif({_PIECES.format("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)", "' '")}, '') title, nullif({_PIECES.format("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)", "chr(10)")}, '') clean_text from pages""")
def page_text(spark, d):
    return html.parse_articles(_table(spark, d, "pages"), title="h1", body="article", date="footer").select("page_id", "title", "clean_text")


@_query()
def selector_candidates(spark, d):
    """What could select the body and the title of the pages."""
    pages = _table(spark, d, "pages")
    support = scratch.stored(html.selector_support(html.selectors(pages)), "support")
    return html.candidate_selectors(support, pages.count()).withColumn("share", _r("share"))


_TAGS = "h1|h2|h3|p|li|article|nav|footer"


@_query(rf"""select tag as selector, count(distinct page_id) n_pages, count(*) n_elements, count(distinct regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)', 1)) n_hosts
from (select page_id, url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '<({_TAGS})[\s>/]', 1)) tag from pages) group by 1""")
def selector_counts(spark, d):
    """Support of some tags over pages and hosts."""
    found = html.selector_support(html.selectors(_table(spark, d, "pages")))
    return found.where(F.col("selector").isin(_TAGS.split("|"))).select("selector", "n_pages", "n_elements", "n_hosts")


@_query(r"""select class, count(*) n from (select unnest(regexp_split_to_array(trim(c), '\s+')) class from (select unnest(regexp_extract_all(html, '<div\b[^>]*?class="([^"]*)"', 1)) c from pages)) where class <> '' group by 1 order by n desc, class limit 10""")
def class_counts(spark, d):
    return html.class_counts(_table(spark, d, "pages"))


@_query("select url from (select distinct url from pages) where url not in (select url from pages where url like '%page=%' and url is not null) and url is not null")
def url_frontier(spark, d):
    pages = _table(spark, d, "pages").where("url is not null")
    return records.pending(pages, pages.where("url like '%page=%'"))


LABEL_TEXTS = ["['A','B']", "A, Z", "nan", "['Q','C']", "[A", "", "['F', 'F', 'E']", "D", "[ ]"]
_CODES_SQL = "map {'A': 1, 'B': 0, 'C': 2, 'D': 4, 'E': 3, 'F': 5, 'Z': 6}"


@_query(
    "select id, case when starts_with(codes, '[') <> ends_with(codes, ']') then '' else array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(codes, '^\\[|\\]$', '', 'g'), ','), lambda x: "
    + _CODES_SQL
    + "[trim(trim(trim(x), '''\"'))]), lambda i: i is not null))), ',') end idx from (select doc_id id, (["
    + ", ".join("'" + t.replace("'", "''") + "'" for t in LABEL_TEXTS)
    + "])[(2 * quality + toxic + doc_id) % 9 + 1] codes from labels)"
)
def parse_labels(spark, d):
    """Labelled rows, with the ways in which codes are written by turns."""
    turn = (2 * F.col("quality") + F.col("toxic") + F.col("doc_id")) % 9
    codes = F.element_at(F.array(*map(F.lit, LABEL_TEXTS)), (turn + 1).cast("int"))
    rows = _table(spark, d, "labels").select(F.col("doc_id").alias("id"), codes.alias("codes"))
    return rows.select("id", F.array_join(L.parse_codes(F.col("codes"), L.QUESTION_CODES, L.QUESTION_LABELS), ",").alias("idx"))


_MULTI_SQL = "(select doc_id id, [quality, toxic] labels, [(n_chars % 2)::int, (n_chars % 3 = 0)::int] predicted from labels join documents using (doc_id))"


def _multi(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "labels").join(_table(spark, d, "documents"), "doc_id")
    return rows.select(F.col("doc_id").alias("id"), F.array("quality", "toxic").alias("labels"), F.array((F.col("n_chars") % 2).cast("int"), (F.col("n_chars") % 3 == 0).cast("int")).alias("predicted"))


@_query(f"select id, array_to_string(list_filter([case when labels[1] = 1 then 0 end, case when labels[2] = 1 then 1 end], lambda x: x is not null), ',') idx, array_to_string(labels, ',') hot from {_MULTI_SQL}")
def multi_hot(spark, d):
    idx = L.hot_indexes(F.col("labels"))
    return _multi(spark, d).select("id", F.array_join(idx, ",").alias("idx"), F.array_join(L.multi_hot(idx, 2), ",").alias("hot"))


@_query(
    f"""with c as (select id, unnest([1, 2]) k, labels, predicted from {_MULTI_SQL}), g as (select k, sum(labels[k] * predicted[k]) tp, sum((1 - labels[k]) * predicted[k]) fp, sum(labels[k] * (1 - predicted[k])) fn from c group by 1)
select round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6)::double f1_micro, round(sum(2 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn), 6)::double f1_weighted,
(select round(avg(coalesce((labels[1] * predicted[1] + labels[2] * predicted[2]) / nullif(greatest(labels[1], predicted[1]) + greatest(labels[2], predicted[2]), 0), 0)), 6) from {_MULTI_SQL}) jaccard from g"""
)
def multilabel_metrics(spark, d):
    m = ml.multilabel_metrics(_multi(spark, d))
    return m.select(*[_r(c).alias(c) for c in m.columns])


@_query("with n as (select count(*) n, cast(ceil(count(*) * 4 / 10) as bigint) rest from labels) select 'train' part, n - rest n from n union all select 'val', rest - cast(ceil(rest / 2) as bigint) from n union all select 'test', cast(ceil(rest / 2) as bigint) from n")
def split_sizes(spark, d):
    return ml.split(_table(spark, d, "labels"), "doc_id").groupBy("part").agg(F.count("*").alias("n"))


_CODED_SQL = "(select doc_id id, text question, case when doc_id % 5 = 0 then '' when doc_id % 3 = 0 then '[''A'',''B'']' when doc_id % 3 = 1 then 'C, Q' else 'Z' end codes from documents)"


@_query(f"with s as (select count(*) n, cast(ceil(count(*) * 4 / 10) as bigint) rest from {_CODED_SQL} where codes <> '' and {_STRIP.format('question')} not in ('') and lower({_STRIP.format('question')}) <> 'nan') select 'train' part, n - rest n from s union all select 'val', rest - cast(ceil(rest / 2) as bigint) from s union all select 'test', cast(ceil(rest / 2) as bigint) from s")
def prepared_dataset(spark, d):
    k = F.col("doc_id")
    codes = F.when(k % 5 == 0, "").when(k % 3 == 0, "['A','B']").when(k % 3 == 1, "C, Q").otherwise("Z")
    rows = _table(spark, d, "documents").select(k.alias("id"), F.col("text").alias("question"), codes.alias("final_QT"))
    return ml.prepare(rows, "qtypes").groupBy("part").agg(F.count("*").alias("n"))


_PLAN_SQL = f"""c as (select k - 1 as label, count(*) n from (select unnest([1, 2]) k, labels from {_MULTI_SQL}) where labels[k] = 1 group by 1), m as (select list_sort(list(n))[count(*) // 2 + 1] m from c), total as (select count(*) total from {_MULTI_SQL}),
plan as (select label, n, cast(ceil((1 - n / total) * m) as bigint) target, greatest(cast(ceil((1 - n / total) * m) as bigint) - n, 0) needed from c, m, total where n < m)"""


@_query(f"with {_PLAN_SQL} select cast(label as integer) label, n, target, needed from plan")
def balance_plan(spark, d):
    return ml.balance_plan(_multi(spark, d))


@_query(f"with {_PLAN_SQL}, s as (select p.label, x.id, (labels[1] = 0 or 0 in (select label from plan)) and (labels[2] = 0 or 1 in (select label from plan)) only_scarce from {_MULTI_SQL} x join plan p on labels[p.label + 1] = 1 where needed > 0) select cast(label as integer) label, id, only_scarce, cast(row_number() over (partition by label order by only_scarce desc, id) as integer) place from s")
def balance_sources(spark, d):
    rows = _multi(spark, d)
    return ml.balance_sources(rows, ml.balance_plan(rows))


@_query(f"with {_PLAN_SQL} select cast(k - 1 as integer) label, sum(labels[k]) n_before, sum(labels[k]) + coalesce(any_value(needed), 0) n_after from (select unnest([1, 2]) k, labels from {_MULTI_SQL}) left join plan on label = k - 1 group by k".replace("sum(labels[k])", "cast(sum(labels[k]) as bigint)"))
def balanced_counts(spark, d):
    """Label counts before and after the labels in need are filled up; the rarer of two labels is in need."""
    rows = _multi(spark, d).join(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").select("id", "text", "labels")
    whole = augment.balanced(rows)
    cells = whole.select("source", F.posexplode("labels").alias("label", "v"))
    return cells.groupBy("label").agg(F.sum(F.when(F.col("source").isNull(), F.col("v")).otherwise(0)).alias("n_before"), F.sum("v").alias("n_after"))


@_query()
def train_multilabel(spark, d):
    """Quality and toxicity of labelled documents: a fit on 60 %, the best epoch by 20 %, the metrics of the other 20 %."""
    rows = _table(spark, d, "labels").where("quality is not null and toxic is not null").join(_table(spark, d, "documents"), "doc_id")
    parted = scratch.stored(ml.split(rows.select(F.col("doc_id").alias("id"), "text", F.array("quality", "toxic").alias("labels"))), "parts")
    model = training.fit(parted, 2)
    scored = scratch.stored(model.predict(parted.where("part = 'test'")).select("id", "labels", "predicted"), "predicted")
    m = ml.multilabel_metrics(scored)
    return m.select(*[_r(c).alias(c) for c in m.columns], F.lit(len(model.history)).cast("long").alias("epochs"))


@_query("select count(*) total, count(quality) evaluated, round(avg(quality), 6) mean_rating, count(*) - count(quality) remaining, round(100.0 * count(quality) / greatest(count(*), 1), 6)::double percent from documents left join labels using (doc_id)")
def rating_progress(spark, d):
    rows = _table(spark, d, "documents").join(_table(spark, d, "labels"), "doc_id", "left")
    return ratings.progress(rows.select(F.col("doc_id").alias("id"), F.col("quality").alias("manual_rating")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
