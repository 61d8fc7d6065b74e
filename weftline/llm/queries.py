"""The training-data operators as driver queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import byte_bpe, chat, conversation_repair, divergence, exact_dedup, html_extract, knn_join, language_id, near_dedup, oracles, packing, sharding, toxicity, url_filter
from weftline.llm._common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, decode and digest every document; the tokenizer's files are a parameter of the operator."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents into eight shards; the checksums are those of the sharded rows' texts."""
    return sharding.digests(sharding.shard(sharding.sized(read(spark, sf_dir, "documents")), 8))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are similar at 0.8 or more."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    return exact_dedup.classify(read(spark, sf_dir, "documents"))


ORACLES["op4_exact_dedup"] = """
select d.doc_id, max(d.doc_id) over g as keep_id, count(*) over g as group_size,
       d.doc_id = max(d.doc_id) over g as kept, sha256(coalesce(d.text, '')) as text_sha256
from documents d
window g as (partition by coalesce(d.text, ''))
"""

ORACLES["op2_near_dedup"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), shingles as (
  select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
                                      when len(w) = 1 then [w[1]] else [] end) as s
  from words
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as k
  from shingles x join shingles y on x.s = y.s and x.doc_id < y.doc_id
  group by all
), links as (
  select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)
), ways as (select a, b from links union all select b, a from links),
reach(doc_id, c) as (
  select doc_id, doc_id from documents
  union
  select w.b, r.c from reach r join ways w on r.doc_id = w.a where r.c < w.b
), least as (select doc_id, min(c) as component_id from reach group by doc_id)
select d.doc_id, coalesce(s.n, 0) as n_shingles, l.component_id, d.doc_id = l.component_id as kept
from documents d left join sizes s using (doc_id) join least l using (doc_id)
"""


@query
def op6_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every row whose vec_id is divisible by 50."""
    table = read(spark, sf_dir, "embeddings")
    return knn_join.top_k(table, table.where("vec_id % 50 = 0"), 5)


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return url_filter.judge(read(spark, sf_dir, "pages"), URL_RULES)


# The rules of the contract.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

ORACLES["op6_knn_join"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from scored
qualify rank <= 5
"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings."""
    stored = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.format_turns(chat.text_turns(stored.unionByName(extra))))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    found = language_id.identify(language_id.of_documents(read(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id")


@query
def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every web page, with its markup, address and host as evidence."""
    found = language_id.identify(language_id.of_pages(read(spark, sf_dir, "pages")))
    return found.withColumnRenamed("id", "page_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected severity of every document."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


ORACLES["op3_chat_format"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked as (
  select *, '<|im_start|>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10)
            || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) as formatted
  from rows
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, formatted)) as turns_sha256,
       coalesce(cast(sum(length(text)) filter (role = 'assistant') as bigint), 0) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, formatted) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(formatted)) as bigint) as formatted_chars
from marked group by conv_id
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    return conversation_repair.repair(conversation_repair.damage(read(spark, sf_dir, "conversations")), "dropped")


ORACLES["op13_conversation_repair"] = oracles.REPAIR


@query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that set it apart."""
    return divergence.audit(read(spark, sf_dir, "documents"))


ORACLES["op11_source_divergence"] = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), occurring as (select id, lang, source, unnest(w) as term from d),
kept as (select lang, term from occurring group by all having count(distinct id) >= 3),
counted as (select lang, source, term, count(*) as n from occurring semi join kept using (lang, term) group by all),
words as (select lang, count(*) as v from kept group by lang),
gs as (select distinct lang, source from d),
totals as (select gs.lang, gs.source, cast(coalesce(sum(n), 0) as hugeint) as total from gs left join counted using (lang, source) group by all),
langs as (select lang, sum(total) as total from totals group by lang),
cells as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, cast(1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.total + v) as bigint) as p
  from totals t join words using (lang) join kept k using (lang) left join counted c using (lang, source, term)
), whole as (
  select k.lang, k.term, cast(1 + 1000000000::hugeint * (coalesce(sum(c.n), 0) + 1) // (any_value(l.total) + any_value(v)) as bigint) as q
  from kept k join langs l using (lang) join words using (lang) left join counted c using (lang, term) group by all
), far as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from gs a join gs b on a.lang = b.lang and a.source <> b.source
  left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from cells join whole using (lang, term) where n > 0 and p > q
)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 200
"""


@query
def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


#: The given pages have one article each, of headings and paragraphs, and few character references.
ORACLES["op12_html_extraction"] = r"""
with inner_html as (
  select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as h from pages
), lines as (
  select page_id, url, unnest(string_split_regex(h, '</?(?:p|h1)>')) as line, generate_subscripts(string_split_regex(h, '</?(?:p|h1)>'), 1) as k from inner_html
), plain as (
  select page_id, url, k, trim(regexp_replace(
           regexp_replace(replace(regexp_replace(regexp_replace(line, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'),
           '[\s\x0B\x{85}\x{A0}]+', ' ', 'g')) as line
  from lines
), joined as (
  select page_id, url, coalesce(string_agg(line, chr(10) order by k) filter (line <> ''), '') as text from plain group by all
)
select page_id, url, text, cast(length(text) as bigint) as n_chars from joined
"""
