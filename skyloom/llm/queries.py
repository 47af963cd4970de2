"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express; tests hold the others against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm.collocations import collocations
from skyloom.llm.common import table
from skyloom.llm.decontamination import decontaminate
from skyloom.llm.hard_negatives import hard_negatives
from skyloom.llm.html_text import extract_pages
from skyloom.llm.license_scan import license_scan
from skyloom.llm.mixing import mix_sources
from skyloom.llm.secrets_scan import secret_scan
from skyloom.llm.setsketch import setsketch_dedup
from skyloom.llm.simhash import simhash_dedup
from skyloom.llm.substring_dedup import substring_dedup
from skyloom.llm.token_output import token_output
from skyloom.llm.topk import top_k
from skyloom.llm.toxicity import toxicity

#: The tokenizer of op10 and of the pipeline, by its name in the installed package of public tokenizers.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).drop("words")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_substring_dedup, op3_simhash_dedup, op4_toxicity, op5_secret_scan, op6_license_scan, op7_html_text, op8_top_k, op9_decontaminate, op10_token_output, op11_collocations, op12_hard_negatives, op13_setsketch_dedup)
}
#: Plain SQL for the same rows, over all pairs of a query and a candidate where the operators prune.
ORACLE_SQL: dict[str, str] = {
    "op8_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
""",
    "op11_collocations": r"""
with d as (
  select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), p as (
  select id, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) as piece from d
), w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
i as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
g as (
  select lang, list_slice(words, i, i + k - 1) as ids, count(*) as f
  from i, (values (1), (2), (3)) as sizes(k) where i + k - 1 <= len(words) group by 1, 2
), n as (select lang, sum(len(words))::bigint as n from w group by 1),
c as (select * from g where len(ids) > 1 and f >= 10),
cut as (select lang, ids, f as a, unnest(range(1, len(ids))) as k from c),
s as (
  select cut.lang, cut.ids, cut.a, cut.k, x.f as l, y.f as r,
    (1000000::hugeint * cut.a::hugeint * cut.a::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from cut join g x on x.lang = cut.lang and x.ids = list_slice(cut.ids, 1, cut.k)
  join g y on y.lang = cut.lang and y.ids = list_slice(cut.ids, cut.k + 1, len(cut.ids))
), low as (select * from s qualify row_number() over (partition by lang, ids order by score, k) = 1),
longer as (
  select lang, ids, max(f) as f from (
    select lang, list_slice(ids, 1, 2) as ids, f from c where len(ids) = 3 union all select lang, list_slice(ids, 2, 3), f from c where len(ids) = 3
  ) group by 1, 2
), kept as (
  select low.* from low left join longer using (lang, ids) where longer.f is null or 100 * longer.f < 50 * low.a
), ranked as (
  select lang, array_to_string(ids, ' ') as phrase, a, l, r, score,
    row_number() over (partition by lang order by score desc, a desc, array_to_string(ids, ' ')) as rank from kept
)
select ranked.lang, cast(rank as integer) as rank, phrase, a, l, r, n, score::bigint as score from ranked join n using (lang) where rank <= 2000
""",
    "op12_hard_negatives": """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.r as ar, a.vec_id as anchor_id, c.r as cr, c.vec_id as vec_id, a.label = c.label as same,
    cast(list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * c.e[i])) as bigint) as score
  from v a join v c on a.r <> c.r where a.vec_id % 100 = 0
), p as (select *, row_number() over (partition by ar order by score desc, vec_id, cr) as pr from s where same),
n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.ar, p.cr order by s.score desc, s.vec_id, s.cr) as rank
  from p join s on p.ar = s.ar and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score where p.pr <= 5
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10
""",
    "op13_setsketch_dedup": r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) end) as s from d
), n as (select doc_id, len(s) as n from s), u as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from u a join u b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
r as (select doc_id, doc_id as m from d union select r.doc_id, e.y from r join e on e.x = r.m)
select n.doc_id, n.n as n_shingles, min(m) as component_id, n.doc_id = min(m) as kept from n join r using (doc_id) group by n.doc_id, n.n
""",
}
