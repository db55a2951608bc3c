"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat_format, html_text, language_model, ngram_join, packing, quality, secret_scan, substring, vector_dups
from .common import table

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op2_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_equal(table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = f"{chat_format.END}{chat_format.START}assistant ok"
    probe = spark.range(1).selectExpr("stack(2, -1L, 0L, 'user', -1L, 1L, 'assistant') as (conv_id, turn, role)").selectExpr("*", f"'{said}' as text")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_format.digest(chat_format.formatted(turns))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scanned(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


QUERIES = {
    f.__name__: f
    for f in (op1_html_text, op2_vector_dups, op3_chat_format, op4_secret_scan, op5_quality_rules, op6_byte_bpe, op7_substring_dedup, op8_ngram_join, op9_language_model, op10_packing)
}

ORACLE_SQL = {
    "op2_vector_dups": r"""
        with recursive v as (
            select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
            where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(vec_id, other) as (
            select vec_id, vec_id from embeddings
            union
            select reach.vec_id, links.b from reach join links on links.a = reach.other),
        n as (select a, count(*) as n from links group by a)
        select vec_id, coalesce(n, 0) as n_links, min(other) as component_id, vec_id = min(other) as kept
        from reach left join n on n.a = vec_id group by vec_id, n""",
    "op3_chat_format": r"""
        with rows_ as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        sized as (
            select *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) as body,
                length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) as head,
                lag(role) over w as before, lead(role) over w as after
            from rows_ window w as (partition by conv_id order by turn nulls first, role, text))
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
            sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
            cast(sum(body + case when before is null or before <> role then 12 + head + 1 else 10 end
                + case when after is null or after <> role then 11 else 0 end) as bigint) as formatted_chars
        from sized group by conv_id""",
    "op7_substring_dedup": r"""
        with w as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
        v as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13),
        k as (select doc_id, i, md5(array_to_string(words[i : i + 12], ' ')) as key from v),
        f as (select doc_id, i, min(doc_id) over (partition by key) as first_doc from k),
        gone as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 13)) as p from f where first_doc < doc_id)),
        flat as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from w),
        kept as (select flat.*, gone.p is not null as goes from flat left join gone using (doc_id, p)),
        digests as (
            select doc_id, sum(cast(goes as integer)) as n_removed, sha256(coalesce(string_agg(case when not goes then word end, ' ' order by p), '')) as kept_sha256
            from kept group by doc_id)
        select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(kept_sha256, sha256('')) as kept_sha256
        from w left join digests using (doc_id)""",
    "op8_ngram_join": r"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from documents),
        g as (
            select distinct doc_id, md5(array_to_string(words[i : i + 3], ' ')) as gram from (select doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) as i from w where len(words) > 0)),
        sizes as (select doc_id, count(*) as n from g group by doc_id),
        shared as (select a.doc_id as a, b.doc_id as b, count(*) as common from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by 1, 2),
        links as (
            select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
        reach(doc_id, other) as (
            select doc_id, doc_id from w
            union
            select reach.doc_id, links.b from reach join links on links.a = reach.other)
        select w.doc_id, coalesce(n, 0) as n_shingles, c.component_id
        from w left join sizes using (doc_id) join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)""",
}
