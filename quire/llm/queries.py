"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, jaccard, langid, mixing, packing, pii, quality, repeats, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_entities")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(~langid.held_out()), "text", "lang", F.col("doc_id"))
    return langid.with_language(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, rows.filter(F.col("id") % 50 == 0), k=5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_read(spark, sf_dir, "documents"))
    base = ~quality.verdict(quality.POLICIES["base-1"])
    policy = quality.POLICIES[quality.DEFAULT_POLICY]
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & quality.verdict(policy)).alias("kept"), F.col("failed").alias("failed_bits"), F.lit(policy.version).alias("policy")
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_read(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"), packing.PackConfig(tokenizer_path()))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_and_read(spark, _read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_pii": op1_pii, "op2_language": op2_language, "op3_jaccard": op3_jaccard, "op4_mixing": op4_mixing, "op5_top_k": op5_top_k, "op6_quality": op6_quality, "op7_html": op7_html, "op8_packing": op8_packing, "op9_repeats": op9_repeats, "op10_warc": op10_warc}

SQL: dict[str, str] = {
    "op4_mixing": r"""
with d as (select doc_id, source, md5('mix-1:' || coalesce(cast(doc_id as varchar), '')) as k,
        cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
t as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) - 1 as rank from t),
w as (select *, 1.0::double + rank % 3 as w, 3 * source_size as cap from r),
l as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0) as rest,
        sum(w) over () - coalesce(sum(w) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0) as w_rest from w),
f as (select *, rest * w >= cap * w_rest as fully, rest / w_rest as level from l),
g as (select source, source_size, rank, cast(case when fully then cap else (select arg_max(level, w_rest) from f where not fully) * w end as double) as target from f),
s as (select d.doc_id, d.size, g.source_size, g.rank, g.target, cast(floor(g.target) as bigint) as want,
        coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) as a
      from d join g on d.source is not distinct from g.source),
c as (select *, list_transform([0, 1, 2], lambda x: greatest(0, least(size, want - x * source_size - a))) as got from s),
p as (select *, list_position(list_transform(got, lambda x: x > 0), true) - 1 as first from c),
q as (select *, (first * source_size + a) / cast(greatest(want, 1) as double) as share from p)
select doc_id, size, source_size, target, cast(list_sum(got) as bigint) as taken,
  case when first is null or first < 0 then null when rank % 2 = 0 then least(1.0, case when share < 1 then 0.0 + (sqrt(greatest(0.0, 0.25 + 2.0 * share)) - 0.5) / 1.0 else 1.0 end)
       else least(1.0, case when share < 1 then 0.0 + (sqrt(greatest(0.0, 2.25 + -2.0 * share)) - 1.5) / -1.0 else 1.0 end) end as position from q""",
    "op5_top_k": r"""
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op6_quality": r"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
lists as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, string_split(text, chr(10)) as l from docs),
wins as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g
         from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from lists)),
hits as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from wins) where n > 1),
reps as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from hits) group by doc_id),
lines as (select doc_id, x, count(*) as n from (select doc_id, unnest(l) as x from lists) where regexp_matches(x, '[^\x20\x09-\x0D]') group by all),
dups as (select doc_id, sum(n - 1) as n, sum(n) as total from lines group by doc_id),
m as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(coalesce(dups.n, 0) as bigint) as n_dup_lines, cast(coalesce(reps.n, 0) as bigint) as n_repeat_words, cast(coalesce(dups.total, 0) as bigint) as n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_letter_words,
        len(list_filter(w, lambda x: not regexp_matches(x, '[a-z]') and regexp_matches(x, '[A-Z].*[A-Z]'))) as n_caps_words,
        length(regexp_replace(text, '[^!]', '', 'g')) as n_exclaim
      from lists left join dups using (doc_id) left join reps using (doc_id)),
f as (select *, (n_words < 50)::int + 2 * (100 * n_repeat_words > 50 * n_words)::int + 4 * (n_words > 0 and 10 * n_symbols > n_words)::int
        + 8 * (10 * n_dup_lines > 3 * n_lines)::int + 16 * (n_words > 0 and word_chars < 2 * n_words)::int + 32 * (word_chars > 20 * n_words)::int
        + 64 * (10 * n_letter_words < 6 * n_words)::int + 128 * (2 * n_caps_words > n_words and n_words > 0)::int + 256 * (n_words > 0 and 5 * n_exclaim > n_words)::int as bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 as base_failed, (bits & 455) = 0 and bit_count(bits & 56) <= 1 as kept,
  cast(bits as bigint) as failed_bits, 'strict-2' as policy from f""",
    "op10_warc": """
with p as (select page_id, sha256(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first from p)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to from f""",
}
