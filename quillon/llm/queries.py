"""Queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def tokenizer() -> str:
    """Place of the public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document: all, kept, removed, those removed that only resemble the line kept; and what remains."""
    from .line_dedup import deduplicated

    out = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), detail=True)
    return out.selectExpr("doc_id", "n_lines", "n_lines - n_removed as n_kept", "n_removed", "n_near", "char_length(text) as n_chars_kept", "md5(text) as text_md5")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import identified, learn

    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = identified(docs, learn(docs.where(~fold).select("text", "lang")))
    return found.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), tokenizer())


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), least=0)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation import damage_report

    return damage_report(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .negatives import mined

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"))
    return mined(rows, "id % 50 = 0")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .privacy import report

    return report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _AZ + r", '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all(" + _AZ + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: crc32 of a short ASCII text.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({0}) + 1), lambda k: ascii({0}[k])::bigint)), lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::bigint)"
_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> {0}) & 31) + 1, 1)"

_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _then(state: str, cost: str, edit: str) -> str:
    """A state's `cost, edits` in SQL, one edit on."""
    return f"(printf('%06d', substr({state}, 1, 6)::int + {cost}) || substr({state}, 7) || '{edit}')"


_REPAIR = f"""with recursive f as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
 g as (select *, {_CRC.format("key")} % 20 as fate from f),
 h as (select conv_id, turn, case when fate = 4 then 'user' else role end as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy from g, unnest(range(case fate when 0 then 0 when 3 then 2 else 1 end)) t(copy)),
 w as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as k, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, rtrim(text, {_WS}) as solid from h),
 x as (select conv_id, turn, role, text, k, substr(role, 1, 1) as i, solid = '' as blank, solid <> '' and again as duplicate, solid <> '' and not again and right(solid, 1) not in ('.', '!', '?') as truncated, lag(substr(role, 1, 1)) over (partition by conv_id order by k) as p from w),
 r as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank, sum(duplicate::int) as duplicate, sum(truncated::int) as truncated, sum((k > 1 and p || i not in ('su', 'ua', 'au'))::int) as illegal from x group by 1),
 d(conv_id, k, n, e, s, u, a) as (
  select conv_id, 0::bigint, n, '000000', null::varchar, '000002I', '000004II' from r
  union all select conv_id, k, n, e, s, least(u, {_then("e", "2", "I")}, {_then("s", "2", "I")}, {_then("a", "2", "I")}), least(a, {_then("u", "2", "I")}, {_then("e", "4", "II")}, {_then("s", "4", "II")}) from (
   select d.conv_id, x.k, n, {_then("e", "3", "D")} as e,
    least({_then("s", "3", "D")}, case when ok and i = 's' then {_then("e", "t", "K")} end) as s,
    least({_then("u", "3", "D")}, case when ok and i = 'u' then least({_then("e", "t", "K")}, {_then("s", "t", "K")}, {_then("a", "t", "K")}) end, case when ok then least({_then("e", "2 + t", "R")}, {_then("s", "2 + t", "R")}, {_then("a", "2 + t", "R")}) end) as u,
    least({_then("a", "3", "D")}, case when ok and i = 'a' then {_then("u", "t", "K")} end, case when ok then {_then("u", "2 + t", "R")} end) as a
   from d join (select *, truncated::int as t, not blank and not duplicate as ok from x) x on d.conv_id is not distinct from x.conv_id and x.k = d.k + 1)),
 z as (select conv_id, n, least(e, a) as best from d where k = n),
 y as (select conv_id, substr(best, 7) as audit, substr(best, 1, 6)::bigint as cost, list_filter(range(1, length(best) - 5), lambda j: best[j + 6] <> 'I') as at from z),
 m as (select conv_id, j::bigint as j, audit[j] as edit from y, unnest(range(1, length(audit) + 1)) t(j)),
 v as (select m.conv_id, m.j, m.edit, x.role, x.text, sum((m.edit <> 'D')::int) over (partition by m.conv_id order by m.j) as place, case when m.edit = 'K' then substr(x.role, 1, 1) end as kept from m join y on m.conv_id is not distinct from y.conv_id left join x on x.conv_id is not distinct from m.conv_id and m.edit <> 'I' and x.k = list_position(y.at, m.j)),
 o as (select *, bool_or(kept = 's') over (partition by conv_id) as headed from v where edit <> 'D'),
 t as (select conv_id, sha256(string_agg(case when edit = 'K' then role when (place - headed::int) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by j)) as sha from (select * replace (coalesce(headed, false) as headed) from o) group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join r on c.conv_id is not distinct from r.conv_id left join y on c.conv_id is not distinct from y.conv_id left join t on c.conv_id is not distinct from t.conv_id"""

_NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_sum(list_transform(range(1, len(a.v) + 1), lambda k: a.v[k] * b.v[k]))::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
 p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
 n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3"""

_SQL = {
    "op12_hard_negatives": _NEGATIVES,
    "op11_conversation_repair": _REPAIR,
    "op3_ngram_jaccard": f"""with recursive d as (select doc_id, {_WORDS} w from documents),
 s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
 n as (select doc_id, count(*) n from s group by 1),
 p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
 u as (select a, b from e union all select b, a from e),
 r as (select doc_id root, doc_id node from documents union select root, u.b from r join u on u.a = node)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id from documents left join n using (doc_id) join (select root doc_id, min(node) component_id from r group by 1) using (doc_id)""",
    "op7_warc": f"""with p as (select page_id, coalesce(url, '') url, coalesce(html, '') h from pages), q as (select *, sha1(h) x, min(page_id) over (partition by h) first from p)
select page_id, strlen(h)::bigint payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda g: ('0x' || substr(x, (g * 5 + 1)::int, 5))::bigint), lambda v: {" || ".join(_B32.format(k) for k in (15, 10, 5, 0))}), '') payload_digest,
 case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to, url from q""",
    "op10_decontamination": f"""with d as (select doc_id, {_ALNUM} w from documents), i as (select item_id, {_ALNUM} w from benchmark),
 iw as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') g from (select item_id, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) k from i where len(w) > 0)),
 dw as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from iw) where len(w) >= n)),
 h as (select doc_id, k, n, item_id from dw join iw using (n, g)),
 c as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(k, k + n)) p from h) group by 1),
 t as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from h group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join c using (doc_id) left join t using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
