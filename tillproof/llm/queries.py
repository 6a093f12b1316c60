"""The queries op1 to op13 over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, html_text, langid, licenses, maxent_lm, permutation_index, repair, runs, sharding, simhash, toxicity, whitening
from .common import table


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(table(spark, sf_dir, "documents"))


def op2_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return repair.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op6_monoid_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_weak_label_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = langid.id_mod("doc_id", 4) == 2
    return toxicity.toxicity(docs, labels).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_dom_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return permutation_index.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.id_mod("doc_id", 5) == 0
    return langid.languages(docs).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", runs.with_planted_period(docs.text, docs.doc_id).alias("text"))
    return runs.digests(runs.periodic_runs(planted))


def op12_subspace_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(table(spark, sf_dir, "documents"), 24)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_repair_token_files": op2_repair_token_files,
    "op3_license_signatures": op3_license_signatures,
    "op4_benchmark_leaks": op4_benchmark_leaks,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_monoid_bpe": op6_monoid_bpe,
    "op7_weak_label_toxicity": op7_weak_label_toxicity,
    "op8_dom_main_text": op8_dom_main_text,
    "op9_permutation_index": op9_permutation_index,
    "op10_crf_language": op10_crf_language,
    "op11_word_runs": op11_word_runs,
    "op12_subspace_whitening": op12_subspace_whitening,
    "op13_minimax_shards": op13_minimax_shards,
}

#: A step of the checksum for each byte: eight bits, reflected, with the usual polynomial.
CRC_TABLE = "[list_reduce(list_prepend(cast(b as bigint), range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) for b in range(256)]"
#: The last end of a group up to x, and the first from x on.
FLOOR, CEIL = "list_max(list_filter(ends, lambda v: v <= {x}))", "coalesce(list_min(list_filter(ends, lambda v: v >= {x})), total)"

OP13 = f"""with recursive tab as materialized (select {CRC_TABLE} as tab),
t as materialized (select doc_id, coalesce(text, '') as x from documents),
bytes as (select distinct x, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda v: cast('0x' || v as bigint)) as b from t),
crcs as materialized (select x, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, v: xor(c >> 8, tab[1 + xor(c & 255, v)])), 4294967295) as crc from bytes, tab),
d as materialized (select doc_id, octet_length(encode(x)) + 8 as size, crc, cast('0x' || substr(md5(x), 1, 15) as bigint) as place from t join crcs using (x)),
g as materialized (select place, cast(sum(size) as bigint) as s from d group by 1),
o as (select place, s, row_number() over w as r, sum(s) over w - s as before from g window w as (order by s desc, place)),
hits as (select *, s * (25 - r) > (select sum(s) from g) - before and r < 24 as hit from o),
alone as materialized (select place, cast(r - 1 as int) as shard from hits where r < coalesce((select min(r) from hits where not hit), 99)),
e as materialized (select place, cast(sum(s) over (order by place) as bigint) as e from g where place not in (select place from alone)),
known as materialized (select list_prepend(cast(0 as bigint), coalesce(list_sort(list(e)), [])) as ends, coalesce(max(e), 0) as total, 24 - (select count(*) from alone) as n from e),
search as (select cast(-1 as bigint) as lo, total as hi from known union all
 select case when fits then lo else mid end, case when fits then mid else hi end from (select lo, hi, (lo + hi) // 2 as mid, list_reduce(list_prepend(cast(0 as bigint), range(n)), lambda pos, i: {FLOOR.format(x="pos + (lo + hi) // 2")}) = total as fits from search, known where hi - lo > 1)),
cap as materialized (select min(hi) as cap from search),
needed as (select n as k, total as x from known union all select k - 1, case when x <= cap then 0 else {CEIL.format(x="x - cap")} end from needed, known, cap where k > 1),
cuts as (select cast(0 as bigint) as k, cast(0 as bigint) as pos from known union all
 select k + 1, least(greatest(case when near > pos then near else {CEIL.format(x="pos + 1")} end, (select min(x) from needed where needed.k = c.k + 1)), {FLOOR.format(x="pos + cap")}) from
 (select *, case when fair - low <= high - fair then low else high end as near from (select *, {FLOOR.format(x="fair")} as low, {CEIL.format(x="fair")} as high from (select k, pos, pos + (total - pos) // (n - k) as fair, ends, total, n, cap from cuts, known, cap where k < n - 1))) c),
placed as (select d.*, coalesce(a.shard, 24 - n + (select count(*) from cuts where k > 0 and pos < e.e)) as shard, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || place), 1, 8) as bigint) as turn from d left join alone a using (place) left join e using (place), known)
select doc_id, cast(size as bigint) as size, crc as text_crc32, 'bytes' as law, cast(shard as int) as shard, row_number() over (partition by shard order by turn, doc_id, place) - 1 as slot, cast(null as int) as grown_shard from placed"""

ORACLE_SQL: dict[str, str] = {"op13_minimax_shards": OP13}
