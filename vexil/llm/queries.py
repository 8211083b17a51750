"""The registered queries of the training-data operators and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.llm import ann, fingerprint, langid, linededup, lm, materialise, minhash, mixing, pieces, pii


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise.materialise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).drop("ids")


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.clean_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select(
        "page_id",
        "site",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept_lines")).cast("long").alias("n_dropped"),
        F.md5(F.concat_ws("\n", "kept_lines")).alias("kept_md5"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_materialise": op2_materialise,
    "op3_ann": op3_ann,
    "op4_lm": op4_lm,
    "op5_minhash": op5_minhash,
    "op6_pieces": op6_pieces,
    "op7_linededup": op7_linededup,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_langid": op10_langid,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op5_minhash": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 1 then [ws[1]] else [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
i as (select x.doc_id as a, y.doc_id as b, count(*) as c from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
e as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as k, doc_id as c from documents union select u.b, r.c from r join u on u.a = r.k)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, m.c = d.doc_id as kept
from documents d left join n using (doc_id) join (select k, min(c) as c from r group by k) m on m.k = d.doc_id
""",
    "op7_linededup": r"""
with p as (
  select page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) as site,
    [trim(x) for x in string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)<(?:/(?:p|div|li|h[1-6]|article|nav|footer|title|ul|table|tr)|br)\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) if trim(x) <> ''] as lines
  from pages),
t as (select site, count(*) as pages from p group by 1),
d as (
  select s.site, s.l from (select site, l, count(*) as n from (select distinct page_id, site, unnest(lines) as l from p) group by 1, 2) s
  join t on t.site is not distinct from s.site where n > 1 and n > pages * 0.3::double),
g as (select site, list(l) as gone from d group by 1),
k as (select page_id, p.site, lines, case when gone is null then lines else [x for x in lines if not list_contains(gone, x)] end as kept from p left join g on g.site is not distinct from p.site)
select page_id, site, len(lines) as n_lines, len(lines) - len(kept) as n_dropped, md5(coalesce(array_to_string(kept, chr(10)), '')) as kept_md5 from k
""",
    "op8_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by 1),
a as (select *, [5.0, 2.0, 1.0][1 + ((row_number() over (order by source nulls last) - 1) % 3)]::double as w, source_size * 2.0::double as cap from s),
b as (select *, cap / w as x, sum(source_size) over () * 1.5::double as want, sum(w) over () as w_all from a),
c as (select *, (want - coalesce(sum(cap) over o, 0)) / (w_all - coalesce(sum(w) over o, 0)) as lev from b
  window o as (order by x, source nulls last rows between unbounded preceding and 1 preceding)),
l as (select *, max(case when x >= lev then lev end) over () as level from c),
t as (select source, source_size, case when level is null then cap else least(cap, w * level) end as target from l),
r as (select doc_id, size, t.source_size, target, case when t.source_size > 0 then target / t.source_size else 0 end as rate,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 12))::bigint / 281474976710656.0::double as u
  from d join t on t.source is not distinct from d.source)
select doc_id, size, source_size, target, (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint as taken from r
""",
}
