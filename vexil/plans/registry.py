"""The registered queries of the vector, attention and evaluation operators, each next to the same in DuckDB's SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.functions import textscore as E
from vexil.functions import vectors as V
from vexil.operators import attention as A
from vexil.operators import blocks
from vexil.operators import ivf
from vexil.operators import kmeans as K
from vexil.operators import search as S
from vexil.operators import selectors as B
from vexil.operators import variants as X
from vexil.plans import evalstats as M
from vexil.plans import taskgen as G
from vexil.plans.canon import DIM, DIM_VALUE, HYBRID, INDEX, LISTS, LOCAL, PIECES, SCALE, SINK, Canon
from vexil.sources import logs
from vexil.sources.shared import stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@functools.lru_cache(8)
def _built(application: str, sf_dir: str, files: tuple) -> Canon:
    return Canon(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), sf_dir)


def canon(spark: SparkSession, sf_dir: str) -> Canon:
    """An index is built once an application and state of the table's files (names, sizes, times), like any table that queries share."""
    files = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return _built(spark.sparkContext.applicationId, sf_dir, tuple(sorted(map(tuple, files.collect()))))


def query(sql: str | None = None):
    def register(f: Callable[[Canon], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(canon(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def six(c) -> F.Column:
    """To six places, as compared."""
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


def by_dim(df: DataFrame) -> DataFrame:
    return df.select("query_id", "d", six("value").alias("value"))


def long(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row a component."""
    return df.select(*keys, F.posexplode(column).alias("d", "value")).select(*keys, F.col("d").cast("long").alias("d"), six("value").alias("value"))


# SQL that several queries begin with

R6 = "round({}, 6) + 0.0"
KV = """kv as (select vec_id as pos, embedding::double[] as k, (embedding::double[])[1:8] as v, label from embeddings),
nn as (select max(pos) + 1 as n from kv),
rg as (select kv.*, case when pos < 4 then 'sink' when pos >= greatest(4, n - 128) then 'local' else 'retrieval' end as region from kv, nn),
q as (select pos as query_id, k as q from kv where pos % 100 = 0),
ret as (select * from rg where region = 'retrieval')"""
NEAR = "(min({{'d': list_inner_product({c}, {c}) - 2 * list_inner_product({v}, {c}), 'l': {l}}})).l"
COARSE = f"""{KV},
c0 as (select pos - 4 as list_id, k as c from ret where pos < 12),
a1 as (select pos, any_value(k) as k, {NEAR.format(c="c", v="k", l="list_id")} as list_id from ret, c0 group by pos),
m1 as (select list_id, list(x order by d) as c from (select list_id, d, avg(x) as x from (select list_id, unnest(k) as x, generate_subscripts(k, 1) as d from a1) group by 1, 2) group by 1),
c1 as (select c0.list_id, coalesce(m1.c, c0.c) as c from c0 left join m1 using (list_id)),
a2 as (select pos, any_value(k) as k, any_value(v) as v, {NEAR.format(c="c", v="k", l="list_id")} as list_id from ret, c1 group by pos)"""
PQ = f"""{COARSE},
rs as (select pos, list_id, [k[i] - c[i] for i in range(1, 65)] as r from a2 join c1 using (list_id)),
sb as (select pos, m, r[m * 8 + 1 : m * 8 + 8] as s from rs, range(8) t(m)),
w0 as (select m, pos - 4 as code, s as w from sb where pos < 20),
b1 as (select pos, m, any_value(s) as s, {NEAR.format(c="w", v="s", l="code")} as code from sb join w0 using (m) group by pos, m),
m2 as (select m, code, list(x order by d) as w from (select m, code, d, avg(x) as x from (select m, code, unnest(s) as x, generate_subscripts(s, 1) as d from b1) group by 1, 2, 3) group by 1, 2),
w1 as (select w0.m, w0.code, coalesce(m2.w, w0.w) as w from w0 left join m2 using (m, code)),
cd as (select pos, m, {NEAR.format(c="w", v="s", l="code")} as code from sb join w1 using (m) group by pos, m)"""
LUT = f"""{PQ},
lut as (select query_id, m, code, list_inner_product(q[m * 8 + 1 : m * 8 + 8], w) as x from q, w1),
bias as (select query_id, list_id, list_inner_product(q, c) as b from q, c1)"""
SCORE = f"""{LUT},
pq as (select query_id, pos, sum(x) as x from cd join lut using (m, code) group by 1, 2),
sc as (select query_id, pos, list_id, x + b as score from pq join a2 using (pos) join bias using (query_id, list_id)),
ex as (select query_id, pos, region, v, list_inner_product(q, k) * 0.125 as logit from q, rg)"""
PROBE = f"""{SCORE},
pr as (select * from (select query_id, list_id, row_number() over (partition by query_id order by b desc, list_id) as rank from bias) where rank <= 2),
ca as (select query_id, pos, list_id, score, row_number() over (partition by query_id order by score desc, pos) as rank from sc semi join pr using (query_id, list_id))"""
RANKED = f"""{SCORE},
rk as (select *, row_number() over (partition by query_id order by score desc, pos) as rank from sc),
tk as (select query_id, pos from rk where rank <= (select ceil(count(*) * 0.01::double) from ret)),
lg as (select query_id, pos, region, null as list_id, logit, true as chosen, v from ex where region <> 'retrieval' union all
  select ex.query_id, ex.pos, region, sc.list_id, case when tk.pos is null then score * 0.125 else logit end, tk.pos is not null, ex.v
  from ex join sc using (query_id, pos) left join tk using (query_id, pos))"""
WEIGHTS = f"""{RANKED},
mx as (select query_id, max(logit) as m from lg group by 1),
wt as (select lg.*, exp(logit - m) / sum(exp(logit - m)) over (partition by query_id) as w from lg join mx using (query_id))"""
MEANS = """vm as (select list_id, d, avg(x) as x, sum(x) as sx, count(*) as n from (select list_id, unnest(v) as x, generate_subscripts(v, 1) as d from a2) group by 1, 2)"""


def combined(rows: str) -> str:
    return f"select query_id, d - 1 as d, {R6.format('sum(w * x)')} as value from (select query_id, w, unnest(v) as x, generate_subscripts(v, 1) as d from {rows}) group by 1, 2"


def attention_sql(prelude: str, logits: str) -> str:
    return f"with {prelude}, zz as ({logits}), zm as (select query_id, max(logit) as m from zz group by 1), zw as (select zz.*, exp(logit - m) / sum(exp(logit - m)) over (partition by query_id) as w from zz join zm using (query_id)) {combined('zw')}"


def with_background(prelude: str, weights: str, means: str) -> str:
    """means(query_id or not, list_id, d, x)."""
    return f"""with {prelude}, lm as (select query_id, list_id, sum(w) as w from {weights} where not chosen group by 1, 2),
bb as (select query_id, d, w * x as x from ({means})),
dd as (select query_id, d, w * x as x from (select query_id, w, unnest(v) as x, generate_subscripts(v, 1) as d from {weights} where chosen))
select query_id, d - 1 as d, {R6.format("sum(x)")} as value from (select * from bb union all select * from dd) group by 1, 2"""


# scalars and layout


@query(f"with {KV} select query_id, pos, {R6.format('list_inner_product(q, k)')} as x from q, kv")
def p1_dot(c: Canon) -> DataFrame:
    return A.exact(c.queries, c.kv, 1.0, DIM, ["pos"]).select("query_id", "pos", six("logit").alias("x"))


@query(f"with {KV}, nr as (select pos, k, greatest(sqrt(list_inner_product(k, k)), 1e-12) as l from kv) select pos, {R6.format('l')} as length, d - 1 as d, {R6.format('x / l')} as value from (select pos, l, unnest(k) as x, generate_subscripts(k, 1) as d from nr)")
def p2_norm_split(c: Canon) -> DataFrame:
    k = F.col("key")
    return long(c.kv.select("pos", six(V.norm(k, DIM)).alias("length"), V.direction(k, DIM).alias("u")), ["pos", "length"], "u")


@query(f"with {PQ} select pos, list_id, d - 1 as d, {R6.format('x')} as value from (select pos, list_id, unnest(r) as x, generate_subscripts(r, 1) as d from rs)")
def p5_residual(c: Canon) -> DataFrame:
    return long(c.residual.select("pos", F.col("list_id").cast("long").alias("list_id"), "r"), ["pos", "list_id"], "r")


@query(f"with {PQ} select pos, m // 2 as byte, sum(case when m % 2 = 0 then code else code * 16 end)::bigint as packed from cd group by 1, 2")
def p9_pack(c: Canon) -> DataFrame:
    packed = c.index.codes.select("pos", F.posexplode(V.pack4(F.col("codes"), PIECES)).alias("byte", "packed"))
    return packed.select("pos", F.col("byte").cast("long").alias("byte"), F.col("packed").cast("long").alias("packed"))


@query(f"with {PQ} select pos, m, code::bigint as code from cd")
def p9_unpack(c: Canon) -> DataFrame:
    codes = V.unpack4(V.pack4(F.col("codes"), PIECES), PIECES)
    return c.index.codes.select("pos", F.posexplode(codes).alias("m", "code")).select("pos", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


@query(f"with {KV} select region, count(*) as n, min(pos) as first, max(pos) as last from rg group by 1")
def d2_regions(c: Canon) -> DataFrame:
    return c.regions.groupBy("region").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query(f"with {KV} select pos // 16 as page, count(*) as n, {R6.format('avg(k[1])')} as mean_0, {R6.format('max(k[1])')} as max_0 from kv group by 1")
def d19_pages(c: Canon) -> DataFrame:
    return c.kv.groupBy(B.page().alias("page")).agg(F.count("*").alias("n"), six(F.avg(F.get("key", F.lit(0)))).alias("mean_0"), six(F.max(F.get("key", F.lit(0)))).alias("max_0"))


@query(f"with {KV} select (label // 2)::bigint as stream_id, query_id, count(*) as n, {R6.format('max(list_inner_product(q, k)) * 0.125')} as best from q, kv group by 1, 2")
def p18_head_groups(c: Canon) -> DataFrame:
    """Ten label heads, two a key/value head: each query meets every head's rows."""
    kv = A.head_queries(c.kv.withColumn("q_head", F.col("label")), 2).select("stream_id", "pos", "key")
    heads = kv.select("stream_id").distinct()
    asked = c.queries.drop("stream_id").withColumn("_a", F.lit(1)).join(heads.withColumn("_a", F.lit(1)), "_a").drop("_a")
    logits = A.exact(asked, kv, SCALE, DIM, ["pos"])
    return logits.groupBy("stream_id", "query_id").agg(F.count("*").alias("n"), six(F.max("logit")).alias("best"))


# index


@query(f"with {COARSE} select l.list_id, count(pos) as n from (select unnest(range(8)) as list_id) l left join a2 using (list_id) group by 1")
def a1_list_sizes(c: Canon) -> DataFrame:
    return K.list_sizes(c.assigned, LISTS).select(F.col("list_id").cast("long").alias("list_id"), "n")


@query(f"with {COARSE} select pos, list_id from a1")
def k1_assign(c: Canon) -> DataFrame:
    return K.assign(c.points, c.first(LISTS), ["stream_id"], DIM).select("pos", F.col("list_id").cast("long").alias("list_id"))


@query(f"with {COARSE} select list_id, d - 1 as d, {R6.format('x')} as value from (select list_id, unnest(c) as x, generate_subscripts(c, 1) as d from c1)")
def k1_update(c: Canon) -> DataFrame:
    out = c.coarse_and_assigned[0].select(F.col("list_id").cast("long").alias("list_id"), "centroid")
    return long(out, ["list_id"], "centroid")


@query(
    f"with {COARSE}, m3 as (select list_id, list(x order by d) as c from (select list_id, d, avg(x) as x from (select list_id, unnest(k) as x, generate_subscripts(k, 1) as d from a2) group by 1, 2) group by 1),"
    f" c2 as (select c1.list_id, coalesce(m3.c, c1.c) as c from c1 left join m3 using (list_id)) select pos, {NEAR.format(c='c', v='k', l='list_id')} as list_id from ret, c2 group by pos"
)
def k1_two_iter(c: Canon) -> DataFrame:
    _, out = K.kmeans(c.points, ["stream_id"], LISTS, DIM, 2, c.first(LISTS), refill=False)
    return out.select("pos", F.col("list_id").cast("long").alias("list_id"))


@query(f"with {COARSE} select list_id, pos, row_number() over (order by list_id, pos) - 1 as place from a2")
def k13_invert(c: Canon) -> DataFrame:
    lists = K.inverted(c.assigned, LISTS)
    flat = lists.select("list_id", "first", F.posexplode("members").alias("i", "pos"))
    return flat.select(F.col("list_id").cast("long").alias("list_id"), "pos", (F.col("first") + F.col("i")).cast("long").alias("place"))


@query(f"with {COARSE}, {MEANS} select list_id, d - 1 as d, n, {R6.format('x')} as value from vm")
def k15_value_means(c: Canon) -> DataFrame:
    return long(c.means.select(F.col("list_id").cast("long").alias("list_id"), "n", "v_mean"), ["list_id", "n"], "v_mean")


@query(f"with {COARSE}, s as (select l.list_id, count(pos) as n from (select unnest(range(8)) as list_id) l left join a2 using (list_id) group by 1) select count(*) as lists, count(*) filter (n = 0) as empty, max(n) as largest, sum(n)::bigint as rows from s")
def k20_health(c: Canon) -> DataFrame:
    return K.health(c.assigned, LISTS).drop("stream_id")


@query(f"with {COARSE}, s as (select count(*) as rows from a2) select rows, rows * 4 as code_bytes, rows * 2 as list_bytes, 3072::bigint as codebook_bytes, {R6.format('rows * 128 / (rows * 6 + 3072)')} as key_compression_ratio from s")
def k19_footprint(c: Canon) -> DataFrame:
    out = ivf.footprint(c.index, ivf.packed(c.index))
    return out.select("rows", "code_bytes", "list_bytes", "codebook_bytes", six("key_compression_ratio").alias("key_compression_ratio"))


@query(f"with {PQ} select pos, m, code::bigint as code from cd")
def p7_encode(c: Canon) -> DataFrame:
    return c.index.codes.select("pos", F.posexplode("codes").alias("m", "code")).select("pos", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


@query(f"with {LUT} select query_id, m, code::bigint as code, {R6.format('x')} as x from lut")
def p10_lut(c: Canon) -> DataFrame:
    return S.lookup(c.queries, c.index).select("query_id", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"), six("x").alias("x"))


@query(f"with {SCORE} select query_id, pos, {R6.format('x')} as x from pq")
def p11_lut_score(c: Canon) -> DataFrame:
    index = replace(c.index, config=replace(INDEX, residual=False))
    return S.approximate(c.queries, index).select("query_id", "pos", six("score").alias("x"))


@query(f"with {LUT} select query_id, list_id, {R6.format('b')} as b from bias")
def p13_list_bias(c: Canon) -> DataFrame:
    return S.bias(c.queries, c.index).select("query_id", F.col("list_id").cast("long").alias("list_id"), six("bias").alias("b"))


@query(f"with {SCORE} select query_id, pos, list_id, {R6.format('score')} as score from sc")
def p15_approx_score(c: Canon) -> DataFrame:
    return S.approximate(c.queries, c.index).select("query_id", "pos", F.col("list_id").cast("long").alias("list_id"), six("score").alias("score"))


@query(
    f"with {PQ}, dc as (select pos, flatten(list(w order by m)) as r from cd join w1 using (m, code) group by pos)"
    f" select pos, d - 1 as d, {R6.format('x')} as value from (select pos, unnest(z) as x, generate_subscripts(z, 1) as d from (select pos, [r[i] + c[i] for i in range(1, 65)] as z from dc join a2 using (pos) join c1 using (list_id)))"
)
def p16_reconstruct(c: Canon) -> DataFrame:
    return long(ivf.reconstruct(c.index), ["pos"], "key")


# search


@query(f"with {PROBE} select query_id, list_id, rank from pr")
def t1_probe(c: Canon) -> DataFrame:
    return S.probes(c.queries, c.index, 2).select("query_id", F.col("list_id").cast("long").alias("list_id"), "rank")


@query(f"with {PROBE} select query_id, pos, list_id from ca")
def t2_candidates(c: Canon) -> DataFrame:
    return S.candidates(S.probes(c.queries, c.index, 2), c.index, c.queries).select("query_id", "pos", F.col("list_id").cast("long").alias("list_id"))


@query(f"with {PROBE} select query_id, pos, rank, {R6.format('score')} as score from ca where rank <= 20")
def t3_budget(c: Canon) -> DataFrame:
    return S.search(c.queries, c.index, 10, 2, 20)["candidates"].select("query_id", "pos", "rank", six("score").alias("score"))


@query(f"with {PROBE} select query_id, pos, rank from ca where rank <= 10")
def t4_search(c: Canon) -> DataFrame:
    """Without a budget; a single query is a table of one row."""
    return S.search(c.queries, c.index, 10, 2)["topk"].select("query_id", "pos", "rank")


@query(f"with {PROBE} select query_id, pos, rank, {R6.format('score')} as score from ca where rank <= 10")
def t5_search_many(c: Canon) -> DataFrame:
    return S.search(c.queries, c.index, 10, 2, 20)["topk"].select("query_id", "pos", "rank", six("score").alias("score"))


@query(f"with {RANKED} select query_id, pos, rank, {R6.format('score')} as score from rk where rank <= 10")
def t6_allpq_topk(c: Canon) -> DataFrame:
    return S.top(S.approximate(c.queries, c.index), 10).select("query_id", "pos", "rank", six("score").alias("score"))


@query(f"with {KV} select 0::bigint as stream_id, ceil(count(*) * 0.01::double)::bigint as k_1, ceil(count(*) * 0.5::double)::bigint as k_50, count(*) as k_100 from ret")
def t8_fraction_k(c: Canon) -> DataFrame:
    n = c.retrieval.groupBy("stream_id").agg(F.count("*").alias("n"))
    return n.select("stream_id", *(S.fraction_k(F.col("n"), f).alias(f"k_{int(100 * f)}") for f in (0.01, 0.5, 1.0)))


NUCLEUS = f"{SCORE}, ap as (select query_id, pos, score * 0.125 as l from sc)"


@query(
    f"with {NUCLEUS}, s as (select query_id, pos, l, exp(l - max(l) over (partition by query_id)) as e from ap), g as (select query_id, coalesce(sum(e) over (partition by query_id order by l desc, pos rows between unbounded preceding and 1 preceding), 0) / sum(e) over (partition by query_id) as b from s)"
    " select query_id, count(*) filter (b < 0.3) as k from g group by 1"
)
def t9_nucleus(c: Canon) -> DataFrame:
    return S.nucleus(S.approximate(c.queries, c.index).select("query_id", "pos", (F.col("score") * SCALE).alias("logit")), 0.3)


@query(
    f"with {NUCLEUS}, u as (select query_id, pos, l, true as r from ap union all select query_id, pos, logit, false from ex where region <> 'retrieval'), s as (select *, exp(l - max(l) over (partition by query_id)) as e from u),"
    " t as (select query_id, sum(e) as z, sum(e) filter (not r) as p from s group by 1),"
    " g as (select query_id, (p + coalesce(sum(e) over (partition by query_id order by l desc, pos rows between unbounded preceding and 1 preceding), 0)) / z as b from s join t using (query_id) where r)"
    " select query_id, count(*) filter (b < 0.5) as k from g group by 1"
)
def t10_nucleus_prefix(c: Canon) -> DataFrame:
    cfg = replace(HYBRID, top_fraction=None, top_p=0.5, top_p_scope="denominator")
    scaled = S.approximate(c.queries, c.index).withColumn("score", F.col("score") * SCALE)
    return A.chosen_counts(scaled, c.queries, cfg, A.exact(c.queries, c.regions, SCALE, DIM).filter("region <> 'retrieval'"))


@query(
    f"with {SCORE}, b as (select query_id, list_id, max(score) as s from sc group by 1, 2), l as (select * from (select query_id, list_id, row_number() over (partition by query_id order by s desc, list_id) as r from b) where r <= 3),"
    " t as (select query_id, pos, row_number() over (partition by query_id order by score desc, pos) as rank from sc semi join l using (query_id, list_id)) select * from t where rank <= 10"
)
def t13_listmax_topk(c: Canon) -> DataFrame:
    return S.listmax(S.approximate(c.queries, c.index), 3, 10).select("query_id", "pos", "rank")


@query(f"with {PROBE}, f as (select pos, list_id, row_number() over (partition by list_id order by pos) as r from a2) select query_id, f.list_id, pos from f join pr using (list_id) where r <= 16")
def t14_slots(c: Canon) -> DataFrame:
    return S.slotted(S.probes(c.queries, c.index, 2), c.index, 16).select("query_id", F.col("list_id").cast("long").alias("list_id"), "pos")


@query(
    f"with {PQ}, hq as (select query_id, query_id // 100 as h, query_id // 400 as g, q from q), gm as (select g, list(x order by d) as q from (select g, d, avg(x) as x from (select g, unnest(q) as x, generate_subscripts(q, 1) as d from hq) group by 1, 2) group by 1),"
    " gl as (select g, m, code, list_inner_product(q[m * 8 + 1 : m * 8 + 8], w) as x from gm, w1), gs as (select g, pos, sum(x) as x from cd join gl using (m, code) group by 1, 2),"
    " gr as (select g, pos, row_number() over (partition by g order by x + list_inner_product(gm.q, c) desc, pos) as rank from gs join gm using (g) join a2 using (pos) join c1 using (list_id)) select h as query_id, pos, rank from gr join hq using (g) where rank <= 5"
)
def t16_group_shared(c: Canon) -> DataFrame:
    heads = c.queries.withColumn("query_id", F.floor(F.col("query_id") / 100).cast("long"))
    return S.shared_topk(heads, c.index, 4, 5)


@query(
    "with e as (select vec_id as step, embedding::double[] as q from embeddings), p as (select step, q, lag(q) over (order by step) as p from e),"
    " a as (select step, coalesce(list_inner_product(q, p) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(p, p))) >= 0.0, false) as ok from p),"
    " g as (select step, sum(case when ok then 0 else 1 end) over (order by step) as g from a), r as (select step, row_number() over (partition by g order by step) - 1 as age from g) select step, age % 4 > 0 as reused from r"
)
def t17_reuse(c: Canon) -> DataFrame:
    steps = c.kv.select("stream_id", F.col("pos").alias("step"), F.lit(0).alias("head"), F.col("key").alias("q"))
    return S.reuse_steps(steps, DIM, 0.0, 3).select("step", "reused")


# attention


@query(attention_sql(SCORE, "select query_id, logit, v from ex"))
def h1_dense(c: Canon) -> DataFrame:
    return by_dim(A.dense(c.queries, c.kv, SCALE, DIM, DIM_VALUE))


@query(attention_sql(RANKED, "select query_id, logit, v from lg where chosen"))
def h2_sparse(c: Canon) -> DataFrame:
    return by_dim(A.attend(c.logits(), replace(HYBRID, mode="sparse", value_mode="denominator"), DIM_VALUE))


@query(f"with {WEIGHTS} select query_id, pos, region, chosen, {R6.format('w')} as w from wt")
def h3_hybrid_weights(c: Canon) -> DataFrame:
    return A.softmax(c.logits()).select("query_id", "pos", "region", "chosen", six("w").alias("w"))


@query(f"with {WEIGHTS} {combined('(select * from wt where chosen)')}")
def h4_denominator(c: Canon) -> DataFrame:
    return by_dim(A.attend(c.logits(), replace(HYBRID, value_mode="denominator"), DIM_VALUE))


@query(f"with {WEIGHTS} {combined('wt')}")
def h5_full(c: Canon) -> DataFrame:
    cfg = replace(HYBRID, value_mode="full")
    return by_dim(A.attend(c.logits(cfg), cfg, DIM_VALUE))


@query(with_background(f"{WEIGHTS}, {MEANS}", "wt", "select query_id, d, w, x from lm join vm using (list_id)"))
def h6_centroid(c: Canon) -> DataFrame:
    return by_dim(A.attend(c.logits(), HYBRID, DIM_VALUE, c.means))


@query(f"with {SCORE}, s as (select query_id, list_id, exp((score - max(score) over (partition by query_id)) * 0.125) as e from sc) select query_id, list_id, {R6.format('sum(e)')} as s from s group by 1, 2")
def h7_segment_expsum(c: Canon) -> DataFrame:
    logits = S.approximate(c.queries, c.index).select("query_id", F.col("list_id").cast("long").alias("list_id"), (F.col("score") * SCALE).alias("logit"))
    return A.segment_sums(logits).select("query_id", "list_id", six("s").alias("s"))


@query(f"with {SCORE}, s as (select query_id, list_id, score * 0.125 as l, max(score * 0.125) over (partition by query_id, list_id) as m from sc) select query_id, list_id, {R6.format('max(l)')} as m, {R6.format('sum(exp(l - m))')} as s from s group by 1, 2")
def h8_segment_stats(c: Canon) -> DataFrame:
    logits = S.approximate(c.queries, c.index).select("query_id", F.col("list_id").cast("long").alias("list_id"), (F.col("score") * SCALE).alias("logit"))
    return A.segment_stats(logits, ["query_id", "list_id"]).select("query_id", "list_id", six("m").alias("m"), six("s").alias("s"))


@query(f"with {SCORE}, s as (select query_id, score * 0.125 as l, max(score * 0.125) over (partition by query_id) as m from sc) select query_id, {R6.format('max(l)')} as m, {R6.format('sum(exp(l - m))')} as s from s group by 1")
def h9_block_merge(c: Canon) -> DataFrame:
    """Blocks of 64 positions, each summed by itself, then merged."""
    logits = S.approximate(c.queries, c.index).select("query_id", F.floor(F.col("pos") / 64).alias("block"), (F.col("score") * SCALE).alias("logit"))
    return A.merge_stats(A.segment_stats(logits, ["query_id", "block"]), ["query_id"]).select("query_id", six("m").alias("m"), six("s").alias("s"))


CANDIDATE = f"{PROBE}, ck as (select query_id, pos, score, rank <= (select ceil(count(*) * 0.01::double) from ret) as hit from ca), cl as (select query_id, logit, v, true as chosen from ex where region <> 'retrieval' union all select ex.query_id, case when hit then logit else score * 0.125 end, v, hit from ex join ck using (query_id, pos))"


@query(f"with {CANDIDATE}, cm as (select query_id, max(logit) as m from cl group by 1), cw as (select cl.*, exp(logit - m) / sum(exp(logit - m)) over (partition by query_id) as w from cl join cm using (query_id)) {combined('(select * from cw where chosen)')}")
def h10_candidate_denominator(c: Canon) -> DataFrame:
    cfg = replace(HYBRID, topk_source="ivf_candidates", denominator_source="ivf_candidates", value_mode="denominator")
    return by_dim(A.attend(c.logits(cfg), cfg, DIM_VALUE))


@query(f"with {WEIGHTS}, t as (select query_id, sum(exp(logit - m)) as total, sum(exp(logit - m)) filter (not chosen) as background from lg join mx using (query_id) group by 1) select query_id, {R6.format('total')} as total, {R6.format('background')} as background from t")
def h12_corrected(c: Canon) -> DataFrame:
    return A.corrected(c.queries, c.regions, c.index, HYBRID, DIM).select("query_id", six("total").alias("total"), six("background").alias("background"))


@query(attention_sql(SCORE, "select query_id, logit, v from ex where region <> 'retrieval'"))
def h15_sink_local(c: Canon) -> DataFrame:
    return by_dim(A.dense(c.queries, c.regions.filter("region <> 'retrieval'"), SCALE, DIM, DIM_VALUE))


@query(attention_sql(SCORE, "select query_id, logit, v from ex"))
def h16_lse_merge(c: Canon) -> DataFrame:
    """Attention over retrieval rows and over the others, merged; equal to h1_dense."""
    return by_dim(A.merge_partial(blocks.partial(c.queries, c.regions, SCALE, DIM, DIM_VALUE, F.col("region") == "retrieval"), DIM_VALUE))


@query(f"with {RANKED} select query_id, count(*) filter (region = 'sink') as n_sink, count(*) filter (region = 'local') as n_local, count(*) filter (region = 'retrieval' and chosen) as n_chosen, count(*) filter (not chosen) as n_background, {R6.format('count(*) filter (chosen) / count(*)')} as exact_share from lg group by 1")
def h18_stats(c: Canon) -> DataFrame:
    return A.stats(c.logits()).withColumn("exact_share", six("exact_share"))


# maintenance

LOCAL_ROWS = "lo as (select pos, k, v from rg where region = 'local')"
ADDED = f"""{PQ}, {LOCAL_ROWS},
la as (select pos, any_value(k) as k, {NEAR.format(c="c", v="k", l="list_id")} as list_id from lo, c1 group by pos)"""


def coded_sql(rows: str, centroids: str, words: str) -> str:
    return f"""lr as (select pos, list_id, [k[i] - c[i] for i in range(1, 65)] as r from {rows} join {centroids} using (list_id)), ls as (select pos, list_id, m, r[m * 8 + 1 : m * 8 + 8] as s from lr, range(8) t(m)),
lc as (select pos, any_value(list_id) as list_id, m, {NEAR.format(c="w", v="s", l="code")} as code from ls join {words} using (m) group by pos, m)"""


@query(f"with {ADDED}, {coded_sql('la', 'c1', 'w1')} select pos, list_id, m, code::bigint as code from lc union all select pos, a2.list_id, m, code from cd join a2 using (pos)")
def k10_add(c: Canon) -> DataFrame:
    """The local rows, indexed under frozen codebooks."""
    codes = ivf.add(c.index, c.regions.filter("region = 'local'")).codes
    return codes.select("pos", F.col("list_id").cast("long").alias("list_id"), F.posexplode("codes").alias("m", "code")).select("pos", "list_id", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


EMA = f"""{ADDED},
lm as (select list_id, d, avg(x) as x from (select list_id, unnest(k) as x, generate_subscripts(k, 1) as d from la) group by 1, 2),
c2 as (select list_id, list(coalesce(z.x * 0.5 + y.x * 0.5, z.x) order by d) as c from (select list_id, unnest(c) as x, generate_subscripts(c, 1) as d from c1) z left join lm y using (list_id, d) group by 1)"""


@query(f"with {EMA} select list_id, d - 1 as d, {R6.format('x')} as value from (select list_id, unnest(c) as x, generate_subscripts(c, 1) as d from c2)")
def k12_ema(c: Canon) -> DataFrame:
    points = ivf.projected(c.regions.filter("region = 'local'"), INDEX, DIM, None)
    coarse = c.coarse_and_assigned[0]
    out = ivf.blended(coarse, K.assign(points, coarse, ["stream_id"], DIM), ["stream_id"], DIM, 0.5)
    return long(out.select(F.col("list_id").cast("long").alias("list_id"), "centroid"), ["list_id"], "centroid")


DELTA = f"""{EMA},
l2 as (select pos, any_value(k) as k, {NEAR.format(c="c", v="k", l="list_id")} as list_id from lo, c2 group by pos),
e1 as (select pos, list_id, [k[i] - c[i] for i in range(1, 65)] as r from l2 join c2 using (list_id)), e2 as (select pos, m, r[m * 8 + 1 : m * 8 + 8] as s from e1, range(8) t(m)),
e3 as (select pos, m, any_value(s) as s, {NEAR.format(c="w", v="s", l="code")} as code from e2 join w1 using (m) group by pos, m),
e4 as (select m, code, d, avg(x) as x from (select m, code, unnest(s) as x, generate_subscripts(s, 1) as d from e3) group by 1, 2, 3),
w2 as (select m, code, list(coalesce(z.x * 0.5 + y.x * 0.5, z.x) order by d) as w from (select m, code, unnest(w) as x, generate_subscripts(w, 1) as d from w1) z left join e4 y using (m, code, d) group by 1, 2)"""


@query(f"with {DELTA}, {coded_sql('l2', 'c2', 'w2')} select pos, list_id, m, code::bigint as code from lc union all select pos, a2.list_id, m, code from cd join a2 using (pos)")
def k16_delta_flush(c: Canon) -> DataFrame:
    codes = ivf.delta_flush(c.index, c.regions.filter("region = 'local'"), 0.5).codes
    return codes.select("pos", F.col("list_id").cast("long").alias("list_id"), F.posexplode("codes").alias("m", "code")).select("pos", "list_id", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


@query(
    f"with {DELTA}, al as (select pos, k from ret union all select pos, k from lo), l3 as (select pos, any_value(k) as k, {NEAR.format(c='c', v='k', l='list_id')} as list_id from al, c2 group by pos), {coded_sql('l3', 'c2', 'w2')} select pos, list_id, m, code::bigint as code from lc"
)
def k11_online_refresh(c: Canon) -> DataFrame:
    batch = c.regions.filter("region = 'local'")
    codes = ivf.online_refresh(c.index, c.regions.filter("region <> 'sink'"), batch, 0.5).codes
    return codes.select("pos", F.col("list_id").cast("long").alias("list_id"), F.posexplode("codes").alias("m", "code")).select("pos", "list_id", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


@query("with e as (select event_type, value from events) select case when value is null then 'no_value' when value < 10 then 'too_small' when event_type = 'view' then 'excluded' else 'admitted' end as reason, count(*) as n from e group by 1")
def r12_admission(c: Canon) -> DataFrame:
    rules = [("no_value", F.col("value").isNull()), ("too_small", F.col("value") < 10), ("excluded", F.col("event_type") == "view")]
    return M.rejected(c.table("events").select("event_type", "value"), rules)


# selectors

PAGES = f"""{SCORE}, pg as (select *, pos // 16 as page from rg), pb as (select page, list(lo order by d) as lo, list(hi order by d) as hi from (select page, d, min(x) as lo, max(x) as hi from (select page, unnest(k) as x, generate_subscripts(k, 1) as d from pg) group by 1, 2) group by 1),
ps as (select query_id, page, list_sum([greatest(q[i] * lo[i], q[i] * hi[i]) for i in range(1, 65)]) as score from q, pb),
bp as (select query_id, page from (select query_id, page, row_number() over (partition by query_id order by score desc, page) as r from ps) where r <= (select greatest(3, (16 * ceil((132 + ceil(0.1::double * greatest(0, n - 132))) / 16))::bigint // 16) from nn))"""


def _pages(c: Canon) -> DataFrame:
    n = (c.kv.agg(F.max("pos")).first()[0] or 0) + 1
    return B.best_pages(B.page_scores(c.queries, c.kv, DIM), B.budget(n, 0.1, SINK, LOCAL))


@query(f"with {PAGES} select query_id, page from bp")
def b2_page_select(c: Canon) -> DataFrame:
    return _pages(c).select("query_id", "page")


@query(attention_sql(PAGES, "select query_id, logit, v from ex join bp on bp.query_id = ex.query_id and bp.page = ex.pos // 16".replace("select query_id", "select ex.query_id")))
def b2_page_attention(c: Canon) -> DataFrame:
    return by_dim(B.page_attention(c.queries, c.kv, _pages(c), SCALE, DIM, DIM_VALUE))


PAGE_MEANS = f"""{PAGES}, km as (select page, list(x order by d) as k, any_value(n) as n from (select page, d, avg(x) as x, count(*) as n from (select page, unnest(k) as x, generate_subscripts(k, 1) as d from pg) group by 1, 2) group by 1),
pv as (select page, list(x order by d) as v from (select page, d, avg(x) as x from (select page, unnest(v) as x, generate_subscripts(v, 1) as d from pg) group by 1, 2) group by 1)"""
PAGE_HIT = "select ex.query_id, logit, v from ex join bp on bp.query_id = ex.query_id and bp.page = ex.pos // 16"


@query(attention_sql(PAGE_MEANS, f"{PAGE_HIT} union all select query_id, list_inner_product(q, k) * 0.125 + ln(n), v from (select * from q, (select * from km join pv using (page))) anti join bp using (query_id, page)"))
def b3_page_background(c: Canon) -> DataFrame:
    return by_dim(B.page_background(c.queries, c.kv, _pages(c), SCALE, DIM, DIM_VALUE))


@query(attention_sql(PAGE_MEANS, f"{PAGE_HIT} union all select query_id, score * 0.125 + ln(n), v from ps join km using (page) join pv using (page) anti join bp using (query_id, page)"))
def b3_page_upper_bound(c: Canon) -> DataFrame:
    return by_dim(B.page_background(c.queries, c.kv, _pages(c), SCALE, DIM, DIM_VALUE, "upper_bound"))


@query(
    attention_sql(
        PAGES,
        f"{PAGE_HIT} union all select query_id, b.l, b.v from (select query_id, page, arg_min({{'l': logit, 'v': v}}, {{'a': -logit, 'p': pos}}) as b from (select ex.*, pos // 16 as page from ex) group by 1, 2) anti join bp using (query_id, page)",
    )
)
def b4_page_calibrated(c: Canon) -> DataFrame:
    return by_dim(B.page_best_token(c.queries, c.kv, _pages(c), SCALE, DIM, DIM_VALUE))


@query(f"with {WEIGHTS} select query_id, {R6.format('sum(w) filter (chosen)')} as share from wt group by 1")
def b5_selected_mass(c: Canon) -> DataFrame:
    return B.share_of_mass(A.softmax(c.logits())).select("query_id", six("share").alias("share"))


VOTES = f"""{KV}, lq as (select pos as qp, k as q from kv, nn where pos >= n - 8), ll as (select qp, pos, list_inner_product(q, k) * 0.125 as l from lq join kv on pos <= qp),
lw as (select qp, pos, exp(l - max(l) over (partition by qp)) as e from ll), lv as (select pos, sum(w) as vote from (select pos, e / sum(e) over (partition by qp) as w from lw) group by 1),
lp as (select pos, max(vote) over (order by pos rows between 3 preceding and 3 following) as p from lv),
lk as (select pos from (select pos, (pos < 4 or pos >= n - 128) as a, row_number() over (order by case when pos < 4 or pos >= n - 128 then 0 else 1 end, p desc, pos) as r from lp, nn) where a or r <= (select 16 * ceil((132 + ceil(0.1::double * greatest(0, n - 132))) / 16) from nn))"""


def _voted(c: Canon) -> DataFrame:
    n = (c.kv.agg(F.max("pos")).first()[0] or 0) + 1
    late = c.kv.filter(F.col("pos") >= n - 8).select("stream_id", F.col("pos").alias("q_pos"), F.lit(0).alias("q_head"), F.col("key").alias("q"))
    return B.voted(c.kv, late, SCALE, DIM, SINK, LOCAL, B.budget(n, 0.1, SINK, LOCAL))


@query(f"with {VOTES} select pos from lk")
def b6_vote(c: Canon) -> DataFrame:
    return _voted(c).select("pos")


@query(f"with {VOTES}, gn as (select pos // 16 as page, v from kv anti join lk using (pos)) select page, d - 1 as d, count(*) as n, {R6.format('avg(x)')} as value from (select page, unnest(v) as x, generate_subscripts(v, 1) as d from gn) group by 1, 2")
def b7_evicted_pages(c: Canon) -> DataFrame:
    return long(B.evicted_pages(c.kv, _voted(c), DIM, DIM_VALUE).select("page", "n", "value"), ["page", "n"], "value")


ANCHORS, KNN, NEAR, LIST_CAP = 16, 5, 4, 64
ANCHORED = f"""{SCORE}, an as (select pos, k as q from kv, nn where pos >= n - 128 or pos in (select floor(i * greatest((n - 1) / 15.0::double, 1.0) + 0.5)::bigint from range(16) t(i), nn)),
lk as (select * from (select an.pos as anchor, ret.pos, row_number() over (partition by an.pos order by list_inner_product(q, k) desc, ret.pos) as r from an, ret) where r <= {KNN}),
na as (select * from (select query_id, an.pos as anchor, row_number() over (partition by query_id order by list_inner_product(q.q, an.q) desc, an.pos) as r from q, an) where r <= {NEAR}),
i1 as (select pos, any_value(k) as k, (min({{'d': -list_inner_product(k, c), 'l': list_id}})).l as list_id from ret, c0 group by pos),
n1 as (select list_id, list(x order by d) as c from (select list_id, d, avg(x) as x from (select list_id, unnest(k) as x, generate_subscripts(k, 1) as d from i1) group by 1, 2) group by 1),
ic as (select c0.list_id, coalesce(n1.c, c0.c) as c from c0 left join n1 using (list_id)),
i2 as (select pos, (min({{'d': -list_inner_product(k, c), 'l': list_id}})).l as list_id from ret, ic group by pos),
il as (select pos, list_id from (select *, row_number() over (partition by list_id order by pos) as r from i2) where r <= {LIST_CAP} // 2),
ip as (select * from (select query_id, list_id, row_number() over (partition by query_id order by list_inner_product(q, c) desc, list_id) as r from q, ic) where r <= 2),
cn as (select query_id, lk.pos from na join lk using (anchor) union select query_id, il.pos from ip join il using (list_id)),
af as (select query_id, pos from (select query_id, pos, row_number() over (partition by query_id order by logit desc, pos) as r from cn join ex using (query_id, pos)) where r <= 10)"""


def _anchored(c: Canon) -> DataFrame:
    n = (c.kv.agg(F.max("pos")).first()[0] or 0) + 1
    return B.anchors(c.kv.withColumn("n", F.lit(n)), ANCHORS, LOCAL).select(F.col("pos").alias("query_id"), "stream_id", F.col("key").alias("q"))


def _anchored_candidates(c: Canon) -> DataFrame:
    return B.anchored_candidates(c.queries, _anchored(c), c.retrieval.select("stream_id", "pos", "key"), c.first(LISTS), DIM, KNN, NEAR, 2, LIST_CAP, 1 << 20)


@query(f"with {ANCHORED} select distinct pos from lk")
def b8_anchor_neighbours(c: Canon) -> DataFrame:
    return B.nearest_keys(_anchored(c), c.retrieval, KNN, DIM).select("pos").distinct()


@query(f"with {ANCHORED} select query_id, pos from cn")
def b8_candidates(c: Canon) -> DataFrame:
    return _anchored_candidates(c).select("query_id", "pos")


@query(attention_sql(ANCHORED, "select query_id, logit, v from ex where region <> 'retrieval' union all select ex.query_id, logit, v from ex join af using (query_id, pos)"))
def b8_attention(c: Canon) -> DataFrame:
    return by_dim(B.anchored_attention(c.queries, c.regions, stash(_anchored_candidates(c), "candidates"), 10, SCALE, DIM, DIM_VALUE))


TRUE = f"""{PAGE_MEANS}, tl as (select query_id, pos // 16 as page, logit, max(logit) over (partition by query_id, pos // 16) as m from ex),
tr as (select query_id, page, any_value(m) + ln(sum(exp(logit - m)) / count(*)) as t from tl group by 1, 2),
mu as (select query_id, page, list_inner_product(q, k) * 0.125 as mean from q, km),
sh as (select query_id, avg(t - score * 0.125) as shift from tr join ps using (query_id, page) join bp using (query_id, page) group by 1)"""


def page_mode_sql(logit: str, value: str = "v") -> str:
    """logit from t (true), u (bound), mean and shift."""
    rest = f"select query_id, {logit} + ln(n), {value} from (select query_id, page, t, score * 0.125 as u, mean, shift from tr join ps using (query_id, page) join mu using (query_id, page) join sh using (query_id)) join km using (page) join pv using (page) anti join bp using (query_id, page)"
    return attention_sql(TRUE, f"{PAGE_HIT} union all {rest}")


def _page_mode(mode: str, sql: str) -> None:
    def run(c: Canon) -> DataFrame:
        return by_dim(B.page_background(c.queries, c.kv, _pages(c), SCALE, DIM, DIM_VALUE, mode))

    run.__name__ = f"b3_{mode}"
    query(sql)(run)


_page_mode("ub_margin", page_mode_sql("(u - (u - mean) / 2)"))
_page_mode("ub_calibrated", page_mode_sql("(u + shift)"))
_page_mode("alpha_true", page_mode_sql("t"))
_page_mode("trunc_true", page_mode_sql("t", "null::double[]"))


@query(
    attention_sql(
        f"{VOTES}, gk as (select pos // 16 as page, k, v from kv anti join lk using (pos)), gm as (select page, list(x order by d) as k, any_value(n) as n from (select page, d, avg(x) as x, count(*) as n from (select page, unnest(k) as x, generate_subscripts(k, 1) as d from gk) group by 1, 2) group by 1),"
        " gv as (select page, list(x order by d) as v from (select page, d, avg(x) as x from (select page, unnest(v) as x, generate_subscripts(v, 1) as d from gk) group by 1, 2) group by 1)",
        "select query_id, list_inner_product(q, k) * 0.125 as logit, v from q, (select * from kv semi join lk using (pos)) union all select query_id, list_inner_product(q, k) * 0.125 + ln(n), v from q, (select * from gm join gv using (page))",
    )
)
def b7_evicted_background(c: Canon) -> DataFrame:
    return by_dim(B.evicted_background(c.queries, c.kv, stash(_voted(c), "kept"), SCALE, DIM, DIM_VALUE))


def _numbers(x) -> str:
    """Numbers as DuckDB reads them: doubles, not decimals."""
    return "[" + ", ".join(_numbers(y) if hasattr(y, "__len__") else f"{float(y):.17e}" for y in x) + "]"


FINAL = 10
_LEVEL, _EDGE = B.lloyd_max(DIM // PIECES)
_QUANT = "case " + " ".join(f"when abs(u) <= {e:.17e} then {lv:.17e}" for lv, e in zip(_LEVEL, _EDGE)) + f" else {_LEVEL[-1]:.17e} end * case when u >= 0 then 1.0 else -1.0 end"
COLLIDE = f"""{SCORE}, ro as (select {_numbers(V.rotation(DIM, B.TURN_SEED).T)} as t),
zk as (select pos, sqrt(list_inner_product(k, k)) as l, [list_inner_product(u, c) for c in t] as z from (select pos, k, t, [x / greatest(sqrt(list_inner_product(k, k)), 1e-12) for x in k] as u from ret, ro)),
zq as (select query_id, [list_inner_product(u, c) for c in t] as z from (select query_id, t, [x / greatest(sqrt(list_inner_product(q, q)), 1e-12) for x in q] as u from q, ro)),
px as (select query_id, pos, m, round(list_sum([zq.z[m * 8 + i] * case when zk.z[m * 8 + i] >= 0 then 1.0 else -1.0 end for i in range(1, 9)]), 9) as x from zq, zk, range(8) t(m)),
pr_ as (select query_id, pos, row_number() over (partition by query_id, m order by x desc, pos) as r, greatest(1, least(n, ceil({B.RHO}::double * n))) as w from px, (select count(*) as n from ret)),
cs as (select query_id, pos, sum(case {" ".join(f"when r <= least(w, ceil({s}::double * w)) then {g}" for g, s in B.TIERS)} else 0 end)::bigint as score from pr_ group by 1, 2),
cc as (select query_id, pos, score from (select *, row_number() over (partition by query_id order by score desc, pos) as r from cs) where r <= (select greatest({FINAL}, ceil({B.BETA}::double * count(*))) from ret)),
cu as (select query_id, pos, score, l, m, r, [x / greatest(r, 1e-12) for x in zz] as us, zq.z[m * 8 + 1 : m * 8 + 8] as qs
  from (select cc.*, l, m, z[m * 8 + 1 : m * 8 + 8] as zz, sqrt(list_inner_product(z[m * 8 + 1 : m * 8 + 8], z[m * 8 + 1 : m * 8 + 8])) as r from cc join zk using (pos), range(8) t(m)) join zq using (query_id)),
cv as (select *, [x / greatest(sqrt(list_inner_product(vs, vs)), 1e-12) for x in vs] as vh from (select *, [{_QUANT} for u in us]::double[] as vs from cu)),
ce as (select query_id, pos, any_value(score) as score, round(sum(r * list_inner_product(qs, vh) / greatest(list_inner_product(us, vh), 1e-3)) * any_value(l), 9) as est from cv group by 1, 2),
cf as (select query_id, pos, score, rank from (select *, row_number() over (partition by query_id order by est desc, pos) as rank from ce) where rank <= {FINAL})"""


def _collided(c: Canon) -> DataFrame:
    return B.collided(c.queries, c.regions, FINAL, DIM, PIECES)


@query(f"with {COLLIDE} select query_id, pos, score, rank from cf")
def b9_collision(c: Canon) -> DataFrame:
    return _collided(c).select("query_id", "pos", "score", "rank")


@query(f"with {SCORE} select query_id, pos, rank from (select query_id, pos, row_number() over (partition by query_id order by list_inner_product(q, k) desc, pos) as rank from q, ret) where rank <= 10")
def b9_exact_top(c: Canon) -> DataFrame:
    """What the collision selector is measured against."""
    return S.top(blocks.nearest(c.queries, c.retrieval, 10, 1.0, DIM), 10, "logit").select("query_id", "pos", "rank")


@query("select i - 1 as place, round(level[i], 6) as level, round(edge[i], 6) as edge from (select " + _numbers(_LEVEL) + " as level, " + _numbers(_EDGE) + " as edge), range(1, 9) t(i)")
def b10_levels(c: Canon) -> DataFrame:
    """The quantizer's eight levels and seven thresholds; tests hold them against their defining equations."""
    level, edge = B.lloyd_max(DIM // PIECES)
    rows = [(i, float(x), float(edge[i]) if i < len(edge) else None) for i, x in enumerate(level)]
    return c.spark.createDataFrame(rows, "place long, level double, edge double").withColumns({"level": six("level"), "edge": six("edge")})


@query(attention_sql(COLLIDE, "select query_id, logit, v from ex where region <> 'retrieval' union all select ex.query_id, logit, v from ex join cf using (query_id, pos)"))
def b11_attention(c: Canon) -> DataFrame:
    return by_dim(B.selected_attention(c.queries, c.regions, stash(_collided(c), "chosen"), SCALE, DIM, DIM_VALUE))


@query(f"with {COLLIDE} select count(*) as n_records, 0.0::double as skipped_share, {R6.format('avg(132.0 + ' + str(FINAL) + ')')}::double as mean_budget, {R6.format('avg(s / ' + str(sum(w for w, _ in B.TIERS) * PIECES) + ')')}::double as mean_collision_share from (select query_id, avg(score) as s from cf group by 1)")
def b12_stats(c: Canon) -> DataFrame:
    out = B.selector_stats(c.queries, c.regions, stash(_collided(c), "chosen"), PIECES, FINAL)
    return out.select("n_records", *(six(x).alias(x) for x in ("skipped_share", "mean_budget", "mean_collision_share")))


# variants


@query(with_background(f"{WEIGHTS}, {MEANS}, gm as (select d, sum(sx) / sum(n) as x from vm group by 1)", "wt", "select query_id, d, w, x from lm, gm"))
def v3_global_mean(c: Canon) -> DataFrame:
    return by_dim(A.attend(c.logits(), HYBRID, DIM_VALUE, X.global_mean(c.means, DIM_VALUE)))


def const_sql(level: str) -> str:
    return with_background(
        f"{WEIGHTS}, {MEANS}, lv as ({level}), kl as (select query_id, list_id, v, chosen, case when chosen then logit else lev end as logit from lg join lv using (query_id)), km as (select query_id, max(logit) as m from kl group by 1), kw as (select kl.*, exp(logit - m) / sum(exp(logit - m)) over (partition by query_id) as w from kl join km using (query_id))",
        "kw",
        "select query_id, d, w, x from lm join vm using (list_id)",
    )


@query(const_sql("select query_id, avg(score) * 0.125 as lev from tk join sc using (query_id, pos) group by 1"))
def v4_const_mass(c: Canon) -> DataFrame:
    scaled = S.approximate(c.queries, c.index).withColumn("score", F.col("score") * SCALE)
    return by_dim(A.attend(X.constant_mass(c.logits(), scaled, "mean_pq"), HYBRID, DIM_VALUE, c.means))


@query(const_sql("select query_id, min(logit) as lev from tk join ex using (query_id, pos) group by 1"))
def v4_const_min(c: Canon) -> DataFrame:
    return by_dim(A.attend(X.constant_mass(c.logits(), c.logits(), "min_exact"), HYBRID, DIM_VALUE, c.means))


@query(attention_sql(RANKED, "select query_id, logit, v from lg where chosen"))
def v5_truncated(c: Canon) -> DataFrame:
    return by_dim(X.truncated(c.logits(), DIM_VALUE))


@query(
    f"with {WEIGHTS}, lm as (select query_id, list_id, sum(w) as w from wt where not chosen group by 1, 2),"
    " um as (select query_id, list_id, d, avg(x) as x from (select query_id, list_id, unnest(v) as x, generate_subscripts(v, 1) as d from wt where region = 'retrieval' and not chosen) group by 1, 2, 3)"
    f" select query_id, d - 1 as d, {R6.format('sum(w * x)')} as value from lm join um using (query_id, list_id) group by 1, 2"
)
def v6_unselected_mean(c: Canon) -> DataFrame:
    return by_dim(X.unselected_mean(A.softmax(c.logits()), c.means, DIM_VALUE))


@query(f"with {WEIGHTS} select query_id, {R6.format('sum(w) filter (not chosen)')} as share, count(*) filter (not chosen) as n_background from wt group by 1")
def v9_background_share(c: Canon) -> DataFrame:
    return X.background_share(A.softmax(c.logits())).select("query_id", six("share").alias("share"), "n_background")


@query(f"with {WEIGHTS}, b as (select query_id, max(logit) as best, sum(w) as weight from wt where pos in (10, 20, 30) group by 1) select query_id, count(*) filter (logit > best) as rank, {R6.format('any_value(weight)')} as weight from wt join b using (query_id) group by 1")
def v9_needle_rank(c: Canon) -> DataFrame:
    needles = c.spark.createDataFrame([(10,), (20,), (30,)], "pos long")
    return X.needle_rank(A.softmax(c.logits()), needles).select("query_id", "rank", six("weight").alias("weight"))


# evaluation


def _labelled(c: Canon) -> DataFrame:
    return c.table("documents").select("doc_id", "source", "lang", "n_chars").join(c.table("labels"), "doc_id")


@query("with s as (select 'quality' as method, source as task, quality as score from documents join labels using (doc_id) union all select 'toxic', source, toxic from documents join labels using (doc_id)), t as (select method, task, avg(score) as m from s group by 1, 2) select method, round(avg(m), 6) as macro, count(*) as tasks from t group by 1")
def m1_macro_mean(c: Canon) -> DataFrame:
    rows = _labelled(c)
    scores = rows.select(F.lit("quality").alias("method"), F.col("source").alias("task"), F.col("quality").alias("score")).union(rows.select(F.lit("toxic"), "source", "toxic"))
    return M.macro_mean(scores).withColumn("macro", six("macro"))


@query()
def m2_bootstrap(c: Canon) -> DataFrame:
    pairs = _labelled(c).select(F.lit("quality-toxic").alias("label"), F.col("lang").alias("task"), F.col("doc_id").cast("string").alias("_id"), F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    return M.bootstrap(pairs.filter("a is not null and b is not null"))


@query(
    f"with {SCORE}, p as (select query_id, ex.pos, logit as r, score * 0.125 as t from ex join sc using (query_id, pos)),"
    " l as (select *, r - max(r) over w - ln(sum(exp(r)) over w / exp(max(r) over w)) as lr, t - max(t) over w - ln(sum(exp(t)) over w / exp(max(t) over w)) as lt, row_number() over (partition by query_id order by r desc, pos) as pr, row_number() over (partition by query_id order by t desc, pos) as pt from p window w as (partition by query_id)),"
    " s as (select query_id, sum(-lr) filter (pos = 4) as nr, sum(-lt) filter (pos = 4) as nt, sum(exp(lr) * (lr - lt)) as kl, sqrt(sum(pow(r - t, 2))) / greatest(sqrt(sum(pow(r, 2))), 1e-12) as l2, max((pr = 1 and pt = 1)::int) as s, max((pr = 1 and pt <= 10)::int) as i from l group by 1)"
    " select round(avg(nr), 6) as nll_ref, round(avg(nt), 6) as nll_test, round(exp(avg(nt) - avg(nr)), 6) as ppl_ratio, round(avg(kl), 6) as kl, round(avg(l2), 6) as rel_l2, round(avg(s), 6) as top1, round(avg(i), 6) as top1_in_10 from s"
)
def m3_compare(c: Canon) -> DataFrame:
    parts = blocks.compared(c.queries, c.retrieval, S.tables(c.queries, c.index), c.index.codes, INDEX, SCALE, DIM, SINK)
    return M.rounded(M.compare_parts(parts))


@query(
    f"with {PROBE}, et as (select query_id, pos from (select query_id, pos, row_number() over (partition by query_id order by logit desc, pos) as r from ex where region = 'retrieval') where r <= 10)"
    f" select et.query_id, {R6.format('count(ca.pos) / 10')} as recall from et left join (select * from ca where rank <= 10) ca using (query_id, pos) group by 1"
)
def m4_recall(c: Canon) -> DataFrame:
    best = S.top(blocks.nearest(c.queries, c.retrieval, 10, SCALE, DIM), 10, "logit")
    return M.recall(best, S.search(c.queries, c.index, 10, 2)["topk"], 10).select("query_id", six("recall").alias("recall"))


@query("with g as (select event_type, lead(epoch_us(ts)) over (partition by user_id order by epoch_us(ts), event_id) - epoch_us(ts) as gap from events) select event_type, sum(gap)::bigint as total, count(*) as calls from g where gap is not null group by 1")
def m6_spans(c: Canon) -> DataFrame:
    marks = c.table("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return M.spans(marks, "user_id", "event_type", F.col("us"))


@query("select event_type, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std from events group by 1")
def a6_mean_std(c: Canon) -> DataFrame:
    return M.rounded(M.mean_std(c.table("events"), "event_type", "value"))


@query("select event_type, round(quantile_cont(value, 0.025), 6) as low, round(quantile_cont(value, 0.975), 6) as high from events group by 1")
def a7_percentile(c: Canon) -> DataFrame:
    ends = [F.percentile("value", F.lit(p)) for p in (0.025, 0.975)]
    return M.rounded(c.table("events").groupBy("event_type").agg(ends[0].alias("low"), ends[1].alias("high")))


@query("select lang, count(*) as n from documents anti join labels using (doc_id) group by 1")
def j6_resume_antijoin(c: Canon) -> DataFrame:
    named = lambda t: t.withColumn("suite", F.lit("docs")).withColumn("task", F.lit("label")).withColumnRenamed("doc_id", "_id")
    left = logs.remaining(named(c.table("documents").select("doc_id", "lang")), named(c.table("labels").select("doc_id")))
    return left.groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "with a as (select source as task, doc_id as _id, quality as a from documents join labels using (doc_id)), b as (select source as task, doc_id as _id, (n_chars > 2000)::int as b from documents)"
    " select coalesce(a.task, b.task) as task, count(*) filter (a._id is not null and b._id is not null) as n_paired, count(*) filter (b._id is null) as a_only, count(*) filter (a._id is null) as b_only,"
    " round(avg(a - b) filter (a._id is not null and b._id is not null), 6) as diff, count(*) filter (a <> b) as nonzero from a full join b on a.task = b.task and a._id = b._id group by 1"
)
def j7_paired_diff(c: Canon) -> DataFrame:
    a = _labelled(c).select(F.col("source").alias("task"), F.col("doc_id").alias("_id"), F.col("quality").alias("score"))
    b = c.table("documents").select(F.col("source").alias("task"), F.col("doc_id").alias("_id"), (F.col("n_chars") > 2000).cast("int").alias("score"))
    return M.paired_summary(a, b).select("task", "n_paired", "a_only", "b_only", six("diff").alias("diff"), "nonzero")


# text scores


def _turns(c: Canon) -> DataFrame:
    """Each turn with the one that answers it."""
    t = c.table("conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    return t.select("conv_id", "turn", F.col("text").alias("pred")).join(nxt, ["conv_id", "turn"])


TURNS = "tu as (select a.conv_id, a.turn, a.text as pred, b.text as truth from conversations a join conversations b on a.conv_id = b.conv_id and a.turn + 1 = b.turn)"
#: Twice, since neighbours share the character between them.
ARTICLE = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
NORMAL = "trim(regexp_replace(" + ARTICLE.format(ARTICLE.format(r"regexp_replace(lower({}), '[!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g')")).replace("{L}", "{{L}}").replace("{N}", "{{N}}") + r", '\s+', ' ', 'g'))"


@query(f"select conv_id, turn, md5({NORMAL.format('text')}) as normal from conversations")
def e1_normalize(c: Canon) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", F.md5(E.normalize(F.col("text"))).alias("normal"))


@query(
    f"with {TURNS}, n as (select conv_id, turn, list_filter(string_split({NORMAL.format('pred')}, ' '), lambda w: w <> '') as p, list_filter(string_split({NORMAL.format('truth')}, ' '), lambda w: w <> '') as t from tu),"
    " s as (select conv_id, turn, len(p) as np, len(t) as nt, coalesce(list_sum([least(len(list_filter(p, lambda x: x = w)), len(list_filter(t, lambda x: x = w))) for w in list_distinct(p)]), 0)::double as c from n)"
    " select conv_id, turn, round(case when c = 0 then 0 else 2 * (c / greatest(1, np)) * (c / greatest(1, nt)) / (c / greatest(1, np) + c / greatest(1, nt)) end, 6) as f1 from s"
)
def e2_f1(c: Canon) -> DataFrame:
    return _turns(c).select("conv_id", "turn", six(E.f1(F.col("pred"), F.col("truth"))).alias("f1"))


@query()
def e3_rouge_l(c: Canon) -> DataFrame:
    return _turns(c).select("conv_id", "turn", six(E.rouge_l("pred", "truth")).alias("rouge_l"))


@query("with h as (select doc_id, lang, [x for x in ['de', 'en', 'es', 'fr'] if contains(text, x) and not (contains(lang, x) and x <> lang)] as held from documents) select doc_id, round(case when list_contains(held, lang) then 1.0 / len(held) else 0.0 end, 6)::double as score from h")
def e4_classify(c: Canon) -> DataFrame:
    classes = F.array(*map(F.lit, ("de", "en", "es", "fr")))
    return c.table("documents").select("doc_id", six(E.classification(F.col("text"), F.col("lang"), classes)).alias("score"))


@query(r"with r as (select doc_id, regexp_extract_all(text, '(\d+)') as runs from documents) select doc_id, round(case when len(runs) = 0 then 0.0 else len(list_filter(runs, lambda x: x = '555')) / len(runs) end, 6)::double as score from r")
def e5_count(c: Canon) -> DataFrame:
    return c.table("documents").select("doc_id", six(E.count_score(F.col("text"), F.lit("555"))).alias("score"))


@query()
def e6_code_similarity(c: Canon) -> DataFrame:
    return _turns(c).select("conv_id", "turn", six(E.code_similarity(F.col("pred"), F.col("truth"))).alias("score"))


@query(f"with {TURNS} select conv_id, turn, round(len(list_filter(string_split(truth, ' '), lambda a: contains(lower(pred), lower(a)))) / len(string_split(truth, ' ')), 6)::double as score from tu")
def e8_match_all(c: Canon) -> DataFrame:
    return _turns(c).select("conv_id", "turn", six(E.match_all(F.col("pred"), F.split("truth", " "))).alias("score"))


@query(r"select doc_id, case when regexp_extract(text, '(\d+)', 1) = '1' then 1.0 else 0.0 end::double as score, case when regexp_extract(text, '(\d+)', 1) = '' then 0 else 1 end::bigint as has_digits from documents")
def e9_first_int(c: Canon) -> DataFrame:
    text = F.col("text")
    return c.table("documents").select("doc_id", E.first_int(text, F.lit("1")).alias("score"), (F.regexp_extract(text, r"(\d+)", 1) != "").cast("long").alias("has_digits"))


#: Predictions that begin or end in a choice, made of the turns.
SAID = """pr as (select conv_id, turn, case (conv_id + turn) % 6 when 0 then 'B' || text when 1 then 'x, answer is: C ' || text when 2 then 'the answer is (A) ' || text
when 3 then text || ' answer:' when 4 then 'so. D ' || text else text end as pred, ['A', 'B', 'C', 'D', 'AB'][1 + conv_id % 5] as label from conversations)"""


def _said(c: Canon) -> DataFrame:
    k, text = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)), F.col("text")
    pred = F.when(k == 0, F.concat(F.lit("B"), text)).when(k == 1, F.concat(F.lit("x, answer is: C "), text)).when(k == 2, F.concat(F.lit("the answer is (A) "), text))
    pred = pred.when(k == 3, F.concat(text, F.lit(" answer:"))).when(k == 4, F.concat(F.lit("so. D "), text)).otherwise(text)
    label = F.get(F.array(*map(F.lit, ("A", "B", "C", "D", "AB"))), F.pmod("conv_id", F.lit(5)).cast("int"))
    return c.table("conversations").select("conv_id", "turn", pred.alias("pred"), label.alias("label"))


def _phrase_sql(phrase: str) -> str:
    then = f"substr(p, strpos(p, '{phrase}') + {len(phrase)} + 1, 1)"
    return f"when strpos(p, '{phrase}') > 0 then {then} <> '' and contains(label, {then})"


BLANKS = " " * 9


def _blanked(text: str, colon: str = "") -> str:
    """Punctuation that counts as blanks, for DuckDB."""
    return f"""translate({text}, chr(10) || '{colon}"' || chr(39) || '.,?!{{}}', '{BLANKS}{" " * len(colon)}')"""


@query(
    f"with {SAID}, cl as (select *, regexp_replace({_blanked('pred')}, ' {{2,}}', ' ', 'g') as p from pr),"
    f" sc as (select conv_id, turn, case when pred <> '' and contains('ABCD', pred[1]) then pred[1] = label {' '.join(map(_phrase_sql, E.PHRASES))}"
    r" else coalesce(list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '' and contains('ABCD', w))[1] = label, false) end as hit from cl) select conv_id, turn, case when hit then 1.0 else 0.0 end::double as score from sc"
)
def e9_choice(c: Canon) -> DataFrame:
    return _said(c).select("conv_id", "turn", E.choice_score(F.col("pred"), F.col("label")).alias("score"))


@query(
    "with p as (select conv_id, turn, text, string_split(text, ' ')[3] as label from conversations) select conv_id, turn, case when list_contains(regexp_split_to_array("
    + _blanked("text", ":")
    + r", '\s+'), label) then 1.0 else 0.0 end::double as score from p"
)
def e9_kv(c: Canon) -> DataFrame:
    text = F.col("text")
    return c.table("conversations").select("conv_id", "turn", E.kv_score(text, F.get(F.split(text, " "), F.lit(2))).alias("score"))


@query(
    r"with p as (select doc_id, regexp_extract(text, '\d+\.\d+|\d+') as x, ['555', '3.5', '1', '10.0'][1 + doc_id % 4] as label from documents)"
    " select doc_id, case when x = '' then 0.0 when contains(label, '.') then (try_cast(x as double) = try_cast(label as double))::int::double when contains(x, '.') then 0.0 else coalesce((try_cast(x as bigint) = try_cast(label as bigint))::int::double, 0.0) end as score from p"
)
def e9_math(c: Canon) -> DataFrame:
    label = F.get(F.array(*map(F.lit, ("555", "3.5", "1", "10.0"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    return c.table("documents").select("doc_id", E.math_score(F.col("text"), label).alias("score"))


@query(
    f"with {TURNS}, k as (select *, string_split(truth, ' ') as answers, (conv_id % 3)::int as k from tu),"
    r" s as (select conv_id, turn, k, len(list_filter(answers, lambda a: contains(lower(pred), lower(a)))) / len(answers) as every, list_bool_or([contains(lower(pred), lower(a)) for a in answers]) as hit,"
    r" list_max([case when len(regexp_extract_all(pred, '(\d+)')) = 0 then 0.0 else len(list_filter(regexp_extract_all(pred, '(\d+)'), lambda x: x = a)) / len(regexp_extract_all(pred, '(\d+)')) end for a in answers]) as n from k)"
    " select conv_id, turn, round(case k when 0 then every when 1 then n else case when hit then 1.0 else 0.0 end end, 6)::double as score from s where k < 2 or hit"
)
def e7_by_task(c: Canon) -> DataFrame:
    """Tasks by conversation; of those scored in part, the turns that hold an answer (the others are e2_f1's)."""
    rows = _turns(c).withColumn("task", F.get(F.array(*map(F.lit, ("match_all", "count", "match_part"))), F.pmod("conv_id", F.lit(3)).cast("int")))
    rows = rows.withColumn("answers", F.split("truth", " "))
    some = F.exists("answers", lambda a: F.lower("pred").contains(F.lower(a)))
    return rows.filter((F.col("task") != "match_part") | some).select("conv_id", "turn", six(E.by_task(F.col("task"), F.col("pred"), F.col("answers"))).alias("score"))


@query("select conv_id, turn, md5(ltrim(list_last(string_split(text, '</think>')))) as rest from conversations")
def e10_strip_think(c: Canon) -> DataFrame:
    return c.table("conversations").select("conv_id", "turn", F.md5(E.without_thought(F.col("text"))).alias("rest"))


# task generation, windows, corpus


@query("with t as (select doc_id, string_split(text, ' ') as w from documents) select doc_id, len(w) as n, md5(array_to_string(case when len(w) <= 65 then w else list_concat(w[1:32], w[len(w) - 32:]) end, ' ')) as cut from t")
def g8_truncate(c: Canon) -> DataFrame:
    w = F.split("text", " ")
    return c.table("documents").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.concat_ws(" ", E.middle_cut(w, 65))).alias("cut"))


@query("with t as (select doc_id, string_split(text, ' ') as w from documents) select doc_id, s::bigint as start, md5(array_to_string(w[s + 1 : s + 16], ' ')) as piece from t, (select unnest([0, 16, 48]) as s) where len(w) >= 64")
def g10_windows(c: Canon) -> DataFrame:
    """Of documents that all three windows fit in: a window that reaches beyond the tokens is an error, which a test looks at."""
    rows = c.table("documents").select("doc_id", F.split("text", " ").alias("w")).filter(F.size("w") >= 64)
    return G.windows(rows, "w", [0, 16, 48], 16).select("doc_id", F.col("start").cast("long").alias("start"), F.md5(F.concat_ws(" ", "window")).alias("piece"))


@query("select p::bigint as nprobe, f::double as fraction, 'nprobe' || p || '-fraction' || f as name from (select unnest([16, 32, 64]) as p), (select unnest(['0.01', '0.02']) as f)")
def g11_grid(c: Canon) -> DataFrame:
    rows = G.grid({"nprobe": [16, 32, 64], "fraction": [0.01, 0.02]})
    return c.spark.createDataFrame([(r["nprobe"], r["fraction"], r["name"]) for r in rows], "nprobe long, fraction double, name string")


@query()
def g1_samples(c: Canon) -> DataFrame:
    ids = c.table("benchmark").select(F.col("item_id").alias("id"))
    made = None
    for kind in G.KINDS:
        one = G.samples(ids, kind, 300)
        made = made.union(one) if made else one
    return made


@query(r"with f as (select doc_id, text from documents where trim(text) <> '' order by doc_id limit 50), t as (select list_filter(regexp_split_to_array(string_agg(text, chr(10) || chr(10) order by doc_id), '\s+'), lambda x: x <> '') as w from f) select md5(array_to_string(w[1:5000], ' ')) as head, len(w) >= 5000 as enough from t")
def s10_corpus(c: Canon) -> DataFrame:
    """The first 50 texts as one list of 5000 tokens: the limits are the operator."""
    out = logs.corpus(c.table("documents").select("doc_id", "text"), 50, 5000)
    return out.select(F.md5(F.concat_ws(" ", "tokens")).alias("head"), "enough")


@query("with l as (select lang as _id, source as task, quality as score, doc_id from documents join labels using (doc_id)), r as (select *, row_number() over (partition by task, _id order by doc_id desc) as r, count(*) over (partition by task, _id) - 1 as repeats from l) select task, _id, score::bigint as score, repeats from r where r = 1")
def s11_last_wins(c: Canon) -> DataFrame:
    rows = _labelled(c).select(F.col("lang").alias("_id"), F.col("source").alias("task"), F.col("quality").cast("long").alias("score"), "doc_id")
    return logs.last_wins(rows, [F.desc("doc_id")]).select("task", "_id", "score", "repeats")


@query(f"with {KV}, bt as (select pos // 16 as logical, (pos // 16) * 7 % (select max(pos) // 16 + 1 from kv) as physical, pos % 16 as slot, pos, k from kv) select pos, {R6.format('k[1]')} as key_0 from bt where pos >= 100 and pos < 300")
def s6_paged_range(c: Canon) -> DataFrame:
    """Positions 100 to 299 of a sequence kept in blocks of 16: the range is the operator."""
    from vexil.sources import paged

    block = F.floor(F.col("pos") / 16).cast("long")
    table = c.kv.select(F.col("stream_id").alias("seq_id"), block.alias("logical_block"), F.xxhash64(block).alias("physical_block")).distinct()
    blocks = c.kv.select(F.xxhash64(block).alias("physical_block"), F.pmod("pos", F.lit(16)).alias("slot"), "key", "value")
    return paged.gather(table, blocks, 16, 100, 300).select("pos", six(F.get("key", F.lit(0))).alias("key_0"))


@query(f"with {KV} select pos, {R6.format('k[1]')} as key_0, {R6.format('v[8]')} as value_7 from kv where pos % 100 = 0")
def s2_rows_at(c: Canon) -> DataFrame:
    from vexil.sources import paged

    out = paged.rows_at(c.kv, c.queries.select("stream_id", F.col("query_id").alias("pos")))
    return out.select("pos", six(F.get("key", F.lit(0))).alias("key_0"), six(F.get("value", F.lit(7))).alias("value_7"))


@query(f"with {RANKED}, s as (select query_id, list_sort(list(pos)) as m from rk where rank <= 10 group by 1), p as (select query_id, m, lag(m) over (order by query_id) as b from s) select query_id as step, {R6.format('len(list_intersect(m, b)) / len(list_distinct(list_concat(m, b)))')} as jaccard from p where b is not null")
def u3_jaccard(c: Canon) -> DataFrame:
    best = S.top(S.approximate(c.queries, c.index), 10)
    sets = best.groupBy("query_id").agg(F.collect_list("pos").alias("members")).select(F.lit(0).alias("stream_id"), F.col("query_id").alias("step"), "members")
    return M.jaccard_steps(sets).select("step", six("jaccard").alias("jaccard"))


# registers the queries of upkeep, layout and selection in the same tables
from vexil.plans import upkeep  # noqa: E402, F401
