"""More registered queries: layout of heads, packed scans, other ways to the same top-k, upkeep of lists and indexes, appended sequences, files, and task parts."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.functions import vectors as V
from vexil.operators import attention as A
from vexil.operators import ivf
from vexil.operators import kmeans as K
from vexil.operators import search as S
from vexil.operators import selectors as B
from vexil.plans import evalstats as M
from vexil.plans import taskgen as G
from vexil.plans.canon import DIM, DIM_VALUE, HYBRID, INDEX, LISTS, LOCAL, PIECES, SCALE, SINK, Canon
from vexil.plans.registry import CANDIDATE, COARSE, KV, MEANS, PQ, PROBE, R6, RANKED, SCORE, _numbers, attention_sql, by_dim, combined, long, query, six
from vexil.sources import logs, paged, snapshot
from vexil.sources.shared import fresh_path, stash
from vexil.streaming import append as R

# scalars and layout

TURN8 = V.rotation(DIM_VALUE, 3)
OUT = np.arange(3 * DIM_VALUE, dtype=float).reshape(3, DIM_VALUE) / 10


@query(f"with {KV}, r as (select {_numbers(TURN8.T)} as t) select pos, d - 1 as d, {R6.format('x')} as value from (select pos, unnest(z) as x, generate_subscripts(z, 1) as d from (select pos, [list_inner_product(v, c) for c in t] as z from kv, r))")
def p3_rotate(c: Canon) -> DataFrame:
    return long(c.kv.select("pos", V.rotate(F.col("value"), TURN8).alias("z")), ["pos"], "z")


@query(f"with {KV} select pos, d - 1 as d, {R6.format('x')} as value from (select pos, unnest(v) as x, generate_subscripts(v, 1) as d from kv)")
def p3_rotate_back(c: Canon) -> DataFrame:
    """There and back: the value itself."""
    return long(c.kv.select("pos", V.rotate(V.rotate(F.col("value"), TURN8), TURN8.T).alias("z")), ["pos"], "z")


@query(f"with {KV}, w as (select {_numbers(OUT)} as w) select pos, d - 1 as d, {R6.format('x')} as value from (select pos, unnest(z) as x, generate_subscripts(z, 1) as d from (select pos, [list_inner_product(v, c) + 0.5 for c in w] as z from kv, w))")
def p19_linear(c: Canon) -> DataFrame:
    return long(c.kv.select("pos", V.linear(F.col("value"), OUT, np.full(3, 0.5)).alias("z")), ["pos"], "z")


@query(f"with {SCORE} select query_id, pos, {R6.format('score * (1 + pos % 3) * 2')} as score from sc")
def p14_norm_scale(c: Canon) -> DataFrame:
    """Directions as they are, keys of lengths 1 to 3, queries of length 2."""
    codes = c.index.codes.withColumn("key_norm", (1 + F.pmod("pos", F.lit(3))).cast("double"))
    index = replace(c.index, config=replace(INDEX, direction_normalize=True), codes=codes)
    long_queries = c.queries.withColumn("q", F.transform("q", lambda x: 2 * x))
    return S.approximate(long_queries, index).select("query_id", "pos", six("score").alias("score"))


@query(f"with {KV}, r as (select row_number() over (order by pos) - 1 as local, pos from ret) select local, pos from r")
def p17_global(c: Canon) -> DataFrame:
    """Retrieval rows by their place in the region and in the whole sequence."""
    local = c.retrieval.select((F.col("pos") - SINK).alias("local"))
    return paged.global_positions(local.withColumn("pos", F.col("local")), SINK, 1 << 40).select("local", "pos")


@query(f"with {KV} select pos, h as head, d - 1 as d, {R6.format('x')} as value from (select pos, h, unnest(z) as x, generate_subscripts(z, 1) as d from (select pos, h, k[h * 16 + 1 : h * 16 + 16] as z from kv, range(4) t(h)))")
def p18_split_heads(c: Canon) -> DataFrame:
    parts = A.split_heads(c.kv.select("pos", F.col("key").alias("z")), "z", 4, 16)
    return long(parts.select("pos", F.col("head").cast("long").alias("head"), "z"), ["pos", "head"], "z")


@query(f"with {KV} select pos, d - 1 as d, {R6.format('x')} as value from (select pos, unnest(k) as x, generate_subscripts(k, 1) as d from kv)")
def p18_merge_heads(c: Canon) -> DataFrame:
    """Split and merged again."""
    parts = A.split_heads(c.kv.select("pos", F.col("key").alias("z")), "z", 4, 16)
    return long(A.merge_heads(parts, ["pos"], "z"), ["pos"], "z")


@query(f"with {KV} select pos, {R6.format('x')} as x from (select pos, case pos % 5 when 0 then null when 1 then 'nan'::double when 2 then 'inf'::double else k[1] end as x from kv) where pos % 5 > 2")
def p22_finite(c: Canon) -> DataFrame:
    k = F.pmod("pos", F.lit(5))
    bad = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(float("nan"))).when(k == 2, F.lit(float("inf"))).otherwise(F.get("key", F.lit(0)))
    return c.kv.select("pos", bad.alias("x")).filter(V.finite(F.col("x"))).withColumn("x", six("x"))


@query(f"with {SCORE} select query_id, pos, {R6.format('score')} as score from sc")
def p12_packed_scan(c: Canon) -> DataFrame:
    return S.packed_scan(c.queries, c.index, ivf.packed(c.index)).select("query_id", "pos", six("score").alias("score"))


@query(f"with {SCORE} select query_id, pos, {R6.format('score')} as score from sc")
def p21_pair_lut(c: Canon) -> DataFrame:
    return S.packed_scan(c.queries, c.index, ivf.packed(c.index), pairs=True).select("query_id", "pos", six("score").alias("score"))


# other ways to the same rows


@query(f"with {RANKED} select query_id, pos, rank, {R6.format('score')} as score from rk where rank <= 10")
def t11_block_merge(c: Canon) -> DataFrame:
    return S.block_top(S.approximate(c.queries, c.index), 10, 64).select("query_id", "pos", "rank", six("score").alias("score"))


@query(f"with {RANKED} select query_id, pos, rank, {R6.format('score')} as score from rk where rank <= 10")
def t12_histogram(c: Canon) -> DataFrame:
    return S.histogram_top(S.approximate(c.queries, c.index), 10).select("query_id", "pos", "rank", six("score").alias("score"))


@query(f"with {PROBE} select query_id, pos, rank, {R6.format('score')} as score from ca where rank <= 10")
def t7_probed_topk(c: Canon) -> DataFrame:
    return S.probed_top(S.approximate(c.queries, c.index), S.probes(c.queries, c.index, 2), 10).select("query_id", "pos", "rank", six("score").alias("score"))


@query(
    f"with {KV}, a as (select pos, [label, (label * 3) % 10, label, 7, (label + 1) % 10]::bigint[] as a from kv)"
    " select pos, array_to_string([a[i] for i in range(1, 6) if not list_contains(a[1 : i - 1], a[i])], ',') as firsts,"
    " array_to_string([x for x in a if x not in (3, 8)], ',') as rest, array_to_string([coalesce(list_position(a, n), 0) - 1 for n in [7, 2, 0]], ',') as places from a"
)
def t15_sets(c: Canon) -> DataFrame:
    label = F.col("label").cast("long")
    a = F.array(label, F.pmod(label * 3, F.lit(10)), label, F.lit(7).cast("long"), F.pmod(label + 1, F.lit(10)))
    numbers = lambda *xs: F.array(*(F.lit(x).cast("long") for x in xs))
    said = lambda x: F.concat_ws(",", x.cast("array<string>"))
    return c.kv.select("pos", said(F.array_distinct(a)).alias("firsts"), said(V.difference(a, numbers(3, 8))).alias("rest"), said(V.positions(a, numbers(7, 2, 0))).alias("places"))


@query(f"with {CANDIDATE}, cm as (select query_id, max(logit) as m from cl where chosen group by 1), cw as (select cl.*, exp(logit - m) / sum(exp(logit - m)) over (partition by query_id) as w from cl join cm using (query_id) where chosen) {combined('cw')}")
def v1_probed_truncation(c: Canon) -> DataFrame:
    """Softmax over sink, local and the best of the probed lists; a budget beyond them changes nothing."""
    cfg = replace(HYBRID, mode="sparse", value_mode="denominator", topk_source="ivf_candidates", candidate_budget=4096)
    return by_dim(A.attend(c.logits(cfg), cfg, DIM_VALUE))


ONE = SCORE + ", rk as (select *, row_number() over (partition by query_id order by score desc, pos) as rank from sc)"


@query(attention_sql(ONE, "select query_id, logit, v from ex where region <> 'retrieval' union all select ex.query_id, logit, v from ex join rk using (query_id, pos) where rank = 1"))
def v7_single_row(c: Canon) -> DataFrame:
    """A fraction of a millionth still chooses one row."""
    cfg = replace(HYBRID, mode="sparse", value_mode="denominator", top_fraction=1e-6)
    return by_dim(A.attend(c.logits(cfg), cfg, DIM_VALUE))


@query(attention_sql(SCORE, "select query_id, logit, v from ex where region <> 'retrieval'"))
def h14_no_retrieval(c: Canon) -> DataFrame:
    """Nothing indexed: sink and local rows alone."""
    nothing = replace(c.index, codes=c.index.codes.filter("pos < 0"))
    kv = c.regions.filter("region <> 'retrieval'")
    return by_dim(A.attend(A.hybrid_logits(c.queries, kv, nothing, HYBRID, DIM), replace(HYBRID, value_mode="denominator"), DIM_VALUE))


HEADS = """hk as (select vec_id // 10 as pos, label::bigint as head, label // 2 as stream, embedding::double[] as k, (embedding::double[])[1:8] as v from embeddings),
hq as (select vec_id as query_id, label::bigint as head, label // 2 as stream, embedding::double[] as q from embeddings where vec_id % 100 < 10)"""


@query(attention_sql(HEADS, "select query_id, list_inner_product(q, k) * 0.125 as logit, v from hq join hk using (stream)"))
def h13_heads(c: Canon) -> DataFrame:
    """Ten query heads in groups of two over five key/value heads, all in one plan: a query meets its own head's rows only."""
    kv = A.head_queries(c.kv.withColumn("q_head", F.col("label")), 2)
    asked = c.kv.filter("pos % 100 < 10").select(F.col("pos").alias("query_id"), F.col("label").alias("q_head"), F.col("key").alias("q"))
    return by_dim(A.dense(A.head_queries(asked, 2).select("query_id", "stream_id", "q"), kv.select("stream_id", "pos", "key", "value"), SCALE, DIM, DIM_VALUE))


@query(
    f"with {KV}, hz as (select query_id, pos, h, list_inner_product(q[h * 16 + 1 : h * 16 + 16], k[h * 16 + 1 : h * 16 + 16]) * 0.25 as l, v[h * 2 + 1 : h * 2 + 2] as v from q, kv, range(4) t(h)),"
    " hm as (select query_id, h, max(l) as m from hz group by 1, 2), hw as (select hz.*, exp(l - m) / sum(exp(l - m)) over (partition by query_id, h) as w from hz join hm using (query_id, h))"
    f" select query_id, h * 2 + d - 1 as d, {R6.format('sum(w * x)')} as value from (select query_id, h, w, unnest(v) as x, generate_subscripts(v, 1) as d from hw) group by 1, 2"
)
def h17_multihead(c: Canon) -> DataFrame:
    """Keys, values and queries split in four heads, each attended by itself, and merged: the wrapper's plan."""
    kv = A.split_heads(c.kv.select("pos", F.col("key").alias("z")), "z", 4, 16).select("pos", F.col("head").cast("long").alias("stream_id"), F.col("z").alias("key"))
    values = A.split_heads(c.kv.select("pos", F.col("value").alias("z")), "z", 4, 2).select("pos", F.col("head").cast("long").alias("stream_id"), F.col("z").alias("value"))
    asked = A.split_heads(c.queries.select("query_id", F.col("q").alias("z")), "z", 4, 16).select((F.col("query_id") * 4 + F.col("head")).alias("query_id"), F.col("head").cast("long").alias("stream_id"), F.col("z").alias("q"))
    out = A.dense(asked, kv.join(values, ["stream_id", "pos"]), 0.25, 16, 2)
    one = out.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "value"))), lambda e: e["value"]).alias("z"))
    heads = one.select(F.floor(F.col("query_id") / 4).cast("long").alias("query_id"), F.pmod("query_id", F.lit(4)).alias("head"), "z")
    return long(A.merge_heads(heads, ["query_id"], "z"), ["query_id"], "z")


@query(
    f"with {KV}, lq as (select pos as query_id, k as q from kv, nn where pos >= n - 6), zz as (select query_id, list_inner_product(q, k) * 0.125 as logit, v from lq join kv on pos <= query_id),"
    f" zm as (select query_id, max(logit) as m from zz group by 1), zw as (select zz.*, exp(logit - m) / sum(exp(logit - m)) over (partition by query_id) as w from zz join zm using (query_id)) {combined('zw')}"
)
def r10_causal(c: Canon) -> DataFrame:
    """The last six rows as a speculative step: query j sees rows up to its own."""
    n = (c.kv.agg(F.max("pos")).first()[0] or 0) + 1
    late = c.kv.filter(F.col("pos") >= n - 6).select(F.col("pos").alias("query_id"), "stream_id", F.col("key").alias("q"))
    return by_dim(A.combine(A.softmax(R.causal(A.exact(late, c.kv, SCALE, DIM), F.col("query_id"))), DIM_VALUE))


# lists and indexes


@query(f"with {COARSE} select list_id, pos, row_number() over (order by list_id, pos) - 1 as place from a2")
def k14_merge(c: Canon) -> DataFrame:
    """Lists of the even and of the odd positions, merged."""
    parts = [K.inverted(c.assigned.filter(F.pmod("pos", F.lit(2)) == r), LISTS) for r in (0, 1)]
    flat = K.merged(*parts).select("list_id", "first", F.posexplode("members").alias("i", "pos"))
    return flat.select(F.col("list_id").cast("long").alias("list_id"), "pos", (F.col("first") + F.col("i")).cast("long").alias("place"))


@query(f"with {COARSE}, {MEANS} select list_id, d - 1 as d, n, {R6.format('x')} as value from vm")
def k15_merge(c: Canon) -> DataFrame:
    """Value sums of the even and of the odd positions, merged."""
    parts = [K.value_means(c.assigned.filter(F.pmod("pos", F.lit(2)) == r), DIM_VALUE) for r in (0, 1)]
    out = K.merge_value_means(*parts, DIM_VALUE)
    return long(out.select(F.col("list_id").cast("long").alias("list_id"), "n", "v_mean"), ["list_id", "n"], "v_mean")


def _codes(codes: DataFrame) -> DataFrame:
    return codes.select("pos", F.col("list_id").cast("long").alias("list_id"), F.posexplode("codes").alias("m", "code")).select("pos", "list_id", F.col("m").cast("long").alias("m"), F.col("code").cast("long").alias("code"))


CODES = f"with {PQ} select pos, list_id, m, code::bigint as code from cd join a2 using (pos)"


@query(CODES)
def k7_build(c: Canon) -> DataFrame:
    """The whole build at once, from given centroids and words: lists, residuals, codebooks, codes."""
    words = ivf.subvectors(c.residual.filter((F.col("pos") >= SINK) & (F.col("pos") < SINK + INDEX.words)), INDEX, DIM)
    words = words.select("stream_id", "m", (F.col("pos") - SINK).cast("int").alias("list_id"), F.col("v").alias("centroid"))
    return _codes(ivf.build(c.retrieval, INDEX, DIM, c.first(LISTS), stash(words, "words"), refill=False).codes)


@query(CODES)
def k8_given_codebooks(c: Canon) -> DataFrame:
    """Centroids and codebooks given without a stream: they serve every stream."""
    built = ivf.build_with_codebooks(c.retrieval, INDEX, DIM, c.index.coarse.drop("stream_id"), c.index.codebook.drop("stream_id"))
    return _codes(built.codes)


@query(CODES)
def s7_snapshot(c: Canon) -> DataFrame:
    """Saved, loaded with the same settings."""
    path = fresh_path(c.spark, "snapshot")
    snapshot.save(c.index, path)
    return _codes(snapshot.load(c.spark, path, INDEX).codes)


# appended sequences


def _stream(c: Canon, upto: int, **cfg) -> R.Stream:
    """The canonical index on the positions below `upto`, as the state of one request."""
    rows = c.kv.filter(F.col("pos") < upto).select("stream_id", "pos", "key", "value")
    end = max(SINK, upto - LOCAL)
    index = replace(c.index, codes=stash(c.index.codes.filter(F.col("pos") < end), "codes"))
    return R.Stream(INDEX, replace(HYBRID, **cfg), DIM, stash(rows, "rows"), upto, index, upto)


def _length(c: Canon) -> int:
    return (c.kv.agg(F.max("pos")).first()[0] or -1) + 1


def _state(c: Canon, s: R.Stream, name: str) -> DataFrame:
    """One row of numbers, and how many rows and codes the tables hold."""
    k = s.counters
    row = (name, s.length, s.indexed_length, s.pending, k.rebuilds, k.adds, k.online_updates, k.refreshes, k.deferred, s.rows.count(), s.index.codes.count())
    return c.spark.createDataFrame([row], "name string, length long, indexed_length long, pending long, rebuilds long, adds long, online_updates long, refreshes long, deferred long, n_rows long, n_codes long")


NUMBERS = "name, length, indexed_length, pending, rebuilds, adds, online_updates, refreshes, deferred, n_rows, n_codes"


def numbers_sql(*rows: str) -> str:
    values = ", ".join(f"({r})" for r in rows)
    return f"with {KV}, t as (select x.* from nn, lateral (values {values}) x({NUMBERS})) select name, {', '.join(f'{c}::bigint as {c}' for c in NUMBERS.split(', ')[1:])} from t"


@query(numbers_sql("'incremental', n, n - 8, 8, 0, 2, 0, 2, 0, n, n - 8 - 132", "'deferred', n, n - 40, 40, 0, 0, 0, 0, 1, n, n - 40 - 132", "'applied', n, n, 0, 0, 0, 1, 1, 1, n, n - 132"))
def r2_strategies(c: Canon) -> DataFrame:
    """Forty rows in five appends, refreshed when sixteen are pending: at once, deferred, and deferred work done at the end."""
    n = _length(c)
    out = None
    for strategy in ("incremental", "deferred"):
        s = _stream(c, n - 40, strategy=strategy, update_interval=16)
        for i in range(5):
            at = n - 40 + 8 * i
            s.append(c.kv.filter((F.col("pos") >= at) & (F.col("pos") < at + 8)), 8)
        out = _state(c, s, strategy) if out is None else out.union(_state(c, s, strategy))
    s.apply_pending()
    return out.union(_state(c, s, "applied"))


@query(CODES)
def r1_append_stream(c: Canon) -> DataFrame:
    """Codes after the last forty rows were appended one batch at a time: those of an index that had them from the beginning, since centroids and words stay."""
    n = _length(c)
    s = _stream(c, n - 40, strategy="incremental", update_interval=8)
    for i in range(5):
        at = n - 40 + 8 * i
        s.append(c.kv.filter((F.col("pos") >= at) & (F.col("pos") < at + 8)), 8)
    return _codes(s.index.codes)


@query(numbers_sql("'many', n, n - 8, 8, 0, 0, 2, 2, 2, n, n - 8 - 132"))
def r7_append_many(c: Canon) -> DataFrame:
    """Rewound by ten, fifty rows written from there in chunks of twenty-one, flushed between chunks only."""
    n = _length(c)
    s = _stream(c, n - 40, strategy="deferred", update_interval=16)
    start = n - 50
    s.append_many(c.kv.filter(F.col("pos") >= start), start, 50, 21)
    return _state(c, s, "many")


@query(numbers_sql("'restored', n - 40, n - 40, 0, 0, 0, 0, 0, 0, n - 40, n - 40 - 132"))
def r8_restore(c: Canon) -> DataFrame:
    n = _length(c)
    s = _stream(c, n - 40, strategy="incremental", update_interval=8)
    saved = s.checkpoint()
    s.append(c.kv.filter(F.col("pos") >= n - 40), 40)
    s.restore(saved)
    return _state(c, s, "restored")


@query(numbers_sql("'extended', n, n, 0, 0, 0, 1, 1, 1, n, n - 132"))
def r9_extend(c: Canon) -> DataFrame:
    """A stored prefix grown to the whole sequence, from its last row on, by one flush."""
    n = _length(c)
    saved = _stream(c, n - 40, strategy="deferred", update_interval=16).checkpoint()
    s = saved.checkpoint()
    s.extend_prefix(saved, c.kv.filter(F.col("pos") >= n - 41), n)
    return _state(c, s, "extended")


@query(attention_sql(SCORE, "select query_id, logit, v from ex"))
def r6_decode_step(c: Canon) -> DataFrame:
    """The last row appended, then attended to with all others; nothing is indexed, so all rows are exact."""
    n = _length(c)
    rows = c.kv.filter(F.col("pos") < n - 1).select("stream_id", "pos", "key", "value")
    s = R.Stream(INDEX, replace(HYBRID, local=1 << 30, update_interval=1 << 30), DIM, rows, n - 1, None, n - 1)
    return by_dim(s.decode_step(c.kv.filter(F.col("pos") == n - 1), c.queries, DIM_VALUE))


@query("with e as (select user_id::bigint as request_id, list(event_id order by event_id) as ids from events group by 1), p as (select request_id, l as length, md5(array_to_string(ids[1:l], ',')) as digest, request_id * 10 + l as prefix_id from e, (select unnest([1, 2, 3]) as l) where len(ids) >= l and request_id % 2 = 0), m as (select e.request_id, p.prefix_id, p.length from e join p on len(ids) >= length and md5(array_to_string(ids[1:length], ',')) = digest) select request_id, prefix_id, length::int as length from (select *, row_number() over (partition by request_id order by length desc, prefix_id) as r from m) where r = 1")
def j10_prefix(c: Canon) -> DataFrame:
    """The events of a user as ids; prefixes of every second user are stored."""
    ids = c.table("events").groupBy(F.col("user_id").cast("long").alias("request_id")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    ids = stash(ids, "ids")
    stored = ids.filter("request_id % 2 = 0").select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("length")).filter(F.size("ids") >= F.col("length"))
    stored = stored.select((F.col("request_id") * 10 + F.col("length")).alias("prefix_id"), "length", R.prefix_digest(F.col("ids"), F.col("length")).alias("digest"))
    return R.prefix_matches(stored, ids)


STATES = "st as (select distinct user_id::bigint as request_id, (user_id % 40)::bigint as length from events where user_id % 7 > 0), sp as (select event_id % 50 as step, user_id::bigint as request_id, case when event_id % 31 = 0 then 2 else 1 end as rows from events where event_id < 200)"


@query(f"with {STATES} select step::bigint as step, case when max((length is null)::int) = 1 then 'missing_id' when max((rows <> 1)::int) = 1 then 'not_one_row' when max((length < 5)::int) = 1 then 'too_short' else 'admitted' end as verdict from sp left join st using (request_id) group by 1")
def r11_verdicts(c: Canon) -> DataFrame:
    e = c.table("events")
    user = F.col("user_id").cast("long")
    states = e.filter("user_id % 7 > 0").select(user.alias("request_id"), F.pmod(user, F.lit(40)).alias("length")).distinct()
    steps = e.filter("event_id < 200").select(F.pmod(F.col("event_id"), F.lit(50)).cast("long").alias("step"), user.alias("request_id"), F.when(F.pmod(F.col("event_id"), F.lit(31)) == 0, 2).otherwise(1).alias("rows"))
    return R.verdicts(steps, states, 5)


@query(f"with {STATES} select request_id, length from st semi join sp using (request_id)")
def r11_live(c: Canon) -> DataFrame:
    e = c.table("events")
    user = F.col("user_id").cast("long")
    states = e.filter("user_id % 7 > 0").select(user.alias("request_id"), F.pmod(user, F.lit(40)).alias("length")).distinct()
    return R.live_states(states, e.filter("event_id < 200").select(user.alias("request_id")))


@query(f"with {KV}, t as (select pos, case when pos % 6 = 0 then null else pos % 20 end as known, label as len, pos % 3 = 0 as ok from kv) select pos, case when known is null then 'rebuild' when len = known + 1 then 'append' when len <= known then 'restore' when ok then 'extend' else 'rebuild' end as action from t")
def r13_actions(c: Canon) -> DataFrame:
    known = F.when(F.pmod("pos", F.lit(6)) == 0, F.lit(None)).otherwise(F.pmod("pos", F.lit(20)))
    return c.kv.select("pos", R.action(known, F.col("label"), F.pmod("pos", F.lit(3)) == 0).alias("action"))


# selectors, tasks, files, evaluation


@query(f"with {KV} select pos, (16 * ceil((132 + ceil(0.02::double * greatest(0, pos - 132))) / 16))::bigint as tokens from kv")
def b1_budget(c: Canon) -> DataFrame:
    return c.kv.select("pos", B.budget_of(F.col("pos"), 0.02, SINK, LOCAL).alias("tokens"))


@query("select item_id, [x for x in range(1, 2000) if 7 * x + 3 <= b][-1]::bigint as words from (select item_id, 20 + length(text) as b from benchmark where 20 + length(text) < 14000)")
def g5_largest_fit(c: Canon) -> DataFrame:
    """The most words whose size, 7 a word and 3, is within a budget; halving is done on a column, all rows at once."""
    rows = c.table("benchmark").select("item_id", (20 + F.length("text")).alias("b")).filter("b < 14000")
    return rows.select("item_id", G.largest_fit(lambda n: 7 * n + 3, F.col("b"), 1, 1999).cast("long").alias("words"))


HAY = [w for _ in range(40) for w in G.FILLER.split()]


@query(
    f"with h as (select ({HAY!r}::varchar[])[1:193] as hay), a as (select hay, max(i) as cut from h, range(1, 97) t(i) where hay[i][-1] = '.' group by hay)"
    " select item_id, md5(array_to_string(list_concat(hay[1:cut], list_concat(string_split('The pass key is ' || (10000 + item_id) || '. Remember it.', ' '), hay[cut + 1 : len(hay)])), ' ')) as prompt from benchmark, a"
)
def g6_passkey(c: Canon) -> DataFrame:
    """Two hundred words exactly, the needle at the sentence end nearest below the middle."""
    key = (F.col("item_id") + 10000).cast("string")
    return c.table("benchmark").select("item_id", F.md5(G.passkey_prompt(200, 0.5, key)).alias("prompt"))


SUITES = [(k, t) for k, t in G.TEMPLATES.items()]


def _template_sql(template: str) -> str:
    out, rest = [], template
    names = {"context": "text", "input": "'item ' || item_id", "a": "'one'", "b": "'two'", "c": "'three'", "d": "'four'"}
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += ["'" + head.replace("'", "''") + "'", names[name]]
    return " || ".join([*out, "'" + rest.replace("'", "''") + "'"])


@query(" union all ".join(f"select item_id, '{k}' as suite, md5({_template_sql(t)}) as prompt from benchmark" for k, t in SUITES))
def g7_prompts(c: Canon) -> DataFrame:
    parts = {"context": F.col("text"), "input": F.concat(F.lit("item "), F.col("item_id").cast("string")), **{k: F.lit(v) for k, v in (("a", "one"), ("b", "two"), ("c", "three"), ("d", "four"))}}
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("suite"), F.md5(G.prompt(k, **parts)).alias("prompt")) for k, _ in SUITES))).alias("p")
    return c.table("benchmark").select("item_id", named).select("item_id", "p.*")


@query(f"with {KV}, o as (select pos, ['red', 'green', 'blue', 'grey'] as o, ['blue', 'black', 'red', 'grey', 'green'][1 + label % 5] as a from kv) select pos, case when list_contains(o, a) then substr('ABCD', list_position(o, a), 1) end as letter from o")
def g7_letters(c: Canon) -> DataFrame:
    options = F.array(*map(F.lit, ("red", "green", "blue", "grey")))
    answer = F.get(F.array(*map(F.lit, ("blue", "black", "red", "grey", "green"))), F.pmod("label", F.lit(5)).cast("int"))
    return c.kv.select("pos", G.letter(options, answer).alias("letter"))


@query("with w as (select doc_id, string_split(text, ' ') as w from documents), r as (select doc_id, len(w) as n, flatten([w for i in range(0, 1 + 100 // greatest(1, len(w)))])[1:100] as z from w) select doc_id, len(z)::bigint as n, md5(array_to_string(z, ' ')) as filled from r")
def g9_fill(c: Canon) -> DataFrame:
    z = G.filled(F.split("text", " "), 100)
    return c.table("documents").select("doc_id", F.size(z).cast("long").alias("n"), F.md5(F.concat_ws(" ", z)).alias("filled"))


@query("select item_id, md5(text) as text from benchmark order by item_id limit 25")
def s9_first_rows(c: Canon) -> DataFrame:
    """Line-wise JSON, blank lines between, the first 25 rows in file order: the limit is the operator."""
    path = fresh_path(c.spark, "lines")
    rows = c.table("benchmark").orderBy("item_id").select(F.to_json(F.struct("item_id", "text")).alias("value"))
    rows.coalesce(1).select(F.explode(F.array(F.col("value"), F.lit("  "))).alias("value")).write.text(path)
    schema = c.table("benchmark").select("item_id", "text").schema
    return logs.first_rows(c.spark, path, schema, 25).select("item_id", F.md5("text").alias("text"))


LONG = "select item_id::varchar as _id, 'single_qa' as dataset, 'en' as language, text as context, 'What is said in ' || item_id || '?' as input, [substr(text, 1, 5), substr(text, 1, 9)] as answers, null as all_classes from benchmark"


@query(f"with l as ({LONG}) select _id, dataset, md5(context) as context, input, array_to_string(answers, '|') as answers, length(context)::bigint as length from l")
def s8_long_rows(c: Canon) -> DataFrame:
    """Rows as the long-context sets have them, written and read back by their schema."""
    path = fresh_path(c.spark, "long")
    text = F.col("text")
    rows = c.table("benchmark").select(
        F.col("item_id").cast("string").alias("_id"), F.lit("single_qa").alias("dataset"), F.lit("en").alias("language"), text.alias("context"),
        F.concat(F.lit("What is said in "), F.col("item_id").cast("string"), F.lit("?")).alias("input"), F.array(F.substring(text, 1, 5), F.substring(text, 1, 9)).alias("answers"), F.length(text).alias("length"),
    )
    rows.write.json(path)
    back = logs.long_rows(c.spark, path)
    return back.select("_id", "dataset", F.md5("context").alias("context"), "input", F.concat_ws("|", "answers").alias("answers"), "length")


@query("select event_type, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def s13_reports(c: Canon) -> DataFrame:
    """A report written as CSV with a header and as JSON, both read back, and equal."""
    report = M.rounded(c.table("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))
    path = fresh_path(c.spark, "report")
    logs.write_csv(report, f"{path}/csv")
    logs.write_report(report, f"{path}/json")
    csv = c.spark.read.option("header", True).schema(report.schema).csv(f"{path}/csv")
    return csv.join(c.spark.read.schema(report.schema).json(f"{path}/json"), report.columns, "left_semi")


@query("select event_type as name, round(sum(value), 6) as total, count(distinct user_id % 3) as ranks from events where value is not null and user_id % 3 >= 0 group by 1")
def s14_rank_stats(c: Canon) -> DataFrame:
    """Three ranks' numbers, each an object in a file of its own, read as one table."""
    path = fresh_path(c.spark, "ranks")
    per = c.table("events").filter("value is not null").groupBy(F.pmod("user_id", F.lit(3)).alias("rank"), "event_type").agg(F.sum("value").alias("x"))
    objects = per.groupBy("rank").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "x"))))).alias("value"))
    logs.dump_rank_stats(objects, path)
    return logs.rank_stats(c.spark, path).select("name", F.round("total", 6).alias("total"), "ranks")


@query(f"with {KV}, t as (select label, label <> 3 as ok, avg(k[1]) as a from kv group by 1, 2) select count(*) as n, bool_and(ok and 0.5 - 0.5 >= -0.05) as passed from t")
def m7_gate(c: Canon) -> DataFrame:
    rows = c.kv.groupBy("label").agg(F.avg(F.get("key", F.lit(0))).alias("a")).select((F.col("label") != 3).alias("ref_hit"), F.lit(True).alias("test_hit"), F.lit(0.5).alias("ref_score"), F.lit(0.5).alias("test_score"), F.lit(0.95).alias("span_top1"))
    return M.gate(rows)


RUNS = "r as (select event_type as name, event_id as step, value as ref_ms, case when event_type = 'view' then 0.0 else value / 2 end as test_ms, (event_id % 7) / 10.0::double as ref_nll, (event_id % 5) / 10.0::double as test_nll, (event_id % 3) / 100.0::double as kl, (event_id % 2)::double as top1, 1 as n_tokens from events)"


@query(
    f"with {RUNS}, s as (select name, count(*) as steps, sum(n_tokens)::bigint as n_tokens, sum(ref_ms) as ref_ms, sum(test_ms) as test_ms, avg(ref_ms) as ref_ms_mean, avg(test_ms) as test_ms_mean, coalesce(stddev_samp(test_ms), 0) as test_ms_std, avg(ref_nll) as ref_nll, avg(test_nll) as test_nll, avg(kl) as kl_mean, max(kl) as kl_max, avg(top1) as top1 from r group by 1)"
    " select name, steps, n_tokens, round(ref_ms, 4) as ref_ms, round(test_ms, 4) as test_ms, round(ref_ms_mean, 6) as ref_ms_mean, round(test_ms_mean, 6) as test_ms_mean, round(test_ms_std, 6) as test_ms_std, round(ref_nll, 6) as ref_nll, round(test_nll, 6) as test_nll, round(kl_mean, 6) as kl_mean, round(kl_max, 6) as kl_max, round(top1, 6) as top1,"
    " round(exp(ref_nll), 6) as ref_ppl, round(exp(test_nll), 6) as test_ppl, round(test_nll - ref_nll, 6) as nll_delta, round(exp(test_nll) - exp(ref_nll), 6) as ppl_delta, round(exp(test_nll) / exp(ref_nll), 6) as ppl_ratio,"
    " case when test_ms = 0 then 'inf'::double else round(ref_ms / test_ms, 6) end as speedup, round(test_ms / ref_ms, 6) as slowdown, round(1000.0::double * n_tokens / ref_ms, 6) as ref_tokens_a_second, case when test_ms = 0 then 'inf'::double else round(1000.0::double * n_tokens / test_ms, 6) end as test_tokens_a_second from s"
)
def m5_summary(c: Canon) -> DataFrame:
    e, step = c.table("events"), F.col("event_id")
    part = lambda n, by: F.pmod(step, F.lit(n)) / F.lit(by)
    runs = e.select(
        F.col("event_type").alias("name"), step.alias("step"), F.col("value").alias("ref_ms"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value") / 2).alias("test_ms"),
        part(7, 10.0).alias("ref_nll"), part(5, 10.0).alias("test_nll"), part(3, 100.0).alias("kl"), part(2, 1.0).alias("top1"), F.lit(1).alias("n_tokens"),
    )
    out = M.rounded(M.summary(runs))
    return out.withColumns({x: F.round(x, 4) for x in ("ref_ms", "test_ms")})
