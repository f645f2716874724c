"""Queries of texts with several lines, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.operators import segments as S
from cuewright.plans.registry import IGNORED, SQL, flat, query, read

SIGNIFICANT = f"translate({{}}, {IGNORED}, '')"


def lines_sql(source: str, out: str) -> str:
    """CTEs that merge segments (v, a, b, x: lines), a run's lines tracked by the best
    matching of each step: a matching is extended line by line and left when it costs
    more than the plain one, line i to line i."""
    key = SIGNIFICANT.format("t")
    return f""", {out}1 as (select *, row_number() over (partition by v order by a, b, array_to_string(x, chr(10))) as k, list_filter(list_transform(x, lambda t: {key}), lambda t: t <> '') as f from {source}),
{out}2 as (select c.v, c.k, p.f as g, c.f, len(c.f) as n, cast(len(p.f) as bigint) as m from {out}1 c join {out}1 p on p.v = c.v and p.k = c.k - 1),
{out}3 as (select v, k, n, i, j, cast(cast(length(g[i]) + length(f[j]) - levenshtein(g[i], f[j]) as float) / cast(length(g[i]) + length(f[j]) as float) as float) as r from {out}2, range(1, n + 1) t(i), range(1, n + 1) u(j) where n = m and n > 0),
{out}4 as (select *, cast(trunc(cast((1::float - r) * 1000::float as float)) as int) as c, r >= 0.8::float as ok from {out}3),
{out}5 as (select v, k, n, sum(c) filter (where i = j) as bound from (select *, bool_or(ok) over (partition by v, k, i) as hope from {out}4) group by 1, 2, 3 having bool_and(hope)),
{out}6(v, k, n, i, cost, bound, p, ok) as (select v, k, n, cast(0 as bigint), cast(0 as hugeint), cast(bound as hugeint), []::bigint[], true from {out}5 union all
  select s.v, s.k, s.n, s.i + 1, s.cost + e.c, s.bound, list_append(s.p, e.j), s.ok and e.ok from {out}6 s join {out}4 e on e.v = s.v and e.k = s.k and e.i = s.i + 1 where not list_contains(s.p, e.j) and s.cost + e.c <= s.bound),
{out}7 as (select v, k, first(p order by cost, p) as p, first(ok order by cost, p) as ok from {out}6 where i = n group by 1, 2),
{out}8 as (select v, k, []::bigint[] as p from {out}2 where n = 0 and m = 0 union all select v, k, p from {out}7 where ok),
{out}9 as (select s.*, t.p as step, sum(case when t.p is null then 1 else 0 end) over (partition by s.v order by s.k rows unbounded preceding) as run from {out}1 s left join {out}8 t on t.v = s.v and t.k = s.k),
{out}10(v, run, k, place) as (select v, run, k, range(1, len(x) + 1) from {out}9 where step is null union all
  select c.v, c.run, c.k, list_transform(r.place, lambda q: coalesce(c.step[q], q)) from {out}10 r join {out}9 c on c.v = r.v and c.run = r.run and c.k = r.k + 1),
{out}11 as (select r.v, r.run, i, s.x[r.place[i]] as t, sum(s.b - s.a) as d from {out}10 r join {out}9 s on s.v = r.v and s.k = r.k, range(1, len(r.place) + 1) u(i) where s.x[r.place[i]] is not null group by 1, 2, 3, 4),
{out}12 as (select v, run, i, case when max(d) > 0 then first(t order by d desc, t) else '' end as t from {out}11 group by 1, 2, 3),
{out}13 as (select v, run, list(t order by i) as x from {out}12 group by 1, 2),
{out} as (select s.v, cast(min(s.a) as bigint) as a, cast(max(s.b) as bigint) as b, coalesce(first(w.x), []::varchar[]) as x from {out}9 s left join {out}13 w on w.v = s.v and w.run = s.run group by s.v, s.run)"""


def segments_sql(source: str) -> str:
    """CTEs of the segments s of a table of events (v, t, x)."""
    return f"ev as (select * from {source}), a as (select v, t, x from ev union all select v, max(t) + 60000, []::varchar[] from ev group by v), s0 as (select v, t as a, lead(t) over (partition by v order by t, array_to_string(x, chr(10))) as b, x from a), s as (select v, a, b, x from s0 where b is not null union all select v, 0, min(t), []::varchar[] from a group by v)"


LINED = f"(select conv_id as v, turn * 1000 as t, list_filter(string_split(text, chr(10)), lambda t: {SIGNIFICANT.format('t')} <> '') as x from conversations)"
OUT = " select v as video_id, a as start_ms, b as end_ms, array_to_string(x, chr(10)) as text from "
SQL["multi_line_segments"] = "with recursive " + segments_sql(LINED) + lines_sql("s", "m") + ", l as (select v, a, b, x from m where b - a > 100)" + lines_sql("l", "z") + OUT + "z"

SWAPPED = "(select doc_id // 6 as v, doc_id % 6 * 1000 as t, case doc_id % 3 when 0 then [w1, w2, w3] when 1 then [w3 || 's', w1, w2] else [w2, w1 || '!', w3 || 's'] end as x from (select doc_id, min(g) filter (where k = 1) as w1, min(g) filter (where k = 2) as w2, min(g) filter (where k = 3) as w3 from (select d.doc_id, k, f.p_name || ' ' || k as g from documents d join part f on f.p_partkey = d.doc_id // 6 % 50 + 1, range(1, 4) t(k)) group by 1))"


@query("with recursive " + segments_sql(SWAPPED) + lines_sql("s", "m") + OUT + "m")
def swapped_lines(spark, sf):
    """Three lines that change their places and a letter from event to event."""
    part = read(spark, sf, "part").where("p_partkey <= 50").select((F.col("p_partkey") - 1).alias("p"), "p_name")
    docs = read(spark, sf, "documents").select("doc_id").withColumn("p", F.floor(F.col("doc_id") / 6) % 50)
    w = [F.concat("p_name", F.lit(f" {k}")) for k in (1, 2, 3)]
    kind = F.col("doc_id") % 3
    said = F.when(kind == 0, F.array(*w)).when(kind == 1, F.array(F.concat(w[2], F.lit("s")), w[0], w[1])).otherwise(F.array(w[1], F.concat(w[0], F.lit("!")), F.concat(w[2], F.lit("s"))))
    events = docs.join(part, "p").select(F.floor(F.col("doc_id") / 6).alias("video_id"), (F.col("doc_id") % 6 * 1000).alias("time_ms"), said.alias("texts"))
    return flat(S.merge(S.segments(S.with_end(events))))
