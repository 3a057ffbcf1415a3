"""Ordered funnels counted by filling: attempts and candidate rows in one order, native operations only.

Each step unions the open attempts with the rows that may end them, sorts by client and time descending, and fills the next
row of each kind downwards with the last value that isn't null.  Tags order ties: an attempt comes before the rows of its own
microsecond, so it sees later rows only.

One client may hold any share of the rows, so the fill runs over slices of a minute.  What an attempt needs from beyond its
minute are the first rows of each kind in the following ones: they are aggregated once for each minute (map-side first), filled
over the minutes of an hour and the next, and enter each slice as candidate rows beyond its end.  So no task gets a client whole: a group
has the rows of one client and minute, or at most 120 minutes' summaries.

Percentiles are selected exactly in two levels: counts in bins of about a second give the bin that holds the wanted value, then
the distinct values of that bin alone (2 ** 20 at most) are ranked.

Defined cases: rows with a null client, kind or time don't count; repeated rows are one; a client without a first-step row
isn't in the result; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import persist

MINUTE = 60_000_000
#: Microseconds between two steps at most: an hour.  Slices are filled from this and the next hour, so it is also the most that the fill covers.
WITHIN = 60 * MINUTE
#: Times from step to step are binned by their bits above these.
LOW_BITS = 20
PERCENT = 90


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, ...]
    without: str


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)


def _micros(clicks: DataFrame) -> Column:
    if clicks.schema["ts"].dataType.typeName() == "timestamp":
        return F.unix_micros("ts")
    # from the parts of the wall-clock time: a difference of times would go by the session's zone, in which an hour may be missing
    seconds = F.unix_date(F.col("ts").cast("date")).cast("long") * 86_400 + F.hour("ts") * 3_600 + F.minute("ts") * 60
    return seconds * 1_000_000 + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")


#: Rows travel as client_id, minute (its number), off (microseconds from the minute's start) and code: the number of a kind, or
#: for an attempt one less than none, and so on, by the number of its funnel.  Attempts so come before the rows of their own microsecond.
ROW = ("client_id", "minute", "off", "code")


def _placed(us: Column) -> tuple[Column, Column]:
    off = F.pmod(us, F.lit(MINUTE))
    return F.floor((us - off) / MINUTE).alias("minute"), off.alias("off")


def _time() -> Column:
    return F.col("minute") * MINUTE + F.col("off")


def _attempt(number: int | Column) -> Column:
    return F.lit(-1) - number


def _carried(rows: DataFrame, codes: Sequence[int]) -> DataFrame:
    """For each client and minute with rows, the first row of each kind in the minutes after it, as a row of that minute (whose ``off`` lies beyond it)."""
    own = rows.groupBy("client_id", "minute").agg(*[F.min(F.when(F.col("code") == k, F.col("off"))).alias(f"own{k}") for k in codes])
    hour = F.floor(F.col("minute") / 60)
    twice = own.withColumn("hour", F.explode(F.array(hour, hour - 1)))
    later = Window.partitionBy("client_id", "hour").orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    first = [F.last(F.col("minute") * MINUTE + F.col(f"own{k}"), ignorenulls=True).over(later) for k in codes]
    filled = twice.select("client_id", "hour", "minute", *[f.alias(f"next{k}") for k, f in zip(codes, first, strict=True)]).where(F.col("hour") == hour)
    each = F.array(*[F.struct((F.col(f"next{k}") - F.col("minute") * MINUTE).alias("off"), F.lit(k).alias("code")) for k in codes])
    return filled.select("client_id", "minute", F.inline(F.filter(each, lambda x: x["off"] < MINUTE + WITHIN)))  # null and farther ones end no attempt of this minute


def _stepped(attempts: DataFrame, rows: DataFrame, carried: DataFrame, step: int, funnels: Sequence[Funnel], kinds: Sequence[str]) -> DataFrame:
    """funnel, client_id, us, d: the attempts (funnel, client_id, us) that reach their next step, at its time and ``d`` after the one before."""
    wanted, without = ({i: kinds.index(k) for i, k in enumerate(x)} for x in ([f.steps[step] for f in funnels], [f.without for f in funnels]))
    codes = sorted({*wanted.values(), *without.values()})
    number = F.coalesce(*[F.when(F.col("funnel") == f.name, i) for i, f in enumerate(funnels)])
    tried = attempts.select("client_id", *_placed(F.col("us")), _attempt(number).alias("code"))
    may = rows.unionByName(carried).where(F.col("code").isin(codes)).select(*ROW)
    order = Window.partitionBy("client_id", "minute").orderBy(F.desc("off"), "code").rowsBetween(Window.unboundedPreceding, 0)
    following = {k: F.last(F.when(F.col("code") == k, F.col("off")), ignorenulls=True).over(order) for k in codes}
    filled = tried.unionAll(may).select(*ROW, *[f.alias(f"next{k}") for k, f in following.items()]).where("code < 0")

    def of(kind: dict[int, int]) -> Column:
        return F.coalesce(*[F.when(F.col("code") == _attempt(i), F.col(f"next{k}")) for i, k in kind.items()])

    name = F.element_at(F.array(*[F.lit(f.name) for f in funnels]), -F.col("code"))
    found = filled.select(name.alias("funnel"), "client_id", "minute", "off", of(wanted).alias("to"), of(without).alias("stop"))
    reached = (F.col("to") - F.col("off") <= WITHIN) & (F.col("stop").isNull() | (F.col("stop") > F.col("to")))
    return found.where(reached).select("funnel", "client_id", (F.col("minute") * MINUTE + F.col("to")).alias("us"), (F.col("to") - F.col("off")).alias("d"))


def _percentiles(times: DataFrame, keys: Sequence[str], percent: int) -> DataFrame:
    """keys, value: the ceil(percent * n / 100)-th smallest ``d`` of each group of ``keys``."""
    counted = times.withColumn("bin", F.shiftright("d", LOW_BITS)).repartition(*keys, "bin").groupBy(*keys, "bin", "d").agg(F.count(F.lit(1)).alias("c"))
    ranked = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "bin").orderBy("d")))
    bins = times.groupBy(*keys, F.shiftright("d", LOW_BITS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    placed = bins.withColumns({"upto": upto, "k": F.floor((F.lit(percent) * total + 99) / 100)})
    target = placed.where("k <= upto and k > upto - n").select(*keys, "bin", (F.col("k") - F.col("upto") + F.col("n")).alias("at"))
    return ranked.join(target, [*keys, "bin"]).where("at <= upto and at > upto - c").select(*keys, F.col("d").alias("value"))


def count_funnels(clicks: DataFrame, funnels: Sequence[Funnel] = FUNNELS, percent: int = PERCENT) -> DataFrame:
    """funnel, client_id, n1 ..., deepest, t2 ..., same_depth of clicks (client_id, kind, ts); see the module."""
    depth = {len(f.steps) for f in funnels}
    if len(depth) != 1:
        raise ValueError("funnels of one call have the same number of steps")
    steps = depth.pop()
    kinds = sorted({k for f in funnels for k in (*f.steps, f.without)})
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    rows = clicks.where(F.col("client_id").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(kinds)).select("client_id", *_placed(_micros(clicks)), code.alias("code"))
    carried = persist(_carried(rows, range(len(kinds))), "funnel-minutes")
    starts = F.filter(F.array(*[F.when(F.col("code") == kinds.index(f.steps[0]), F.lit(f.name)) for f in funnels]), lambda x: x.isNotNull())
    # repeated rows change no fill, so the attempts alone are made distinct
    first = rows.where(F.col("code").isin([kinds.index(f.steps[0]) for f in funnels])).distinct().select(F.explode(starts).alias("funnel"), "client_id", _time().alias("us"))
    attempts = persist(first.withColumn("d", F.lit(None).cast("long")), "funnel-step1")
    reached = [attempts.withColumn("step", F.lit(1))]
    for step in range(1, steps):
        attempts = persist(_stepped(attempts.select("funnel", "client_id", "us"), rows, carried, step, funnels, kinds), f"funnel-step{step + 1}")
        reached.append(attempts.withColumn("step", F.lit(step + 1)))
    every = reached[0]
    for part in reached[1:]:
        every = every.unionByName(part)
    own = ["funnel", "client_id"]
    counts = every.groupBy(*own).agg(*[F.count_if(F.col("step") == s).alias(f"n{s}") for s in range(1, steps + 1)], F.max("step").alias("deepest"))
    values = _percentiles(every.where("step > 1").select(*own, "step", "d"), [*own, "step"], percent)
    wide = values.groupBy(*own).agg(*[F.max(F.when(F.col("step") == s, F.col("value"))).alias(f"t{s}") for s in range(2, steps + 1)])
    out = persist(counts.join(wide, own, "left"), "funnel-counts")
    alike = out.groupBy("funnel", "deepest").agg(F.count(F.lit(1)).alias("same_depth"))
    # alike: a row for each funnel and depth, whatever the input
    return out.join(F.broadcast(alike), ["funnel", "deepest"]).select(
        *own, *[f"n{s}" for s in range(1, steps + 1)], "deepest", *[f"t{s}" for s in range(2, steps + 1)], "same_depth")


def oracle(funnels: Sequence[Funnel] = FUNNELS, percent: int = PERCENT) -> str:
    """The same rows in SQL."""
    steps = len(funnels[0].steps)
    rows = "SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL"
    ctes, parts = [f"r AS MATERIALIZED ({rows})"], []
    for f in funnels:
        p = f.name.lower()
        ctes.append(f"{p}1 AS (SELECT client_id, ts, NULL::BIGINT AS d FROM r WHERE kind = '{f.steps[0]}')")
        parts.append(f"SELECT '{f.name}' AS funnel, client_id, 1 AS step, d FROM {p}1")
        for s in range(2, steps + 1):
            ctes.append(f"""{p}{s} AS (SELECT client_id, nts AS ts, epoch_us(nts) - epoch_us(ts) AS d FROM (
SELECT a.client_id, a.ts, c.ts AS nts, x.ts AS xts FROM {p}{s - 1} a ASOF JOIN (SELECT client_id, ts FROM r WHERE kind = '{f.steps[s - 1]}') c ON a.client_id = c.client_id AND a.ts < c.ts
ASOF LEFT JOIN (SELECT client_id, ts FROM r WHERE kind = '{f.without}') x ON a.client_id = x.client_id AND a.ts < x.ts)
WHERE epoch_us(nts) - epoch_us(ts) <= {WITHIN} AND (xts IS NULL OR xts > nts))""")
            parts.append(f"SELECT '{f.name}', client_id, {s}, d FROM {p}{s}")
    ns = ", ".join(f"count(*) FILTER (WHERE step = {s}) AS n{s}" for s in range(1, steps + 1))
    ds = ", ".join(f"list_sort(list(d) FILTER (WHERE step = {s})) AS l{s}" for s in range(2, steps + 1))
    ts = ", ".join(f"l{s}[({percent} * n{s} + 99) // 100] AS t{s}" for s in range(2, steps + 1))
    columns = ", ".join(f"n{s}" for s in range(1, steps + 1))
    return f"""WITH {', '.join(ctes)}, every AS ({' UNION ALL '.join(parts)}),
g AS (SELECT funnel, client_id, {ns}, CAST(max(step) AS INTEGER) AS deepest, {ds} FROM every GROUP BY funnel, client_id)
SELECT funnel, client_id, {columns}, deepest, {ts}, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g"""
