"""Analysis of queue logs and of benchmark results."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from tallyward.sources.store import kept_table

LIFETIME, DEVIATION_ALPHA = 10.0, 0.1
PAUSE_ABOVE, RESUME_BELOW = 10_000, 1_000
#: Rows of a queue beyond which it is dealt over ranges of time, ranges of one queue at most, and rows of a side that is broadcast.
HOT_ROWS, MOST_RANGES, MOST_BROADCAST = 2_000_000, 4096, 200_000
#: Rows of a group's segment that are ranked, and least and greatest number of cells that a larger one is counted by: sixteen for each MOST_RANKED rows in it.
MOST_RANKED, LEAST_CELLS, CELLS = 20_000, 16, 1024


@dataclass
class Dealt:
    """Rows of queues, those of long queues dealt over ranges of time: hash partitions of (queue, _range) hold HOT_ROWS rows or so.

    A window over a queue becomes one over (queue, _range), and the first and last rows of ranges carry over what lies beyond the range's edge.
    Rows of one moment stay together. few: whether a row a range of the long queues may be broadcast.
    """

    rows: DataFrame
    queue: str
    order: tuple[str, ...]
    hot: bool = False
    few: bool = True

    def window(self):
        return Window.partitionBy(self.queue, *(["_range"] if self.hot else [])).orderBy(*self.order)

    def with_rows(self, rows: DataFrame) -> Dealt:
        return replace(self, rows=rows)

    def _edges(self, *aggregates: Column) -> DataFrame:
        return self.rows.filter("_range IS NOT NULL").groupBy(self.queue, "_range").agg(*aggregates)

    def _joined(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        """rows with the columns of edges, which is a row a range of a long queue."""
        side = edges.withColumnsRenamed({self.queue: "_edge_queue", "_range": "_edge_range"})
        same = F.col(self.queue).eqNullSafe(F.col("_edge_queue")) & (F.col("_range") == F.col("_edge_range"))
        return rows.join(F.broadcast(side) if self.few else side, same, "left").drop("_edge_queue", "_edge_range")

    def neighbours(self, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None) -> Dealt:
        """Adds values of the row before and of the row after, by name; null where there is none."""
        before, after, w = before or {}, after or {}, self.window()
        out = self.rows.select("*", *(F.lag(c).over(w).alias(n) for n, c in before.items()), *(F.lead(c).over(w).alias(n) for n, c in after.items()), *([F.lag(F.lit(1)).over(w).alias("_inner"), F.lead(F.lit(1)).over(w).alias("_going")] if self.hot else []))
        if not self.hot:
            return self.with_rows(out)
        key, ranges = F.struct(*self.order), Window.partitionBy(self.queue).orderBy("_range")
        ends = self._edges(F.max_by(F.struct(F.lit(1).alias("_one"), *(c.alias(n) for n, c in before.items())), key).alias("_last"), F.min_by(F.struct(F.lit(1).alias("_one"), *(c.alias(n) for n, c in after.items())), key).alias("_first"))
        ends = ends.select(self.queue, "_range", F.lag("_last").over(ranges).alias("_carried"), F.lead("_first").over(ranges).alias("_coming"))
        out = self._joined(out, ends)
        values = {n: F.when(F.col("_inner").isNull(), F.col(f"_carried.{n}")).otherwise(F.col(n)) for n in before} | {n: F.when(F.col("_going").isNull(), F.col(f"_coming.{n}")).otherwise(F.col(n)) for n in after}
        return self.with_rows(out.withColumns(values).drop("_inner", "_going", "_carried", "_coming"))

    def last_known(self, name: str, value: Column) -> Dealt:
        """Adds the last value that isn't null up to and with the row."""
        out = self.rows.withColumn(name, F.last(value, ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, 0)))
        if not self.hot:
            return self.with_rows(out)
        ranges = Window.partitionBy(self.queue).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        ends = self._edges(F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))).alias("_own")).select(self.queue, "_range", F.last("_own", ignorenulls=True).over(ranges).alias("_carried"))
        return self.with_rows(self._joined(out, ends).withColumn(name, F.coalesce(name, "_carried")).drop("_carried"))

    def plain(self, *names: str) -> DataFrame:
        return self.rows.drop("_range", *names)


def deal(rows: DataFrame, queue: str, order: tuple[str, ...], hot_rows: int | None = None) -> Dealt:
    """Counts the queues (sums of tasks meet); where the longest has more than hot_rows (HOT_ROWS) rows, those with so many are cut at quantiles of time.

    The cuts are stored, so that all uses of a row's range agree. Rows of other queues have a null range.
    """
    hot_rows = hot_rows or HOT_ROWS
    counts = rows.groupBy(queue).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    most = counts.agg(F.max("_n").alias("n"), F.count("*").alias("queues")).first()
    if not most.n:
        return Dealt(rows, queue, order)
    ranges = min(MOST_RANGES, -(-most.n // hot_rows))
    long = counts.select(F.col(queue).alias("_long"))
    few = most.queues <= MOST_BROADCAST
    of_long = rows.select(queue, order[0]).join(F.broadcast(long) if few else long, F.col(queue).eqNullSafe(F.col("_long")))
    cuts = kept_table(of_long.groupBy(queue).agg(F.percentile_approx(order[0], [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts")), "queue-cuts").withColumnRenamed(queue, "_long")
    few = most.queues * ranges <= MOST_BROADCAST
    joined = rows.join(F.broadcast(cuts) if few else cuts, F.col(queue).eqNullSafe(F.col("_long")), "left")
    time = F.col(order[0])
    # null times come first; cuts are sorted, so their number below a time is its range
    at = F.when(F.col("_cuts").isNotNull(), F.coalesce(F.size(F.filter("_cuts", lambda c: c < time)), F.lit(0)))
    return Dealt(joined.withColumn("_range", at).drop("_cuts", "_long"), queue, order, True, few)


def pair_snapshots(records: DataFrame, *, log: str = "log_id", order: tuple[str, ...] = ("ts", "event_id"), observed: Column, scheduled: Column, hot_rows: int | None = None) -> DataFrame:
    """Observations with the next scheduling record of their log: the first observation after a scheduling record counts, later ones until the next are passed over. order_* of both."""
    kept = records.withColumn("_kind", F.when(observed, "O").when(scheduled, "S")).filter("_kind IS NOT NULL")
    marked = deal(kept, log, order, hot_rows).neighbours(before={"_before": F.col("_kind")})
    start = (F.col("_kind") == "O") & F.coalesce(F.col("_before") != "O", F.lit(True))
    end = (F.col("_kind") == "S") & F.coalesce(F.col("_before") == "O", F.lit(False))
    ends = marked.with_rows(marked.rows.withColumns({"_start": start, "_end": end}).filter("_start OR _end"))
    nexts = ends.neighbours(after={f"scheduled_{c}": F.col(c) for c in order})
    return nexts.with_rows(nexts.rows.filter(F.col("_start") & F.col(f"scheduled_{order[0]}").isNotNull())).plain("_kind", "_before", "_start", "_end")


def queue_consumption(probes: DataFrame, *, queue: str = "log_id", order: tuple[str, ...] = ("ts", "event_id"), time: str = "ts", emptied: str | None = None, hot_rows: int | None = None) -> DataFrame:
    """Adds consumption, exhausted and elapsed (seconds, 0 for the first probe) from the probe before; before the first the queue was empty. time is a timestamp, or a number of seconds, which counts to the microsecond as a timestamp does: seconds since 1970 as doubles are off by up to 0.12 microseconds each, which their difference would keep."""
    numeric = isinstance(probes.schema[time].dataType, NumericType)
    micros = F.round(F.col(time) * 1e6).cast("bigint") if numeric else F.unix_micros(F.col(time).cast("timestamp"))
    seen = deal(probes, queue, order, hot_rows).neighbours(before={"_length": F.col("queue_length"), "_micros": micros} | ({"_emptied": F.col(emptied)} if emptied else {}))
    before = F.coalesce("_length", F.lit(0))
    seconds = (micros - F.col("_micros")) / 1e6
    rose = F.col(emptied) > F.coalesce("_emptied", F.lit(0)) if emptied else F.lit(False)
    added = {"consumption": F.greatest(F.lit(0), before + F.col("enqueued") - F.col("queue_length")).cast("bigint"), "exhausted": (F.col("queue_length") == 0) | rose, "elapsed": F.coalesce(seconds, F.lit(0.0))}
    return seen.with_rows(seen.rows.select(*(F.col(c) for c in probes.columns), *(x.alias(n) for n, x in added.items()))).rows


def ewma_step(state: tuple[float, float], consumption: float, elapsed: float, first: bool, lifetime: float = LIFETIME, deviation_alpha: float = DEVIATION_ALPHA) -> tuple[float, float, float, float]:
    """(deviation, alpha, consumption ewma, deviation ewma) after a probe; the deviation is from the ewma before it. The first probe has no rate. Probes at the same moment leave the ewmas."""
    ewma, spread = state
    if first:
        return 0.0, 0.0, 0.0, 0.0
    deviation = abs(consumption - ewma * elapsed)
    alpha = 1 - math.exp(-elapsed / lifetime)
    if elapsed > 0:
        ewma, spread = (1 - alpha) * ewma + alpha * consumption / elapsed, (1 - deviation_alpha) * spread + deviation_alpha * deviation / elapsed
    return float(deviation), float(alpha), float(ewma), float(spread)


_EWMAS = ("deviation", "consumption_alpha", "consumption_ewma", "deviation_ewma")


def queue_ewma(consumed: DataFrame, *, queue: str = "log_id", order: tuple[str, ...] = ("ts", "event_id"), lifetime: float = LIFETIME, deviation_alpha: float = DEVIATION_ALPHA, start: tuple[str, str] | None = None, hot_rows: int | None = None) -> DataFrame:
    """queue, order, consumption and the running deviation, alpha and ewmas. start: columns with the ewmas before a queue's first row (null: the queue starts with it, and its elapsed is 0).

    A task walks its queues in order and keeps two numbers of the one it is in. Long queues are walked range by range at once, as a scan: a range maps
    the ewma before it to the one behind it by two numbers (keep x + add), and, the ewmas being known, the deviation's by two more; the maps of a
    queue's ranges, composed in order, give the ewmas with which every range starts.
    """
    given = consumed.withColumns({"_ewma": F.col(start[0]).cast("double") if start else F.lit(None).cast("double"), "_spread": F.col(start[1]).cast("double") if start else F.lit(None).cast("double")})
    dealt = deal(given.select(*dict.fromkeys([queue, *order, "consumption", "elapsed", "_ewma", "_spread"])), queue, order, hot_rows)
    if not dealt.hot:
        return _walk(dealt.rows.withColumn("_range", F.lit(0)), queue, order, lifetime, deviation_alpha)
    long = dealt.with_rows(dealt.rows.filter("_range IS NOT NULL"))
    ewmas = _entries(_maps(long.rows, queue, order, lifetime, deviation_alpha, False), queue, "_ewma")
    with_ewma = lambda rows: dealt._joined(rows, ewmas).withColumn("_ewma", F.coalesce("_entry", "_ewma")).drop("_entry")
    spreads = _entries(_maps(with_ewma(long.rows), queue, order, lifetime, deviation_alpha, True), queue, "_spread")
    rows = dealt._joined(with_ewma(dealt.rows), spreads).withColumn("_spread", F.coalesce("_entry", "_spread")).drop("_entry")
    return _walk(rows, queue, order, lifetime, deviation_alpha)


def _sorted(rows: DataFrame, queue: str, order: tuple[str, ...]) -> DataFrame:
    return rows.repartition(queue, "_range").sortWithinPartitions(queue, "_range", *order)


def _steps(batches: Iterator[pd.DataFrame], queue: str, lifetime: float, deviation_alpha: float) -> Iterator[tuple[pd.DataFrame, list[tuple], list[bool]]]:
    """Batches with the results of ewma_step and whether a row begins a range."""
    now, state = (), (0.0, 0.0)
    plain = lambda x: None if x is None or x != x else x
    for batch in batches:
        out, begins = [], []
        for q, r, c, dt, e, s in zip(batch[queue], batch["_range"], batch["consumption"], batch["elapsed"], batch["_ewma"], batch["_spread"], strict=True):
            here, first = (plain(q), plain(r)), False
            if here != now:
                now, first = here, e != e or e is None
                state = (0.0, 0.0) if first else (float(e), 0.0 if s is None or s != s else float(s))
                begins.append(True)
            else:
                begins.append(False)
            out.append(ewma_step(state, c, dt, first, lifetime, deviation_alpha))
            state = out[-1][2:]
        yield batch, out, begins


def _walk(rows: DataFrame, queue: str, order: tuple[str, ...], lifetime: float, deviation_alpha: float) -> DataFrame:
    columns = list(dict.fromkeys([queue, *order, "consumption"]))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + "".join(f", {c} double" for c in _EWMAS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, out, _ in _steps(batches, queue, lifetime, deviation_alpha):
            yield pd.concat([batch[columns], pd.DataFrame(out, columns=list(_EWMAS))], axis=1)

    return _sorted(rows, queue, order).mapInPandas(run, schema)


def _maps(rows: DataFrame, queue: str, order: tuple[str, ...], lifetime: float, deviation_alpha: float, of_deviation: bool) -> DataFrame:
    """queue, _range, keep, add and given (the value that a queue starts with): the map of a range of the ewma (or, with the ewmas known, of the deviation's ewma)."""
    schema = f"{queue} {rows.schema[queue].dataType.simpleString()}, _range int, keep double, add double, given double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch, out, begins in _steps((b.assign(**({"_spread": 0.0} if of_deviation else {"_ewma": 0.0})) for b in with_given(batches)), queue, lifetime, deviation_alpha):
            done = []
            for q, r, dt, g, (_, _, ewma, spread), new in zip(batch[queue], batch["_range"], batch["elapsed"], batch["_given"], out, begins, strict=True):
                if new:
                    done += [held] if held else []
                    held = (q, r, 1.0, 0.0, g)
                keep = held[2] * ((1 - deviation_alpha if dt > 0 else 1.0) if of_deviation else math.exp(-dt / lifetime))
                held = (q, r, keep, spread if of_deviation else ewma, held[4])
            yield pd.DataFrame(done, columns=[queue, "_range", "keep", "add", "given"])
        if held:
            yield pd.DataFrame([held], columns=[queue, "_range", "keep", "add", "given"])

    def with_given(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # where the queue starts with its first row, so do both
            yield b.assign(_given=b["_spread"].where(b["_ewma"].notna()) if of_deviation else b["_ewma"])

    return _sorted(rows, queue, order).mapInPandas(run, schema)


def _entries(maps: DataFrame, queue: str, name: str) -> DataFrame:
    """queue, _range and _entry: the value with which each range starts (null where the queue starts with it). A queue has MOST_RANGES maps at most."""
    schema = f"{queue} {maps.schema[queue].dataType.simpleString()}, _range int, _entry double"

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_range")
        value, out = frame["given"].iloc[0], []
        for keep, add in zip(frame["keep"], frame["add"], strict=True):
            out.append(value)
            value = add + keep * (0.0 if value != value or value is None else value)
        return frame[[queue, "_range"]].assign(_entry=out)

    return kept_table(maps.groupBy(queue).applyInPandas(compose, schema), f"queue-entries{name}")


def queue_invariants(series: DataFrame, least: int, *, queue: str = "log_id", order: tuple[str, ...] = ("ts", "event_id"), hot_rows: int | None = None) -> DataFrame:
    """Rows that break a rule, with broken: refill (lag(queue_length) + enqueued < least), drained (queue_length + consumption < least), starved (queue_length + lead(enqueued) < threshold)."""
    seen = deal(series, queue, order, hot_rows).neighbours(before={"_length": F.col("queue_length")}, after={"_more": F.col("enqueued")})
    rules = F.array(
        F.when(F.col("_length") + F.col("enqueued") < least, "refill"),
        F.when(F.col("queue_length") + F.col("consumption") < least, "drained"),
        F.when(F.col("queue_length") + F.col("_more") < F.col("threshold"), "starved"),
    )
    return seen.with_rows(seen.rows.withColumn("broken", rules).select("*", F.explode("broken").alias("rule")).filter("rule IS NOT NULL")).plain("broken", "_length", "_more")


def backpressure_state(series: DataFrame, *, queue: str = "log_id", order: tuple[str, ...] = ("ts", "event_id"), high: int = PAUSE_ABOVE, low: int = RESUME_BELOW, hot_rows: int | None = None) -> DataFrame:
    """Adds paused: set above high, cleared below low, kept in between, cleared at first."""
    mark = F.when(F.col("queue_length") > high, True).when(F.col("queue_length") < low, False)
    known = deal(series, queue, order, hot_rows).last_known("paused", mark)
    return known.with_rows(known.rows.withColumn("paused", F.coalesce("paused", F.lit(False)))).plain()


def queue_inefficiency(series: DataFrame, *, queue: str = "log_id", time: str = "time", order: tuple[str, ...] = ("time",), hot_rows: int | None = None) -> DataFrame:
    """Per queue: the widths of the intervals that ended exhausted, by the last time; an upper bound of the idle share, null if the last time is 0."""
    seen = deal(series, queue, order, hot_rows).neighbours(before={"_time": F.col(time)})
    wide = seen.rows.withColumn("_width", F.col(time) - F.col("_time"))
    return wide.groupBy(queue).agg(F.try_divide(F.coalesce(F.sum(F.when(F.col("exhausted"), F.col("_width"))), F.lit(0)), F.max(time)).alias("inefficiency"))


def _cell(value: Column, low: Column, high: Column, cells: Column) -> Column:
    """Where value lies in [low, high], in so many steps; the ends of a range that isn't one value lie in different cells. Ranges that doubles can't divide have three."""
    half = lambda c: c.cast("double") / 2
    width = half(high) - half(low)
    even = (width > 0) & (width < float("inf"))
    share = F.when(even, (half(value) - half(low)) / width)
    inner = F.when(even, F.least(F.floor(share * cells), cells - 2)).otherwise(F.floor(cells / 2))
    return F.when(value == low, 0).when(value == high, cells - 1).otherwise(F.greatest(inner.cast("int"), F.lit(0)))


def with_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], stats: list[Column], most: int | None = None) -> DataFrame:
    """keys, stats and exact quantiles (linear between neighbours) of each group, however large, by names in shares. Null values don't count.

    Selection in rounds: a segment is a range of a group's values that holds wanted ranks. As long as a segment has more than `most` (MOST_RANKED) rows
    and more than one value, its rows are counted by cells, sums of tasks meeting, and the cells with wanted ranks become the next segments, from their least to their greatest value.
    The rows of what is left are ranked: no segment that a task sorts has more than `most` rows, and none that it sums more than CELLS cells.
    """
    names, marks, most = list(shares), list(shares.values()), most or MOST_RANKED
    groups = kept_table(rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"), *stats), "groups")
    # ranks of the values on both sides of each quantile, by number
    rank = lambda q, of: of((F.col("_n") - 1) * F.lit(q)).cast("bigint")
    wanted = F.array(*(F.struct(F.lit(2 * i + j).alias("t"), rank(q, of).alias("rank")) for i, q in enumerate(marks) for j, of in enumerate((F.floor, F.ceil))))
    left = groups.filter("_n > 0").select(*keys, "_low", "_high", F.lit(0).cast("bigint").alias("_below"), F.col("_n").alias("_inside"), wanted.alias("_wanted"))
    on = lambda *more: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, *more)])
    named = lambda df, *more: df.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, *more)})
    is_open = (F.col("_inside") > most) & (F.col("_low") != F.col("_high"))
    size = left.agg(F.count("*").alias("groups"), F.count_if(is_open).alias("open")).first()
    few, still_open = size["groups"] <= MOST_BROADCAST, size["open"]
    side = lambda df: F.broadcast(df) if few else df

    def inside(segments: DataFrame) -> DataFrame:
        """The rows of segments, with their ranges and numbers of cells."""
        cells = F.least(F.greatest(F.ceil(F.col("_inside") * LEAST_CELLS / most), F.lit(LEAST_CELLS)), F.lit(CELLS)).cast("int")
        ranges = named(segments.select(*keys, "_low", "_high", cells.alias("_cells")))
        return rows.select(*keys, F.col(value).alias("_value")).join(side(ranges), on() & F.col("_value").between(F.col("_low"), F.col("_high"))).select(*keys, "_low", "_high", "_value", "_cells")

    def reached(counted: DataFrame, segments: DataFrame, upto: Column, by: str) -> DataFrame:
        """Counts in segments (upto: their running sum in order of by) with the wanted ranks that lie in each; others are left out."""
        known = counted.withColumn("_upto", upto.over(Window.partitionBy(*keys, "_low").orderBy(by))).join(side(named(segments.select(*keys, "_low", "_below", "_wanted"), "_low")), on("_low"))
        known = known.withColumn("_before", F.col("_below") + F.col("_upto") - F.col("_c"))
        return known.withColumn("_wanted", F.filter("_wanted", lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_before") + F.col("_c")))).filter(F.size("_wanted") > 0)

    done = []
    while still_open:
        done.append(left.filter(~is_open))
        still = left.filter(is_open)
        cells = inside(still).groupBy(*keys, "_low", _cell(F.col("_value"), F.col("_low"), F.col("_high"), F.col("_cells")).alias("_cell")).agg(F.count("*").alias("_c"), F.min("_value").alias("_least"), F.max("_value").alias("_most"))
        found = reached(cells, still, F.sum("_c"), "_cell").select(*keys, F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.col("_before").alias("_below"), F.col("_c").alias("_inside"), "_wanted")
        left = kept_table(found, "segments")
        still_open = left.filter(is_open).count()
    segments = reduce(DataFrame.unionByName, [*done, left])
    told = F.explode("_wanted").alias("w")
    one = segments.filter("_low <=> _high").select(*keys, F.col("_low").alias("_value"), told)
    several = segments.filter("NOT _low <=> _high")
    ranked = reached(inside(several).withColumn("_c", F.lit(1)), several, F.row_number(), "_value")
    values = one.unionByName(ranked.select(*keys, "_value", told))
    at = lambda t: F.max(F.when(F.col("w.t") == t, F.col("_value")))
    wide = named(values.groupBy(*keys).agg(*(at(t).alias(f"_at_{t}") for t in range(2 * len(marks)))))
    part = lambda q: (F.col("_n") - 1) * F.lit(q) - F.floor((F.col("_n") - 1) * F.lit(q))
    between = lambda a, b, q: F.when(a == b, a.cast("double")).otherwise(a + (b - a) * part(q))
    quantile = lambda i, q: between(F.col(f"_at_{2 * i}"), F.col(f"_at_{2 * i + 1}"), q)
    return groups.join(side(wide), on(), "left").select(*keys, *(F.col(c) for c in groups.columns[len(keys) + 3 :]), *(quantile(i, q).alias(n) for i, (n, q) in enumerate(zip(names, marks, strict=True))))


def bench_by_method(bench: DataFrame, value: str = "total_duration") -> DataFrame:
    stats = [F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")]
    return with_quantiles(bench, ["method"], value, {"q05": 0.05}, stats).orderBy("min")


def bench_by_params(bench: DataFrame, params: list[str | tuple[str, ...]], value: str = "total_duration") -> DataFrame:
    """Statistics for each value of each parameter, or combination of parameters, of a method: method, param, value, mean, median, min, max, q05.

    The names of a combination, and its values (then text), are joined by commas; single parameters have the type of them all.
    """
    sets = [(p,) if isinstance(p, str) else p for p in params]
    single = all(len(p) == 1 for p in sets)
    of = lambda p: F.col(p[0]) if single else F.concat_ws(",", *(F.col(c).cast("string") for c in p))
    long = bench.select("method", value, F.explode(F.array(*(F.struct(F.lit(",".join(p)).alias("param"), of(p).alias("value")) for p in sets))).alias("p"))
    stats = [F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")]
    return with_quantiles(long.select("method", "p.param", "p.value", value), ["method", "param", "value"], value, {"median": 0.5, "q05": 0.05}, stats)


def bench_cases(bench: DataFrame, keys: list[str], value: str) -> DataFrame:
    return with_quantiles(bench, keys, value, {"median": 0.5, "q95": 0.95}, [F.avg(value).alias("mean")]).orderBy("median")


def case_order(cases: DataFrame, scenario: str, operation: str) -> DataFrame:
    """The cases of one scenario and operation, from the lowest median up."""
    return cases.filter((F.col("scenario") == scenario) & (F.col("operation") == operation)).orderBy("median").select("case", "median")


def bench_mean_runs(bench: DataFrame, keys: list[str], value: str) -> DataFrame:
    return bench.groupBy(*keys).agg(F.avg(value).alias("mean"))


def best_params(bench: DataFrame, by: list[str], value: str = "total_duration") -> DataFrame:
    """The rows of least duration in each group, ties kept."""
    w = Window.partitionBy(*by).orderBy(value)
    return bench.withColumn("_rank", F.rank().over(w)).filter("_rank = 1").drop("_rank").orderBy(value)
