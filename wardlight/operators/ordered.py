"""Per-patient ordered primitives that stay balanced when one patient dominates.

Ordinary patients use one plain window per patient. A patient holding more than
``MAX_ROWS_PER_KEY`` visits ("hot") is cut into time chunks: each chunk is a
window group of its own, one summary row per chunk carries the running state
across chunks, and the two parts are merged by formula. Results are identical;
no task ever sorts a whole hot patient. ``hot_keys`` decides with one
column-pruned, map-side combined count and returns ``None`` in the usual case,
which leaves the simple single-shuffle plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.schema import KEY, ROW, TIME
from wardlight.session import broadcast_if_fits

MAX_ROWS_PER_KEY = 5_000_000
CHUNK_SECONDS = 86_400
MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS


def hot_keys(df: DataFrame, key: str = KEY, max_rows: int | None = None) -> DataFrame | None:
    """Keys above ``max_rows`` rows, or ``None`` when there are none.

    At most total/max_rows keys can qualify, so the result stays small.
    """
    bound = MAX_ROWS_PER_KEY if max_rows is None else max_rows
    hot = (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > bound).select(key)
    )
    return None if hot.isEmpty() else hot


def micros(time: str = TIME) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


class PatientOrder:
    """A frame with its per-patient order, split into chunks where a key is hot.

    Rows without key or time have no place in the order: they come back with
    null history columns.
    """

    def __init__(self, df: DataFrame, key: str = KEY, time: str = TIME, row: str = ROW,
                 max_rows: int | None = None, chunk_seconds: int = CHUNK_SECONDS,
                 hot: DataFrame | None | bool = True):
        self.key, self.time, self.row = key, time, row
        self.chunk_seconds = chunk_seconds
        if hot is True:
            hot = hot_keys(df, key, max_rows)
        self.hot = hot
        self.chunked = hot is not None
        base = df.withColumn("_us", micros(time))
        placed = F.col(key).isNotNull() & F.col("_us").isNotNull()
        if self.chunked:
            flags = hot.select(F.col(key), F.lit(True).alias("_hot"))
            base = base.join(broadcast_if_fits(flags), key, "left")
            whole = F.floor(F.col("_us") / F.lit(chunk_seconds * MICROS)).cast("long")
            base = base.withColumn("_chunk", F.when(F.col("_hot") & placed, whole).otherwise(F.lit(0)))
        # Unplaced rows get a group of their own each, so null keys never pile up.
        self.df = base.withColumn("_lone", F.when(placed, F.lit(None)).otherwise(F.xxhash64(row)))
        self.groups = [key, "_lone"] + (["_chunk"] if self.chunked else [])

    @property
    def order(self) -> list[Column]:
        return [F.col("_us"), F.col(self.row)]

    def window(self):
        return Window.partitionBy(*self.groups).orderBy(*self.order)

    def replace(self, df: DataFrame) -> "PatientOrder":
        out = object.__new__(PatientOrder)
        out.__dict__.update(self.__dict__)
        out.df = df
        return out

    def done(self) -> DataFrame:
        return self.df.drop("_us", "_hot", "_chunk", "_lone")

    def carry(self, summaries: list[Column], carried) -> DataFrame:
        """Attach state of all earlier chunks of a hot key as ``_carry`` columns.

        ``summaries`` are aggregates over one chunk; ``carried(window)`` turns
        them into named columns over the earlier chunks of the same key.
        """
        per_chunk = (
            self.df.where(F.col("_hot") & F.col("_lone").isNull())
            .groupBy(self.key, "_chunk").agg(*summaries)
        )
        earlier = (
            Window.partitionBy(self.key).orderBy("_chunk")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        state = per_chunk.select(self.key, "_chunk", *carried(earlier))
        return self.df.join(state, [self.key, "_chunk"], "left")

    # -- primitives -----------------------------------------------------

    def position(self, name: str = "visit_index") -> "PatientOrder":
        """Zero-based visit number."""
        local = F.row_number().over(self.window()) - 1
        if not self.chunked:
            return self.replace(self.df.withColumn(name, F.when(F.col("_lone").isNull(), local)))
        df = self.carry([F.count(F.lit(1)).alias("_c")],
                        lambda w: [F.sum("_c").over(w).alias("_before")])
        df = df.withColumn(name, F.when(F.col("_lone").isNull(),
                                        local + F.coalesce(F.col("_before"), F.lit(0))))
        return self.replace(df.drop("_before"))

    def previous(self, columns: list[str], count: int, name: str) -> "PatientOrder":
        """``name``: array of the last ``count`` earlier rows (structs), oldest first."""
        item = F.struct(*[F.col(c) for c in columns])
        local = F.collect_list(item).over(self.window().rowsBetween(-count, -1))
        if not self.chunked:
            return self.replace(self.df.withColumn(name, local))
        # Last rows of a chunk: a bounded list per chunk, merged over the few
        # chunks needed to fill ``count`` slots (every chunk holds at least one row).
        ranked = self.df.where(F.col("_hot") & F.col("_lone").isNull()).withColumn(
            "_rn", F.row_number().over(
                Window.partitionBy(self.key, "_chunk").orderBy(*[c.desc() for c in self.order])))
        tails = (
            ranked.where(F.col("_rn") <= count).groupBy(self.key, "_chunk")
            .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rn")).alias("_o"), item.alias("_v")))).alias("_tail"))
        )
        over = Window.partitionBy(self.key).orderBy("_chunk").rowsBetween(-count, -1)
        state = tails.select(
            self.key, "_chunk", F.flatten(F.collect_list("_tail").over(over)).alias("_tails"))
        df = self.df.withColumn("_local", local).join(state, [self.key, "_chunk"], "left")
        empty = F.coalesce(F.transform("_tails", lambda s: s["_v"]), F.slice("_local", 1, 0))
        both = F.concat(empty, F.col("_local"))
        size = F.least(F.size(both), F.lit(count))
        df = df.withColumn(name, F.slice(both, F.size(both) - size + 1, size))
        return self.replace(df.drop("_local", "_tails"))

    def lag(self, columns: list[str], steps: tuple[int, ...] = (1,), pattern: str = "{c}_lag{k}") -> "PatientOrder":
        names = {(c, k): pattern.format(c=c, k=k) for c in columns for k in steps}
        if not self.chunked:
            w = self.window()
            return self.replace(self.df.withColumns(
                {n: F.lag(c, k).over(w) for (c, k), n in names.items()}))
        deepest = max(steps)
        held = self.previous(columns, deepest, "_prev")
        size = F.size("_prev")
        df = held.df.withColumns({
            n: F.when(size >= k, F.try_element_at("_prev", F.lit(-k)).getField(c))
            for (c, k), n in names.items()})
        return self.replace(df.drop("_prev"))

    def prior_moments(self, columns: list[str]) -> "PatientOrder":
        """Count, mean and population std of all earlier visits, per column.

        Adds ``<c>_prior_n``, ``<c>_prior_mean``, ``<c>_prior_std``.
        """
        w = self.window().rowsBetween(Window.unboundedPreceding, -1)
        df = self.df
        if self.chunked:
            summaries = [e for c in columns for e in moment_aggs(c, f"_s_{c}")]
            df = self.carry(summaries, lambda win: [
                e for c in columns for e in moments_over(f"_s_{c}", win, f"_e_{c}",
                                                         Window.partitionBy(self.key).orderBy("_chunk"))])
        df = df.withColumns({k: v for c in columns for k, v in window_moments(c, w, f"_l_{c}").items()})
        out, scratch = {}, []
        for c in columns:
            parts = [f"_l_{c}"] + ([f"_e_{c}"] if self.chunked else [])
            n, mean, m2 = merge_moments(parts)
            out[f"{c}_prior_n"] = n
            out[f"{c}_prior_mean"] = mean
            out[f"{c}_prior_std"] = F.when(n > 0, F.sqrt(m2 / n))
            scratch += [f"{p}_{s}" for p in parts for s in ("n", "mean", "m2")]
        return self.replace(df.withColumns(out).drop(*scratch))

    def rolling_moments(self, columns: list[str], days: tuple[int, ...],
                        mean: str | None = "{c}_mean_{d}d", std: str | None = "{c}_std_{d}d",
                        count: str | None = None) -> "PatientOrder":
        """Mean / population std / count of ``columns`` over (t - N days, t]."""
        order = self
        for d in days:
            order = order._rolling(columns, d, mean, std, count)
        return order

    def _rolling(self, columns, days, mean, std, count):
        span = days * DAY_MICROS
        base = Window.partitionBy(*self.groups).orderBy("_us").rangeBetween(-span + 1, 0)
        df, parts = self.df, ["_l"]
        df = df.withColumns({k: v for c in columns for k, v in window_moments(c, base, f"_l_{c}").items()})
        if self.chunked:
            df = self._rolling_earlier_chunks(df, columns, span)
            parts = ["_l", "_f", "_x"]
        out, scratch = {}, []
        for c in columns:
            n, m, m2 = merge_moments([f"{p}_{c}" for p in parts])
            if mean:
                out[mean.format(c=c, d=days)] = m
            if std:
                out[std.format(c=c, d=days)] = F.when(n > 0, F.sqrt(m2 / n))
            if count:
                out[count.format(c=c, d=days)] = n
            scratch += [f"{p}_{c}_{s}" for p in parts for s in ("n", "mean", "m2")]
        return self.replace(df.withColumns(out).drop(*scratch))

    def _rolling_earlier_chunks(self, df, columns, span):
        """Parts of (t-span, t] outside the row's own chunk: whole chunks and one cut chunk.

        Rows of the cut chunk reach the chunk of ``t`` as expiry copies moved
        ``span`` ahead in time, so "ts > t - span" becomes "later in this chunk".
        """
        width = self.chunk_seconds * MICROS
        if span % width:
            raise ValueError("chunk length must divide the rolling window")
        gap = span // width
        hot_rows = F.col("_hot") & F.col("_lone").isNull()
        summaries = [e for c in columns for e in moment_aggs(c, f"_s_{c}")]
        per_chunk = self.df.where(hot_rows).groupBy(self.key, "_chunk").agg(*summaries)
        between = Window.partitionBy(self.key).orderBy("_chunk").rangeBetween(-gap + 1, -1)
        anchor = Window.partitionBy(self.key).orderBy("_chunk")
        whole = per_chunk.select(self.key, "_chunk", *[
            e for c in columns for e in moments_over(f"_s_{c}", between, f"_f_{c}", anchor)])
        live = df.join(whole, [self.key, "_chunk"], "left").withColumn("_expiry", F.lit(False))
        copies = self.df.where(hot_rows).select(
            self.key, (F.col("_chunk") + gap).alias("_chunk"), (F.col("_us") + span).alias("_us"),
            F.lit(None).cast("long").alias("_lone"), F.lit(True).alias("_expiry"),
            *[F.col(c).alias(f"_v_{c}") for c in columns])
        both = live.unionByName(copies, allowMissingColumns=True)
        later = (
            Window.partitionBy(self.key, "_lone", "_chunk").orderBy(F.col("_us").desc())
            .rangeBetween(Window.unboundedPreceding, -1)
        )
        both = both.withColumns({
            k: v for c in columns for k, v in window_moments(f"_v_{c}", later, f"_x_{c}").items()})
        return both.where(~F.col("_expiry")).drop("_expiry", *[f"_v_{c}" for c in columns])

    def running_sum_and_low(self, column: str, total: str, low: str) -> "PatientOrder":
        """Running sum of ``column`` and the running minimum of that sum."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumn(total, F.sum(column).over(w))
        df = df.withColumn(low, F.min(total).over(w))
        if not self.chunked:
            return self.replace(df)
        me = self.replace(df)
        per_chunk = (
            df.where(F.col("_hot") & F.col("_lone").isNull()).groupBy(self.key, "_chunk")
            .agg(F.sum(column).alias("_s"), F.min(low).alias("_m"))
        )
        earlier = (Window.partitionBy(self.key).orderBy("_chunk")
                   .rowsBetween(Window.unboundedPreceding, -1))
        per_chunk = per_chunk.withColumn("_base", F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)))
        per_chunk = per_chunk.withColumn("_lowest", F.min(F.col("_base") + F.col("_m")).over(earlier))
        state = per_chunk.select(self.key, "_chunk", "_base", "_lowest")
        df = me.df.join(state, [self.key, "_chunk"], "left")
        base = F.coalesce(F.col("_base"), F.lit(0.0))
        df = df.withColumns({
            total: F.coalesce(F.col(total) + base, F.col("_base")),
            low: F.least(F.col(low) + base, F.col("_lowest")),
        })
        return self.replace(df.drop("_base", "_lowest"))

    def last_known(self, columns: list[str], names: list[str]) -> "PatientOrder":
        """Latest non-null value at or before the row (forward fill / as-of)."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0)
        df = self.df.withColumns({n: F.last(c, ignorenulls=True).over(w) for c, n in zip(columns, names)})
        if self.chunked:
            me = self.replace(df)
            at = F.struct(*self.order)
            df = me.carry(
                [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_t_{i}") for i, c in enumerate(columns)],
                lambda win: [F.last(f"_t_{i}", ignorenulls=True).over(win).alias(f"_k_{i}")
                             for i in range(len(columns))])
            df = df.withColumns({n: F.coalesce(F.col(n), F.col(f"_k_{i}")) for i, n in enumerate(names)})
            df = df.drop(*[f"_k_{i}" for i in range(len(columns))])
        return self.replace(df)

    def first_rows(self, columns: list[Column], count: int) -> DataFrame:
        """The first ``count`` rows of every patient (for warm-up baselines)."""
        w = Window.partitionBy(*self.groups).orderBy(*self.order)
        kept = self.df.where(F.col("_lone").isNull()).select(
            *self.groups, "_us", self.row, *columns).withColumn("_rn", F.row_number().over(w))
        kept = kept.where(F.col("_rn") <= count)
        if self.chunked:
            again = Window.partitionBy(self.key).orderBy(*self.order)
            kept = kept.withColumn("_rn", F.row_number().over(again)).where(F.col("_rn") <= count)
        return kept


# -- moments: (n, mean, m2) triples, m2 = sum of squared deviations ------


def moment_aggs(column: str, prefix: str) -> list[Column]:
    n = F.count(column)
    return [
        n.alias(f"{prefix}_n"),
        F.avg(column).alias(f"{prefix}_mean"),
        (F.var_pop(column) * n).alias(f"{prefix}_m2"),
    ]


def window_moments(column: str, window, prefix: str) -> dict[str, Column]:
    n = F.count(column).over(window)
    return {
        f"{prefix}_n": n,
        f"{prefix}_mean": F.avg(column).over(window),
        f"{prefix}_m2": F.var_pop(column).over(window) * n,
    }


def moments_over(prefix: str, window, out: str, anchor) -> list[Column]:
    """Combine triples of many chunks; deviations are taken from the first chunk's mean."""
    shift = F.first(f"{prefix}_mean", ignorenulls=True).over(
        anchor.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    n, mean, m2 = (F.col(f"{prefix}_{s}") for s in ("n", "mean", "m2"))
    total = F.sum(n).over(window)
    drift = F.sum(n * (mean - shift)).over(window)
    square = F.sum(m2 + n * (mean - shift) * (mean - shift)).over(window)
    return [
        total.alias(f"{out}_n"),
        (shift + drift / F.when(total > 0, total)).alias(f"{out}_mean"),
        F.greatest(square - drift * drift / F.when(total > 0, total), F.lit(0.0)).alias(f"{out}_m2"),
    ]


def merge_moments(prefixes: list[str]) -> tuple[Column, Column, Column]:
    """Pool (n, mean, m2) triples held in columns; missing parts count as empty."""
    if len(prefixes) == 1:
        p = prefixes[0]
        return F.col(f"{p}_n"), F.col(f"{p}_mean"), F.col(f"{p}_m2")

    def part(p, s):
        return F.coalesce(F.col(f"{p}_{s}"), F.lit(0.0))

    def add(values):
        return reduce(lambda a, b: a + b, values)

    n = add([F.coalesce(F.col(f"{p}_n"), F.lit(0)) for p in prefixes])
    total = F.when(n > 0, n)
    mean = add([part(p, "n") * part(p, "mean") for p in prefixes]) / total
    m2 = add([
        part(p, "m2") + part(p, "n") * (part(p, "mean") - mean) * (part(p, "mean") - mean)
        for p in prefixes])
    return n, mean, m2
