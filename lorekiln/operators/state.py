"""Time-ordered state in batch form: job lifecycles, request budgets, pacing, pages of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a job, which of them end it, and what may follow what. A restart of the server interrupts
# jobs too, and only what it has interrupted may be queued again.
STATES = ("QUEUED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "INTERRUPTED", "REPLAN_REQUIRED")
RESTART = "SERVER_RESTART"
_ENDS = ("COMPLETED", "FAILED", "CANCELLED", "INTERRUPTED", "REPLAN_REQUIRED", RESTART)
NEXT = {"QUEUED": ("RUNNING", *_ENDS), "RUNNING": _ENDS, RESTART: ("QUEUED",)}


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def step(state: str | None, wanted: str) -> str | None:
    """The state after an event; events that a state does not allow leave it as it is."""
    if state is None:
        return "QUEUED" if wanted == "QUEUED" else None
    return wanted if wanted in NEXT.get(state, ()) else state


def shown(state: Column) -> Column:
    """The state that a job's row shows: one that a restart has cut off is interrupted."""
    return F.when(state == RESTART, "INTERRUPTED").otherwise(state)


def final_states(events: DataFrame, job: str = "job_id", order: tuple[str, ...] = ("ts",), wanted: str = "wanted") -> DataFrame:
    """job, state, accepted: each job's events folded in order by a JVM-side aggregate over its sorted events.

    A job's own events are one array: bounded by the life of a job, not by the table.
    """
    following = F.create_map(*[x for s, ws in NEXT.items() for x in (F.lit(s), F.array(*[F.lit(w) for w in ws]))])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(wanted).alias("wanted")))), lambda e: e["wanted"])
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(0).cast("long").alias("accepted"))

    def fold(acc: Column, w: Column) -> Column:
        allowed = F.when(acc["state"].isNull(), w == "QUEUED").otherwise(F.coalesce(F.array_contains(F.element_at(following, acc["state"]), w), F.lit(False)))
        return F.struct(F.when(allowed, w).otherwise(acc["state"]).alias("state"), (acc["accepted"] + allowed.cast("long")).alias("accepted"))

    folded = events.groupBy(job).agg(F.aggregate(ordered, start, fold).alias("end"))
    return folded.select(job, shown(F.col("end.state")).alias("state"), F.col("end.accepted").alias("accepted"))


def status_counts(jobs: DataFrame) -> DataFrame:
    """state, n with zeros for states that no job is in."""
    all_ = jobs.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return all_.join(jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def idempotent(requests: DataFrame, key: str, *order: str) -> DataFrame:
    """The first request of each key; requests without a key are all kept."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return requests.withColumn("nth", nth).where((F.col("nth") == 1) | F.col(key).isNull()).drop("nth")


def budgeted(events: DataFrame, caller: str = "caller", ts: str = "ts", seconds: int = 60, most: int = 120, tie: str | None = None) -> DataFrame:
    """Adds window (from 1), nth and refused: fixed windows that begin with a caller's first request after the last one ended.

    Such windows depend on each other, so a caller's requests are taken in order, a batch of sorted
    rows at a time with one carried state: memory does not grow with the number of requests.
    """
    ordered = [ts, *([tie] if tie else [])]
    micros = _micros(ts).alias("__us")
    dealt = events.select("*", micros).repartition(caller).sortWithinPartitions(caller, *ordered)
    span = seconds * 1_000_000

    def part(batches):
        last, start, number, nth = object(), 0, 0, 0
        for rows in batches:
            windows, nths = [], []
            for who, at in zip(rows[caller], rows["__us"], strict=True):
                if who != last:
                    last, start, number, nth = who, at, 1, 0
                elif at - start >= span:
                    start, number, nth = at, number + 1, 0
                nth += 1
                windows.append(number)
                nths.append(nth)
            yield rows.drop(columns="__us").assign(window=windows, nth=nths, refused=[n > most for n in nths])

    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", window long, nth long, refused boolean"
    return dealt.mapInPandas(part, schema)


def paced(events: DataFrame, by: str, interval_us: int, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Adds slot_us: next = max(next, now) + interval, in closed form per ``by``."""
    order = [ts, *([tie] if tie else [])]
    i = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")
    free = _micros(ts) - (i - 1) * interval_us
    latest = F.max("__free").over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("__i", i).withColumn("__free", free).withColumn("slot_us", latest + (F.col("__i") - 1) * interval_us).drop("__i", "__free")


def throttled(progress: DataFrame, job: str = "job_id", ts: str = "ts", seconds: int = 1, tie: str | None = None) -> DataFrame:
    """Progress writes at most one a second: a row passes if the job's last row that passed is a second older, or there is none.

    What passes depends on what has passed, so a job's rows are taken in order, a batch of sorted rows at a
    time with one carried state. Rows of the same time go by ``tie``.
    """
    dealt = progress.select("*", _micros(ts).alias("__us")).repartition(job).sortWithinPartitions(job, ts, *([tie] if tie else []))
    span = seconds * 1_000_000

    def part(batches):
        last, written_at = object(), 0
        for rows in batches:
            passes = []
            for who, at in zip(rows[job], rows["__us"], strict=True):
                passes.append(who != last or at - written_at >= span)
                if passes[-1]:
                    last, written_at = who, at
            yield rows[passes].drop(columns="__us")

    return dealt.mapInPandas(part, progress.schema)


def keyset_page(rows: DataFrame, order: tuple[str, str], after: tuple | None, limit: int) -> DataFrame:
    """The page of rows that come strictly after a key, newest first, with ``more``: whether another page follows."""
    limit = clamped(limit)
    a, b = order
    if after is not None:
        rows = rows.where((F.col(a) < F.lit(after[0])) | ((F.col(a) == F.lit(after[0])) & (F.col(b) < F.lit(after[1]))))
    nth = F.row_number().over(Window.orderBy(F.desc(a), F.desc(b)))
    return truncated(rows.orderBy(F.desc(a), F.desc(b)).limit(limit + 1).withColumn("nth", nth), limit)


def clamped(limit: int | None, most: int = 100, default: int = 20) -> int:
    """A page's size: within 1 and ``most``, ``default`` where none is asked for."""
    return default if limit is None else max(1, min(most, limit))


def slug_page(rows: DataFrame, cursor: str | None, limit: int | None = None, slug: str = "slug") -> DataFrame:
    """The page of rows that come after a slug, in its order, with nth and more. A cursor that no row has is an error."""
    if cursor is not None and rows.where(F.col(slug) == cursor).isEmpty():
        raise ValueError(f"no row has the cursor {cursor!r}")
    size = clamped(limit)
    after = rows if cursor is None else rows.where(F.col(slug) > cursor)
    nth = F.row_number().over(Window.orderBy(slug))
    return truncated(after.orderBy(slug).limit(size + 1).withColumn("nth", nth), size)


def admitted(jobs: DataFrame, queue_cap: int) -> DataFrame:
    """running, queued, may_start, may_queue: one job runs at a time, and at most ``queue_cap`` wait."""
    found = jobs.agg(F.count(F.when(F.col("state") == "RUNNING", 1)).alias("running"), F.count(F.when(F.col("state") == "QUEUED", 1)).alias("queued"))
    return found.select("running", "queued", (F.col("running") == 0).alias("may_start"), (F.col("queued") < queue_cap).alias("may_queue"))


def truncated(rows: DataFrame, limit: int) -> DataFrame:
    """Of a list of limit + 1 rows with nth: the first ``limit``, and whether there was one more."""
    return rows.withColumn("more", F.max("nth").over(Window.partitionBy()) > limit).where(F.col("nth") <= limit)


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: those that were queued or running are interrupted; ``resume`` is their order, oldest first."""
    cut = F.col("state").isin("QUEUED", "RUNNING")
    after = jobs.withColumn("was", F.col("state")).withColumn("state", F.when(cut, "INTERRUPTED").otherwise(F.col("state")))
    nth = F.row_number().over(Window.partitionBy(F.col("state") == "INTERRUPTED").orderBy("created_at", "job_id"))
    return after.withColumn("resume", F.when(F.col("state") == "INTERRUPTED", nth))
