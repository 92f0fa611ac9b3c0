"""The adaptive candidate stream: candidates arrive one by one and each is tested alone, at its round's error rate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import formulas as fx
from ..operators import evidence as ev
from ..operators.splits import row_index

LIMIT = 500.0


def loss(value: str = "value"):
    return F.least(F.col(value) / LIMIT, F.lit(1.0))


def in_rounds(rows: DataFrame, start: int = 0) -> DataFrame:
    """A round for each candidate by its arrival, after the first ``start`` ones, ordered by ranges and not in one task."""
    return row_index(rows, F.struct("ts", "candidate"), "candidate", out="round").withColumn("round", F.col("round") + 1 + start)


def candidate_rounds(events: DataFrame, alpha: float) -> DataFrame:
    """Statistics of each candidate's losses, its round by first arrival, and what the round spends of ``alpha``."""
    rows = events.where("value is not null").groupBy(F.col("user_id").alias("candidate")).agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.avg(loss()).alias("mean"), F.var_samp(loss()).alias("var")
    )
    return in_rounds(rows).withColumns({"round_alpha": fx.quadratic_alpha("round", alpha), "cumulative_alpha": fx.quadratic_spent("round", alpha)})


def decide(rows: DataFrame, tolerance: float) -> DataFrame:
    rows = rows.withColumns({"tolerance": F.lit(tolerance), "lower": F.lit(0.0), "upper": F.lit(1.0)})
    rows = rows.withColumns({"badness_p": ev.badness_p("empirical_bernstein"), "violation_p": ev.badness_p("empirical_bernstein", True)})
    return rows.withColumn("status", ev.status(F.col("badness_p") <= F.col("round_alpha"), F.col("violation_p") <= F.col("round_alpha")))


def adaptive_audit(events: DataFrame, alpha: float = 0.05, tolerance: float = 0.3) -> DataFrame:
    return decide(candidate_rounds(events, alpha), tolerance)


class Ledger:
    """The live form, for ``foreachBatch``: candidates get a round each as they arrive, closed ones enter a table, tested at
    what their round spends, before results are read; losses that came after their candidate had closed enter a table of
    rejects, with their count.

    A candidate that is in the ledger never enters again, whichever batch brings it, so a replayed or repeated batch
    spends nothing twice. Each batch is a folder named by its number; a replay overwrites its own folders alone.
    """

    def __init__(self, spark: SparkSession, path: str, alpha: float, tolerance: float) -> None:
        self.spark, self.path, self.alpha, self.tolerance = spark, path, alpha, tolerance

    def _folders(self, what: str) -> dict[int, str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return {int(n[6:]): f"{self.path}/{what}/{n}" for n in names if n.startswith("batch=")}

    def _before(self, what: str, batch_id: int) -> DataFrame | None:
        paths = [path for batch, path in self._folders(what).items() if batch < batch_id]
        return self.spark.read.parquet(*paths) if paths else None

    def __call__(self, rows: DataFrame, batch_id: int) -> None:
        """``rows(kind, candidate, ts, n, mean, var)``: candidates that no other can precede any more, of kind ``opened``, those
        whose losses are complete, of kind ``closed``, and losses that came too late, of kind ``rejected``. A candidate that
        closes without having been opened is opened by it."""
        rows.persist()
        closed = rows.where("kind = 'closed'").drop("kind").dropDuplicates(["candidate"])
        opened = rows.where("kind in ('opened', 'closed')").groupBy("candidate").agg(F.min("ts").alias("ts"))
        old, start = self._before("arrivals", batch_id), 0
        if old is not None:
            start = old.agg(F.max("round")).first()[0] or 0
            opened = opened.join(old.select("candidate"), "candidate", "left_anti")
        at = f"{self.path}/arrivals/batch={batch_id}"
        in_rounds(opened, start).write.mode("overwrite").parquet(at)
        arrived = self.spark.read.parquet(at).select("candidate", "round")
        arrived = arrived if old is None else arrived.union(old.select("candidate", "round"))
        if (done := self._before("rounds", batch_id)) is not None:
            closed = closed.join(done.select("candidate"), "candidate", "left_anti")
        new = closed.join(arrived, "candidate").withColumn("round_alpha", fx.quadratic_alpha("round", self.alpha))
        decide(new, self.tolerance).write.mode("overwrite").parquet(f"{self.path}/rounds/batch={batch_id}")
        rows.where("kind = 'rejected'").drop("kind").write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch_id}")
        rows.unpersist()

    def table(self) -> DataFrame:
        return self.spark.read.parquet(*self._folders("rounds").values())

    def rejects(self) -> DataFrame:
        """``(candidate, ts, n, mean, var)``: one row for each candidate and batch that brought losses after the close."""
        return self.spark.read.parquet(*self._folders("rejects").values())


CLOSED = "kind string, candidate long, us long, n long, mean double, var double"


def added(s: tuple | None, f: pd.DataFrame) -> tuple:
    """(first and last microsecond, n, sum, sum of squared deviations) ``s`` with the losses of ``f(us, loss)``. Losses are added
    one after another in order of time, as an average over events in that order adds them: where a mean lies half way
    between two rounded ones, another order ends at the other."""
    f = f.sort_values(["us", "loss"])
    x, n = f["loss"].to_numpy(), len(f)
    first, last, have, total, m2 = s or (int(f["us"].iloc[0]), int(f["us"].iloc[-1]), 0, 0.0, 0.0)
    gap = x.mean() - total / have if have else 0.0
    m2 += float(((x - x.mean()) ** 2).sum() + gap * gap * have * n / (have + n))
    return min(first, int(f["us"].iloc[0])), max(last, int(f["us"].iloc[-1])), have + n, float(np.add.accumulate(np.append(total, x))[-1]), m2


class Closing(StatefulProcessor):
    """Holds each candidate's statistics and two timers, at its first loss and ``gap_ms`` after its last one. When the
    watermark passes the first timer, nothing can arrive before the candidate any more, and it opens; when it passes the
    second, the candidate closes, once and for all; losses that come later are rejected, by count and statistics."""

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stats = handle.getValueState("stats", "first long, last long, n long, sum double, m2 double")
        self.opened = handle.getValueState("opened", "us long")
        self.closed = handle.getValueState("closed", "rejected long")

    def _row(self, kind: str, key, s: tuple) -> pd.DataFrame:
        var = s[4] / (s[2] - 1) if s[2] > 1 else None
        return pd.DataFrame({"kind": [kind], "candidate": [key[0]], "us": [s[0]], "n": [s[2]], "mean": [s[3] / s[2]], "var": pd.array([var], dtype="Float64")})

    def _closes(self, s: tuple) -> int:
        return s[1] // 1000 + self.gap_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names that Spark calls by)
        late = self.closed.exists()
        got = tuple(self.stats.get()) if not late and self.stats.exists() else None
        for f in rows:
            got = added(got, f) if len(f) else got
        if got is None:
            return
        if late:
            self.closed.update((self.closed.get()[0] + got[2],))
            yield self._row("rejected", key, got)
            return
        self.stats.update(got)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(self._closes(got))
        if not self.opened.exists():
            self.handle.registerTimer(got[0] // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (names that Spark calls by)
        if not self.stats.exists():
            return
        got = tuple(self.stats.get())
        if not self.opened.exists():
            yield self._row("opened", key, got)
            self.opened.update((got[0],))
        if expiredTimerInfo.getExpiryTimeInMs() >= self._closes(got):
            yield self._row("closed", key, got)
            self.stats.clear()
            self.opened.clear()
            self.closed.update((0,))

    def close(self) -> None:
        pass


def closed_candidates(events: DataFrame, delay: str = "1 hour", gap: str = "30 days") -> DataFrame:
    """A stream of ``(kind, candidate, ts, n, mean, var)``: candidates whose first loss the watermark has passed, those that it
    has passed by ``gap``, and losses that came after. Whatever comes before the close belongs to the candidate, however long it has paused."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    rows = events.where("value is not null and user_id is not null and ts is not null").withWatermark("ts", delay)
    rows = rows.select(F.col("user_id").cast("long").alias("candidate"), "ts", F.unix_micros("ts").alias("us"), loss().alias("loss"))
    out = rows.groupBy("candidate").transformWithStateInPandas(Closing(gap_ms), CLOSED, outputMode="Append", timeMode="EventTime")
    return out.select("kind", "candidate", F.timestamp_micros("us").alias("ts"), "n", "mean", "var")


STORE = "spark.sql.streaming.stateStore.providerClass"


def live_audit(events: DataFrame, ledger: Ledger, checkpoint: str, delay: str = "1 hour", gap: str = "30 days"):
    """Start the live audit over all available rows of a stream; the caller awaits it."""
    conf = ledger.spark.conf
    was = conf.get(STORE, None)
    conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        return closed_candidates(events, delay, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(ledger).start()
    finally:
        conf.set(STORE, was) if was else conf.unset(STORE)


def dropped_rows(query) -> int:
    """Losses older than the watermark when they came, which Spark leaves out before any processor sees them."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
