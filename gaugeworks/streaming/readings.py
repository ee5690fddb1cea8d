"""Continuous readings: contract, duplicates, future and late rows with reasons, one-shot disconnect alerts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gaugeworks.operators.contracts import finite
from gaugeworks.operators.evaluate import psi


@dataclass(frozen=True)
class Limits:
    """Seconds."""

    late: float = 300
    ahead: float = 5
    silent: float = 120
    keep: float = 86_400


def contract_broken():
    """Whether a row has no asset or no time, or a value that is not finite; a null value is a missing measurement."""
    return F.col("asset").isNull() | F.col("ts").isNull() | F.col("observed_at").isNull() | F.coalesce(F.isnan("value") | (F.abs("value") == float("inf")), F.lit(False))


def batch(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The batch twin: all rows with a reason (null: accepted). Rows: asset, ts, value, observed_at, seq.

    Checks come in the order contract, duplicate, future, late. A reading is a duplicate if an earlier one of its asset and
    time was accepted within the retention; dead rows count for nothing, so the first row that passes the other checks is accepted.
    """
    observed = F.unix_micros("observed_at")
    lag = (observed - F.unix_micros("ts")) / 1e6
    fine = ~contract_broken() & lag.between(-limits.ahead, limits.late)
    before = Window.partitionBy("asset", "ts").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(fine, F.struct("seq", observed.alias("observed")))).over(before)
    reason = F.when(contract_broken(), "contract").when(observed - first["observed"] <= limits.keep * 1e6, "duplicate").when(lag < -limits.ahead, "future").when(lag > limits.late, "late")
    return df.withColumn("reason", reason)


OUT = "asset string, ts long, value double, seq long, reason string, raw string"
READING = Row("asset", "ts", "value", "seq", "reason", "raw")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Asset(StatefulProcessor):
    """What is kept of an asset: for each time of an accepted reading when it was observed, as an entry of its own that goes when its
    time to live is over; the time of the reading accepted last (in order of arrival) and whether an alert is out; one timer.
    A batch reads and writes the entries of its own readings alone."""

    def __init__(self, limits: Limits, timer: bool, ttl: float) -> None:
        self.limits, self.timer, self.ttl = limits, timer, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "ts long", "observed long", ttlDurationMs=int(self.ttl * 1000))
        self.state = handle.getValueState("state", "last long, alerted boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        keep, now, known = self.limits.keep * 1e6, None, {}
        last, alerted = self.state.get() or (None, False)
        for r in sorted(rows, key=lambda r: r.seq):  # an asset's readings of one batch
            now = r.observed if now is None else max(now, r.observed if r.observed is not None else now)
            if r.broken:
                yield READING(key[0], r.ts, r.value, r.seq, "contract", r.raw)
                continue
            if r.ts not in known:
                known[r.ts] = self.seen.getValue((r.ts,))[0] if self.seen.containsKey((r.ts,)) else None
            lag, before = (r.observed - r.ts) / 1e6, known[r.ts]
            reason = "duplicate" if before is not None and r.observed - before <= keep else "future" if lag < -self.limits.ahead else "late" if lag > self.limits.late else None
            if reason is None:
                known[r.ts], last, alerted = r.observed, r.ts, False
                self.seen.updateValue((r.ts,), (r.observed,))
            yield READING(key[0], r.ts, r.value, r.seq, reason, None if reason is None else r.raw)
        if now is not None and last is not None and now - last > self.limits.silent * 1e6 and not alerted:
            alerted = True
            yield READING(key[0], last, None, None, "disconnect", None)
        self.state.update((last, alerted))
        if self.timer:
            for at in self.handle.listTimers():
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.limits.silent * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, alerted = self.state.get() or (None, False)
        if last is not None and not alerted:
            self.state.update((last, True))
            yield READING(key[0], last, None, None, "disconnect", None)

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, limits: Limits = Limits(), timer: bool = False, ttl: float | None = None) -> DataFrame:
    """Rows (asset, ts in microseconds, value, seq, reason, raw): accepted rows have no reason, dead ones theirs and the whole row as
    JSON, alerts `disconnect`.

    A dead row leaves no trace in the state. When a batch's last observation of an asset lies more than the limit behind its last
    accepted reading, the asset is told as disconnected, once, until a reading is accepted again. An asset that sends nothing at all
    is told by its timer, for which the query has to go on (see write_batches). Entries live for `ttl` seconds by the clock, as long
    as duplicates are looked for if not given; readings that are worked off later than that need more. The session keeps state in
    RocksDB, which holds each entry by itself; queries begun with another store go on with theirs."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    raw = F.to_json(F.struct(*stream.columns))
    rows = stream.select("asset", F.unix_micros("ts").alias("ts"), "value", F.unix_micros("observed_at").alias("observed"), "seq", contract_broken().alias("broken"), raw.alias("raw"))
    return rows.groupBy("asset").transformWithState(Asset(limits, timer, limits.keep if ttl is None else ttl), OUT, "append", "ProcessingTime")


def accepted_only(stream: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The cheap mode: the accepted rows alone, their duplicates dropped by a watermark, without reasons, alerts or Python.

    Two readings of one asset and time that both are neither late nor early are observed within late + ahead of each other, so the
    state of a reading goes after that. A row that arrives after rows observed so much later is dropped. Of duplicates within one
    batch any may stay."""
    lag = (F.unix_micros("observed_at") - F.unix_micros("ts")) / 1e6
    fine = stream.where(~contract_broken() & lag.between(-limits.ahead, limits.late))
    return fine.withWatermark("observed_at", f"{limits.late + limits.ahead} seconds").dropDuplicatesWithinWatermark(["asset", "ts"])


def write_batches(out: DataFrame, folder: str, checkpoint: str, **trigger):
    """Accepted rows, dead letters and alerts as three tables, and each batch's counts, observed while they are written; a batch that is
    run again replaces its own part. trigger: as for a stream's writer, all data at hand if none is given. With such an end, timers
    can only go off in batches with data."""
    trigger = trigger or {"availableNow": True}
    spark = out.sparkSession

    def write(df: DataFrame, batch_id: int) -> None:
        df, counts = df.persist(), {}
        for name, rows in (("accepted", df.where("reason is null")), ("dead", df.where("reason <> 'disconnect'")), ("alerts", df.where("reason = 'disconnect'"))):
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
            counts[name] = seen.get["n"]
        row = (counts["accepted"] + counts["dead"], counts["accepted"], counts["dead"])
        df.sparkSession.createDataFrame([row], COUNTS).write.mode("overwrite").parquet(f"{folder}/counts/batch_id={batch_id}")
        df.unpersist()

    ends = bool(trigger.get("availableNow") or trigger.get("once"))
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false" if ends else before)  # a query takes its own copy of the settings when it starts
    try:
        return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
    finally:
        spark.conf.set(empty, before)


COUNTS = "input_count long, accepted_count long, dead_letter_count long"


def throughput(query) -> list[tuple[int, int, float]]:
    """(batch, rows in, rows a second) of a query's recent batches with rows."""
    return [(p["batchId"], p["numInputRows"], p["processedRowsPerSecond"]) for p in query.recentProgress if p["numInputRows"]]


def batch_counts(checked: DataFrame) -> DataFrame:
    """One row on checked readings: input, accepted, dead letters."""
    return checked.agg(F.count("*").alias("input_count"), F.count_if(F.col("reason").isNull()).alias("accepted_count"), F.count("reason").alias("dead_letter_count"))


def drift_alerts(reference: DataFrame, accepted: DataFrame, measurement: str, value: str, threshold: float = 0.2, bins: int = 10, least: int = 5) -> DataFrame:
    """By measurement of the reference: population stability of a batch's accepted readings and the alert it calls for.

    Finite values only. Fewer than `least` on either side: no score and `drift_evidence_insufficient`. A constant reference
    scores 0 if all readings equal it, else ln(1e6). From the threshold on: `distribution_drift`.
    """
    tidy = lambda df: df.select(F.col(measurement).alias("m"), F.col(value).cast("double").alias("x"))
    good = lambda df: df.where(finite(F.col("x")))
    names, ref, cur = tidy(reference).select("m").distinct(), good(tidy(reference)), good(tidy(accepted))
    r = ref.groupBy("m").agg(F.count("*").alias("rn"), F.min("x").alias("low"), F.max("x").alias("high"))
    near = ref.groupBy("m").agg(F.min("x").alias("level"))
    c = cur.join(near, "m").groupBy("m").agg(F.count("*").alias("cn"), F.max(F.abs(F.col("x") - F.col("level")) - (1e-8 + 1e-5 * F.abs("level"))).alias("off"))
    scores = psi(ref, cur, "x", "m", bins).withColumnRenamed("psi", "varying")
    j = names.join(r, "m", "left").join(c, "m", "left").join(scores, "m", "left")
    enough = (F.coalesce("rn", F.lit(0)) >= least) & (F.coalesce("cn", F.lit(0)) >= least)
    score = F.when(enough, F.when(F.col("low") == F.col("high"), F.when(F.col("off") <= 0, 0.0).otherwise(math.log(1_000_000))).otherwise(F.col("varying")))
    alert = F.when(score.isNull(), "drift_evidence_insufficient").when(score >= threshold, "distribution_drift")
    return j.select(F.col("m").alias(measurement), F.coalesce("cn", F.lit(0)).alias("current_samples"), score.alias("psi"), alert.alias("alert"))
