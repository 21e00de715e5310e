"""The life of a job as one stream: a masked submission, its attempts, the retry, the final status.

Submissions and attempts are joined as streams, each with a watermark, and a keyed state decides when a job
is settled. What is held is bounded by the jobs that are open, never by those that ever were: join rows go
when the watermark passes the time in which attempts may come, the attempts of a job go when it is settled, and a timer
removes the mark that it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veritally.streaming.jobs import ATTEMPTS_PER_JOB, keep_state_on_disk

ATTEMPT = "job_id string, attempt int, unreadable boolean, result_json string, error string, attempted_at timestamp"
STATUS = "job_id string, status string, result_json string, error string, attempts int"

Try = tuple[bool, str | None, str | None]


def settled(tries: dict[int, Try], most: int, closed: bool) -> tuple[str, str | None, str | None, int] | None:
    """(status, result, error, attempts) once nothing that may still come can change it, or when the job is closed.

    The first success wins; else the last message stands. An unreadable payload is an error at once. A success counts only
    when all earlier attempts are known, since they may come later than it does.
    """
    if 1 in tries and tries[1][0]:
        return "error", None, tries[1][2], 1
    won = min((a for a, (_, _, error) in tries.items() if error is None), default=None)
    if won is not None and (closed or all(a in tries for a in range(1, won))):
        return "done", tries[won][1], None, won
    if closed and not tries:
        return "error", None, "never attempted", 0
    if closed or (won is None and all(a in tries for a in range(1, most + 1))):
        return "error", None, tries[max(tries)][2], max(tries)
    return None


class Settling(StatefulProcessor):
    """Collects the attempts of a job until its outcome is certain, emits it once, and forgets the job after its time."""

    def __init__(self, most: int, patience_ms: int):
        self.most, self.patience_ms = most, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value per job, read and written once a batch: every use of a state is a message to the JVM.
        self.job = handle.getValueState("job", "done boolean, tries string")

    def _known(self, job) -> dict[int, Try]:
        return {int(a): tuple(t) for a, t in json.loads(job[1]).items()} if job else {}

    def _row(self, key, outcome) -> Row:
        status, result, error, attempts = outcome
        return Row(job_id=key[0], status=status, result_json=result, error=error, attempts=attempts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        job = self.job.get()
        if job and job[0]:
            return  # a late attempt, or the submission once more
        known = self._known(job)
        new, closed = job is None, False
        for row in rows:
            if new:
                self.handle.registerTimer(int(row.submitted_ms) + self.patience_ms)
                new = False
            if row.attempt is None:
                closed = True  # the join has given up: no attempt came in time
                continue
            if row.attempt > self.most or (row.unreadable and row.attempt > 1) or row.attempt in known:
                continue
            known[row.attempt] = (bool(row.unreadable), row.result_json, row.error)
        outcome = settled(known, self.most, closed)
        self.job.update((outcome is not None, json.dumps({} if outcome else known)))
        if outcome is not None:
            yield self._row(key, outcome)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        job = self.job.get()
        self.job.clear()
        if not (job and job[0]):
            yield self._row(key, settled(self._known(job), self.most, True))

    def close(self) -> None:
        pass


def job_flow(
    stored: DataFrame, attempts: DataFrame, patience: str = "1 hour", delay: str = "10 minutes", max_attempts: int = ATTEMPTS_PER_JOB
) -> DataFrame:
    """One row per job when it is settled: done, error or rejected.

    `stored` is the stream of masked submissions (what stream_sanitize writes), `attempts` that of the workers (ATTEMPT).
    An attempt counts when it was made within `patience` of the submission; events may come `delay` late.
    A job with too few attempts by then is an error with its last message, one without any was never attempted.
    """
    keep_state_on_disk(stored.sparkSession)
    patience_ms = int(stored.sparkSession.sql(f"SELECT timestampdiff(MILLISECOND, timestamp'2000-01-01', timestamp'2000-01-01' + interval {patience})").first()[0])
    queued = stored.filter("status = 'queued'").select("job_id", "submitted_at").withWatermark("submitted_at", delay)
    tried = attempts.select(F.col("job_id").alias("tried_job"), "attempt", "unreadable", "result_json", "error", "attempted_at").withWatermark("attempted_at", delay)
    in_time = F.expr(f"job_id = tried_job AND attempted_at >= submitted_at AND attempted_at <= submitted_at + interval {patience}")
    joined = queued.join(tried, in_time, "leftOuter").select(
        "job_id", "submitted_at", F.unix_millis("submitted_at").alias("submitted_ms"), "attempt", "unreadable", "result_json", "error"
    )
    outcomes = joined.groupBy("job_id").transformWithState(
        Settling(max_attempts, patience_ms), outputStructType=STATUS, outputMode="append", timeMode="eventTime"
    )
    refused = stored.filter("status = 'rejected'").select(
        "job_id", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("result_json"), "error", F.lit(0).alias("attempts")
    )
    return outcomes.unionByName(refused)
