"""Collection in rounds that can be broken off: every round is committed once.

Round 1 sends every cell (prompt, system); each later one sends the cells whose
latest attempt was blocked, while they have attempts left. A round's answers
are the outcome of one unit of a commit log, so that a run that starts again
finds the rounds that were done, works out the queue from them and goes on; an
answer that was committed is not asked for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commit_log import CommitLog
from . import collect as CO

ANSWERS = "prompt_id long, system string, attempt long, response string, blocked boolean, latency_s double"


class Rounds:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def attempts(self) -> DataFrame:
        """Answers of all committed rounds."""
        return self.log.read_all(ANSWERS)

    def queue(self, cells: DataFrame, done: int, max_attempts: int) -> DataFrame:
        """(prompt_id, system, attempt) of the next round."""
        if not done:
            return cells.select("prompt_id", "system", F.lit(1).cast("long").alias("attempt"))
        # a round asks for the attempt of its number, so only the last one's answers can be blocked now
        last = self.log.read_all(ANSWERS, [self._unit(done)])
        return last.where(F.col("blocked") & (F.col("attempt") < max_attempts)).select(
            "prompt_id", "system", (F.col("attempt") + 1).alias("attempt"))

    @staticmethod
    def _unit(number: int) -> str:
        return f"round-{number:04d}"

    def run(self, cells: DataFrame, send: Callable[[DataFrame], DataFrame], *, max_attempts: int = 4) -> DataFrame:
        """Rounds until nothing is left to send. ``send`` answers a queue; returns all answers."""
        done = len(self.log.units())
        while done < max_attempts:
            queue = self.queue(cells, done, max_attempts)
            if queue.isEmpty():
                break
            answers = send(queue).select("prompt_id", "system", F.col("attempt").cast("long").alias("attempt"), "response", "blocked", "latency_s")
            self.log.write(self._unit(done + 1), answers)
            done += 1
        return self.attempts()

    def latest(self) -> DataFrame:
        """The consolidated result: latest attempt, status and latency of every cell."""
        slim = CO.with_status(self.attempts()).select("prompt_id", "system", "attempt", "status", "latency_s")
        return CO.latest_status(slim)
