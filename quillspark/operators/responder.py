"""Batch responder: a user function is applied to every (prompt, system)
pair in Arrow batches (``mapInPandas``); an exception becomes an error value
on that row, never a job failure. Systems are data (a column expanded in-row),
restricted to an allowed set by membership."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SYSTEMS = ["sys_a", "sys_b", "sys_c", "sys_retired"]
ALLOWED = ["sys_a", "sys_b", "sys_c"]
MIN_PROMPT = 15

OUT_SCHEMA = "prompt_id long, system string, response string, error string"


def echo_responder(prompt: str, system: str) -> str:
    """Deterministic local responder used in tests (no network client ships)."""
    if prompt is None or len(prompt) < MIN_PROMPT:
        raise ValueError("prompt too short")
    return f"{system}: {prompt}"


def _apply(fn: Callable[[str, str], str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            resp, err = [], []
            for p, s in zip(b["prompt"], b["system"]):
                try:
                    resp.append(fn(p, s))
                    err.append(None)
                except Exception as e:  # noqa: BLE001 - errors are values here
                    resp.append(None)
                    err.append(f"ERROR: {e}")
            yield pd.DataFrame({"prompt_id": b["prompt_id"], "system": b["system"], "response": resp, "error": err})
    return run


def batch_responder(prompts: DataFrame, *, systems=DEFAULT_SYSTEMS, allowed=ALLOWED,
                    fn: Callable[[str, str], str] = echo_responder) -> DataFrame:
    pairs = prompts.select("prompt_id", "prompt", F.explode(F.array(*[F.lit(s) for s in systems])).alias("system"))
    pairs = pairs.filter(F.col("system").isin(*allowed))
    return pairs.mapInPandas(_apply(fn), OUT_SCHEMA)
