"""The mask-then-restore protocol as a stream: one state for each (system, payload id).

States hold originals, so they are sealed with the configuration's secret before they leave the worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakwork.operators.restoring import masked_again, restore
from cloakwork.operators.sealing import open_bytes, seal_bytes
from cloakwork.plans.engine import Engine, compiled, entries_of, entry_rows

RESULT = "payload_id string, seq bigint, direction string, result string, status int, code string"
STATE = "mapping binary"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def step(mapping: dict | None, payload: str, mask, may_restore: bool) -> tuple[dict | None, str, str | None, int, str | None]:
    """(mapping, direction, result, status, code) of one request; a mapping is created once and never changed."""
    if mapping is None:
        masked, entries, _ = mask(payload)
        made = {"original_hash": _hash(payload), "masked_hash": _hash(masked), "entries": entry_rows(entries)}
        return made, "mask", masked, 200, None
    entries, digest = entries_of(mapping["entries"]), _hash(payload)
    if digest == mapping["original_hash"]:
        return mapping, "mask", masked_again(payload, entries), 200, None
    if not may_restore:
        return mapping, "error", None, 403, "DEMASK_FORBIDDEN"
    exact = digest == mapping["masked_hash"]
    return mapping, "demask_exact" if exact else "demask_substitute", restore(payload, entries, exact), 200, None


def process_stream(requests: DataFrame, engine: Engine, system: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """(payload_id, seq, direction, result, status, code) of a stream (payload_id, seq, payload).

    Requests of one id in a batch are taken by seq. With ttl_ms a mapping ends that long (processing time) after it was
    made, however often it is read.
    """
    name = engine._system(system)
    blob, may_restore, secret = engine.blob, engine.config.system(name).demask, engine.config.secret

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = compiled(blob)
        mapping = json.loads(open_bytes(secret, bytes(state.get[0]))) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["seq", "payload"], kind="stable")
        out = []
        for seq, payload in zip(rows["seq"], rows["payload"], strict=True):
            had = mapping is not None
            mapping, *answer = step(mapping, payload or "", lambda t: held.mask(t, name), may_restore)
            if not had:
                state.update((seal_bytes(secret, json.dumps(mapping).encode()),))
                if ttl_ms:
                    state.setTimeoutDuration(ttl_ms)
            out.append((key[0], seq, *answer))
        yield pd.DataFrame(out, columns=["payload_id", "seq", "direction", "result", "status", "code"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    valid = requests.filter(F.trim("payload_id") != "")
    return valid.select("payload_id", "seq", "payload").groupBy("payload_id").applyInPandasWithState(run, RESULT, STATE, "append", timeout)


def windowed_rates(log: DataFrame, every: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests a second by window and route, for a stream of (ts, route) with late rows up to `late`."""
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    counted = log.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "route").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "route", "n", (F.col("n") / seconds).alias("rate"))
