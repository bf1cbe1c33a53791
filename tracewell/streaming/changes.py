"""Change events as streams: debounced bursts, the latest change per path, replayed into tables.

The same functions serve batch and streaming frames: a stream needs a watermark on its time column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.functions.paths import gate_path
from tracewell.operators.dml import latest_changes, replace_by_key


def bursts(events: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """key, started, n: one row per burst of a key's events (key, ts); a burst ends when none follows within ``quiet``."""
    out = events.groupBy("key", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("started"), "n")


def dispatch(path, groups: dict[str, list[str]], fallback: str = "other"):
    """Which group of path prefixes an event belongs to; the first group in order counts."""
    out = None
    for name, prefixes in groups.items():
        for p in prefixes:
            hit = (path == p) | path.startswith(p.rstrip("/") + "/")
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(fallback) if out is None else out.otherwise(fallback)


def apply_changes(read_table: Callable[[], DataFrame], write_table: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that brings a table (path, content) up to date with the batch's last change per path.

    Replaying a batch gives the same table, so a retry after a failure does no harm.
    """

    def run(batch: DataFrame, _: int) -> None:
        last = latest_changes(batch)
        old = read_table()
        kept = old.join(last.select("path"), "path", "left_anti")
        changed = last.where("kind <> 'deleted'").select("path", "content")
        write_table(replace_by_key(kept, changed, ["path"]))

    return run


TOKEN_STATE = "operation string, files array<string>, used array<string>, expires double"
TOKEN_OUT = "event_id long, token string, ok boolean, error string"


def _consume(state: tuple, row, files: list[str], used: list[str]) -> str:
    operation, _, _, expires = state
    if row.ts >= expires:
        return "missing"
    if row.operation != operation:
        return "operation"
    if row.p not in files:
        return "path"
    return "used" if row.p in used else ""


def token_states(ttl: float = 900.0, timeouts: bool = True):
    """A stateful function for ``applyInPandasWithState``: issue and consume events of one token, in time order.

    Its state is one token's plan and what is used of it; it goes when all is used or the token has expired.
    """
    life = max(float(ttl), 1.0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one token's events of one micro-batch
        held = state.get if state.exists else None
        out = []
        for row in rows.itertuples():
            if row.kind == "issue":
                if held is None:
                    held = (row.operation, sorted({f for f in row.clean if f}), [], float(row.ts) + life)
                continue
            error = "missing" if held is None else _consume(held, row, held[1], held[2])
            if not error:
                held = (held[0], held[1], [*held[2], row.p], held[3])
                if set(held[2]) >= set(held[1]):
                    held = None
            out.append((row.event_id, key[0], not error, error))
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            if timeouts:
                state.setTimeoutDuration(int(life * 1000))
        yield pd.DataFrame(out, columns=["event_id", "token", "ok", "error"])

    return run


def consume_tokens(events: DataFrame, ttl: float = 900.0, timeouts: bool = True) -> DataFrame:
    """The stream of decisions on a stream of events (event_id, token, kind, operation, files, path, ts).

    ``timeouts`` removes expired tokens by the clock; such a query runs until it is stopped. A query that ends when
    its input does, over a log, has none: there an expired token is only refused.
    """
    clean = events.withColumn("clean", F.transform(F.coalesce("files", F.array().cast("array<string>")), gate_path)).withColumn("p", F.coalesce(gate_path(F.col("path")), F.lit("")))
    clean = clean.select("event_id", "token", "kind", "operation", "clean", "p", "ts")
    kind = GroupStateTimeout.ProcessingTimeTimeout if timeouts else GroupStateTimeout.NoTimeout
    return clean.groupBy("token").applyInPandasWithState(token_states(ttl, timeouts), TOKEN_OUT, TOKEN_STATE, "append", kind)


class RuleCache:
    """A table that is read again after ``ttl`` seconds or when it is invalidated, for stream-static joins."""

    def __init__(self, load: Callable[[], DataFrame], ttl: float = 300.0, clock: Callable[[], float] | None = None):
        import time

        self.load, self.ttl, self.clock = load, ttl, clock or time.monotonic
        self.held: DataFrame | None = None
        self.read_at = 0.0

    def get(self) -> DataFrame:
        if self.held is None or self.clock() - self.read_at >= self.ttl:
            self.invalidate()
            self.held, self.read_at = self.load().persist(), self.clock()
        return self.held

    def invalidate(self) -> None:
        if self.held is not None:
            self.held.unpersist()
        self.held = None
