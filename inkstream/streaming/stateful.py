"""Keyed state over micro-batches: admission by token bucket, and the state of a URL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkstream.operators.frontier import bucket_ttl


def _rows(pieces: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(pieces)).sort_values(order, kind="stable")  # one key's rows of one micro-batch


def stream_token_bucket(stream: DataFrame, key: str, order: str, micros: str, rate: float, burst: float, idle_out: bool = True) -> DataFrame:
    """(key, order, allowed) of a stream, as ``frontier.token_bucket`` of a table; rows of a micro-batch are taken in time order.

    With ``idle_out`` a bucket's state is dropped when it has been idle for ``bucket_ttl`` seconds; such a stream always has a timeout to wait
    for, so it runs until it is stopped, and one that is to end with what is there goes without. A row that comes in an earlier time than the last one finds
    the tokens as they are. The state of a key is two numbers. ``stream`` must give each row once."""

    def admit(k: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        rows = _rows(pieces, [micros, order])
        allowed = []
        for t in rows[micros].tolist():
            if last is not None:
                tokens = min(burst, tokens + max(0, t - last) / 1e6 * rate)
            last = t if last is None else max(t, last)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((float(tokens), int(last)))
        if idle_out:
            state.setTimeoutDuration(bucket_ttl(rate, burst) * 1000)
        yield pd.DataFrame({key: k[0], order: rows[order].to_numpy(), "allowed": allowed})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_out else GroupStateTimeout.NoTimeout
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, order)}
    rows = stream.select(key, order, micros).dropna(subset=[key, micros])
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean"
    return rows.groupBy(key).applyInPandasWithState(admit, out, "tokens double, last long", "append", timeout)


def stream_url_state(stream: DataFrame) -> DataFrame:
    """(url_id, attempts, last_outcome, failures, last_us) after each micro-batch that has attempts at a URL, in update mode.

    ``stream``: (id, url_id, outcome, us). The fold of ``crawl.fold_attempts``, kept as four values a URL; failures are counted since the last
    success in the order of arrival, within a micro-batch in time order. ``stream`` must give each attempt once."""

    def fold(k: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, outcome, failures, last = state.get if state.exists else (0, None, 0, -1)
        for o, t in _rows(pieces, ["us", "id"])[["outcome", "us"]].itertuples(index=False):
            o = o if isinstance(o, str) else None
            attempts, failures = attempts + 1, 0 if o == "success" else failures + 1
            if t >= last:
                outcome, last = o, int(t)
        state.update((attempts, outcome, failures, last))
        yield pd.DataFrame({"url_id": [k[0]], "attempts": [attempts], "last_outcome": [outcome], "failures": [failures], "last_us": [last]})

    rows = stream.select("id", "url_id", "outcome", "us").dropna(subset=["url_id", "us"])
    kind = stream.schema["url_id"].dataType.simpleString()
    kept = "attempts long, last_outcome string, failures long, last_us long"
    return rows.groupBy("url_id").applyInPandasWithState(fold, f"url_id {kind}, {kept}", kept, "update", GroupStateTimeout.NoTimeout)
