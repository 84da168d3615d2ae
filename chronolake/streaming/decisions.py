"""State that streams keep by instrument: decisions of the frozen rule and their fills, and labels that mature."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DECISION = "day date, kind string, at timestamp, target int, reason string, quantity int, price decimal(18,6), position int"
_STATE = "closes array<decimal(18,6)>, days array<date>, pending_day date, pending_target int, position int, last timestamp"


def decide(stream: DataFrame, key: str, lookback: int, units: int, cost: str) -> DataFrame:
    """key, day, kind (decision or fill), at, target, reason, quantity, price, position of a stream of session events.

    stream: key, day, kind (open or close), available_at, price (decimal), next_day (of a close: the next declared session, or null).  A
    close adds to the history and decides for the next session's open: warmup, no_next_declared_session, or a target of 1 where
    close * n > sum of n closes, else 0.  The open of that very session fills the difference to target * ``units`` at price * cost (a sale
    at price / cost); an open of another session drops the intent: missed_next_session_open.  Events of a key must come in the order of
    available_at over batches; inside a batch they are sorted, an open before a close of one instant, and one that is not later than
    the last batch's is late: it changes nothing and gives the reason late_event.  State is ``lookback`` closes a key."""
    factor = Decimal(cost)
    id_type = stream.schema[key].dataType.simpleString()

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, days, due, aim, held, last = state.get if state.exists else ([], [], None, None, 0, None)
        closes, days, out = list(closes), list(days), []
        before = last
        events = pd.concat(list(frames))
        events["_first"] = events["kind"] != "open"
        for e in events.sort_values(["available_at", "_first", "day"], kind="stable").itertuples():
            row = {key: name[0], "day": e.day, "kind": "fill" if e.kind == "open" else "decision", "at": e.available_at, "target": None, "reason": None, "quantity": None, "price": None, "position": held}
            if before is not None and e.available_at <= before:
                out.append(row | {"reason": "late_event"})
                continue
            last = e.available_at.to_pydatetime()
            if e.kind == "open":
                if aim is None:
                    continue
                if e.day != due:
                    out.append(row | {"target": aim, "reason": "missed_next_session_open"})
                elif wanted := aim * units - held:
                    held += wanted
                    price = e.price * factor if wanted > 0 else e.price / factor
                    out.append(row | {"target": aim, "quantity": wanted, "price": price.quantize(Decimal("0.000001")), "position": held})
                due = aim = None
                continue
            closes, days = [*closes, e.price][-lookback:], [*days, e.day][-lookback:]
            if len(closes) < lookback:
                row["reason"] = "warmup"
            elif e.next_day is None or pd.isna(e.next_day):
                row["reason"] = "no_next_declared_session"
            else:
                due, aim = e.next_day, int(e.price * lookback > sum(closes))
                row["target"] = aim
            out.append(row)
        state.update((closes, days, due, aim, held, last))
        columns = [key, *(c.split()[0] for c in DECISION.replace("decimal(18,6)", "decimal").split(", "))]
        yield pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("target", "quantity", "position")})

    rows = stream.select(F.col(key), "day", "kind", "available_at", F.col("price").cast("decimal(18,6)").alias("price"), "next_day")
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {id_type}, {DECISION}", _STATE, "append", GroupStateTimeout.NoTimeout)


def mature(stream: DataFrame, key: str, delay: str, keep_days: int = 30) -> DataFrame:
    """key, state, at of a stream of predictions and their outcomes: awaiting_outcome once the label's end has passed without one.

    stream: key, kind (prediction or outcome), event_at, label_end (of a prediction), status (of an outcome).  A timer of event time fires when the
    watermark, ``delay`` behind the latest event, has passed label_end.  An outcome is given out as its status when it comes, and so is a
    correction; a validated one before label_end is not_matured and counts for nothing.  A prediction is forgotten ``keep_days``
    after its label's end; an outcome of none, or of a forgotten one, is unknown_prediction.  The first prediction of a key stays."""
    id_type = stream.schema[key].dataType.simpleString()

    keep = timedelta(days=keep_days)

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end, status, over = state.get if state.exists else (None, None, False)
        mark, out = pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms").to_pydatetime(), []
        if end is not None and not over and mark >= end:
            over = True
            if status is None:
                out.append((name[0], "awaiting_outcome", end))
        if over and mark >= end + keep:
            end, status, over = None, None, False
        if not state.hasTimedOut:
            events = pd.concat(list(frames))
            events["_second"] = events["kind"] != "prediction"
            for e in events.sort_values(["event_at", "_second"], kind="stable").itertuples():
                if e.kind == "prediction":
                    end = e.label_end.to_pydatetime() if end is None and not pd.isna(e.label_end) else end
                    continue
                early = e.status == "validated" and end is not None and e.event_at < end
                status = status if end is None or early else e.status
                out.append((name[0], "unknown_prediction" if end is None else "not_matured" if early else e.status, e.event_at))
        if end is not None:
            state.update((end, status, over))
            next_ = pd.Timestamp(end + keep if over else end, tz="UTC")
            state.setTimeoutTimestamp(max(int(next_.timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "state", "at"]).astype({"at": "datetime64[ns]"})

    rows = stream.withWatermark("event_at", delay).select(key, "kind", "event_at", "label_end", "status")
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {id_type}, state string, at timestamp", "label_end timestamp, status string, matured boolean", "append", GroupStateTimeout.EventTimeTimeout)


def rows_of_instants(stream: DataFrame, keys: list[str], available_at: str, delay: str) -> DataFrame:
    """The rows themselves, each once the watermark has passed its instant, with group_rows: how many share keys and instant.

    Rows meet their group's count in a stream-to-stream join on keys and instant, so a group is delivered whole and no row is
    collected into another's; ``delay`` bounds how late its rows may come, and state is dropped behind it."""
    marked = stream.withWatermark(available_at, delay)
    counts = marked.groupBy(*keys, F.unix_micros(available_at).alias("_at"), F.window(available_at, "1 millisecond").alias("_w")).agg(F.count("*").alias("group_rows"))
    counts = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.window_time("_w").alias("_t"), "_at", "group_rows")  # after its watermark, so never late itself
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.unix_micros(available_at) == F.col("_at")]
    near = F.col("_t").between(F.col(available_at) - F.expr("INTERVAL 1 SECOND"), F.col(available_at) + F.expr("INTERVAL 1 SECOND"))  # bounds the state
    return marked.join(counts, [*same, near]).drop(*[f"_{k}" for k in keys], "_t", "_at")
