"""Alert rules on a stream, with their hold times: pending, firing and resolved as the windows close.

Two queries, since Spark allows no state with timers behind an aggregation. The first one aggregates the log into windows,
one length for each kind of rule; a window is written once the watermark has passed its end, so late rows have had their
time. The second one follows the written windows with a state per rule, kept under its checkpoint: since when the
rule has been broken, and until when that is known. A timer at the next window's end resolves the rule if nothing came
by then - a window in which the rule is kept sends no row, and neither does one without requests - so a rule falls back
without rows of its own. Both queries go on where they stopped when they are started again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import fixed_values as V
from ..operators import monitor as M

WINDOWS = "window_end timestamp, alerts array<string>"
STATES = "alert string, window_end timestamp, since timestamp, state string"
KEPT = "since timestamp, until timestamp"


def closed_windows(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(window_end, alerts): the windows of every length that some rule uses, with the rules of that length they break."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    parts = None
    for length in sorted(set(M.ALERT_WINDOWS.values())):
        rules = [r for r, w in M.ALERT_WINDOWS.items() if w == length]
        w = M.with_alerts(M.alert_windows_direct(timed, length)).select(
            "window_end", F.filter("alerts", lambda a: a.isin(rules)).alias("alerts"))
        parts = w if parts is None else parts.unionByName(w)
    return parts


def follow_rules(windows: DataFrame, slide_minutes: int = 5) -> DataFrame:
    """(alert, window_end, since, state): a row for each broken window of a rule and one when the rule is kept again.

    A rule is pending, and firing once it has been broken for its hold time: the rows of ``monitor.alert_states``.
    "resolved" stands at the first window end at which the rule was no longer broken. Windows must arrive in the order of
    their ends, as ``closed_windows`` writes them.
    """
    step = pd.Timedelta(minutes=slide_minutes)
    hold = {name: pd.Timedelta(minutes=rule[4]) for name, rule in V.ALERT_RULES.items()}

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, out = key[0], []
        since, until = (pd.Timestamp(x) for x in state.get) if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((name, until + step, since, "resolved"))
            state.remove()
        else:
            for at in sorted({x for part in parts for x in part["at"]}):
                if until is not None and at != until + step:
                    out.append((name, until + step, since, "resolved"))
                    since = None
                since, until = at if since is None else since, at
                out.append((name, at, since, "firing" if at - since >= hold[name] else "pending"))
            state.update((since.to_pydatetime(), until.to_pydatetime()))
            state.setTimeoutTimestamp(int((until + step).tz_localize("UTC").timestamp() * 1000) - 1)
        if out:
            yield pd.DataFrame(out, columns=["alert", "window_end", "since", "state"])

    broken = windows.withWatermark("window_end", "0 seconds").select(F.explode("alerts").alias("alert"), F.col("window_end").alias("at"))
    return broken.groupBy("alert").applyInPandasWithState(follow, STATES, KEPT, "append", GroupStateTimeout.EventTimeTimeout)


def start_alerts(log: DataFrame, root: str, late: str = "10 minutes", **trigger) -> list[StreamingQuery]:
    """Both queries, with windows, states and checkpoints under ``root``. Without a trigger the log is followed to its present
    end and no further, the first query before the second."""
    spark: SparkSession = log.sparkSession
    once = not trigger

    def start(df: DataFrame, name: str) -> StreamingQuery:
        q = (df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/checkpoints/{name}")
             .trigger(**(trigger or {"availableNow": True})).start(f"{root}/{name}"))
        if once:
            q.awaitTermination()
        return q

    first = start(closed_windows(log, late), "windows")
    return [first, start(follow_rules(spark.readStream.schema(WINDOWS).parquet(f"{root}/windows")), "states")]
