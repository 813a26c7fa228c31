"""Messages of a queue that delivers at least once: applied once, and set aside after too many receives.

A queue hands a message out again until it is deleted. Both functions take a stream of what
was received and keep state by message across micro-batches; state that the watermark has
left behind is dropped, so that it grows with the messages of that time, not with the stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What a queue allows before it gives a message up, and how long it keeps one.
MAX_RECEIVES = 1
RETENTION = "4 days"
# State of so many buckets of messages; never change it under a checkpoint.
BUCKETS = 1024
DELIVER, DEAD_LETTER, GONE = "deliver", "dead letter", "gone"

_IDENTITY, _TIME = "__message", "__time"


def _time(at: str) -> Column:
    """When something came; what does not say so comes now."""
    return F.coalesce(F.col(at).cast("timestamp"), F.current_timestamp())


def _identified(messages: DataFrame, message_id: str, body: str | None) -> DataFrame:
    """A message without an id is known by its body."""
    own = F.concat(F.lit("i"), F.col(message_id).cast("string"))
    if body is None:
        return messages.withColumn(_IDENTITY, F.coalesce(own, F.lit("n")))
    return messages.withColumn(_IDENTITY, F.coalesce(own, F.concat(F.lit("b"), F.md5(F.coalesce(F.col(body), F.lit(""))))))


def once(messages: DataFrame, message_id: str = "message_id", at: str = "sent_at", within: str = RETENTION, body: str | None = None) -> DataFrame:
    """The first delivery of each message, in a stream or a batch.

    A copy counts as such if it comes within ``within`` (an interval) of the first one, by the
    times ``at`` (a null one is now); a stream keeps no ids for longer, and drops what is older
    than the watermark. In a batch, all copies go.
    """
    named = _identified(messages, message_id, body)
    if not messages.isStreaming:
        return named.dropDuplicates([_IDENTITY]).drop(_IDENTITY)
    timed = named.withColumn(_TIME, _time(at)).withWatermark(_TIME, within)
    return timed.dropDuplicatesWithinWatermark([_IDENTITY]).drop(_IDENTITY, _TIME)


def count_receives(
    receipts: DataFrame,
    message_id: str = "message_id",
    at: str = "received_at",
    limit: int = MAX_RECEIVES,
    keep: str = RETENTION,
    late: str = "0 seconds",
    body: str | None = None,
) -> DataFrame:
    """A stream of receipts with ``receives`` (how often the message has been received by then) and ``action``.

    The first ``limit`` receives of a message are to be delivered, the next one makes it a dead
    letter, after that it is gone. Receives more than ``keep`` apart are of different messages.
    Receipts of one micro-batch are counted in order of ``at``; those older than the watermark
    (the latest time seen, less ``late``) are dropped, as in any windowed stream.

    Messages are dealt to buckets, whose state stands together: a call for each message would
    take most of the time. A task holds the receipts that one bucket has in one micro-batch, with
    what is kept of its messages; the cap of the source and ``keep`` bound them.
    """
    span = int(receipts.sparkSession.sql(f"SELECT CAST(INTERVAL '{keep}' AS INTERVAL DAY TO SECOND) AS i").first().i.total_seconds() * 1_000_000)
    columns = list(receipts.columns)

    def store(state: GroupState, held: dict) -> None:
        """Keep the messages that the watermark has not left behind, until it leaves the next one."""
        passed = state.getCurrentWatermarkMs()
        held = {message: seen for message, seen in held.items() if (seen[1] + span) // 1000 >= passed}
        if held:
            state.update((json.dumps(held),))
            state.setTimeoutTimestamp(min(last + span for _, last in held.values()) // 1000 + 1)
        elif state.exists:
            state.remove()

    def count(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if state.hasTimedOut:
            store(state, held)
            return
        rows = pd.concat(list(frames)).sort_values(["__at", *columns[:1]], kind="stable")
        counted = []
        for message, now in zip(rows[_IDENTITY].tolist(), rows["__at"].tolist()):
            receives, last = held.get(message, (0, None))
            receives = 1 if last is None or now - last > span else receives + 1
            held[message] = (receives, now if last is None else max(now, last))
            counted.append(receives)
        store(state, held)
        rows["receives"] = counted
        rows["action"] = [DELIVER if n <= limit else DEAD_LETTER if n == limit + 1 else GONE for n in counted]
        yield rows[[*columns, "receives", "action"]]

    named = _identified(receipts, message_id, body).withColumn(_TIME, _time(at)).withWatermark(_TIME, late).withColumn("__at", F.unix_micros(_TIME))
    schema = T.StructType([*receipts.schema.fields, T.StructField("receives", T.LongType()), T.StructField("action", T.StringType())])
    dealt = named.withColumn("__bucket", F.pmod(F.xxhash64(_IDENTITY), F.lit(BUCKETS)))
    return dealt.groupBy("__bucket").applyInPandasWithState(count, schema, "held string", "append", GroupStateTimeout.EventTimeTimeout)
