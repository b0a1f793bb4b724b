"""Responses that arrive in frames: correlated, limited, joined whole, and only then protected and given out.

A frame is a row (response_id, frame_seq, position, choice_index, channel, text, ...). Finished responses are joined by
grouped operators; live ones by a stateful processor that keeps frames until a terminal frame or an idle timeout.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.model import InspectionLimits


def correlate(frames: DataFrame) -> DataFrame:
    """Adds ``choice`` and ``failure_code``. All frames numbered: by choice_index; none: by position, of the same count
    in each frame; mixed, or an index twice in a frame and channel: TRANSFORMATION_CONFLICT."""
    one = frames.groupBy("response_id", "frame_seq").agg(
        F.count("*").alias("n"), F.count("choice_index").alias("numbered"), F.countDistinct("position").alias("arity"), F.count_distinct("channel", "choice_index").alias("distinct"), F.countDistinct("channel", "position").alias("places")
    )
    whole = one.groupBy("response_id").agg(F.sum("n").alias("n"), F.sum("numbered").alias("numbered"), F.countDistinct("arity").alias("arities"), F.max(F.col("numbered") > F.col("distinct")).alias("twice"), F.max(F.col("n") > F.col("places")).alias("again"))
    bad = F.when(F.col("numbered") == 0, (F.col("arities") > 1) | F.col("again")).otherwise((F.col("numbered") < F.col("n")) | F.col("twice"))
    judged = whole.select("response_id", (F.col("numbered") > 0).alias("_by_index"), F.when(bad, "TRANSFORMATION_CONFLICT").alias("failure_code"))
    return frames.join(judged, "response_id").withColumn("choice", F.when(F.col("_by_index"), F.col("choice_index")).otherwise(F.col("position").cast("long"))).drop("_by_index")


def join_text(frames: DataFrame, order: str = "frame_seq") -> DataFrame:
    """The text of each response, choice and channel; null fragments add nothing, and all null is null."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(order, "position", "text"))))
    grouped = frames.groupBy("response_id", "choice", "channel").agg(parts.alias("parts"), F.first("failure_code", ignorenulls=True).alias("failure_code"), F.max(order).alias("last_seq"))
    joined = F.when(F.size("parts") > 0, F.array_join(F.transform("parts", lambda x: x["text"]), ""))
    return grouped.select("response_id", "choice", "channel", "last_seq", F.when(F.col("failure_code").isNull(), joined).alias("text"), "failure_code")


def merge_fragments(fragments: Column, blank_is_empty: bool = False) -> Column:
    """Fragments that repeat what came before count once (cumulative), others are appended (delta)."""

    def step(acc: Column, x: Column) -> Column:
        none = acc.rlike(r"\A\p{javaWhitespace}*\z") if blank_is_empty else acc == ""
        same = x.rlike(r"\A\p{javaWhitespace}*\z") if blank_is_empty else x == ""
        return F.when(none, x).when(same, acc).when(F.startswith(x, acc), x).when(F.startswith(acc, x), acc).otherwise(F.concat(acc, x))

    return F.aggregate(F.filter(fragments, lambda x: x.isNotNull()), F.lit(""), step)


def merge_tool_calls(calls: DataFrame) -> DataFrame:
    """(response_id, frame_seq, position, id, name, arguments): by id if all calls of a response have one, else by
    position, one call a frame; name and id must agree. Adds ``failure_code``."""
    whole = calls.groupBy("response_id").agg((F.count("*") == F.count("id")).alias("by_id"), F.max(F.col("position")).alias("most"))
    keyed = calls.join(whole, "response_id").withColumn("_key", F.when(F.col("by_id"), F.col("id")).otherwise(F.concat(F.lit("#"), F.col("position").cast("string"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_seq", "position", "arguments"))), lambda x: x["arguments"])
    merged = keyed.groupBy("response_id", "_key").agg(F.max("id").alias("id"), F.max("name").alias("name"), merge_fragments(ordered, True).alias("arguments"), (F.countDistinct("name") > 1).alias("names"), (F.countDistinct("id") > 1).alias("ids"), F.bool_or(~F.col("by_id") & (F.col("most") > 0)).alias("many"))
    bad = F.col("names") | F.col("ids") | F.col("many")
    return merged.select("response_id", "id", "name", F.when(~bad, F.col("arguments")).alias("arguments"), F.when(bad, "TRANSFORMATION_CONFLICT").alias("failure_code"))


def replace_last(frames: DataFrame, protected: DataFrame, order: str = "frame_seq") -> DataFrame:
    """The protected text stands on the last frame of a response, choice and channel; earlier frames lose theirs."""
    keys = ["response_id", "choice", "channel"]
    joined = frames.drop("text", "failure_code").join(protected.select(*keys, "last_seq", "text"), keys)
    return joined.withColumn("text", F.when(F.col(order) == F.col("last_seq"), F.col("text"))).drop("last_seq")


def first_breach(frames: DataFrame, limits: InspectionLimits | None = None, key: str = "response_id", order: str = "frame_seq", media: str | None = None) -> DataFrame:
    """(response, first_breach): the first frame at which frames, characters or media bytes pass a limit."""
    limits = limits or InspectionLimits()
    line = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    chars, size = F.length(F.coalesce("text", F.lit(""))), F.coalesce(F.col(media), F.lit(0)) if media else F.lit(0)
    ran = frames.select(key, order, F.count("*").over(line).alias("n"), F.sum(chars).over(line).alias("chars"), F.sum(size).over(line).alias("bytes"))
    over = (F.col("n") > limits.max_frames) | (F.col("chars") > limits.max_characters) | (F.col("bytes") > limits.max_media_bytes)
    return ran.where(over).groupBy(key).agg(F.min(order).alias("first_breach"))


def media_bytes(data: Column, is_text: Column) -> Column:
    """Bytes of a media item; a character of text counts four."""
    return F.when(is_text, 4 * F.length(data)).otherwise(F.octet_length(data))


def idle_gaps(frames: DataFrame, key: str, at: str, idle_seconds: float = 60.0) -> DataFrame:
    """(key, gaps): how often a stream was silent longer than allowed; the whole may last any time."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at))
    gap = F.col("_at").cast("timestamp").cast("double") - F.col("_before").cast("timestamp").cast("double")
    return frames.select(key, F.col(at).alias("_at"), before.alias("_before")).groupBy(key).agg(F.count_if(gap > idle_seconds).alias("gaps"))


def doubled_calls(calls: DataFrame) -> DataFrame:
    """Identities (response_id, id) that occur both in messages and in metadata."""
    one = lambda s: calls.where(F.col("source") == s).select("response_id", "id")
    return one("message").intersect(one("metadata"))


def merge_metadata(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reasoning metadata of a response by key: strings merged like fragments; strings mixed with others fail.

    ``frames``: response_id, frame_seq, name, value (text), is_string."""
    some = frames.where(F.col("name").isin(list(keys)))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame_seq", "value"))), lambda x: x["value"])
    merged = some.groupBy("response_id", "name").agg(merge_fragments(ordered).alias("value"), (F.countDistinct("is_string") > 1).alias("mixed"))
    return merged.select("response_id", "name", F.when(~F.col("mixed"), F.col("value")).alias("value"), F.when(F.col("mixed"), "TRANSFORMATION_CONFLICT").alias("failure_code"))


def pass_valid_calls(stream: DataFrame, registered: Sequence[str], name: str = "tool_name") -> DataFrame:
    """Without buffering: each frame at once, with a failure code where its tool isn't registered."""
    known = F.col(name).isNull() | F.col(name).isin(list(registered))
    return stream.withColumn("failure_code", F.when(~known, "TOOL_POLICY_FAILED"))


# --- live streams ----------------------------------------------------------------------------------------------

WHOLE = "response_id string, choice long, channel string, text string, failure_code string"
_FRAME = "frame_seq long, position int, choice_index long, channel string, text string, last boolean, media long"
_FIELDS = ["frame_seq", "position", "choice_index", "channel", "text", "last", "media"]
#: How long a finished response is remembered, in times of its idle limit: later frames of it are refused.
REMEMBER = 60


def join_frames(frames: list[tuple]) -> list[tuple[int, str, str | None, str | None]]:
    """The rules of ``correlate`` and ``join_text`` for the frames of one response: (choice, channel, text, code)."""
    frames = sorted(frames, key=lambda f: (f[0], f[1]))
    numbered = sum(f[2] is not None for f in frames)
    by_frame: dict[int, list[tuple]] = {}
    for f in frames:
        by_frame.setdefault(f[0], []).append(f)
    if numbered:
        bad = numbered < len(frames) or any(len({(f[3], f[2]) for f in fs}) < len(fs) for fs in by_frame.values())
    else:
        bad = len({len({f[1] for f in fs}) for fs in by_frame.values()}) > 1 or any(len({(f[3], f[1]) for f in fs}) < len(fs) for fs in by_frame.values())
    texts: dict[tuple[int, str], list[str]] = {}
    for f in frames:
        part = texts.setdefault((f[2] if numbered else f[1], f[3]), [])
        if f[4] is not None:
            part.append(f[4])
    code = "TRANSFORMATION_CONFLICT" if bad else None
    return [(c if c is not None else -1, ch, None if bad or not parts else "".join(parts), code) for (c, ch), parts in texts.items()]


class ResponseBuffer(StatefulProcessor):
    """Keeps the frames of a response until its last one, then gives the whole text and forgets it.

    Over a limit, or silent too long, it gives a failure instead and forgets as well. Frames after that are refused with
    a row that says so, until the mark of the finished response expires (REMEMBER idle times later, with timers)."""

    def __init__(self, limits: InspectionLimits | None = None, timers: bool = True):
        self.limits, self.timers = limits or InspectionLimits(), timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", _FRAME)
        life = {"ttlDurationMs": int(REMEMBER * self.limits.idle_seconds * 1000)} if self.timers else {}
        self.closed = handle.getValueState("closed", "code string", **life)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [f for part in rows for f in part.reindex(columns=_FIELDS).itertuples(index=False, name=None)]
        new = [tuple(None if v is None or v != v else v for v in f) for f in new]
        if self.closed.exists():
            yield self._out(key, [(-1, "", None, "TRANSFORMATION_CONFLICT")])
            return
        held = [*self.frames.get(), *new] if self.frames.exists() else new
        code = "RESPONSE_INSPECTION_LIMIT_EXCEEDED" if self.over(held) else None
        if code is None and not any(f[5] for f in held):
            self.frames.appendList([(int(f[0]), int(f[1]), None if f[2] is None else int(f[2]), f[3], f[4], bool(f[5]), int(f[6] or 0)) for f in new])
            self._rearm(timerValues)
            return
        self.frames.clear()
        self.closed.update((code or "",))
        yield self._out(key, [(-1, "", None, code)] if code else join_frames(held))

    def over(self, held: list[tuple]) -> bool:
        """Whether frames, characters or media bytes pass a limit; what is held never grows beyond these."""
        most = self.limits
        return len({f[0] for f in held}) > most.max_frames or sum(len(f[4] or "") for f in held) > most.max_characters or sum(int(f[6] or 0) for f in held) > most.max_media_bytes

    def _rearm(self, timer) -> None:
        if not self.timers:
            return
        for at in list(self.handle.listTimers() or []):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timer.getCurrentProcessingTimeInMs() + int(self.limits.idle_seconds * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.frames.clear()
        self.closed.update(("STREAM_TIMEOUT",))
        yield self._out(key, [(-1, "", None, "STREAM_TIMEOUT")])

    @staticmethod
    def _out(key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"response_id": [key[0]] * len(rows), "choice": [int(r[0]) for r in rows], "channel": [r[1] for r in rows], "text": [r[2] for r in rows], "failure_code": [r[3] for r in rows]})

    def close(self) -> None:
        pass


def buffer_responses(stream: DataFrame, limits: InspectionLimits | None = None, timers: bool = True) -> DataFrame:
    """Whole responses of a live stream of frames (response_id, and the columns of a frame with ``last``; ``media``, the bytes
    of its media, may be missing)."""
    return stream.groupBy("response_id").transformWithStateInPandas(statefulProcessor=ResponseBuffer(limits, timers), outputStructType=WHOLE, outputMode="Append", timeMode="ProcessingTime" if timers else "None")
