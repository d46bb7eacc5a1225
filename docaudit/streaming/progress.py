"""Progress events of runs and chunks of replies, as streams and as tables.

Events: session, ts, seq (order within a session), kind and the fields of EVENT. The functions named ``..._stream`` keep a small state
for each session, which is dropped once the watermark has passed the session's last event by ``IDLE``; the others give the same
from a table.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MARKER = "@@PROGRESS"  # fixed value: what a progress line begins with
EVENT = "kind string, index int, total int, page int, name string, doc_type string, path string, stage string, tps double, tokens bigint, seconds double"
INTERVAL, IDLE = 0.4, "1 hour"
OPEN, CLOSE = "<think>", "</think>"


def parse_progress(lines: DataFrame) -> DataFrame:
    """The events among lines (session, ts, seq, line); other lines, and events whose JSON is broken, are left out."""
    rows = lines.filter(F.col("line").startswith(MARKER)).withColumn("e", F.from_json(F.trim(F.substring("line", len(MARKER) + 1, 1 << 30)), EVENT))
    return rows.filter("e is not null and e.kind is not null").select("session", "ts", "seq", "e.*")


PROGRESS = "session string, document string, doc_type string, doc_index int, doc_total int, path string, page int, page_total int, stage string"


def latest_progress(events: DataFrame) -> DataFrame:
    """Where each session is: its document, and the page or stage since; sessions that are done have no row."""
    last = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.struct("seq", "kind", "name", "doc_type", "index", "total", "path", "page", "stage")))
    s = events.groupBy("session").agg(last("document", "done").alias("d"), last("page", "stage").alias("p"))
    after = F.coalesce(F.col("p.seq") > F.coalesce("d.seq", F.lit(-1).cast("long")), F.lit(False))
    doc = lambda f: F.when(F.col("d.kind") == "document", F.col(f"d.{f}"))
    page = lambda f: F.when(after & (F.col("p.kind") == "page"), F.col(f"p.{f}"))
    return s.filter(after | (F.col("d.kind") == "document")).select(
        "session", doc("name").alias("document"), doc("doc_type").alias("doc_type"), doc("index").alias("doc_index"), doc("total").alias("doc_total"), doc("path").alias("path"),
        page("page").alias("page"), page("total").alias("page_total"), F.when(after, F.col("p.stage")).alias("stage"),
    )


def latest_progress_stream(events: DataFrame) -> DataFrame:
    """The same for a stream with event time ``ts``: a row for each session and batch in which something changed."""
    fields = [f.split()[0] for f in PROGRESS.split(", ")][1:]

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = dict(zip(fields, state.get, strict=True)) if state.exists else dict.fromkeys(fields)
        changed = False
        for e in pd.concat(list(parts)).sort_values("seq").astype(object).where(lambda d: d.notna(), None).to_dict("records"):
            if e["kind"] == "document":
                now = dict.fromkeys(fields) | {"document": e["name"], "doc_type": e["doc_type"], "doc_index": e["index"], "doc_total": e["total"], "path": e["path"]}
            elif e["kind"] == "page":
                now |= {"page": e["page"], "page_total": e["total"], "stage": e["stage"]}
            elif e["kind"] == "stage":
                now |= {"page": None, "page_total": None, "stage": e["stage"]}
            elif e["kind"] == "done":
                now = dict.fromkeys(fields)
            else:
                continue
            changed = True
        now = {f: None if v is None else int(v) if f in ("doc_index", "doc_total", "page", "page_total") else v for f, v in now.items()}
        state.update(tuple(now.values()))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)
        if changed:
            yield pd.DataFrame([{"session": key[0], **now}]).astype({f: "Int32" for f in ("doc_index", "doc_total", "page", "page_total")})

    kept = PROGRESS.split(", ", 1)[1]
    return events.withWatermark("ts", IDLE).groupBy("session").applyInPandasWithState(fold, PROGRESS, kept, "update", GroupStateTimeout.EventTimeTimeout)


def throttle(events: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """The events that are shown: pages at most once per ``interval`` of a session, all others always. The last page of a run of
    pages that was held back is shown when the next page is due, marked ``late``; an event of another kind takes its place.

    A page that comes an interval after the event before, and any other event, begin a piece of their own; only pages of
    one piece depend on each other.
    """
    w = W.Window.partitionBy("session").orderBy("seq")
    at = F.col("ts").cast("timestamp").cast("double")
    rows = events.select("session", "seq", "kind", "page", at.alias("at"))
    new = (F.col("kind") != "page") | F.lag("at").over(w).isNull() | (F.col("at") - F.lag("at").over(w) >= interval)
    rows = rows.withColumn("piece", F.sum(new.cast("int")).over(w)).withColumn("follower_at", F.lead("at").over(w))
    each = F.struct("seq", "at", "kind", "page", "follower_at")
    zero = F.struct(F.lit(-1e18).alias("shown_at"), F.array().cast("array<bigint>").alias("shown"))

    def step(a, x):
        show = (x["kind"] != "page") | (x["at"] - a["shown_at"] >= interval)
        return F.struct(F.when(show, x["at"]).otherwise(a["shown_at"]).alias("shown_at"), F.when(show, F.concat(a["shown"], F.array(x["seq"]))).otherwise(a["shown"]).alias("shown"))

    pieces = rows.groupBy("session", "piece").agg(F.array_sort(F.collect_list(each)).alias("all"))
    pieces = pieces.withColumn("f", F.aggregate("all", zero, step)).select("session", "f.*", F.element_at("all", -1).alias("last"))
    # The last page of a piece is due unless it was shown or something follows before its time.
    late = ~F.array_contains("shown", F.col("last.seq")) & F.coalesce(F.col("last.follower_at") - F.col("shown_at") >= interval, F.lit(True))
    shown = pieces.select("session", F.explode(F.concat(F.transform("shown", lambda s: F.struct(s.alias("seq"), F.lit(False).alias("late"))), F.when(late, F.array(F.struct(F.col("last.seq").alias("seq"), F.lit(True).alias("late")))).otherwise(F.array().cast("array<struct<seq:bigint,late:boolean>>")))).alias("s"))
    return shown.select("session", "s.*").join(events.select("session", "seq", "kind", "page"), ["session", "seq"])


def throttle_stream(events: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """The same for a stream; a page that is held back is shown by a timer. A session's state goes with the first timer that finds nothing to show."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown_at, held_seq, held_page = state.get if state.exists else (-1e18, None, None)
        out = []
        if state.hasTimedOut:
            if held_seq is not None:
                out.append((key[0], held_seq, True, "page", held_page))
                state.update((shown_at + interval, None, None))  # when it was due; pages right after it are held back again
                state.setTimeoutDuration(int(interval * 1000))
            else:
                state.remove()
        else:
            for e in pd.concat(list(parts)).sort_values("seq").itertuples():
                at = e.ts.timestamp()
                page = None if pd.isna(e.page) else int(e.page)
                if held_seq is not None and e.kind == "page" and at - shown_at >= interval and e.seq != held_seq:
                    held_seq = held_page = None  # a newer page is shown instead
                if e.kind != "page" or at - shown_at >= interval:
                    out.append((key[0], int(e.seq), False, e.kind, page))
                    shown_at, held_seq, held_page = at, None, None
                else:
                    held_seq, held_page = int(e.seq), page
            state.update((float(shown_at), held_seq, held_page))
            state.setTimeoutDuration(int(interval * 1000))
        yield pd.DataFrame(out, columns=["session", "seq", "late", "kind", "page"]).astype({"page": "Int32", "seq": "int64", "late": bool})

    return events.select("session", "ts", "seq", "kind", "page").groupBy("session").applyInPandasWithState(
        fold, "session string, seq bigint, late boolean, kind string, page int", "shown_at double, seq bigint, page int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def with_speed(events: DataFrame) -> DataFrame:
    """Calls with their tokens a second to one decimal; none without tokens or time."""
    good = (F.col("tokens") > 0) & (F.col("seconds") > 0)
    return events.filter(good).withColumn("tps", F.bround(F.col("tokens") / F.col("seconds"), 1))


def generation_speed(events: DataFrame) -> DataFrame:
    """session, tps, tokens of the latest call of each session. A stream of them goes to a ``SpeedTable``."""
    last = with_speed(events).groupBy("session").agg(F.max(F.struct("seq", "tps", "tokens")).alias("l"))
    return last.select("session", "l.tps", "l.tokens")


class SpeedTable:
    """The latest speed of each session, kept up by ``foreachBatch(table.merge)``.

    Each batch adds its sessions' latest calls in a folder of its own, which the same batch replaces if it runs again; reading takes the
    latest of each session. No state is held in the stream, and no batch reads or writes the sessions that it does not touch.
    """

    SCHEMA = "session string, seq bigint, tps double, tokens bigint, batch bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def merge(self, events: DataFrame, batch_id: int) -> None:
        """A batch of events (session, seq, tokens, seconds)."""
        last = with_speed(events).groupBy("session").agg(F.max(F.struct("seq", "tps", "tokens")).alias("l"))
        last.select("session", F.col("l.seq").cast("bigint").alias("seq"), "l.tps", F.col("l.tokens").cast("bigint").alias("tokens")).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def frame(self) -> DataFrame:
        """session, tps, tokens."""
        last = self.rows().groupBy("session").agg(F.max(F.struct("seq", "tps", "tokens")).alias("l"))
        return last.select("session", "l.tps", "l.tokens")

    def compacted(self, path: str) -> "SpeedTable":
        """A table elsewhere with a row for each session, from which a stream goes on with later batches."""
        last = self.rows().groupBy("session").agg(F.max(F.struct("seq", "tps", "tokens")).alias("l"), F.max("batch").alias("batch"))
        last.select("session", "l.seq", "l.tps", "l.tokens", F.lit(-1).alias("batch")).write.partitionBy("batch").mode("overwrite").parquet(path)
        return SpeedTable(self.spark, path)


def chunk_speed(chunks: DataFrame) -> DataFrame:
    """session, reply, tokens, seconds, tps of each reply: chunks over the time since the first, or the reported usage at its end.

    chunks: session, reply, ts, usage (tokens of the whole reply, given with the last chunk if at all).
    """
    at = F.col("ts").cast("timestamp").cast("double")
    rows = chunks.groupBy("session", "reply").agg(F.count(F.lit(1)).alias("chunks"), F.max("usage").alias("usage"), (F.max(at) - F.min(at)).alias("seconds"))
    tokens = F.coalesce("usage", "chunks")
    return rows.select("session", "reply", tokens.alias("tokens"), "seconds", F.when(F.col("seconds") > 0, F.bround(tokens / F.col("seconds"), 1)).alias("tps"))


def chunk_speed_stream(chunks: DataFrame, interval: float = INTERVAL, idle: str = IDLE) -> DataFrame:
    """session, reply, tokens, seconds, tps, final: the speed of running replies, at most once per ``interval`` of each, and at its end.

    chunks: session, reply, seq, ts, usage. A reply ends with the chunk that has its usage, whose figure then holds, or when the watermark has passed its
    last chunk by ``idle``; its state goes with it.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, tokens, told = state.get if state.exists else (None, None, 0, None)
        out, ended = [], False
        figure = lambda n, final: (*key, n, round(last - first, 3), round(n / (last - first), 1) if last > first else None, final)
        if state.hasTimedOut:
            out.append(figure(tokens, True))
            ended = True
        else:
            for e in pd.concat(list(parts)).sort_values("seq").itertuples():
                last = e.ts.timestamp()
                first, tokens = last if first is None else first, tokens + 1
                if not pd.isna(e.usage):
                    out.append(figure(int(e.usage), True))
                    ended = True
                    break
                if last > first and (told is None or last - told >= interval):
                    told = last
                    out.append(figure(tokens, False))
        if ended:
            state.remove()
        else:
            state.update((first, last, tokens, told))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(last * 1000)) + 1)
        yield pd.DataFrame(out, columns=["session", "reply", "tokens", "seconds", "tps", "final"]).astype({"tokens": "int64", "seconds": float, "tps": float, "final": bool})

    reply = dict(chunks.dtypes)["reply"]
    return chunks.withWatermark("ts", idle).groupBy("session", "reply").applyInPandasWithState(
        fold, f"session string, reply {reply}, tokens bigint, seconds double, tps double, final boolean", "first double, last double, tokens bigint, told double", "append", GroupStateTimeout.EventTimeTimeout
    )


def split_chunks(in_think: bool, held: str, text: str) -> tuple[bool, str, list[tuple[str, str]]]:
    """One chunk more of a reply: new state, and what is certain of it as (kind, text). A tail that may begin a tag is held back."""
    held, out = held + text, []
    while True:
        tag = CLOSE if in_think else OPEN
        kind = "reasoning" if in_think else "content"
        before, found, after = held.partition(tag)
        if not found:
            keep = next((k for k in range(min(len(tag) - 1, len(held)), 0, -1) if held.endswith(tag[:k])), 0)
            sure, held = held[: len(held) - keep], held[len(held) - keep :]
            return in_think, held, out + [(kind, sure)] * bool(sure)
        out += [(kind, before)] * bool(before)
        in_think, held = not in_think, after


def split_reasoning_stream(chunks: DataFrame) -> DataFrame:
    """session, seq, kind, text: chunks of a stream (session, ts, seq, text) as content and reasoning; what is held back at the end comes by timeout."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        in_think, held, last = state.get if state.exists else (False, "", -1)
        out = []
        if state.hasTimedOut:
            out += [(key[0], last + 1, "reasoning" if in_think else "content", held)] * bool(held)
            state.remove()
        else:
            for e in pd.concat(list(parts)).sort_values("seq").itertuples():
                in_think, held, more = split_chunks(in_think, held, e.text or "")
                last = int(e.seq)
                out += [(key[0], last, kind, text) for kind, text in more]
            state.update((in_think, held, last))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 3_600_000)
        yield pd.DataFrame(out, columns=["session", "seq", "kind", "text"]).astype({"seq": "int64"})

    return chunks.withWatermark("ts", IDLE).groupBy("session").applyInPandasWithState(fold, "session string, seq bigint, kind string, text string", "in_think boolean, held string, last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def split_reasoning_chunks(chunks: DataFrame) -> DataFrame:
    """session, reasoning, content of whole replies from their chunks (session, seq, text)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    whole = chunks.groupBy("session").agg(text.alias("text"))
    parts = F.regexp_extract_all("text", F.lit(rf"(?s){OPEN}(.*?)(?:{CLOSE}|$)"), 1)
    return whole.select("session", F.array_join(parts, "").alias("reasoning"), F.regexp_replace("text", rf"(?s){OPEN}.*?(?:{CLOSE}|$)", "").alias("content"))
