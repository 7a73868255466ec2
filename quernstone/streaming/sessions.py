"""Streaming sessionisation and replacement of what came late."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_counts(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n of each session of a key; batch or stream. Rows later than the watermark are dropped."""
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if rows.isStreaming else rows
    return rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "w.end", "n")


def tumbling_counts(events: DataFrame, key: str, at: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn(at, F.col(at).cast("timestamp"))
    rows = rows.withWatermark(at, late) if rows.isStreaming else rows
    return rows.groupBy(key, F.window(at, width).alias("w")).agg(F.count("*").alias("n")).select(key, "w.start", "n")


def open_exchanges(turns: DataFrame, group: str, order: str, role: str, text: str) -> DataFrame:
    """group, seq, user_text, assistant_text of exchanges as a later prompt closes them; the open one is state.

    Turns of one group must arrive in order. State is one exchange a group.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, user, said = state.get if state.exists else (0, "", "")
        done = []
        rows = pd.concat(list(batches)).sort_values(order)
        for r, t in zip(rows[role], rows[text].fillna("")):
            if r == "user":
                if seq:
                    done.append((key[0], seq, user, said))
                seq, user, said = seq + 1, t, ""
            elif seq and r == "assistant":
                said = f"{said}\n\n{t}" if said else t
            elif seq:
                user = f"{user}\n{t}"
        state.update((seq, user, said))
        yield pd.DataFrame(done, columns=[group, "seq", "user_text", "assistant_text"])

    kind = turns.schema[group].dataType.simpleString()
    return turns.groupBy(group).applyInPandasWithState(run, f"{group} {kind}, seq long, user_text string, assistant_text string", "seq long, user_text string, said string", "append", GroupStateTimeout.NoTimeout)


class ExchangeFold(StatefulProcessor):
    """A conversation's turns, by their number, and the digests of the exchanges that they made when last told.

    A batch's turns are put beside those of earlier batches, so that repeated files change nothing and a late turn
    reopens the exchange that it belongs to; exchanges that came out otherwise than last time are told anew, those that
    are no more with null texts. A timer closes the last exchange once a conversation has been quiet for `quiet`
    milliseconds; turns are forgotten `keep` milliseconds after they came (0: never).
    """

    def __init__(self, names: tuple[str, str, str, str], quiet: int, keep: int) -> None:
        self.names, self.quiet, self.keep = names, quiet, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kept = {"ttlDurationMs": self.keep} if self.keep else {}
        self.turns = handle.getMapState("turns", "o long", "r string, t string", **kept)
        self.told = handle.getMapState("told", "seq long", "digest string", **kept)
        self.times = handle.getValueState("times", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, order, role, text = self.names
        for b in rows:
            for o, r, t in zip(b[order], b[role], b[text]):
                self.turns.updateValue((int(o),), (r, None if pd.isna(t) else t))
        if self.quiet:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        yield from self.tell(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.tell(key, True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Turns of the batch table; their exchanges count as told."""
        _, order, role, text = self.names
        for o, r, t in zip(initialState[order], initialState[role], initialState[text]):
            self.turns.updateValue((int(o),), (r, None if pd.isna(t) else t))
        list(self.tell(key, False))

    def folded(self) -> list[tuple[int, str, str]]:
        seq, out = 0, []
        for _, (r, t) in sorted((k[0], v) for k, v in self.turns.iterator()):
            if r == "user":
                seq += 1
                out.append((seq, [], []))
            if seq and t is not None:
                out[-1][2 if r == "assistant" else 1].append(t)
        joined = [(n, "\n".join(user), "\n\n".join(said)) for n, user, said in out]
        return [x for x in joined if x[1].strip(" ") or x[2].strip(" ")]

    def tell(self, key, quiet: bool) -> Iterator[pd.DataFrame]:
        now, before, out = self.folded(), {k[0]: v[0] for k, v in self.told.iterator()}, []
        nth = 1 + (self.times.get()[0] if self.times.exists() else 0)
        self.times.update((nth,))
        for n, user, said in now:
            still = not quiet and n == now[-1][0]
            digest = hashlib.md5(f"{still}\0{user}\0{said}".encode()).hexdigest()
            if before.pop(n, None) != digest:
                self.told.updateValue((n,), (digest,))
                out.append((key[0], n, user, said, still, nth))
        for n in before:
            self.told.removeKey((n,))
            out.append((key[0], n, None, None, False, nth))
        yield pd.DataFrame(out, columns=[self.names[0], "seq", "user_text", "assistant_text", "open", "nth"])

    def close(self) -> None:
        pass


def exchange_updates(turns: DataFrame, group: str, order: str, role: str, text: str, quiet: int = 0, keep: int = 0, initial: DataFrame | None = None) -> DataFrame:
    """group, seq, user_text, assistant_text, open, nth: a stream of exchanges as they stand (the higher nth of a group is
    the later telling), to replace what was told of the
    same group and number before (null texts: take it out). The latest row of each equals `fold_exchanges` over all
    turns so far, in whatever order and however often they came. initial: turns that a batch has folded already.

    State is a conversation's turns; it needs the RocksDB state store (`use_rocksdb`)."""
    kind = turns.schema[group].dataType.simpleString()
    names = (group, order, role, text)
    first = None if initial is None else initial.select(*names).groupBy(group)
    return turns.select(*names).groupBy(group).transformWithStateInPandas(
        ExchangeFold(names, quiet, keep), f"{group} {kind}, seq long, user_text string, assistant_text string, open boolean, nth long", "Update", "ProcessingTime" if quiet or keep else "None", first
    )


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def upsert_exchanges(batch: DataFrame, path: str, group: str) -> None:
    """Writes a batch of updates over a Parquet table of exchanges; the table is small enough to be written anew, or is
    one of a format with MERGE."""
    spark = batch.sparkSession
    new = batch.groupBy(group, "seq").agg(F.max_by(F.struct("user_text", "assistant_text", "open", "nth"), "nth").alias("x")).select(group, "seq", "x.*").persist()  # the state is updated once a batch
    new.count()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.sc().hadoopConfiguration())
    rows = new
    if store.exists(folder):
        rows = spark.read.parquet(path).join(new.select(group, "seq"), [group, "seq"], "left_anti").unionByName(new)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    rows.where("user_text IS NOT NULL").write.mode("overwrite").parquet(aside.toString())
    store.delete(folder, True)
    store.rename(aside, folder)
    new.unpersist()


def replacing_sink(stream: DataFrame, checkpoint: str, replace: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each batch to `replace`, which overwrites whatever the batch's keys had, so that a batch that is run twice
    leaves the same rows. Ends when all there is has been read."""
    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
