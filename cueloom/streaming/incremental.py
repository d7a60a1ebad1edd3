"""Subtitles that keep arriving: new files as a stream of cues, and operators with state.

The operators keep values, lists and timers for each key (``transformWithState``; the state store is RocksDB, which they set in
the session). Rows of a key arrive in order over batches; within a batch they are put in order. A row with a null in the place
that each operator names ends a key, and an operator with a watermark ends it by a timer; either way nothing of the key is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cueloom.sources import text_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_srt(spark: SparkSession, path: str) -> DataFrame:
    """Cues of SubRip files as they arrive; each file is parsed once."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.srt").load(path)
    files = files.select(F.xxhash64("path").alias("file_id"), "path", "content", "length")
    return text_files.srt_cues(text_files.srt_blocks(text_files.as_text(files)))


def drain(cues: DataFrame, target: str, checkpoint: str) -> None:
    """Writes what is there to target, exactly once, and ends."""
    cues.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: The state store that keeps lists, maps and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, time: str = "None") -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.groupBy(*keys).transformWithState(processor, schema, "append", time)


CUE = "file_id long, start_ms long, end_ms long, text string"


class _Combined(StatefulProcessor):
    """A file's open cue."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cue = handle.getValueState("cue", "start_ms long, end_ms long, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        cue = self.cue.get()
        for r in sorted(rows, key=lambda r: (r.start_ms is None, r.start_ms)):
            if cue and r.text == cue[2] and r.start_ms == cue[1]:
                cue = (cue[0], r.end_ms, cue[2])
                continue
            if cue:
                yield Row(file_id=key[0], start_ms=cue[0], end_ms=cue[1], text=cue[2])
            cue = (r.start_ms, r.end_ms, r.text) if r.text is not None else None
        if cue:
            self.cue.update(tuple(cue))
        else:
            self.cue.clear()

    def close(self) -> None:
        pass


def combine_stream(cues: DataFrame) -> DataFrame:
    """combine() for cues that arrive in order over several batches; a file's open cue is its state.

    A cue is emitted once a later one does not continue it; the last comes with a cue of null text.
    """
    return _with_state(cues.select("file_id", "start_ms", "end_ms", "text"), ["file_id"], _Combined(), CUE)


class _Units(StatefulProcessor):
    """The parts of an open unit, as a list that packets are added to, and where it began."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "data binary")
        self.begun = handle.getValueState("begun", "pkt_no long, emitted long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        begun = self.begun.get()
        for r in sorted(rows, key=lambda r: r.pkt_no):
            payload = r.payload
            if payload is None or r.pusi == 1:
                before, payload = self.split(payload)
                if begun:
                    if before:
                        self.parts.appendValue((bytearray(before),))
                    emitted = begun[1]
                    for out in self.emit(key, begun[0], emitted, b"".join(bytes(x[0]) for x in self.parts.get())):
                        emitted += 1
                        yield out
                    begun = (begun[0], emitted)
                self.parts.clear()
                if r.payload is None:
                    begun = None
                    continue
                begun = (r.pkt_no, begun[1] if begun else 0)
            if begun:
                self.parts.appendValue((bytearray(payload),))
        if begun:
            self.begun.update(begun)
        else:
            self.begun.clear()
            self.parts.clear()

    def split(self, payload: bytes | None) -> tuple[bytes, bytes]:
        """What of a packet that begins a unit ends the unit before, and the rest."""
        return b"", payload or b""

    def emit(self, key: tuple, pkt_no: int, emitted: int, data: bytes) -> Iterator[Row]:
        yield Row(file_id=key[0], pid=key[1], data=bytearray(data))

    def close(self) -> None:
        pass


class _Sections(_Units):
    """Units of table PIDs: a pointer in the first byte says where the unit before ends."""

    def split(self, payload: bytes | None) -> tuple[bytes, bytes]:
        data = bytes(payload or b"\0")
        return data[1 : 1 + data[0]], data[1 + data[0] :]

    def emit(self, key: tuple, pkt_no: int, emitted: int, data: bytes) -> Iterator[Row]:
        at = 0
        while at + 3 <= len(data) and data[at] != 0xFF:
            size = (int.from_bytes(data[at + 1 : at + 3], "big") & 0xFFF) + 3
            if at + size > len(data):
                break
            emitted += 1
            yield Row(file_id=key[0], pid=key[1], section_no=emitted, pkt_no=pkt_no, table_id=data[at], body=bytearray(data[at + 3 : at + size - 4]))
            at += size


def reassemble_stream(packets: DataFrame) -> DataFrame:
    """Units of each (file_id, pid) from packets (pkt_no, pusi, payload) that arrive in order; the open unit's
    parts are the state. A packet of a null payload ends a file's pid: the open unit comes out then."""
    rows = packets.select("file_id", "pid", F.col("pkt_no").cast("long").alias("pkt_no"), "pusi", "payload").filter("payload IS NULL OR length(payload) > 0")
    return _with_state(rows, ["file_id", "pid"], _Units(), "file_id long, pid long, data binary")


def sections_stream(packets: DataFrame) -> DataFrame:
    """psi_sections() for packets that arrive in order over several batches, as reassemble_stream()."""
    rows = packets.select("file_id", "pid", F.col("pkt_no").cast("long").alias("pkt_no"), "pusi", "payload").filter("payload IS NULL OR length(payload) > 0")
    return _with_state(rows, ["file_id", "pid"], _Sections(), "file_id long, pid long, section_no long, pkt_no long, table_id long, body binary")


class _Epochs(StatefulProcessor):
    """The object that a file shows, since when, and its last stamp."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getValueState("shown", "start_ms long, object_id long, last_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        start, shown, last = self.shown.get() or (None, None, None)
        for r in sorted(rows, key=lambda r: r.seg_no):
            ends = r.pts_ms is None
            at = last if ends else r.pts_ms
            shows = not ends and r.n_objects > 0
            if start is not None and (not shows or r.state in (0x40, 0x80) or r.object_id != shown):
                yield Row(file_id=key[0], start_ms=start, end_ms=at)
                start = None
            if shows and start is None:
                start = at
            shown, last = r.object_id if shows else None, None if ends else at
        if last is None:
            self.shown.clear()
        else:
            self.shown.update((start, shown, last))

    def close(self) -> None:
        pass


def pgs_subtitles_stream(compositions: DataFrame) -> DataFrame:
    """pgs_subtitles() for compositions that arrive in order over several batches; a file's shown object is its state.

    A subtitle is emitted when it ends; a row of null pts_ms ends the file and what it leaves open.
    """
    rows = compositions.select("file_id", F.col("seg_no").cast("long").alias("seg_no"), "pts_ms", "state", "n_objects", "object_id")
    return _with_state(rows, ["file_id"], _Epochs(), "file_id long, start_ms long, end_ms long")


class _Pages(StatefulProcessor):
    """Compositions that wait for the watermark, by their stamp, and the page that is shown."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "pts_ms long", "timeout_s int, n_regions int")
        self.page = handle.getValueState("page", "start_ms long, timeout_s int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.waiting.updateValue((r.pts_ms,), (r.timeout_s, r.n_regions))
            self.handle.registerTimer(r.pts_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        page = self.page.get()
        follows = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else None
        if follows:
            self.waiting.removeKey((at,))
        if page and (follows or page[1] and at >= page[0] + page[1] * 1000):
            start, timeout = page
            end = min([at] * bool(follows) + [start + timeout * 1000] * bool(timeout), default=start)
            yield Row(file_id=key[0], pid=key[1], page_id=key[2], start_ms=start, end_ms=end if end > start else start + 5000)
            self.page.clear()
        if follows and follows[1] > 0:
            self.page.update((at, follows[0]))
            if follows[0]:
                self.handle.registerTimer(at + follows[0] * 1000)

    def close(self) -> None:
        pass


def dvb_pages_stream(pages: DataFrame, late: str = "0 seconds") -> DataFrame:
    """dvb_subtitles() for pages: a page ends with the next composition, or once the watermark passes its timeout.

    late: how far behind the latest stamp of any stream a composition may come; up to then compositions wait, so
    they count in the order of their stamps, however they arrive. Those that are later are dropped."""
    rows = pages.select("file_id", "pid", "page_id", "pts_ms", "timeout_s", "n_regions", F.timestamp_millis("pts_ms").alias("at")).withWatermark("at", late)
    return _with_state(rows, ["file_id", "pid", "page_id"], _Pages(), "file_id long, pid long, page_id long, start_ms long, end_ms long", "EventTime")
