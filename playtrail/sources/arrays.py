"""Elements of JSON arrays that are too large for one task.

A file is read as byte ranges by many tasks.  Whether a byte of JSON is structure depends on
all before it, but only through three things: whether it is inside a string, how deep it is
nested, and how many elements came before.

1. `ranges`: each range is scanned once and summed up as a function of how it is entered:
   whether it turns "inside a string" over, and for both cases the change of depth and the
   commas at each relative depth.  These rows are a few numbers for each range.
2. `entries`: windows over the ranges of a file compose the functions, so each range learns
   its own entry.
3. `split_elements`: each range is cut at its commas of depth 1.  Text of elements does not
   move; only the two ends of a range meet those of its neighbours, by a small shuffle.

Ranges come from Spark's text reader with ``}`` as the end of a line, so a range never begins
behind a backslash.  Files that fit one range need no first scan and no entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playtrail.session import materialize
from playtrail.sources.tasks import in_few_tasks

#: An element of more bytes is unreadable; only its beginning is kept.
LONGEST = 64 << 20
#: Bytes kept of what is unreadable for its length.
KEPT = 1000
#: Ranges up to which their entries are sent to all tasks; beyond, they are joined by a shuffle.
BROADCAST_RANGES = 50_000

_RANGE = ["file_path", "start", "length"]
_KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((b'"', b"[{", b"]}", b","), 1):
    _KINDS[list(_chars)] = _kind
_STEP = np.array([0, 0, 1, -1, 0], np.int64)
QUOTE, OPEN, CLOSE, COMMA = 1, 2, 3, 4


def structure(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places and kinds of brackets and commas, in and out of strings; whether an odd number
    of quotes comes before each; and the parity of all quotes.  Begins behind no backslash."""
    data = np.frombuffer(text, np.uint8)
    kinds = _KINDS[data]
    at = np.flatnonzero(kinds)
    kind = kinds[at]
    back = np.flatnonzero(data == 92)
    if len(back):
        first = np.concatenate([[True], np.diff(back) != 1])
        run = back[first][np.cumsum(first) - 1]
        quotes = np.flatnonzero(kind == QUOTE)
        place = at[quotes]
        last = np.searchsorted(back, place) - 1
        behind = (last >= 0) & (back[last] == place - 1)
        kind[quotes[behind & ((place - run[last]) % 2 == 1)]] = 0
    quote = kind == QUOTE
    odd = np.cumsum(quote) & 1
    found = kind > QUOTE
    return at[found], kind[found], odd[found].astype(bool), int(odd[-1]) if len(odd) else 0


class Summary:
    """What a range does to the state it is entered with: outside (0) or inside (1) a string."""

    def __init__(self) -> None:
        self.turns, self.depth, self.commas = 0, [0, 0], [{}, {}]
        self.bytes, self.array = 0, None

    def feed(self, text: bytes) -> None:
        self.bytes += len(text)
        if self.array is None and text.strip():
            self.array = text.lstrip().startswith(b"[")
        _, kind, odd, turns = structure(text)
        for entered in (0, 1):
            counts = kind[odd == bool(self.turns ^ entered)]
            depth = self.depth[entered] + np.cumsum(_STEP[counts])
            for level, n in zip(*(x.tolist() for x in np.unique(depth[counts == COMMA], return_counts=True))):
                self.commas[entered][level] = self.commas[entered].get(level, 0) + n
            if len(depth):
                self.depth[entered] = int(depth[-1])
        self.turns ^= turns


class Cutter:
    """Pieces of a range that is entered in a known state: (position, whole, text).

    A piece without position is a remark on the file.  A text of more than LONGEST bytes is
    cut to KEPT and ends in a NUL byte, so it cannot be read."""

    def __init__(
        self, start: int, array: bool | None, inside: int, depth: int, before: int, after: bool = False
    ) -> None:
        self.array, self.inside, self.depth, self.position = array, inside, depth, before
        self.whole = start == 0
        self.parts: list[bytes] = []
        self.held = 0
        # Behind the array, and whether there is anything.
        self.after, self.more = after, False

    def keep(self, text: bytes) -> None:
        self.held += len(text)
        self.parts.append(text)
        if self.held > LONGEST and len(self.parts[0]) != KEPT + 1:
            self.parts = [b"".join(self.parts)[:KEPT] + b"\0"]
        elif self.held > LONGEST:
            self.parts = self.parts[:1]

    def take(self) -> bytes:
        text, self.parts, self.held = b"".join(self.parts), [], 0
        return text

    def feed(self, text: bytes) -> Iterator[tuple[int | None, bool, bytes]]:
        if self.array is None and text.strip():
            self.array = text.lstrip().startswith(b"[")
            if not self.array:
                yield None, True, b"file is no array"
        at, kind, odd, turns = structure(text)
        outside = odd == bool(self.inside)
        at, kind = at[outside], kind[outside]
        depth = self.depth + np.cumsum(_STEP[kind])
        self.inside ^= turns
        if self.array:
            opens = (kind == OPEN) & (depth == 1)
            closes = (kind == CLOSE) & (depth == 0)
            cuts = np.flatnonzero(opens | closes | ((kind == COMMA) & (depth == 1)))
            begin = 0
            for place, what in zip(at[cuts].tolist(), kind[cuts].tolist()):
                self.keep(text[begin:place])
                piece = self.take()
                if self.after:
                    self.more = True
                elif what != OPEN:
                    # Nothing between the brackets is an array of no elements.
                    if what == COMMA or not self.whole or self.position or piece.strip():
                        yield self.position, self.whole, piece
                    self.position += 1
                    self.after = what == CLOSE
                self.whole, begin = True, place + 1
            self.keep(text[begin:])
        if len(depth):
            self.depth = int(depth[-1])

    def end(self, last: bool) -> Iterator[tuple[int | None, bool, bytes]]:
        rest = self.take()
        if not self.array:
            return
        if self.after:
            if self.more or rest.strip():
                yield None, True, b"text after the array"
        elif self.depth > 0:
            yield self.position, False, rest
            if last:
                yield None, True, b"array is not closed"


def fragments(spark: SparkSession, path: str, more_than: int) -> DataFrame:
    """Texts between ``}`` characters of files of more than so many bytes, in order within
    each range of a file."""
    meta = {"file_source": "file_name", "file_path": "file_path", "size": "file_size"}
    meta |= {"start": "file_block_start", "length": "file_block_length"}
    rows = spark.read.text(path, lineSep="}", pathGlobFilter="*.json")
    large = rows.where(F.col("_metadata.file_size") > more_than)
    own = (F.col(f"_metadata.{m}").alias(n) for n, m in meta.items())
    return in_few_tasks(large.select(*own, F.col("value").cast("binary").alias("text")), rows)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, bytes]]:
    """The rows of each range, joined again: its columns and a text, at its end (None, ``}``)."""
    own = None
    for batch in batches:
        path, start = batch.column("file_path"), batch.column("start").to_numpy(zero_copy_only=False)
        codes = path.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(start) != 0)) + 1
        for begin, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if begin == stop:
                continue
            first = {n: batch.column(n)[begin].as_py() for n in batch.schema.names if n != "text"}
            text = b"}".join(batch.column("text").slice(begin, stop - begin).to_pylist())
            if own == (first["file_path"], first["start"]):
                text = b"}" + text
            elif own:
                yield None, b"}"
            own = (first["file_path"], first["start"])
            yield first, text
    if own:
        yield None, b"}"


_SUMMARY = (
    "file_path string, start long, length long, size long, bytes long, array boolean, turns int, "
    "depth array<long>, commas array<map<long, long>>"
)


def ranges(rows: DataFrame) -> DataFrame:
    """One row for each range of the files that have more than one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, out = None, Summary(), []
        for first, text in _runs(batches):
            own = first or own
            found.feed(text)
            if first is None:
                commas = [list(c.items()) for c in found.commas]
                out.append((*(own[n] for n in (*_RANGE, "size")), found.bytes, found.array, found.turns, found.depth, commas))
                found = Summary()
        types = [pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.map_(pa.int64(), pa.int64()))]
        names = [f.split()[0] for f in _SUMMARY.replace("long, long", "long;long").split(", ")]
        columns = list(zip(*out)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    split = rows.where("length < size").select(*_RANGE, "size", "text")
    return split.mapInArrow(scan, _SUMMARY)


def entries(summaries: DataFrame) -> DataFrame:
    """How each range is entered: ``inside``, ``depth``, elements ``before``, whether the file is
    an ``array`` and the range ``after`` its end, whether it is the ``last`` range, and whether
    the file's last text is followed by the end of a line (``ended``)."""
    file = Window.partitionBy("file_path")
    so_far = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    whole_file = file.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(value):
        return F.coalesce(F.sum(value).over(so_far), F.lit(0))

    turned = summaries.withColumn("inside", (before(F.col("turns")) % 2).cast("int"))
    deep = turned.withColumn("entry_depth", before(F.element_at("depth", F.col("inside") + 1)))
    here = F.element_at("commas", F.col("inside") + 1)
    cut = F.coalesce(F.try_element_at(here, F.lit(1).cast("long") - F.col("entry_depth")), F.lit(0))
    return deep.select(
        *_RANGE,
        "inside",
        F.col("entry_depth").alias("depth"),
        before(cut).alias("before"),
        F.first("array", ignorenulls=True).over(whole_file).alias("array"),
        ((F.col("entry_depth") == 0) & (F.count("array").over(so_far) > 0)).alias("after"),
        (F.col("start") == F.max("start").over(file)).alias("last"),
        # Every text but a file's last is followed by the end of a line.
        (F.sum("bytes").over(file) == F.col("size")).alias("ended"),
    )


def pieces(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``(file_source, file_path, start, pos, whole, text)`` of all ranges."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cutter, out, held = None, None, [], 0
        seen = 0

        def batch() -> pa.RecordBatch:
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            columns = list(zip(*out)) or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            return pa.RecordBatch.from_arrays(arrays, names=["file_source", "file_path", "start", "pos", "whole", "text"])

        for first, text in _runs(batches):
            if cutter is None:
                own, seen = first, 0
                if first["length"] < first["size"] and first["inside"] is None:
                    raise ValueError(f"{first['file_path']} changed while it was read")
                alone = first["length"] >= first["size"]
                own["last"] = True if alone else first["last"]
                state = (None, 0, 0, 0) if alone else tuple(first[n] for n in ("array", "inside", "depth", "before", "after"))
                cutter = Cutter(first["start"], *state)
            seen += len(text)
            if first is not None:
                found = list(cutter.feed(text))
            else:
                # A file's last text has an end of line only if the file's size says so.
                closed = not own["last"] or (own["ended"] if own["length"] < own["size"] else seen == own["size"])
                found = [*(cutter.feed(text) if closed else ()), *cutter.end(own["last"])]
                cutter = None
            for pos, whole, piece in found:
                out.append((own["file_source"], own["file_path"], own["start"], pos, whole, piece))
                held += len(piece)
            if held > 8 << 20 or len(out) > 20_000:
                yield batch()
                out, held = [], 0
        yield batch()

    state = ["inside", "depth", "before", "array", "after", "last", "ended"]
    if known.count() <= BROADCAST_RANGES:
        joined = rows.join(F.broadcast(known), _RANGE, "left")
    else:
        # A range's entry comes as a row before its texts, so these move once.
        numbered = rows.withColumn("line", F.monotonically_increasing_id())
        own_range = Window.partitionBy(*_RANGE).orderBy(F.col("line").asc_nulls_first())
        entered = {n: F.first(n).over(own_range) for n in state}
        joined = numbered.unionByName(known, allowMissingColumns=True).withColumns(entered).where("text IS NOT NULL")
    wanted = joined.select("file_source", *_RANGE, "size", *state, "text")
    return wanted.mapInArrow(cut, "file_source string, file_path string, start long, pos long, whole boolean, text binary")


def split_elements(spark: SparkSession, path: str, more_than: int = 0) -> DataFrame:
    """``(file_source, file_path, pos, text)`` of the elements of the ``*.json`` arrays of a
    directory that have more than so many bytes; a row without position is a remark on its file.

    Elements that cannot be read stay, with what is left of them, for the caller to judge.
    Ranges and pieces are written to the intermediate folder: the pieces are read twice."""
    rows = fragments(spark, path, more_than)
    known = materialize(entries(ranges(rows)), "json-ranges")
    found = materialize(pieces(rows, known), "json-pieces")
    file = ["file_source", "file_path", "pos"]
    whole = found.where("whole").select(*file, F.col("text").cast("string").alias("text"))
    # A range has two ends; an element longer than a range has one piece in each.
    parts = F.sort_array(F.collect_list(F.struct("start", F.col("text").cast("string").alias("text"))))
    joined = found.where("NOT whole").groupBy(*file).agg(F.array_join(parts.getField("text"), "").alias("text"))
    # Nothing between the brackets is an array of no elements.
    return whole.unionByName(joined.where("pos > 0 OR trim(BOTH ' \\t\\r\\n' FROM text) <> ''"))
