"""JSON files of any size as the objects of their array, in parts that many tasks read at once.

A file is read as records that end with '}', which Spark's text reader deals out by byte ranges: such a character is never part
of another and is never escaped. A task sees a range from its middle, so it doesn't know whether it begins inside
a string, nor how deep. A first pass therefore sums up what a range does from either beginning: where it
ends, and how the depth changes. These effects, one row for each range, are composed in the order of the file, and a second pass,
which knows where it begins, cuts the objects out. Only objects that cross a range's border are put together in a shuffle.

Shapes: an array, an object whose field "conversations" is an array, or one object.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import cut


class BrokenExport(ValueError):
    """A file that is no whole JSON text."""


#: Ranges whose beginnings (a short row each) go to all tasks: at 128 MB a range, 12 TB.
MOST_RANGES = 100_000
_BEGIN = "file string, block long, inside boolean, depth long, region boolean, base long, whole boolean"
_DEPTH = np.zeros(256, np.int8)
_DEPTH[[ord("{"), ord("[")]], _DEPTH[[ord("}"), ord("]")]] = 1, -1


def _ranges(spark: SparkSession, path: str, name: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", "}")
    if name:
        reader = reader.option("pathGlobFilter", name)
    rows = reader.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.concat("value", F.lit("}")).alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes, int]]:
    """(file, size, block, joined records, their number) of every run of records of one range inside a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column(0).to_pylist(), batch.column(2).to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | np.array([a != b for a, b in zip(file, file[1:])], bool)]))
        text = batch.column(3).cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2])
        for lo, hi in zip(new, [*new[1:], batch.num_rows]):
            yield file[lo], batch.column(1)[int(lo)].as_py(), int(block[lo]), bytes(data[offsets[lo] : offsets[hi]]), int(hi - lo)


def _scan(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of brackets and braces, whether an even number of quotes is before each, and whether before the end."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    after = quotes[(quotes > 0) & (b[quotes - 1] == 92)]
    if len(after):  # a quote after an odd number of backslashes is escaped
        back = b == 92
        last = np.maximum.accumulate(np.where(back, -1, np.arange(len(b))))
        quotes = np.setdiff1d(quotes, after[(after - 1 - last[after - 1]) % 2 == 1], assume_unique=True)
    marks = np.flatnonzero(_DEPTH[b] != 0)
    return marks, np.searchsorted(quotes, marks) % 2 == 0, np.array(len(quotes) % 2 == 0)


_KEY = re.compile(rb'"conversations"\s*:\s*\[')
_EFFECT = "file string, size long, block long, bytes long, first string, ends array<boolean>, delta array<long>, least array<long>, opens array<array<long>>"


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every range does if it begins outside (0) or inside (1) a string: whether it ends inside one, by how much the depth changes, the least depth on
    the way, and depths at which a field "conversations" opens an array, with the least depth after that; all depths against the beginning's."""
    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("bytes", pa.int64()), ("first", pa.string()), ("ends", pa.list_(pa.bool_())), ("delta", pa.list_(pa.int64())), ("least", pa.list_(pa.int64())), ("opens", pa.list_(pa.list_(pa.int64())))])
    now: dict | None = None

    def row(x: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([x], schema=schema)

    for file, size, block, data, _ in _runs(batches):
        if now is None or (now["file"], now["block"]) != (file, block):
            if now:
                yield row(now)
            first = data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1") if block == 0 else None
            now = {"file": file, "size": size, "block": block, "bytes": 0, "first": first, "ends": [False, True], "delta": [0, 0], "least": [0, 0], "opens": [[], []]}
        marks, even, whole = _scan(data)
        keys = {m.end() - 1 for m in _KEY.finditer(data)}
        deltas = _DEPTH[np.frombuffer(data, np.uint8)[marks]].astype(np.int64)
        now["bytes"] += len(data)
        for s in (0, 1):
            inside = now["ends"][s]
            outside = even != inside
            depth = now["delta"][s] + np.cumsum(np.where(outside, deltas, 0))
            if len(depth):
                least = int(depth.min())
                now["least"][s] = min(now["least"][s], least)
                pairs = now["opens"][s]
                for k in range(1, len(pairs), 2):
                    pairs[k] = min(pairs[k], least)
                for k in np.flatnonzero(outside & np.isin(marks, list(keys))).tolist() if keys else ():
                    pairs += [int(depth[k]), int(depth[k:].min())]
                now["delta"][s] = int(depth[-1])
            now["ends"][s] = bool(inside == whole)
    if now:
        yield row(now)


def _begin(key: tuple, ranges: pd.DataFrame) -> pd.DataFrame:
    """Where every range of a file begins: inside a string or not, its depth, and whether in the array of conversations. base: the objects' depth.
    whole: whether the file ends outside strings and at depth 0."""
    ranges = ranges.sort_values("block")
    inside, depth, region, found = False, 0, None, []
    array = ranges["first"].iloc[0] == "["
    for r in ranges.itertuples():
        found.append([inside, depth, region])
        s = int(inside)
        if region and depth + r.least[s] < 2:
            region = False
        opens = r.opens[s]
        for at, least in zip(opens[::2], opens[1::2]):
            if region is None and depth + at == 2:
                region = depth + least >= 2
        inside, depth = bool(r.ends[s]), depth + int(r.delta[s])
    more = int(ranges["bytes"].sum()) - int(ranges["size"].iloc[0])
    extra = more in (1, -2)  # the last record ended with the file: its brace is ours (the reader leaves out a byte order mark of 3)
    base = 1 if array else 0 if region is None else 2
    return pd.DataFrame({
        "file": key[0], "block": ranges["block"], "inside": [f[0] for f in found], "depth": [f[1] for f in found],
        "region": [base < 2 or bool(f[2]) for f in found], "base": base, "whole": not inside and depth == -int(extra),
    })


@dataclass
class _Cutter:
    """Cuts the objects of one range out of its records."""

    inside: bool
    depth: int
    region: bool
    base: int

    def __post_init__(self) -> None:
        self.kept: list[bytes] = []
        self.open = self.region and self.depth > self.base  # in an element, which may be none of the objects
        self.begun, self.number = False, 0

    def pieces(self, data: bytes) -> Iterator[tuple[int, bool, bool, bytes]]:
        """(number, begun here, ended here, text) of the objects that end in the data."""
        marks, even, whole = _scan(data)
        b = np.frombuffer(data, np.uint8)
        outside = even != self.inside
        self.inside = bool(self.inside == whole)
        marks = marks[outside]
        kinds = b[marks]
        depth = self.depth + np.cumsum(_DEPTH[kinds].astype(np.int64))
        begins = (kinds == 123) & (depth == self.base + 1)
        ends = (_DEPTH[kinds] < 0) & (depth == self.base)
        special = begins | ends | (depth < self.base)
        if self.base == 2:
            special |= (kinds == 91) & (depth == 2)
            keys = {m.end() - 1 for m in _KEY.finditer(data)}
        last = 0
        for k in np.flatnonzero(special).tolist():
            at = int(marks[k])
            if depth[k] < self.base and kinds[k] != 123:
                self.region = self.base < 2
            if self.base == 2 and kinds[k] == 91 and depth[k] == 2 and not self.region:
                self.region = at in keys
            elif begins[k] and self.region and not self.open:
                self.open, self.begun, last = True, True, at
                self.number += 1
            elif ends[k] and self.open:
                yield self.number, self.begun, True, b"".join(self.kept) + data[last : at + 1]
                self.kept, self.open, self.begun = [], False, False
        if self.open:
            self.kept.append(data[last:])
        if len(depth):
            self.depth = int(depth[-1])

    def rest(self) -> tuple[int, bool, bool, bytes] | None:
        return (self.number, self.begun, False, b"".join(self.kept)) if self.open else None


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, cutter = None, None
    names = ["file", "block", "number", "begun", "ended", "json"]

    def out(found: list) -> pa.RecordBatch:
        n, begun, ended, text = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found)), pa.array([now[1]] * len(found), pa.int64()), pa.array(n, pa.int64()), pa.array(begun), pa.array(ended), pa.array(text, pa.binary())], names=names)

    for batch in batches:
        facts = [batch.column(i) for i in range(4, batch.num_columns)]
        at = 0
        for file, _, block, data, n in _runs([batch]):
            if now != (file, block):
                if cutter and (rest := cutter.rest()):
                    yield out([rest])
                now, cutter = (file, block), _Cutter(*(c[at].as_py() for c in facts))
            at += n
            found = list(cutter.pieces(data))
            for i in range(0, len(found), 100):
                yield out(found[i : i + 100])
    if cutter and (rest := cutter.rest()):
        yield out([rest])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records with seq: their number in the task, so in their range's order."""
    seq = 0
    for batch in batches:
        yield batch.append_column("seq", pa.array(np.arange(seq, seq + batch.num_rows)))
        seq += batch.num_rows


def read_objects(spark: SparkSession, path: str, name: str | None = None, strict: bool = True) -> DataFrame:
    """(file, pos, json) of the objects in JSON files: the elements of an array that are objects, those of a field "conversations", or the file's one.

    name: only files of that name in a folder. pos ascends in the order of the file. Keys keep their order and texts their bytes. A file that isn't
    whole (it ends in a string, or before its last bracket) raises BrokenExport, or with strict=False gives no rows. Files may have any size,
    and need not have line breaks; an object has to fit a row, and so does what lies between two closing braces. Files are scanned three
    times, without a shuffle of their text: for the effects, for objects inside a range, for objects across ranges.
    """
    records = _ranges(spark, path, name)
    begins = cut(records.mapInArrow(_effects, _EFFECT).groupBy("file").applyInPandas(_begin, _BEGIN))  # a row for each range
    broken = [r.file for r in begins.where("not whole").select("file").distinct().limit(5).collect()]
    if broken and strict:
        raise BrokenExport(f"no whole JSON: {', '.join(broken)}")
    known = begins.where("whole").drop("whole")
    columns = ["file", "size", "block", "text", "inside", "depth", "region", "base"]
    if known.count() <= MOST_RANGES:
        rows = records.join(F.broadcast(known), ["file", "block"]).select(columns)
    else:  # the records' order is kept as a number
        numbered = records.mapInArrow(_numbered, records.withColumn("seq", F.lit(0).cast("long")).schema)
        rows = numbered.join(known, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "seq").select(columns)
    parts = rows.mapInArrow(_objects, "file string, block long, number long, begun boolean, ended boolean, json binary")
    pos = (F.col("block") * 1024 + F.col("number") - 1).alias("pos")
    whole = parts.where("begun and ended").select("file", pos, F.col("json").cast("string").alias("json"))
    order = Window.partitionBy("file").orderBy("block", "number", F.col("begun").asc())  # two parts of a range at most
    crossing = parts.where("not (begun and ended)").withColumn("of", F.sum(F.col("begun").cast("int")).over(order)).where("of > 0")
    before = order.partitionBy("file", "of").rowsBetween(Window.unboundedPreceding, -1)
    crossing = crossing.withColumn("over", F.coalesce(F.max("ended").over(before), F.lit(False))).where("not over")
    one = crossing.groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "number", "json"))).alias("parts"), F.max("ended").alias("ended")).where("ended")
    text = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.json))").cast("string").alias("json")
    return whole.unionByName(one.select("file", F.expr("parts[0].block * 1024 + parts[0].number - 1").alias("pos"), text))
