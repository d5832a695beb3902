"""Features of a GeoJSON FeatureCollection, cut at their boundaries by the tasks that read the parts of the file.

Whether a brace opens a feature depends on all text before it: on how deep it lies, and on whether it stands in a string.
A first scan finds what each part of the file does to that state (one row a part), the states compose along
the file, and a second scan cuts each part where its features really begin and end. Features that go on over parts come
as fragments and are put together by part. No file is read whole by a task, however it is laid out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The text reader splits files here; what ends a row is put back.
END = "}"
TOKEN = re.compile(r'\\.|"|\{|\}', re.S)
WHOLE, FIRST, MIDDLE, LAST = range(4)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", END).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: whether its number of quotes is odd, and how much deeper its braces lead, outside strings if it begins outside, or inside one."""
    at, odd, deeper = None, 0, [0, 0]
    rows = []
    for batch in batches:
        for file, start, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if (file, start) != at:
                if at:
                    rows.append((*at, bool(odd), *deeper))
                at, odd, deeper = (file, start), 0, [0, 0]
            for token in TOKEN.findall(text + END):
                if token == '"':
                    odd ^= 1
                elif token == "{":
                    deeper[odd] += 1
                elif token == END:
                    deeper[odd] -= 1
    if at:
        rows.append((*at, bool(odd), *deeper))
    kinds = (("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("out", pa.int64()), ("inn", pa.int64()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


def feature_texts(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """(number, text): objects inside the outermost one of each file, numbered from 0 in the order of files and places.

    Members of the collection that are no features (a CRS) are among them. Text outside UTF-8 and unbalanced braces give
    what the scan makes of them; an empty file gives nothing.
    """
    pieces = _pieces(spark, path)
    states: dict[tuple[str, int], tuple[int, int]] = {}
    file, inside, depth = None, 0, 0
    for r in sorted(pieces.mapInArrow(_summaries, "file string, start long, odd boolean, out long, inn long").collect()):  # one row a part
        if r.file != file:
            file, inside, depth = r.file, 0, 0
        states[r.file, r.start] = (inside, depth)
        depth += r.inn if inside else r.out
        inside ^= r.odd

    def cut(batches):
        at, n, held, began, inside, depth = None, 0, [], False, 0, 0
        for batch in batches:
            rows = []

            def give(kind):
                nonlocal n, held
                rows.append((*at, n, kind, "".join(held)))  # noqa: B023
                n, held = n + 1, []

            for file, start, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, start) != at:
                    if held:
                        give(FIRST if began else MIDDLE)
                    at, n, held, began = (file, start), 0, [], False
                    inside, depth = states[at]
                text += END
                copied = 0 if depth > 1 else None
                for m in TOKEN.finditer(text):
                    token = m.group()
                    if token == '"':
                        inside ^= 1
                    elif inside or token[0] == "\\":
                        continue
                    elif token == "{":
                        depth += 1
                        if depth == 2:
                            copied, began = m.start(), True
                    else:
                        depth -= 1
                        if depth == 1 and copied is not None:
                            held.append(text[copied : m.end()])
                            give(WHOLE if began else LAST)
                            copied = None
                if copied is not None:
                    held.append(text[copied:])
            yield table(rows)
        if held:
            yield table([(*at, n, FIRST if began else MIDDLE, "".join(held))])

    def table(rows):
        kinds = (("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("kind", pa.int32()), ("text", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    found = scratch.save(pieces.mapInArrow(cut, "file string, start long, n long, kind int, text string"))
    # a part's numbers go on from those of the parts before; only what begins in it counts
    begun = found.where(F.col("kind").isin(WHOLE, FIRST)).groupBy("file", "start").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = begun.select("file", "start", (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("least")).alias("offset"))
    whole = found.where(F.col("kind") == WHOLE).join(offsets, ["file", "start"]).select((F.col("n") + F.col("offset")).alias("number"), "text")
    # fragments: those between two beginnings belong to the first of them
    broken = found.where(F.col("kind") != WHOLE).join(offsets, ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start", "n")
    first = F.when(F.col("kind") == FIRST, F.col("n") + F.col("offset"))
    broken = broken.withColumn("number", F.last(first, True).over(order)).where("number is not null")
    joined = broken.groupBy("number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "n", "text"))), lambda x: x["text"]), "").alias("text"))
    return whole.union(joined)
