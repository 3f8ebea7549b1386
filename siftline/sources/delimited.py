"""Delimited text files.

A folder is read as lines, in splits. Three scans lead to rows: the encoding and the first line of every file; how
every split of a file changes the state of its quotes, and how many records begin in it; the records. A line begins
either a record or inside a quoted cell, so what a split does is a function of two states, and the states of all
splits follow from composing these functions along each file. Files with quoted line breaks are thus split like others.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.checkpoints import new_path
from siftline.operators.columns import OVERFLOW, ROW_ID, col

# Candidate delimiters, earlier ones win ties.
DELIMITERS = [",", ";", "\t", "|"]
# Up to so many small rows, of files or of splits, are sent to all tasks; more are joined by a shuffle.
MOST_SENT = 100_000
ROWS = 8192
MARK = b"\xef\xbb\xbf"


def route_files(paths: DataFrame) -> DataFrame:
    """Extension and kind (structured, unstructured, unknown) of a ``(path)`` DataFrame."""
    name = F.element_at(F.split(X.strip(F.col("path")), "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    kind = (
        F.when(extension == "csv", F.lit("structured"))
        .when(extension.isin("txt", "pdf"), F.lit("unstructured"))
        .otherwise(F.lit("unknown"))
    )
    return paths.withColumns({"extension": F.coalesce(extension, F.lit("")), "kind": kind})


def _lines(spark: SparkSession, path: str) -> DataFrame:
    # The text source hands over the bytes of each line as they are.
    return spark.read.text(path)


def inspect_delimited(spark: SparkSession, path: str) -> dict:
    """One scan of the lines: data rows, the encoding, and whether quoted cells may span lines."""
    line = F.col("value")
    quotes = F.length(line) - F.length(F.translate(line, '"', ""))
    facts = _lines(spark, path).agg(
        F.count_if(X.present(line)).alias("lines"),
        F.bool_and(F.is_valid_utf8(line)).alias("utf8"),
        F.bool_or(quotes % 2 == 1).alias("spans"),
    ).first()
    return {
        "n_rows": max((facts["lines"] or 0) - 1, 0),
        "encoding": "ISO-8859-1" if facts["utf8"] is False else "UTF-8",
        "multi_line": bool(facts["spans"]),
    }


def _candidates(header: str) -> list[tuple[str, int]]:
    """Delimiters that split the header into two or more columns with the number of those, best first."""
    found = []
    for delim in DELIMITERS:
        cells = next(csv.reader([header.lstrip("﻿")], delimiter=delim, skipinitialspace=True), [])
        found.append((delim, sum(1 for c in cells if c.strip())))
    return sorted((d for d in found if d[1] >= 2), key=lambda d: -d[1])


def _splits(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    first = _lines(spark, path).filter(X.present(F.col("value"))).first()
    found = _candidates(first[0]) if first else []
    if not found:
        raise ValueError(f"{path} does not split into two or more columns")
    return found


def detect_delimiter(spark: SparkSession, path: str) -> DataFrame:
    """``(delim, n_cols, n_rows, score)`` of every candidate with at least two columns, best first."""
    found = _splits(spark, path)
    rows = inspect_delimited(spark, path)["n_rows"]
    scored = [(delim, n, rows, n * 1_000_000 + rows, place) for place, (delim, n) in enumerate(found)]
    schema = "delim string, n_cols bigint, n_rows bigint, score bigint, place int"
    return spark.createDataFrame(scored, schema).orderBy(F.desc("score"), "place").drop("place")


def ends_quoted(line: bytes, delim: bytes, quoted: bool) -> bool:
    """Whether a quoted cell is open after ``line``, if it is or is not before.

    Quotes count at the start of a cell only, blanks before them aside; two quotes inside a quoted cell are one.
    """
    at = 0
    while True:
        if quoted:
            while (at := line.find(b'"', at)) >= 0 and line.startswith(b'"', at + 1):
                at += 2
            if at < 0:
                return True
        else:
            while line.startswith(b" ", at):
                at += 1
            if line.startswith(b'"', at):
                quoted, at = True, at + 1
                continue
        at = line.find(delim, at)
        if at < 0:
            return False
        quoted, at = False, at + 1


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_SPLITS = "file string, block bigint, after boolean, after_quoted boolean, head bigint, records bigint, records_quoted bigint, header binary"


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does, for a split that begins a record and for one that begins inside a quoted cell."""
    for (file, block, delim), lines in groupby(_rows_of(batches), key=lambda r: r[:3]):
        delim = delim.encode()
        plain, quoted, n, starts, starts_quoted = False, True, 0, 0, 0
        head, header, heading = None, [], block == 0
        for *_, line in lines:
            n += 1
            if heading and n == 1:
                line = line.removeprefix(MARK)
            if heading and not header and not line.strip():
                continue
            starts += not plain and line != b""
            starts_quoted += not quoted and line != b""
            if heading:
                header.append(line)
            if b'"' in line:
                plain, quoted = ends_quoted(line, delim, plain), ends_quoted(line, delim, quoted)
            if head is None and not quoted:
                head = n
            heading = heading and plain
        row = (file, block, plain, quoted, n if head is None else head, starts, starts_quoted, b"\n".join(header) if block == 0 else None)
        names = [c.split()[0] for c in _SPLITS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)


def _joined(lines: DataFrame, facts: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``lines`` with the facts of their file or split, in the order of each split."""
    if rows <= MOST_SENT:
        return lines.join(F.broadcast(facts), keys)
    return lines.join(facts, keys).sortWithinPartitions("file", "block", "at")


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(lines: DataFrame, path: str, delim: str | None) -> DataFrame:
    """``file``, ``utf8`` and ``delim`` of every file that has a filled line."""
    there = (F.col("block") == 0) & X.present(F.col("value"))
    facts = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.min_by(F.when(there, F.col("value")), F.when(there, F.col("at"))).cast("binary").alias("first"),
    ).filter("first is not null")

    def with_delimiter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_candidates(h.decode("utf-8" if u else "latin-1")) for h, u in zip(batch.column("first").to_pylist(), batch.column("utf8").to_pylist())]
            best = pa.array([delim or (f[0][0] if f else None) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("utf8"), best], ["file", "utf8", "delim"])

    files = _stored(facts.mapInArrow(with_delimiter, "file string, utf8 boolean, delim string"), "files")
    bad = files.filter("delim is null").first()
    if bad or files.isEmpty():
        raise ValueError(f"{bad['file'] if bad else path} does not split into two or more columns")
    return files


def _names(header: str, delim: str) -> list[str]:
    cells = next(csv.reader(header.lstrip("﻿").splitlines(keepends=True), delimiter=delim, skipinitialspace=True), [])
    return [c.strip() or f"_c{k}" for k, c in enumerate(cells)]


def read_delimited(spark: SparkSession, path: str, delim: str | None = None) -> DataFrame:
    """All cells of a file or folder as text, with ``_row_id`` in the order of files and lines.

    Encoding (UTF-8, else Latin-1 for the whole file), header and delimiter are those of each file. Columns are those
    of all headers, in the order in which the files bring them; of equal names in one header the last counts, and
    columns without a name are called ``_c0`` and so on. Short rows are padded with NULL, empty cells are NULL, and
    cells beyond a file's header are kept in ``_overflow`` (NULL where there are none). Empty lines are no rows, and
    a quote that is never closed ends with its file. Files without a filled line have no rows; a file that does not
    split into two columns is an error. ``_row_id`` counts from 0 and does not depend on the size of the splits.
    """
    lines = _lines(spark, path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
    ).withColumn("at", F.monotonically_increasing_id())
    files = _files(lines, path, delim)
    n_files = files.count()
    raw = lines.withColumn("value", F.col("value").cast("binary"))
    scanned = _joined(raw, files.select("file", "delim"), ["file"], n_files).select("file", "block", "delim", "value")
    blocks = _stored(scanned.mapInArrow(_summarised, _SPLITS), "splits")

    # The state in which each split begins: functions of two states composed along the file, one row a split.
    # From the last split whose end does not depend on its start, each one keeps the state or turns it.
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.col("after") & ~F.col("after_quoted")).cast("int")
    fixed = blocks.withColumn("turns", F.coalesce(F.sum(turn).over(along), F.lit(0)))
    certain = F.when(F.col("after") == F.col("after_quoted"), F.struct("turns", "after"))
    fixed = fixed.withColumn("known", F.last(certain, ignorenulls=True).over(along))
    odd = (F.col("turns") - F.coalesce(F.col("known.turns"), F.lit(0))) % 2 == 1
    fixed = fixed.withColumn("quoted", F.coalesce(F.col("known.after"), F.lit(False)) != odd)
    count = F.when(F.col("quoted"), F.col("records_quoted")).otherwise(F.col("records")) - F.when(F.col("block") == 0, 1).otherwise(0)
    per_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    fixed = fixed.withColumn("count", count).withColumn(
        "inner", F.coalesce(F.sum("count").over(along), F.lit(0))
    )
    totals = fixed.groupBy("file").agg(F.sum("count").alias("total"))
    totals = totals.withColumn("first_row", F.coalesce(F.sum("total").over(per_file), F.lit(0))).drop("total")
    # The first lines of a split that begins inside a cell belong to the last split before it in which a record begins.
    begins = F.when(F.when(F.col("quoted"), F.col("records_quoted")).otherwise(F.col("records")) > 0, F.col("block"))
    owner = F.last(begins, ignorenulls=True).over(along)
    catalog = _stored(
        fixed.withColumn("owner", owner).join(totals, "file").join(files, "file").select(
            "file", "block", "quoted", "head", "owner", (F.col("first_row") + F.col("inner")).alias("base"), "header", "utf8", "delim",
        ), "catalog",
    )
    n_blocks = catalog.count()

    # One row for each different header; names are known to the driver, as they become columns.
    heads = catalog.filter("block = 0").groupBy("header", "utf8", "delim").agg(F.min("file").alias("file")).orderBy("file").collect()
    of_header = {(bytes(h["header"]), h["utf8"], h["delim"]): _names(bytes(h["header"]).decode("utf-8" if h["utf8"] else "latin-1"), h["delim"]) for h in heads}
    names = list(dict.fromkeys(n for found in of_header.values() for n in found))
    ids = {key: k for k, key in enumerate(of_header)}
    numbered = spark.createDataFrame([(*key, k) for key, k in ids.items()], "header binary, utf8 boolean, delim string, names int")
    by_file = catalog.filter("block = 0").join(F.broadcast(numbered), ["header", "utf8", "delim"]).select("file", "names")
    catalog = catalog.drop("header").join(by_file, "file")

    placed = [[{n: k for k, n in enumerate(found)}.get(n) for n in names] for found in of_header.values()]
    widths = [len(found) for found in of_header.values()]
    tails = _tails(raw, catalog, n_blocks)
    wanted = ["block", "base", "quoted", "head", "utf8", "delim", "names", "value"]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        held: list[tuple[int, list[str]]] = []
        kind = -1

        def flush() -> pa.RecordBatch:
            columns = [pa.array([n for n, _ in held], pa.int64())]
            for at in placed[kind]:
                columns.append(pa.array([(r[at] or None) if at is not None and at < len(r) else None for _, r in held], pa.string()))
            columns.append(pa.array([r[widths[kind]:] or None for _, r in held], pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays(columns, [ROW_ID, *names, OVERFLOW])

        # ``file`` alone would not do: a file may be read in any number of splits by one task.
        for key, lines in groupby(_rows_of(batches), key=lambda r: (r[0], r[1:-2])):
            (_, (block, base, quoted, head, utf8, delim, which)) = key
            if which != kind and held:
                yield flush()
                held = []
            kind = which
            coding = "utf-8" if utf8 else "latin-1"

            def texts():
                begun = block > 0
                for k, row in enumerate(lines):
                    line = row[-2].removeprefix(MARK) if block == 0 and k == 0 else row[-2]
                    begun = begun or bool(line.strip())
                    if begun and (not quoted or k >= head):
                        yield line.decode(coding) + "\n"
                    if row[-1] is not None:
                        yield row[-1].decode(coding) + "\n"

            rows = (r for r in csv.reader(texts(), delimiter=delim, skipinitialspace=True) if r)
            if block == 0:
                next(rows, None)
            for n, row in enumerate(rows):
                held.append((base + n, row))
                if len(held) >= ROWS:
                    yield flush()
                    held = []
        if held:
            yield flush()

    rows = _joined(raw, catalog, ["file", "block"], n_blocks)
    if tails is None:
        rows = rows.withColumn("tail", F.lit(None).cast("binary"))
    else:
        rows = rows.join(tails, ["file", "block", "at"], "left").sortWithinPartitions("file", "block", "at")
    schema = ", ".join([f"`{ROW_ID}` bigint", *[f"`{n.replace('`', '``')}` string" for n in names], f"`{OVERFLOW}` array<string>"])
    made = rows.select("file", *wanted, "tail").mapInArrow(parsed, schema)
    return made.select(ROW_ID, *[X.preprocess_markdown_links(col(n)).alias(n) for n in names], OVERFLOW)


def _tails(raw: DataFrame, catalog: DataFrame, n_blocks: int) -> DataFrame | None:
    """``tail``: the lines that end a record of an earlier split, at the last line of that split; none if there are none."""
    moved = catalog.filter("quoted and owner is not null")
    if moved.isEmpty():
        return None
    spans = moved.select("file", "block", "head", "owner")
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    lines = _joined(raw, spans, ["file", "block"], n_blocks).withColumn("k", place).filter("k <= head")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"])
    joined = lines.groupBy("file", "owner").agg(parts.alias("parts")).select(
        "file", F.col("owner").alias("block"),
        F.expr("aggregate(slice(parts, 2, size(parts)), parts[0], (a, p) -> concat(a, X'0A', p))").alias("tail"),
    )
    ends = raw.join(joined.select("file", "block"), ["file", "block"]).groupBy("file", "block").agg(F.max("at").alias("at"))
    return joined.join(ends, ["file", "block"])
