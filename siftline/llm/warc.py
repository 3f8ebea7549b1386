"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by id; the bounds of the shards come from exact sums over ranges of ids, so the same input
always gives the same files. A task writes its files under temporary names, renames them when they are whole, and
writes a manifest last. A task that is run again writes the same bytes under the same names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.tables import stored

SHARD_BYTES, FILE_BYTES, WAYS = 32 << 20, 8 << 20, 4096
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the namespace of URLs


def _store(path: str):
    """A file system and the path in it, for local, HDFS or object storage."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value on one line; control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record with regenerated headers; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = _clean(url) or f"urn:page:{page}"
    name = lambda p: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{p} {digest}')}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {name(refers_to)}")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def shard_bounds(sizes: DataFrame, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards for ``(page, bytes)``: start of each range of ids, its first shard, and over how many shards it goes.

    Ranges that are too heavy are divided again, down to single ids; a single id heavier than a shard goes over
    several by hash. Each pass is one aggregate of at most ``WAYS`` rows for a heavy range.
    """
    ends = sizes.agg(F.min("page"), F.max("page")).first()
    if ends[0] is None:
        return np.array([0]), np.array([0]), np.array([1])
    done, work = [], [(int(ends[0]), int(ends[1]) + 1)]
    while work:
        todo = []
        for low, high in work:
            width = max(1, -(-(high - low) // WAYS))
            found = sizes.filter((F.col("page") >= low) & (F.col("page") < high)).groupBy(
                F.floor((F.col("page") - low) / width).cast("bigint").alias("k")
            ).agg(F.sum("bytes").alias("bytes")).collect()
            for row in found:
                at = low + row["k"] * width
                (todo if row["bytes"] > target and width > 1 else done).append((at, min(at + width, high), row["bytes"]))
        work = [(a, b) for a, b, _ in todo]
    done.sort()
    starts, first, over, shard, filled = [], [], [], 0, 0
    for low, _, size in done:
        ways = max(1, -(-size // target))
        if filled and (filled + size > target or ways > 1):
            shard, filled = shard + 1, 0
        starts.append(low)
        first.append(shard)
        over.append(ways)
        filled += size
        if ways > 1:
            shard, filled = shard + ways, 0
    return np.array(starts), np.array(first), np.array(over)


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below ``path`` and return the manifest: ``file``, ``records``, ``bytes``, ``sha1``.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is the response
    and the others revisit it. Rows that share the smallest id of a payload are all responses. A null payload is
    empty, a null URL is named after the id. Null ids are sorted first and are never referred to unless all ids of
    a payload are null, in which case all those are responses. Other columns are ignored. No rows, no files.

    A file ends when its compressed bytes reach ``file_bytes``; a record is never cut. Each record is a gzip member.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    slim = stored(base.select("page", "url", "digest", F.octet_length("payload").alias("size")), "digests")
    lowest = slim.filter(F.col("size") >= least_bytes).groupBy("digest").agg(
        F.min("page").alias("lowest"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    sizes = slim.select(F.coalesce("page", F.lit(-(1 << 62))).alias("page"), (F.col("size") + 600).alias("bytes"))
    starts, first, over = shard_bounds(sizes, shard_bytes)
    shards = int(first[-1] + over[-1])
    # Ids and digests alone meet in the join; what it finds travels to the shards as marks that are sorted before
    # their records, so payloads are moved once.
    marks = slim.join(lowest, "digest").filter(~F.col("page").eqNullSafe(F.col("lowest")) & F.col("lowest").isNotNull())
    columns = ["digest", "page", "url", "lowest", "payload"]
    dealt = base.withColumn("lowest", F.lit(None).cast("bigint")).select(*columns).unionByName(
        marks.withColumn("payload", F.lit(None).cast("binary")).select(*columns)
    ).withColumn("spread", F.pmod(F.xxhash64("url", "digest"), F.lit(1 << 30)))

    def sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            page = frame["page"].astype("Int64").fillna(-(1 << 62)).astype("int64").to_numpy()
            at = np.maximum(np.searchsorted(starts, page, side="right") - 1, 0)
            yield frame.assign(shard=first[at] + frame["spread"].to_numpy() % over[at])

    fields = "digest string, page bigint, url string, lowest bigint, payload binary, spread bigint, shard bigint"
    placed = dealt.mapInPandas(sharded, fields).drop("spread")
    root = path.rstrip("/")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        tag = f"{task.stageId()}-{task.taskAttemptId()}"
        state: dict = {"shard": None}
        made: list[tuple] = []
        mark: tuple | None = None

        def close() -> None:
            if state.get("out") is not None:
                state["out"].close()
                name = f"{root}/warc-{state['shard']:06d}-{state['k']:05d}.warc.gz"
                store, final = _store(name)
                store.move(state["temp"], final)
                made.append((name, state["records"], state["bytes"], state["sha1"].hexdigest()))
                state["out"] = None

        def end_shard() -> None:
            close()
            if state["shard"] is not None:
                own = [m for m in made if f"/warc-{state['shard']:06d}-" in m[0]]
                lines = "".join(json.dumps(dict(zip(("file", "records", "bytes", "sha1"), m))) + "\n" for m in own)
                store, temp = _store(f"{root}/_{tag}-{state['shard']:06d}.tmp")
                with store.open_output_stream(temp, compression=None) as out:
                    out.write(lines.encode())
                store.move(temp, _store(f"{root}/manifest-{state['shard']:06d}.json")[1])

        for frame in batches:
            for shard, page, url, body, digest, low in zip(
                frame["shard"], frame["page"], frame["url"], frame["payload"], frame["digest"], frame["lowest"]
            ):
                page = None if pd.isna(page) else int(page)
                if body is None:
                    mark = (page, digest, int(low))
                    continue
                revisit = mark is not None and mark[:2] == (page, digest)
                low = mark[2] if revisit else None
                if shard != state["shard"]:
                    end_shard()
                    state = {"shard": shard, "k": -1, "out": None}
                if state["out"] is None:
                    store, temp = _store(f"{root}/_{tag}-{shard:06d}-{state['k'] + 1:05d}.tmp")
                    store.create_dir(temp.rsplit("/", 1)[0], recursive=True)
                    state |= {"k": state["k"] + 1, "out": store.open_output_stream(temp, compression=None), "temp": temp, "bytes": 0, "records": 0, "sha1": hashlib.sha1()}
                text = base64.b32encode(bytes.fromhex(digest)).decode()
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = deflate.compress(record(page, url, body, text, low, revisit, date)) + deflate.flush()
                state["out"].write(member)
                state["sha1"].update(member)
                state["bytes"] += len(member)
                state["records"] += 1
                if state["bytes"] >= file_bytes:
                    close()
        end_shard()
        yield pd.DataFrame(made, columns=["file", "records", "bytes", "sha1"])

    order = ["shard", "page", "digest", F.col("payload").isNotNull(), "url"]
    one_each = placed.withColumn("shard", F.col("shard").cast("int")).repartitionById(shards, F.col("shard"))
    written = one_each.sortWithinPartitions(*order).mapInPandas(
        write, "file string, records bigint, bytes bigint, sha1 string"
    )
    # One run commits all shards; what it returns is checked against the manifests that are read back.
    told = written.agg(F.sum("records").alias("records")).first()["records"] or 0
    manifest = read_manifest(spark, root, bool(told))
    if (manifest.agg(F.sum("records")).first()[0] or 0) != told:
        raise RuntimeError(f"the manifests below {root} do not hold all records")
    return manifest


def read_manifest(spark: SparkSession, path: str, any_: bool = True) -> DataFrame:
    schema = "file string, records bigint, bytes bigint, sha1 string"
    if not any_:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path.rstrip('/')}/manifest-*.json")


def _members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one by one."""
    inflate, parts = zlib.decompressobj(31), []
    while chunk := stream.read(1 << 20):
        while chunk:
            parts.append(inflate.decompress(chunk))
            chunk = inflate.unused_data
            if inflate.eof:
                yield b"".join(parts)
                inflate, parts = zlib.decompressobj(31), []


def read_warc(manifest: DataFrame) -> DataFrame:
    """The records of the files of a manifest: ``page_id``, ``url``, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` and ``payload`` (null for a revisit). Digests of responses are computed anew
    and must agree with their headers."""
    fields = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for name in frame["file"]:
                rows, held = [], 0
                store, path = _store(name)
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in _members(stream):
                        head, _, rest = raw.partition(b"\r\n\r\n")
                        tags = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:])
                        block = rest[:int(tags["Content-Length"])]
                        http, _, body = block.partition(b"\r\n\r\n")
                        digest = tags["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = tags["WARC-Type"] == "response"
                        if response and base32_sha1(body) != digest:
                            raise ValueError(f"a record of {name} does not have its digest")
                        length = len(body) if response else int(http.rsplit(b"Content-Length: ", 1)[1])
                        number = lambda key: int(tags[key]) if key in tags else None
                        rows.append((number("X-Page-ID"), tags["WARC-Target-URI"], length, digest, tags["WARC-Type"],
                                     number("X-Refers-To-Page-ID"), body if response else None))
                        held += len(body)
                        if held > 16 << 20:
                            yield _frame(rows)
                            rows, held = [], 0
                yield _frame(rows)

    # A number of its own keeps these few short rows, which stand for large files, in as many tasks.
    files = max(1, min(manifest.count(), 100_000))
    return manifest.select("file").repartition(files, "file").mapInPandas(run, fields)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})
