"""WARC archives with a two-level capture index.

Writing: records go to gzip members of archive files in the shared folder. Index entries, sorted by reversed-host url
key, id and place, are packed into compressed blocks; a directory holds each block's first key. Reading: a sorted batch of
keys finds its index files, then by binary search its blocks and all entries of the key, then reads the records' byte
ranges. A revisit takes its payload's size and digest from the response that it refers to.

Files are written by tasks under names of their own attempt, and only those that a finished job lists count, so a task
that is run again does no harm.
"""

import base64
import bisect
import hashlib
import json
import uuid
import zlib

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaya.shared import cut, scratch_path

ENTRY = "surt string, id long, file string, offset long, length long, digest string, record_type string, refers_to long"
RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
PLACE = "id long, file string, offset long, length long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """The rows in the schema's columns; numbers stay whole beside nulls."""
    kinds = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pd.DataFrame({name: pd.array(values, dtype="Int64" if kind == "long" else object) for (name, kind), values in zip(kinds, columns)})


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def surt(url: Column) -> Column:
    """The reversed-host key: ``http://www.a.com/x`` gives ``com,a,www)/x``. Null: ``)``."""
    host = F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), rest), F.lit(")"))


def decided(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """id, url, payload, size, SHA-1 and ``refers_to``: the largest id with this payload where that is another row's.

    The largest id of each payload is worked out from digests, with partial sums before the shuffle. It comes back by an
    equi-join that adaptive execution splits where one payload has a third of all rows.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"))
    first = rows.groupBy("sha1", "size").agg(F.max("id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    first = first.select(F.col("sha1").alias("_sha1"), F.col("size").alias("_size"), "_last")
    out = rows.join(first, (F.col("sha1") == F.col("_sha1")) & (F.col("size") == F.col("_size")), "left")
    other = (F.col("size") >= least) & F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("id"))
    return out.select("id", "url", "payload", "size", "sha1", F.when(other, F.col("_last")).alias("refers_to"))


def _record(url: str, payload: bytes, digest: str, refers_to: int | None, record_id: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Capture: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict, dict, bytes]:
    """The headers of WARC and of HTTP, and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda h: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in h.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write(pages: DataFrame, folder: str, id_col="page_id", url_col="url", html_col="html", least: int = 0, level: int = 5, file_bytes: int = 1 << 28) -> DataFrame:
    """Writes the archives; returns the index entries (``ENTRY``), checkpointed. A new file starts after ``file_bytes``."""
    rows = decided(pages, id_col, url_col, html_col, least).withColumn("surt", surt(F.col("url")))

    def archive(batches):
        context = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, at, no, name = None, 0, 0, ""
        for pdf in batches:
            entries = []
            for r in pdf.itertuples(index=False):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at, no = f"{stem}-{no:04d}.warc.gz", 0, no + 1
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                refers = None if r.refers_to is None else int(r.refers_to)
                digest = base64.b32encode(bytes.fromhex(r.sha1)).decode()
                page = None if r.id is None else int(r.id)
                raw = _record(r.url or "", r.payload, digest, refers, str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name}|{at}")))
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                out.write(packed)
                entries.append((r.surt, page, name, at, len(packed), digest, "response" if refers is None else "revisit", refers))
                at += len(packed)
            yield _frame(entries, ENTRY)
        if out is not None:
            out.close()

    # ids as texts: a column of numbers with a null would come as floats
    text = lambda c: F.col(c).cast("string").alias(c)
    return cut(rows.select(text("id"), "url", "payload", "sha1", text("refers_to"), "surt").mapInPandas(archive, ENTRY))


def _id(value: str | None) -> int:
    return -1 if value is None else int(value)


def build_index(entries: DataFrame, folder: str, block: int = 512) -> list[dict]:
    """Writes index files of compressed blocks; returns the top level: each file's first key and name. Its length is the
    number of index files, that is of partitions, however many captures there are.

    Entries are sorted by (key, id, file, offset) over ranges, so a host or page with a third of the captures takes many.
    """

    def pack(batches):
        context = TaskContext.get()
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.idx"
        out, at, directory, lines, first = None, 0, [], [], None

        def flush():
            nonlocal at, lines
            packed = zlib.compress("\n".join(lines).encode(), 6)
            out.write(packed)
            directory.append((json.loads(lines[0])[:2], at, len(packed)))
            at, lines = at + len(packed), []

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                first = first or [row.surt, _id(row.id)]
                lines.append(json.dumps([row.surt, _id(row.id), row.file, row.offset, row.length]))
                if len(lines) >= block:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(zlib.compress(json.dumps(directory).encode()))
            yield pd.DataFrame({"first": [json.dumps(first)], "part": [context.partitionId()], "name": [name]})

    order = [F.asc_nulls_first(c) for c in ("surt", "id", "file", "offset")]
    spread = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    listed = spread.select("surt", F.col("id").cast("string").alias("id"), "file", "offset", "length").mapInPandas(pack, "first string, part int, name string").collect()
    return [{"first": json.loads(r["first"]), "name": r["name"]} for r in sorted(listed, key=lambda r: r["part"])]


def _holding(firsts: list[tuple], key: tuple) -> range:
    """Which of the sorted stretches that begin with ``firsts`` can hold the key."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def lookup(wanted: DataFrame, top: list[dict], folder: str) -> DataFrame:
    """``wanted``: ``surt`` and ``id``. Returns (id, file, offset, length) of every capture of each, in whatever row it was
    written; a key asked for twice has its captures twice.

    Keys are dealt to the index files that can hold them; there, in order, each finds its blocks in the directory by binary
    search, and its entries in them. A block is read once for neighbouring keys.
    """
    firsts = [tuple(r["first"]) for r in top]

    def files_of(batches):
        for pdf in batches:
            held = [list(_holding(firsts, (k, _id(i)))) for k, i in zip(pdf["surt"], pdf["id"])]
            yield pdf.assign(at=held).explode("at").dropna(subset=["at"]).astype({"at": "int32"})

    def find(batches):
        fs, base = _open(folder)
        source, opened, directory, keys, held, entries, entry_keys, waiting = None, None, [], [], None, [], [], []
        for pdf in batches:
            for key, page, at in zip(pdf["surt"], pdf["id"], pdf["at"]):
                if opened != at:
                    if source is not None:
                        source.close()
                    source, opened, held = fs.open_input_file(f"{base}/{top[at]['name']}"), at, None
                    with fs.open_input_stream(f"{base}/{top[at]['name']}.dir", compression=None) as f:
                        directory = json.loads(zlib.decompress(f.read()))
                    keys = [tuple(d[0]) for d in directory]
                want = (key, _id(page))
                for b in _holding(keys, want):
                    if held != b:
                        held = b
                        source.seek(directory[b][1])
                        entries = [json.loads(x) for x in zlib.decompress(source.read(directory[b][2])).decode().split("\n")]
                        entry_keys = [tuple(e[:2]) for e in entries]
                    waiting += entries[bisect.bisect_left(entry_keys, want) : bisect.bisect_right(entry_keys, want)]
                    if len(waiting) >= 10_000:
                        yield frame(waiting)
                        waiting = []
        if waiting:
            yield frame(waiting)
        if source is not None:
            source.close()

    def frame(found):
        return _frame([(None if e[1] == -1 else e[1], *e[2:]) for e in found], PLACE)

    placed = wanted.select("surt", F.col("id").cast("string").alias("id")).mapInPandas(files_of, "surt string, id string, at int")
    placed = placed.repartition(max(1, len(top)), "at").sortWithinPartitions("at", "surt", F.col("id").cast("long"))
    return placed.mapInPandas(find, PLACE)


def read(ranges: DataFrame, folder: str, stripe: int = 1 << 24) -> DataFrame:
    """The records (``RECORD``) at the given byte ranges; each payload's digest is checked. A revisit has no payload: its
    size is null, and its digest that which its header names.

    Ranges are dealt by file and stripe over all shuffle partitions, as they are few bytes for much work, and read in order
    of their offset.
    """

    def fetch(batches):
        fs, base = _open(folder)
        opened, source = None, None
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if opened != r.file:
                    if source is not None:
                        source.close()
                    opened, source = r.file, fs.open_input_file(f"{base}/{r.file}")
                source.seek(r.offset)
                warc, _, payload = parse_record(zlib.decompress(source.read(r.length), 31))
                digest, response = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"] == "response"
                if response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{r.file} at {r.offset}: the payload doesn't have its digest")
                rows.append((None if r.id is None else int(r.id), len(payload) if response else None, digest, warc["warc-type"], int(x) if (x := warc.get("warc-refers-to-capture")) else None))
            yield _frame(rows, RECORD)
        if source is not None:
            source.close()

    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartition(n, "file", F.expr(f"offset div {stripe}")).sortWithinPartitions("file", "offset")
    return dealt.withColumn("id", F.col("id").cast("string")).mapInPandas(fetch, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Records with every revisit's payload size taken from the response with the id and digest that it names. A revisit
    without one is an error."""
    responses = records.filter("record_type = 'response'").groupBy(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    rows = records.join(responses, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response with the payload of a revisit: "), "payload_digest")).cast("long")
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.coalesce("_bytes", lost))
    return rows.select("id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", least: int = 0) -> DataFrame:
    """Writes all rows as records, indexes them, finds each url and id in the index and reads all of their captures back:
    one row per capture, so one for each input row.

    A null html is an empty payload, a null url an empty target. Rows that repeat an id and url are captures each, with
    their own payloads. Of rows with the payload's largest id all are responses. A null id is never the largest unless no
    row of the payload has one; then all are responses. Columns besides these three aren't read.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    entries = write(pages, folder, id_col, url_col, html_col, least)
    top = build_index(entries, folder)
    records = cut(read(lookup(entries.select("surt", "id").distinct(), top, folder), folder))
    return resolved(records).withColumnRenamed("id", id_col)
