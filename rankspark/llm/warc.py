"""Web archives of pages: WARC files with revisit records, read back, and an index of captures merged from sorted runs.

Every task writes its pages into archives of bounded size, one gzip member per record. Each archive is then read record by record, which gives a run of
captures sorted by URL key and time. Runs are cut at common borders; in each range between two borders a loser tree merges the
runs' slices, and the ranges together are the captures of all archives in one order.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.text import text_of
from rankspark.llm.words import batches
from rankspark.session import cut_lineage, new_folder, shuffle_width

ARCHIVE_BYTES = 32 << 20  # an archive is closed once it has grown beyond this
RANGE_ROWS, LEAST_ROWS = 100_000, 2_000  # captures a merge task is to take, and that make a task worth while
CHUNK = 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# ---- fixed values: field names and profile of the WARC 1.1 standard ----
VERSION = "WARC/1.1"
RESPONSE, REVISIT = "response", "revisit"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTENT_TYPE = "application/http; msgtype=response"
# ------------------------------------------------------------------------
PAGE, REFERS = "X-Page-ID", "X-Refers-To-Page-ID"  # extension fields: the caller's own page ids


def base32_of(digest: Column) -> Column:
    """Bare upper-case base32 of a hexadecimal digest of 40 characters: four letters for every five digits."""
    parts = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def url_key(url: str | None) -> str:
    """Key by which captures of one page sort together: host labels reversed, without a leading www, default port, fragment or case; then path and sorted query.
    A text that is no web address is its own key."""
    parts = re.match(r"(?i)(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", url or "")
    if not parts:
        return url or ""
    scheme, host, path, query = parts.groups()
    host = host.rpartition("@")[2].lower()
    host = re.sub(r":(80|443)?$", "", host)
    host = re.sub(r"^www\d*\.", "", host)
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")"
    path = urllib.parse.quote(urllib.parse.unquote_to_bytes(path or "/"), safe="/:@!$&'()*+,;=~-._").lower()
    path = path if path == "/" else path.rstrip("/")
    return key + (path or "/") + (f"?{'&'.join(sorted(query.lower().split('&')))}" if query else "")


# ---- writing -----------------------------------------------------------------------


def open_folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the path in it: a local or mounted path, or a URI of a store."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)


def field_text(value: str) -> str:
    """A header value holds no white space or control character."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: dict[str, str], head: str, payload: bytes) -> bytes:
    """One WARC record as a gzip member of its own."""
    block = head.encode() + payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "Content-Length": str(len(block))}.items())
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(f"{VERSION}\r\n{lines}\r\n".encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def page_record(page: dict) -> bytes:
    payload = page["payload"]
    digest = page["payload_digest"]
    name = f"{page['page_id']}|{page['url']}|{page['date']}|{digest}"
    fields = {
        "WARC-Type": page["record_type"],
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>",
        "WARC-Date": page["date"],
        "WARC-Target-URI": field_text(page["url"] or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": CONTENT_TYPE,
    }
    if page["page_id"] is not None:
        fields[PAGE] = urllib.parse.quote(str(page["page_id"]))
    # A revisit keeps the head of its response, which states the payload's length, and leaves the payload out.
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    if page["record_type"] == REVISIT:
        fields |= {"WARC-Profile": SAME_PAYLOAD, REFERS: urllib.parse.quote(str(page["refers_to"])), "WARC-Refers-To-Date": page["refers_date"],
                   "WARC-Refers-To-Target-URI": field_text(page["refers_url"] or "")}
        payload = b""
    return record(fields, head, payload)


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, captured: Column, min_bytes: int) -> DataFrame:
    """Pages with their digest and record type. Texts are equal by SHA-256 and length; repeated digests alone are joined back, pre-aggregated, and
    the adaptive join splits a digest that many pages share."""
    payload = text_of(html)
    utc = F.to_utc_timestamp(F.coalesce(captured, F.timestamp_seconds(F.lit(0))), F.current_timezone())
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("html"), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        F.sha2(payload, 256).alias("content"), base32_of(F.sha1(payload)).alias("payload_digest"),
    )
    firsts = (
        rows.where(F.octet_length("html") >= min_bytes)
        .groupBy("content")
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "date", "url"))).alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("content", "first")
    )
    again = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    joined = rows.join(cut_lineage(firsts), "content", "left")
    repeat = F.col("first").isNotNull() & again
    return joined.select(
        "page_id", "url", "html", "date", "payload_digest", F.when(repeat, REVISIT).otherwise(RESPONSE).alias("record_type"),
        *[F.when(repeat, F.col(f"first.{c}")).alias(f"refers_{n}") for c, n in (("page_id", "to"), ("date", "date"), ("url", "url"))],
    )


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (see with_revisits) as archives into a folder; one row per archive: archive (path), records, bytes.

    A task names its archives anew on each attempt, and only those of the attempt whose rows are kept are listed."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        done: list[tuple[str, int, int]] = []
        out, held, size = None, 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{len(done):04d}", held, size))
                out = None

        for part in batches(source, 64):
            for page in part.to_pylist():
                if out is None:
                    out, held, size = system.open_output_stream(f"{root}/{name}-{len(done):04d}.warc.gz", compression=None), 0, 0
                page["payload"] = page.pop("html").encode()
                member = page_record(page)
                out.write(member)
                held, size = held + 1, size + len(member)
                if size >= archive_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{name}-{n}.warc.gz" for n, _, _ in done]), pa.array([r for _, r, _ in done], pa.int64()), pa.array([b for _, _, b in done], pa.int64())],
                names=["archive", "records", "bytes"],
            )

    return pages.mapInArrow(work, "archive string, records bigint, bytes bigint")


# ---- reading -----------------------------------------------------------------------


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, held one at a time."""
    data, offset = b"", 0
    while data or (data := stream.read(CHUNK)):
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while not unpack.eof:
            if not data and not (data := stream.read(CHUNK)):
                raise ValueError(f"the archive ends inside the record at {offset}")
            parts.append(unpack.decompress(data))
            used += len(data) - len(unpack.unused_data)
            data = unpack.unused_data
        yield offset, used, b"".join(parts)
        offset += used


def parsed(content: bytes) -> dict:
    """Fields of a record and what they say of its payload. A stored payload is measured and its digest compared with the stated one."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first[:40]}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == RESPONSE:
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if len(payload) != stated or found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    page, refers = (None if fields.get(k) is None else urllib.parse.unquote(fields[k]) for k in (PAGE, REFERS))
    return {
        "page_id": page, "url": fields["WARC-Target-URI"], "captured": fields["WARC-Date"], "payload_bytes": stated,
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": refers, "payload": payload,
    }


def read_record(folder: str, archive: str, offset: int, length: int) -> dict:
    """One record by its place in the index."""
    system, root = open_folder(folder)
    with system.open_input_file(f"{root}/{archive}") as f:
        return parsed(next(members(io.BytesIO(f.read_at(length, offset))))[2])


CAPTURE = pa.schema(
    [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
_DDL = {pa.string(): "string", pa.int64(): "bigint"}
CAPTURE_DDL = ", ".join(f"{f.name} {_DDL[f.type]}" for f in CAPTURE)
ORDER = ["url_key", "captured", "archive", "offset"]


def read_runs(archives: DataFrame, folder: str) -> DataFrame:
    """The captures of each archive, sorted by URL key, time and place: one run per archive, numbered by place in the run."""
    many = min(max(1, archives.count()), 16 * shuffle_width(archives.sparkSession))

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        for part in batches(source, 1):
            archive = part.column(0)[0].as_py()
            run = []
            with system.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                for offset, length, content in members(stream):
                    r = parsed(content)
                    run.append((url_key(r["url"]), r["captured"], r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"],
                                archive, offset, length))
            run.sort(key=lambda c: (c[0], c[1], c[9]))
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*run), CAPTURE)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(range(len(run)), pa.int64())], names=[*CAPTURE.names, "place"])

    return archives.select("archive").repartition(many).mapInArrow(work, f"{CAPTURE_DDL}, place bigint")


# ---- merging -----------------------------------------------------------------------


def loser_tree(heads: list, advance: Callable[[int], object | None]) -> Iterator[int]:
    """Numbers of the runs in the order in which their entries merge. heads holds each run's first key, advance(i) gives the next key of run i, None at its end. Each inner
    node keeps the loser of the match below it, so an entry that leaves is replaced along one path from leaf to root. Equal keys leave in order of run."""
    k = len(heads)
    if not k:
        return
    keys: list = list(heads)
    beats = lambda i, j: keys[j] is None or (keys[i] is not None and (keys[i], i) < (keys[j], j))
    losers, winner = [0] * k, list(range(k)) * 2
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node] if 2 * node < k else 2 * node - k, winner[2 * node + 1] if 2 * node + 1 < k else 2 * node + 1 - k
        winner[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while keys[top] is not None:
        yield top
        keys[top] = advance(top)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures of all runs in the order of ORDER: range_no, place in the range, and the captures' own columns.

    Ranges are cut by the whole order, whose last part is unique, so that a URL with very many captures lies in several ranges. A task holds one range."""
    n, cores = runs.count(), runs.sparkSession.sparkContext.defaultParallelism
    width = max(1, -(-n // range_rows), min(cores, n // LEAST_ROWS))
    slices = runs.repartitionByRange(width, *ORDER).sortWithinPartitions("archive", "place")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in source if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = list(zip(*(table.column(c).to_pylist() for c in ORDER)))
        starts = [i for i, k in enumerate(keys) if not i or k[2] != keys[i - 1][2]]
        ends, at = [*starts[1:], len(keys)], list(starts)

        def advance(run: int) -> tuple | None:
            at[run] += 1
            return keys[at[run]] if at[run] < ends[run] else None

        order = [at[run] for run in loser_tree([keys[s] for s in starts], advance)]
        merged = table.drop_columns(["place"]).take(pa.array(order, pa.int64())).combine_chunks()
        number = pa.array([TaskContext.get().partitionId()] * len(order), pa.int64())
        merged = merged.add_column(0, "range_no", number).add_column(1, "place", pa.array(range(len(order)), pa.int64()))
        yield from merged.to_batches(max_chunksize=8192)

    return slices.mapInArrow(work, f"range_no bigint, place bigint, {CAPTURE_DDL}")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", captured: Column | None = None, min_bytes: int = 0,
                  archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> DataFrame:
    """Write pages as archives, read them back and merge their index: one row per row of pages, in (range_no, place) by URL key and time.

    Columns: range_no, place, url_key, captured, page_id, url, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to, archive, offset, length. The payload is
    the html in UTF-8, null read as empty. Of pages with equal payloads of at least min_bytes the one with the smallest page_id is the response and the others
    revisit it. Rows that share that page_id are all responses, a null page_id is a response only where no page of the group has an id. captured is a
    timestamp column, unless given the second page_id after the start of 1970 (null: its start), modulo 2^32. A null url is an empty one, and white space and control characters in a url come back
    percent-encoded. Other columns are not read, and an
    empty table gives an empty result."""
    spark = pages.sparkSession
    kind = dict(pages.dtypes)[page_id]
    if captured is None:
        captured = F.timestamp_seconds(F.pmod(F.coalesce(F.expr(f"try_cast(`{page_id}` AS bigint)"), F.lit(0)), F.lit(1 << 32)))
    folder = folder or new_folder(spark, "warc")
    archives = cut_lineage(write_archives(with_revisits(pages, page_id, url, html, captured, min_bytes), folder, archive_bytes))
    runs = cut_lineage(read_runs(archives, folder))
    merged = merge_runs(runs)
    return merged.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
