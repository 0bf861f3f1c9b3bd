"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key and written as gzipped WARC records, in
archives of about ARCHIVE_BYTES that each cover a range of keys.  The index keys, in the same order, go into
compressed blocks; a sparse directory holds the first key and the place of each
block.  A lookup finds the archive by the ranges' first keys, the block by binary
search in the directory, the capture by binary search in the block, and then reads
only the bytes of the records it needs.

A payload that several captures share is stored once: the capture with the largest
id is the response, the others are revisits that refer to it.

Files are written to the cluster's shared folder under fresh names; a file counts
only once its directory rows are in the stored table, so a task that ran twice
leaves at most an unused file.

Defined results: a null page is an empty payload; a null URL has an empty key; rows
with one id and one payload are all responses; a null id never becomes a response
of others, and is a response itself only if all captures of its payload lack an id;
empty and very long pages are kept whole; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import shared_dir, stored
from palimpsest.llm._words import chunks

BLOCK_RECORDS = 512
ARCHIVE_BYTES = 64 << 20  # a longer archive ends at the next new key
MAX_READERS = 20_000  # tasks that read archives
BOUNDS_AT_ONCE = 50_000  # archives whose first keys are sent to the tasks together
MAX_BROADCAST_PAYLOADS = 100_000  # shared payloads (50 bytes each) that are broadcast
DATE = "2024-01-01T00:00:00Z"
_DIRECTORY = "archive string, block int, first_key string, first_id long, records int, index_offset long, index_bytes long"
Key = tuple[str, int]


def url_key(url):
    """A column: host labels reversed, then path and query; without scheme, user, port or fragment."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(host == "", F.regexp_replace(url, "[\t\n\r]", " ")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(rest, "[\t\n\r]", " ")))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzipped WARC record; a revisit keeps the HTTP headers and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict[str, object]:
    """Headers and payload of a record's bytes (one gzip member)."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda uri: int(uri[10:-1]) if uri and uri.startswith("<urn:page:") else None
    kind = fields["WARC-Type"]
    if kind == "response" and f"sha1:{digest(payload)}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged record of {fields['WARC-Target-URI']}")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": int(told["Content-Length"]), "payload_digest": fields["WARC-Payload-Digest"][5:],
        "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _line(key: Key, offset: int, size: int) -> str:
    return f"{key[0]}\t{key[1]}\t{offset}\t{size}"


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload: int = 0) -> tuple[str, DataFrame]:
    """Write archives and index; returns their folder and the stored block directory.

    Payloads of fewer than ``min_payload`` bytes are always responses.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/palimpsest/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__html"))
    own = own.withColumn("__sha", F.sha1("__html"))
    shared = own.where(F.octet_length("__html") >= min_payload).groupBy("__sha").agg(F.max("__id").alias("__last"), F.count("*").alias("n")).where("n > 1").select("__sha", "__last")
    shared = stored(shared, "payloads")
    if shared.count() <= MAX_BROADCAST_PAYLOADS:  # else both sides move
        shared = F.broadcast(shared)
    marked = own.join(shared, "__sha", "left").select("__id", "__url", "__html", url_key(F.col("__url")).alias("__key"), F.when((F.octet_length("__html") >= min_payload) & ~F.col("__last").eqNullSafe(F.col("__id")), F.col("__last")).alias("__to"))
    ranged = marked.repartitionByRange("__key", "__id").sortWithinPartitions("__key", F.col("__id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _fs(folder)
        name, warc, index = "", None, None
        rows: list[tuple] = []
        lines: list[str] = []
        first = last = ("", 0)
        offset = at = block = 0

        def flush() -> None:
            nonlocal at, block
            if lines:
                packed = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
                index.write(packed)
                rows.append((name, block, *first, len(lines), at, len(packed)))
                at, block = at + len(packed), block + 1
                lines.clear()

        def close() -> None:
            nonlocal warc, offset, at, block
            if warc is not None:
                flush()
                warc.close()
                index.close()
                warc, offset, at, block = None, 0, 0, 0

        for batch in batches:
            for part in chunks(batch, "__html", 8 << 20):
                for page_id, url, html, key, to in zip(*(part.column(c).to_pylist() for c in ("__id", "__url", "__html", "__key", "__to"))):
                    k = (key, page_id if page_id is not None else -(1 << 63))
                    if offset >= ARCHIVE_BYTES and k != last:
                        close()
                    if warc is None:
                        store.create_dir(path, recursive=True)
                        name = uuid.uuid4().hex
                        warc, index = store.open_output_stream(f"{path}/{name}.warc.gz", compression=None), store.open_output_stream(f"{path}/{name}.cdx", compression=None)
                    data = record(page_id, url or "", html, to)
                    warc.write(data)
                    if not lines:
                        first = k
                    lines.append(_line(k, offset, len(data)))
                    offset, last = offset + len(data), k
                    if len(lines) == BLOCK_RECORDS:
                        flush()
        close()
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in _DIRECTORY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], names=names)

    return folder, stored(ranged.mapInArrow(run, _DIRECTORY), "directory")


class Archive:
    """Reads one archive through its rows of the block directory."""

    def __init__(self, folder: str, name: str, directory: list[tuple[Key, int, int]]):
        store, path = _fs(folder)
        self.warc, self.index = store.open_input_file(f"{path}/{name}.warc.gz"), store.open_input_file(f"{path}/{name}.cdx")
        self.blocks = sorted(directory)
        self.first = [b[0] for b in self.blocks]

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, *_) -> None:
        self.warc.close()
        self.index.close()

    def _block(self, k: int) -> tuple[list[Key], list[tuple[int, int]]]:
        _, offset, size = self.blocks[k]
        self.index.seek(offset)
        rows = [x.rsplit("\t", 3) for x in zlib.decompress(self.index.read(size)).decode("utf-8", "surrogatepass").split("\n")]
        return [(r[0], int(r[1])) for r in rows], [(int(r[2]), int(r[3])) for r in rows]

    def get(self, wanted: list[Key]) -> Iterator[tuple[int, bytes]]:
        """(number in ``wanted``, record bytes) of each capture of each wanted key; sorted keys are read fastest."""
        known: dict[int, tuple[list[Key], list[tuple[int, int]]]] = {}
        held = (0, b"")
        for n, key in enumerate(wanted):
            k = max(0, bisect_left(self.first, key) - 1)  # equal keys may begin in the block before
            while k < len(self.blocks) and self.first[k] <= key:
                if k not in known:
                    if len(known) > 4:
                        known.clear()
                    known[k] = self._block(k)
                keys, places = known[k]
                for i in range(bisect_left(keys, key), bisect_right(keys, key)):
                    offset, size = places[i]
                    if not (held[0] <= offset and offset + size <= held[0] + len(held[1])):
                        # one read for the run of neighbouring records that are wanted next
                        j, m = i, n
                        while j + 1 < len(keys) and m + 1 < len(wanted) and wanted[m + 1] == keys[j + 1] and places[j + 1][0] + places[j + 1][1] - offset < 8 << 20:
                            j, m = j + 1, m + 1
                        self.warc.seek(offset)
                        held = (offset, self.warc.read(places[j][0] + places[j][1] - offset))
                    yield n, held[1][offset - held[0] : offset - held[0] + size]
                k += 1


def _assigned(requests: DataFrame, bounds: list[tuple[Key, str]]) -> DataFrame:
    """The archive of each request, by binary search over the archives' first keys.

    The bounds go to the tasks in slices of BOUNDS_AT_ONCE; requests between two
    slices' first keys belong to the earlier slice."""
    parts = []
    for i in range(0, len(bounds), BOUNDS_AT_ONCE):
        own = bounds[i : i + BOUNDS_AT_ONCE]
        first, names = [k for k, _ in own], [n for _, n in own]
        low = own[0][0] if i else None
        high = bounds[i + BOUNDS_AT_ONCE][0] if i + BOUNDS_AT_ONCE < len(bounds) else None

        def run(batches: Iterator[pa.RecordBatch], first=first, names=names, low=low, high=high) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = list(zip(batch.column("key").to_pylist(), batch.column("id").to_pylist()))
                keep = [(low is None or k >= low) and (high is None or k < high) for k in keys]
                to = [names[max(0, bisect_right(first, k) - 1)] for k in keys]
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(to, pa.string())], names=["key", "id", "archive"]).filter(pa.array(keep, pa.bool_()))

        parts.append(requests.mapInArrow(run, "key string, id long, archive string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def lookup(folder: str, directory: DataFrame, requests: DataFrame, id_col: str = "page_id", url_col: str = "url", payload: bool = True) -> DataFrame:
    """The records of the requested (id, url) captures, each as often as it was archived
    (requests are taken once).  Requests of an archive are read together; archives are of
    bounded size and dealt to twice as many tasks as there are archives."""
    low = F.lit(-(1 << 63)).cast("long")
    wanted = requests.select(url_key(F.col(url_col).cast("string")).alias("key"), F.coalesce(F.col(id_col).cast("long"), low).alias("id")).distinct()
    bounds = sorted(((r["k"]["first_key"], r["k"]["first_id"]), r["archive"]) for r in directory.groupBy("archive").agg(F.min(F.struct("first_key", "first_id")).alias("k")).toLocalIterator())
    spark = directory.sparkSession
    if not bounds:
        return spark.createDataFrame([], _FOUND)
    asked = _assigned(wanted, bounds)

    def read(key: tuple, wants: pa.Table, blocks: pa.Table) -> pa.Table:
        name = key[0].as_py()
        rows: list[dict] = []
        if wants.num_rows and blocks.num_rows:
            listed = [((a, b), c, d) for a, b, c, d in zip(*(blocks.column(c).to_pylist() for c in ("first_key", "first_id", "index_offset", "index_bytes")))]
            order = sorted(zip(wants.column("key").to_pylist(), wants.column("id").to_pylist()))
            with Archive(folder, name, listed) as archive:
                for _, data in archive.get(order):
                    r = parse(data)
                    if not payload:
                        r["payload"] = None
                    rows.append(r)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in zip([f.split()[0] for f in _FOUND.split(", ")], kinds)})

    tasks = min(2 * len(bounds), MAX_READERS)  # a few bytes ask for a whole archive: left to their sizes, all would be one task
    dealt = lambda df: df.repartition(tasks, "archive").groupBy("archive")
    return dealt(asked).cogroup(dealt(directory)).applyInArrow(read, _FOUND)
