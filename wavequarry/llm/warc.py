"""WARC archives of pages and the merged index of their captures.

``write_archives`` writes one WARC 1.1 record per page: the page with the largest id among those with equal payloads is
a response, the others are revisits of it. Files are gzip-compressed WARC text of about ``ARCHIVE_BYTES`` each: a file
takes so many records as of mean length fill it, and none has more than its task's input. ``read_archives`` parses a file
record by record while it is decompressed. ``merge_index`` sorts each archive's captures into a run and merges the runs of a
key range through a loser tree, which gives globally ordered capture histories; runs stay in Arrow form, and a few rows of each
are Python objects at a time. Offsets are those of the uncompressed file.

Defined cases: null html is an empty payload (and, at ``least`` 0, empty payloads are equal to each other); a null url is
the empty target; a page without an id is a response with an empty id; of rows that repeat the id of a response each is one, and rows that
repeat another id are revisits each; payloads of fewer than ``least`` bytes are all responses; further columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavequarry.llm.shared import parts, schema_of, shared_dir, stored

ARCHIVE_BYTES, HEAD_BYTES, SLICE = 64 << 20, 600, 256
CAPTURES = "page_id long, url string, urlkey string, timestamp string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long, payload binary"
INDEX = "urlkey string, timestamp string, page_id long, record_type string, payload_digest string, archive string, offset long, length long, payload_bytes long, refers_to long"
END = "\r\n\r\n"
#: fixed values: the digits of base 32 as conv() writes them, and as RFC 4648 does
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 4 times 40 bits, 8 digits each."""
    digest = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]), DIGITS, BASE32)


def planned(pages: DataFrame, least: int = 0) -> tuple[DataFrame, int]:
    """Pages with payload, digest and the id of the response that stands for each payload; how many records of mean length fill a file."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    first = rows.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("response")).withColumnRenamed("payload_bytes", "bytes")
    first = stored(first, "payloads")
    mean = first.agg(F.avg("bytes")).first()[0] or 0.0
    joined = rows.join(first.withColumnRenamed("payload_digest", "digest"), (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") == F.col("bytes")))
    refers = F.when((F.col("payload_bytes") >= least) & (F.col("response") != F.col("page_id")), F.col("response"))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", refers.alias("refers_to")), max(1, int(ARCHIVE_BYTES / (mean + HEAD_BYTES)))


def record() -> Column:
    """The text of one record, without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", " ")),
        ("WARC-Date", date),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(body).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in head]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), body)


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0) -> str:
    """Writes the archives and returns their folder, by default a new one in the shared folder."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/wavequarry/warc-{uuid.uuid4().hex}"
    rows, per_file = planned(pages, least)
    rows.select(record().alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)
    return folder


def parsed(archive: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """(offset, length, WARC header, HTTP header, payload) of each record of an uncompressed archive, read record by record."""
    at = 0
    while line := archive.readline():
        size, head = len(line), {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8", "replace").removesuffix("\r\n").partition(":")
            head[name] = value.removeprefix(" ")
        body = archive.read(int(head["Content-Length"]))
        split = body.index(b"\r\n\r\n") + 4
        length = size + 2 + len(body)
        yield at, length, head, body[:split], body[split:]
        at += length + len(archive.read(4))


def surt(url: str) -> str:
    """Sort-friendly key of a URL: host labels reversed, lower case, without scheme, port, www and fragment."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url, re.I)
    if not m:
        return url
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/").lower()


def read_archives(spark, folder: str) -> DataFrame:
    """The captures in a folder of archives; columns as in ``CAPTURES``. payload is null for revisits."""
    schema = schema_of(CAPTURES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                out, size, archive = [], 0, path.rsplit("/", 1)[-1]
                opened = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())))
                for offset, length, head, http, payload in parsed(opened):
                    number = int(head["WARC-Record-ID"][10:-1]) if head["WARC-Record-ID"] != "<urn:page:>" else None
                    refers = int(head["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in head else None
                    full = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    url = head["WARC-Target-URI"]
                    out.append((number, url, surt(url), re.sub(r"\D", "", head["WARC-Date"]), head["WARC-Type"], refers, full, head["WARC-Payload-Digest"].removeprefix("sha1:"), archive, offset, length, None if refers is not None else payload))
                    size += len(payload)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, CAPTURES)


def verified(captures: DataFrame) -> DataFrame:
    """Captures whose payload, where the record holds one, has the length and digest that its header states; else an error."""
    true = (F.octet_length("payload") == F.col("payload_bytes")) & (base32_sha1(F.col("payload")) == F.col("payload_digest"))
    return captures.withColumn("payload_bytes", F.when(F.col("payload").isNull() | true, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("payload and header differ")).cast("long")))


def ordered(row: tuple) -> tuple:
    """urlkey, timestamp and page_id, a missing id first."""
    return row[0], row[1], -1 if row[2] is None else row[2]


def loser_tree(runs: Iterable[Iterable[tuple]]) -> Iterator[tuple]:
    """Merges sorted runs: inner nodes hold the loser of each match, so a replaced winner replays one path of log2(k) matches."""
    rest = [iter(r) for r in runs]
    k = len(rest)
    if not k:
        return
    head = [next(r, None) for r in rest]
    key = [(1,) if h is None else (0, ordered(h)) for h in head]
    tree = [-1] * k  # tree[0] is the winner
    for i in range(k):
        winner, node = i, (i + k) // 2
        while node > 0 and tree[node] != -1:
            if key[tree[node]] < key[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[node if node > 0 else 0] = winner
    while key[winner := tree[0]][0] == 0:
        yield head[winner]
        head[winner] = next(rest[winner], None)
        key[winner] = (1,) if head[winner] is None else (0, ordered(head[winner]))
        node = (winner + k) // 2
        while node > 0:
            if key[tree[node]] < key[winner]:
                tree[node], winner = winner, tree[node]
            node //= 2
        tree[0] = winner


def merge_index(captures: DataFrame) -> DataFrame:
    """The capture histories: rows ordered by urlkey, timestamp and page_id over all partitions; columns as in ``INDEX``.

    Each archive is a run. Key ranges deal the runs' pieces to tasks, a popular host or URL over several; a task sorts
    the piece of each run and merges the pieces.
    """
    schema = schema_of(INDEX)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:
            names = b.column(5).to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    pieces.setdefault(names[i], []).append(b.slice(i, j - i))

        def rows_of(run: list[pa.RecordBatch]) -> Iterator[tuple]:
            for b in run:
                for i in range(0, len(b), SLICE):
                    yield from zip(*(c.to_pylist() for c in b.slice(i, SLICE).columns))

        out: list[tuple] = []
        for row in loser_tree(map(rows_of, pieces.values())):
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    columns = [f.name for f in schema]
    rows = captures.select(*columns)
    dealt = rows.repartitionByRange(4 * parts(rows.sparkSession), "urlkey", "timestamp", "page_id").sortWithinPartitions("archive", "urlkey", "timestamp", F.coalesce("page_id", F.lit(-1)))
    return dealt.mapInArrow(run, INDEX)
