"""WARC archives with a Zstandard dictionary.

Records are written in archives of bounded size. Each archive starts with a skippable frame that holds a dictionary
built from records of that archive; every record is a frame of its own, compressed with it, so that a reader can take
the dictionary from the front and any record by its offset. Of records with equal payloads the one with the smallest
id is a response; the others are revisits that name it and keep the payload's digest and length, not its bytes.

Archives are rows of a table (archive, first id, records, bytes), so that Spark's own writers put them on whatever
storage the cluster has; ``save_files`` writes them as .warc.zst files where executors share a folder.

Defined cases: a null payload is empty; ``min_bytes`` is the size from which equal payloads are linked; of repeated
ids with equal payloads one row is the response and the others revisit it; a null id is never a revisit's target; a
null url is written as ``about:blank``, which reads as null; an archive of too little to build a dictionary takes its
first records as a raw dictionary; a payload of any length is one record, which may exceed an archive's size; an empty
table gives no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageframe.llm import common

SKIPPABLE = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    #: Uncompressed bytes after which an archive is closed; one record may exceed it.
    target_bytes: int = 32 << 20
    #: Bytes of an archive's records that its dictionary is built from, and the dictionary's size.
    sample_bytes: int = 1 << 20
    dictionary_bytes: int = 32 << 10
    level: int = 3
    min_bytes: int = 0
    #: When the records were made, so that reruns write the same.
    date: str = "2000-01-01T00:00:00Z"
    #: Parts that the copies of one payload are dealt to.
    salt: int = 32


DEFAULT = Archive()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _response_id(page_id: int, sha: str) -> str:
    """Record id of the response for a page's payload, which its revisits can name."""
    return f"<urn:page:{page_id}:{sha}>"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, place: str = "", date: str = DEFAULT.date) -> bytes:
    """One WARC/1.1 record: its headers, and an HTTP response whose body a revisit leaves out. ``place`` tells records of one
    id and payload apart; the page's own id is a header of its own."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if page_id is not None and refers_to is None:
        own = _response_id(page_id, sha)
    else:
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {sha} {place}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + ("about:blank" if url is None else url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}"]
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_response_id(refers_to, sha)}"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def dictionary(records: list[bytes], archive: Archive = DEFAULT) -> zstandard.ZstdCompressionDict:
    """Built from records spread evenly over the archive, as many as fit the sample, of large ones the beginning."""
    step = max(1, sum(map(len, records)) // archive.sample_bytes)
    chosen, left = records[::step], archive.sample_bytes
    most = left
    for k, size in enumerate(sorted(map(len, chosen))):
        most = left // (len(chosen) - k)
        if size > most:
            break
        left, most = left - size, size
    sample = [r[: max(1, most)] for r in chosen]
    try:
        return zstandard.train_dictionary(archive.dictionary_bytes, sample, k=256, d=8, level=archive.level)
    except zstandard.ZstdError:  # too few samples
        return zstandard.ZstdCompressionDict(b"".join(sample)[: archive.dictionary_bytes] or b"\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def packed(records: list[bytes], archive: Archive = DEFAULT) -> bytes:
    """The bytes of an archive: the dictionary's skippable frame, and a frame a record."""
    made = dictionary(records, archive)
    held = made.as_bytes()
    write = zstandard.ZstdCompressor(level=archive.level, dict_data=made, write_content_size=True).compress
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *map(write, records)])


def unpacked(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    held = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    reader, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind)), memoryview(data)[8 + size :]
    while rest:
        one = reader.decompressobj()
        out = [one.decompress(rest[: 1 << 16])]
        at = min(1 << 16, len(rest))
        while not one.eof:
            if at >= len(rest):
                raise ValueError("an archive ends inside a record")
            out.append(one.decompress(rest[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(rest))
        rest = rest[at - len(one.unused_data) :]
        yield b"".join(out)


def parsed(data: bytes) -> dict:
    """A record's headers, its HTTP body, and the payload length and digest that it states; a stored payload is checked against them."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if len(block) != int(fields["Content-Length"]) + 4 or block[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block[:-4].partition(b"\r\n\r\n")
    size = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    sha, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest(payload) != sha):
        raise ValueError("a payload does not match its digest")
    refers_to = int(fields["WARC-Refers-To"].split(":")[2]) if "WARC-Refers-To" in fields else None
    url, page_id = fields["WARC-Target-URI"], fields.get("X-Page-ID")
    return {"page_id": None if page_id is None else int(page_id), "url": None if url == "about:blank" else url, "record_type": kind, "payload_bytes": size, "payload_digest": sha, "refers_to": refers_to, "payload": payload if kind == "response" else None}


def planned(pages: DataFrame, archive: Archive = DEFAULT) -> DataFrame:
    """page_id, url, payload, its SHA-1 and ``refers_to`` of every row.

    Payloads that occur once never meet others; the copies of a payload are dealt to ``salt`` parts, to each of which
    goes the one row that names their response.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(archive.salt)).cast("int"))
    digests = keyed.select("page_id", "sha", F.octet_length("html").alias("size")).where(F.col("size") >= archive.min_bytes)
    firsts = digests.groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 AND first IS NOT NULL")
    firsts = firsts.select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(archive.salt - 1))).alias("salt"))
    met = keyed.join(firsts, ["sha", "salt"], "left")
    # Of rows that repeat the first id and payload, one stays the response.
    again = F.row_number().over(Window.partitionBy("sha", "salt", "page_id").orderBy(F.lit(1)))
    repeats = F.when(F.col("first").isNotNull() & (F.col("page_id") == F.col("first")), 1).otherwise(0)
    met = met.withColumn("_same", repeats)
    same = met.where("_same = 1").withColumn("_n", again)
    rest = met.where("_same = 0").withColumn("_n", F.lit(2))
    return rest.unionByName(same).select("page_id", "url", "html", F.when(F.col("_n") > 1, F.col("first")).alias("refers_to"))


def archives(plan: DataFrame, archive: Archive = DEFAULT) -> DataFrame:
    """Archives of the planned rows: each task fills one after the other and holds no more than one."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def close(records: list[bytes], first) -> pd.DataFrame:
            data = packed(records, archive)
            return pd.DataFrame({"archive": [hashlib.sha256(data).hexdigest()[:32]], "first_id": pd.array([first], dtype="Int64"), "n_records": [len(records)], "data": [data]})

        held, size, first, n, task = [], 0, None, 0, TaskContext.get().partitionId()
        for batch in batches:
            for page_id, url, html, refers_to in batch.itertuples(index=False, name=None):
                payload = html.encode("utf-8")
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                if not held:
                    first = page_id
                held.append(record(page_id, url, payload, digest(payload), refers_to, f"{task}.{n}", archive.date))
                n += 1
                size += len(held[-1])
                if size >= archive.target_bytes:
                    yield close(held, first)
                    held, size = [], 0
        if held:
            yield close(held, first)

    return plan.mapInPandas(write, "archive string, first_id long, n_records long, data binary")


def read(table: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives, one row each; without ``payloads`` their bytes are checked and left out."""
    columns = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["data"]:
                rows, size = [], 0
                for one in map(parsed, unpacked(data)):
                    rows.append([one[c] for c in columns])
                    size += len(one["payload"] or b"") if payloads else 0
                    if len(rows) >= 5000 or size >= 8 << 20:
                        yield _frame(rows, columns)
                        rows, size = [], 0
                yield _frame(rows, columns)

    kinds = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    return table.select("data").mapInPandas(parse, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


def _frame(rows: list[list], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})


def save_files(table: DataFrame, folder: str) -> None:
    """Writes archives as ``folder``/<archive>.warc.zst; the folder must be one that all executors share."""

    def save(rows) -> None:
        for row in rows:
            at = f"{folder}/{row.archive}.warc.zst"
            with open(f"{at}.{uuid.uuid4().hex}.part", "wb") as out:  # a task that is lost or runs twice leaves no half archive
                out.write(row.data)
            os.replace(out.name, at)

    table.select("archive", "data").foreachPartition(save)


def round_trip(pages: DataFrame, archive: Archive = DEFAULT) -> DataFrame:
    """What the corpus query returns: archives of all pages, written to the shared folder, and what reading them back gives."""
    written = common.stored(archives(planned(pages, archive), archive), "warc")
    return read(written, payloads=False).drop("url")
