"""WARC archives of captures, and the external merge of their indexes.

Writing: a record is a line of text that ends in CR LF CR LF, so Spark's text writer lays down archives with its own
commit protocol, in whatever store the path names. An archive holds a bounded number of records, fewer where payloads
are so long that it would be over ARCHIVE bytes. Equal payloads become one
response and revisits that refer to it; the response's identifier comes from an aggregation that combines before
it shuffles, and payloads that a thousandth of all captures share are broadcast back instead of shuffled.

Reading: archives are parsed by Content-Length, whatever bytes a payload holds, and give one index entry per record.

Merging: the entries that a task read, of all its archives, sorted and written, are a run. A range exchange by (URL key,
timestamp, identifier) hands each range its part of every run, and a loser tree merges these k sorted parts into one
order.
Ranges are ordered among each other, so (range_no, position) orders all captures. The identifier is part of the key,
so that a URL with a third of all captures spreads over many ranges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import checked, new_path, staged

#: Records of an archive at most, bytes that it is to hold; index entries that a range is to hold.
RECORDS, ARCHIVE, RANGE = 1000, 64_000_000, 200_000
END, LINE = "\r\n\r\n", "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def base32(hexed: Column) -> Column:
    """The bare base32 form of 40 hexadecimal digits: five digits are four characters."""
    parts = []
    for at in range(0, 40, 5):
        bits = F.conv(F.substring(hexed, at + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks in a value are escaped."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(LINE)), F.lit(""))


def records(captures: DataFrame, id_col: str, url_col: str, payload_col: str, date: Column, least_bytes: int = 0) -> DataFrame:
    """One row per row of captures, `value`: its WARC record without the final CR LF CR LF."""
    rows = captures.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("rank"), F.col(url_col).alias("url"),
        F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    )
    rows = rows.withColumns({"sha": F.sha1("payload"), "bytes": F.octet_length("payload")})
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max("rank").alias("top"), F.count("*").alias("copies"))
    shared = staged(groups.where("copies > 1"), "payloads")
    # payloads of a thousandth of all captures or more are at most a thousand
    least = max(1000, captures.count() // 1000)
    heavy = shared.where(F.col("copies") >= least).select("sha", F.col("top").alias("heavy_top"))
    light = shared.where(F.col("copies") < least).select(F.col("sha").alias("key"), F.col("top").alias("light_top"))
    rows = rows.join(F.broadcast(heavy), "sha", "left")
    rows = rows.withColumn("key", F.when(F.col("heavy_top").isNull(), F.col("sha")).otherwise(F.concat_ws(":", "sha", "id")))
    top = F.coalesce("heavy_top", "light_top")
    refers = F.when((F.col("bytes") >= least_bytes) & ~F.col("rank").eqNullSafe(top), top.cast("string"))
    rows = rows.join(checked(light), "key", "left").withColumn("refers", refers)
    revisit = F.col("refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:capture:"), c, F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{LINE}"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(LINE)),
        _header("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:capture:>"))), _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.col("date")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha")))), _header("WARC-Refers-To", urn(F.col("refers"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(captures: DataFrame, path: str, id_col: str, url_col: str, payload_col: str, date: Column, least_bytes: int = 0, most: int = RECORDS) -> None:
    """Writes captures as WARC 1.1 files below path, each of at most `most` records and, but for single longer ones, of
    about ARCHIVE bytes.

    Of equal payloads of at least least_bytes bytes the capture with the largest id is the response and the others
    revisit it; repeated rows with that id are all responses. A null payload is empty, a null url or date has no
    header, a null id is never referred to while another exists. An empty table gives an archive without records.
    """
    longest = captures.agg(F.max(F.octet_length(payload_col))).first()[0] or 0
    most = max(1, min(most, ARCHIVE // (longest + 1000)))
    records(captures, id_col, url_col, payload_col, date, least_bytes).write.option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def parse(data: bytes) -> Iterator[dict[str, Any]]:
    """The records of an archive: their headers (lower-case names), offset, length, and block."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        size = int(_LENGTH.search(data, at, end + 2)[1])
        lines = data[at:end].decode().split(LINE)
        found: dict[str, Any] = dict((k.lower(), v) for k, _, v in (x.partition(": ") for x in lines[1:]))
        found |= {"offset": at, "length": end + 8 + size - at, "block": data[end + 4 : end + 4 + size]}
        yield found
        at = end + 8 + size


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels from the last to the first, then path and query; without scheme, user,
    port, fragment and a leading www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


ENTRY = "url_key string, timestamp string, record_id string, run string, offset long, length long, record_type string, url string, payload_bytes long, payload_digest string, refers_to string"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in ENTRY.split(", ")]
    bare = lambda x: x.removeprefix("<urn:capture:").removesuffix(">") or None if x else None
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            run = []
            for r in parse(content.as_py()):
                http, _, body = r["block"].partition(b"\r\n\r\n")
                stated = int(_LENGTH.search(http)[1])
                digest = r["warc-payload-digest"].removeprefix("sha1:")
                if r["warc-type"] == "response" and (len(body) != stated or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                    raise ValueError(f"{path}: the payload of {r['warc-record-id']} does not match its digest")
                url = r.get("warc-target-uri")
                run.append((url_key(url), re.sub(r"\D", "", r.get("warc-date", "")), bare(r["warc-record-id"]), path.as_py(), r["offset"], r["length"], r["warc-type"], url, stated, digest, bare(r.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*run, strict=True) if run else [()] * len(names), kinds, strict=True)], names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of all archives below path, in the order of each archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_entries, ENTRY)


class LoserTree:
    """Merges k sorted sequences. Inner nodes keep the loser of their match, so a step replays one path: log2(k)
    comparisons."""

    def __init__(self, runs: list[list], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _head(self, i: int):
        """A run's next key; an exhausted run's is larger than any other."""
        run, at = self.runs[i], self.at[i]
        return (0, self.key(run[at]), i) if at < len(run) else (1, (), i)

    def _replay(self, player: int) -> None:
        node = (player + self.k) // 2
        while node:
            other = self.losers[node]
            if other == -1:  # its opponent is not there yet
                self.losers[node] = player
                return
            if self.heads[other] < self.heads[player]:
                self.losers[node], player = player, other
            node //= 2
        self.losers[0] = player

    def __iter__(self) -> Iterator:
        while self.k:
            winner = self.losers[0]
            if self.heads[winner][0]:
                return
            yield self.runs[winner][self.at[winner]]
            self.at[winner] += 1
            self.heads[winner] = self._head(winner)
            self._replay(winner)


def _merge(names: list[str]):
    def key(e):
        return e[0], e[1], e[2] or "", e[3], e[4]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[int, list] = {}
        for batch in batches:
            for *row, run in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
                runs.setdefault(run, []).append(tuple(row))
        parts = [runs[r] for r in sorted(runs)]
        for part in parts:  # a part keeps its run's order; if an exchange did not, it is restored
            if any(key(a) > key(b) for a, b in zip(part, part[1:], strict=False)):
                part.sort(key=key)
        here, merged = TaskContext.get().partitionId(), list(LoserTree(parts, key))
        out = pd.DataFrame(merged, columns=names)
        yield out.assign(range_no=here, position=range(len(out))).astype({c: "Int64" for c in ("offset", "length", "payload_bytes")})

    return merge


def merge_index(entries: DataFrame, per_range: int = RANGE) -> DataFrame:
    """All entries in one order: by range_no and, within, position. Equal keys are in the order of archive and offset; an
    empty index stays empty. A range holds about per_range entries, which is what a task keeps in memory."""
    names = entries.columns
    keys = F.coalesce("record_id", F.lit(""))
    runs = staged(entries.withColumn("_run", F.spark_partition_id()).sortWithinPartitions("url_key", "timestamp", keys, "run", "offset"), "runs")
    ranges = max(1, -(-runs.count() // per_range))
    dealt = runs.repartitionByRange(ranges, "url_key", "timestamp", keys)
    return dealt.select(*names, "_run").mapInPandas(_merge(names), f"{ENTRY}, range_no int, position long")


def capture_history(captures: DataFrame, id_col: str, url_col: str, payload_col: str, date: Column, least_bytes: int = 0) -> DataFrame:
    """Writes captures into archives in the shared folder, reads these back, and merges their indexes."""
    spark = captures.sparkSession
    path = new_path(spark, "warc")
    write_archives(captures, path, id_col, url_col, payload_col, date, least_bytes)
    return merge_index(read_index(spark, path))
