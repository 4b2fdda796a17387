"""WARC archives: pages written as records, read back, and merged into capture histories.

Writing.  Payloads are told by their SHA-1; of records with equal payloads the
one with the greatest (id, url) is a response, the others are revisits that
name it and carry its HTTP head but no payload.  Only digests and ids are
grouped; where many digests repeat, a record meets its group by a join that
Spark may split for a very common payload.  Records go out through Spark's text
writer, whose line separator is the end of a WARC record, so any file system
and its commit protocol will do; files are gzip.

Reading.  A gzip file is read by one task as a stream of lines, from which the
records are put together again by their lengths; a payload of any size is only
digested on its way.  A damaged record gives a row with an error.

Merging.  Each reading task sorts its captures by URL key and time: a run, kept
as a table.  Runs are cut at common bounds of (key, time, file, offset), so one
URL with very many captures is cut too, and each range merges its slices of all
runs with a loser tree.  Ranges follow each other, so places count on over them.

Defined results: null payload: empty; null id: below all others, read back as
null; null URL: no target, key ""; control characters and blanks in a URL are
written as %XX; repeated rows: one response, the others revisit it; without a
date column an id counts seconds from 2000 on, modulo 10**9 (one that is no
whole number: 0), and a null date is that of 1970; an empty table gives an empty
result; other columns are ignored, whatever their names; very long payloads:
whole, up to the 2 GB of a Spark string.  Files are told by name, which Spark
makes unique.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, saved, shared_dir, table, tidy
from .urls import host_of, key_of

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Up to so many repeated digests, Spark alone decides how records meet them.
FEW = 50_000
ENTRY = (
    "file string, offset long, length long, record_type string, record_id string, page_id string, at string, target string, "
    "payload_bytes long, payload_digest string, refers_to string, error string"
)


def base32(hexadecimal: Column) -> Column:
    """Upper-case base 32 of 40 hexadecimal digits: five of them make four characters."""
    part = lambda k: F.conv(F.substr(hexadecimal, F.lit(1 + 5 * k), F.lit(5)), 16, 10).cast("int")
    four = lambda v: [F.substr(F.lit(ALPHABET), F.shiftright(v, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)]
    return F.array_join(F.flatten(F.transform(F.array(*[part(k) for k in range(8)]), lambda v: F.array(*four(v)))), "")


def _id_text(c: Column) -> Column:
    """An id as part of a name: null is nothing, an empty text a lone %."""
    s = c.cast("string")
    return F.when(s.isNull(), "").when(s == "", "%").otherwise(F.url_encode(s))


def _uri(url: Column) -> Column:
    safe = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    return F.when(url.rlike(r"[\x00-\x20\x7f]"), safe).otherwise(url)


def captured(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> DataFrame:
    """(id, url, payload, bytes, digest, at) of every row of pages; digest is hexadecimal."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    count = F.pmod(F.coalesce(F.col(id_col).cast("string").try_cast("long"), F.lit(0)), F.lit(10**9))
    at = F.coalesce(F.col(date_col).cast("timestamp"), F.timestamp_seconds(F.lit(0))) if date_col else F.timestamp_seconds(F.lit(946684800) + count)
    at = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"), at.alias("at"))


def repeated(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(digest, top, copies): digests of several rows, the (id, url, at) of the greatest row, and how many equal it."""
    alike = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest", "id", "url", "at").count()
    tops = alike.groupBy("digest").agg(F.max(F.struct("id", "url", "at", "count")).alias("top"), F.sum("count").alias("n"))
    return tops.filter("n > 1").select("digest", F.struct("top.id", "top.url", "top.at").alias("top"), F.col("top.count").alias("copies"))


def _name(one: str, unique: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), _id_text(F.col(f"{one}id")), F.lit(":"), unique, F.lit(">"))


def records(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(value): WARC records without the line ends that close them."""
    tops = saved(repeated(rows, min_bytes), "repeated")
    side = tops if tops.count() <= FEW else tops.hint("shuffle_hash")
    met = rows.join(side, "digest", "left") if not min_bytes else rows.join(side, (rows["digest"] == side["digest"]) & (rows["bytes"] >= min_bytes), "left").drop(side["digest"])
    is_top = F.col("id").eqNullSafe(F.col("top.id")) & F.col("url").eqNullSafe(F.col("top.url")) & F.col("at").eqNullSafe(F.col("top.at"))
    alone = met.filter(F.col("top").isNull() | ~is_top | (F.col("copies") == 1)).withColumn("revisit", F.col("top").isNotNull() & ~is_top)
    if not tops.filter("copies > 1").isEmpty():
        # equal rows that are all the greatest: one response, then so many revisits, dealt out in lots
        alike = met.filter(is_top & (F.col("copies") > 1)).groupBy("digest", "id", "url", "at", "bytes", "top", "copies").agg(F.any_value("payload").alias("payload"))
        lots = alike.select("digest", "id", "url", "at", "bytes", "top", "copies", F.explode(F.sequence(F.lit(1), F.col("copies") - 1, F.lit(4096))).alias("lot")).repartition("digest", "id", "lot")
        again = lots.withColumn("k", F.explode(F.sequence(F.col("lot"), F.least(F.col("lot") + 4095, F.col("copies") - 1)))).drop("lot", "k")
        alone = alone.unionByName(alike.withColumn("revisit", F.lit(False))).unionByName(again.withColumns({"revisit": F.lit(True), "payload": F.lit("")}))
    digest = base32(F.col("digest"))
    own = F.md5(F.concat_ws(" ", F.coalesce("url", F.lit("")), "at", "digest").cast("binary"))
    top = F.md5(F.concat_ws(" ", F.coalesce("top.url", F.lit("")), "top.at", "digest").cast("binary"))
    revisit = F.col("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), line("WARC-Record-ID", _name("", F.when(revisit, F.expr("uuid()")).otherwise(own))),
        line("WARC-Date", F.col("at")), F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", _uri(F.col("url")))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _name("top.", top)), line("WARC-Refers-To-Date", F.col("top.at")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
    )
    return alone.select(F.concat(head, F.lit(END), http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, **columns) -> None:
    """One record for each row of pages, as gzip WARC files in a new folder."""
    records(captured(pages, **columns), min_bytes).write.option("lineSep", END).option("compression", "gzip").text(path)


def entries_of(lines: Iterator[tuple[str, bytes]]) -> Iterator[dict]:
    """ENTRY rows of the records in the lines of files, in order; a line comes without its line feed."""
    import base64
    import hashlib
    from urllib.parse import unquote_plus

    def named(text: str | None) -> str | None:
        part = (text or "").strip("<>").split(":")
        return None if len(part) < 3 or part[:2] != ["urn", "capture"] or not part[2] else "" if part[2] == "%" else unquote_plus(part[2])

    file, at, record = None, 0, None

    def closed(error=None) -> dict:
        head, kind = record["head"], record["head"].get("warc-type")
        digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        size = record["size"]
        if kind == "revisit":
            told = record["http"].get("content-length", "")
            size = int(told) if told.isdigit() else None
        elif not error and digest and digest != base64.b32encode(record["sha1"].digest()).decode():
            error = "payload differs from its digest"
        return {
            "file": file, "offset": record["offset"], "length": at - record["offset"], "record_type": kind, "record_id": head.get("warc-record-id"), "page_id": named(head.get("warc-record-id")), "at": head.get("warc-date"),
            "target": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "refers_to": named(head.get("warc-refers-to")), "error": error,
        }

    for where, line in lines:
        if where != file:
            if record:
                yield closed("the file ends within the record")
            file, at, record = where, 0, None
        piece = line + b"\n"
        if record is None:
            if line.startswith(b"WARC/"):
                record = {"offset": at, "head": {}, "http": {}, "left": -1, "size": 0, "sha1": hashlib.sha1(), "in_http": True}
            elif line.strip(b"\r\n"):
                yield dict.fromkeys(x.split()[0] for x in ENTRY.split(", ")) | {"file": file, "offset": at, "length": len(piece), "error": "no record starts here"}
            at += len(piece)
            continue
        if record["left"] < 0:
            at += len(piece)
            if text := line.rstrip(b"\r"):
                name, _, value = text.decode("utf-8", "replace").partition(":")
                record["head"][name.strip().lower()] = value.strip()
                continue
            told = record["head"].get("content-length", "")
            if not told.isdigit():
                yield closed("no length")
                record = None
                continue
            record["left"] = int(told)
            record["in_http"] = record["head"].get("content-type", "").startswith("application/http")
        else:
            at += len(piece)
            part = piece[: record["left"]]
            record["left"] -= len(part)
            if not record["in_http"]:
                record["sha1"].update(part)
                record["size"] += len(part)
            elif text := part.rstrip(b"\r\n"):
                name, _, value = text.decode("utf-8", "replace").partition(":")
                record["http"][name.strip().lower()] = value.strip()
            else:
                record["in_http"] = False
            if not record["left"] and (rest := piece[len(part) :]) and rest.strip(b"\r\n"):
                yield closed("the record is longer than its length")
                record = None
                continue
        if not record["left"]:
            yield closed()
            record = None
    if record:
        yield closed("the file ends within the record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """ENTRY rows of all records in the gzip files of a folder."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(ENTRY))

    def lines(batches) -> Iterator[tuple[str, bytes]]:
        for batch in batches:
            values, files = batch.column(0).to_pylist(), batch.column(1)
            if len(values):
                first, last = files[0].as_py(), files[-1].as_py()
                yield from zip([first] * len(values) if first == last else files.to_pylist(), values)

    @tidy
    def parsed(batches):
        held = []
        for entry in entries_of(lines(batches)):
            held.append(entry)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=shape)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=shape)

    # a gzip file can't be split, so its lines come in order to one task
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_name").alias("file")).mapInArrow(parsed, ENTRY)


def url_key(target: Column) -> Column:
    """Reversed host, ")" and what follows the host but for the fragment: captures of a site stand together."""
    after = F.substring_index(F.regexp_extract(target, r"^[^:]*://[^/?#]*(.*)$", 1), "#", 1)
    return F.when(target.isNull(), "").otherwise(F.concat(key_of(host_of(target)), F.lit(")"), after))


class LoserTree:
    """Merges sorted runs: each inner place holds the run that lost there, so the next winner costs one path to the top."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.losers = [-1] * max(1, self.k)
        for run in range(self.k):
            self._replay(run, filling=True)

    def _head(self, run: int):
        at = self.at[run]
        return self.runs[run][at] if at < len(self.runs[run]) else None

    def _before(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, run: int, filling: bool = False) -> None:
        place = (run + self.k) // 2
        while place > 0:
            held = self.losers[place]
            if filling and held < 0:
                self.losers[place] = run
                return
            if self._before(held, run):
                self.losers[place], run = run, held
            place //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it), in order."""
        while self.k and self._head(run := self.losers[0]) is not None:
            yield run, self.at[run]
            self.at[run] += 1
            self._replay(run)


def histories(entries: DataFrame) -> DataFrame:
    """entries with url_key and place, the number of the capture in the order of (url_key, at, file, offset)."""
    spark = entries.sparkSession
    order = ["url_key", "at", "file", "offset"]
    keyed = entries.withColumn("url_key", url_key(F.col("target"))).withColumn("at", F.coalesce("at", F.lit("")))
    runs = saved(keyed.sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()), "runs")
    shape = runs.drop("run").withColumn("_part", F.lit(0)).withColumn("_row", F.lit(0).cast("long")).schema

    @tidy
    def merged(batches):
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        keys, slices, places = list(zip(*(rows.column(c).to_pylist() for c in order))), {}, {}
        for i, run in enumerate(rows.column("run").to_pylist()):
            slices.setdefault(run, []).append(keys[i])
            places.setdefault(run, []).append(i)
        for run, own in slices.items():
            if any(a > b for a, b in zip(own, own[1:])):  # a shuffle may hand over a run's blocks in another order
                turn = sorted(range(len(own)), key=own.__getitem__)
                slices[run], places[run] = [own[i] for i in turn], [places[run][i] for i in turn]
        at = list(places.values())
        out = rows.drop_columns(["run"]).take(pa.array([at[run][i] for run, i in LoserTree(list(slices.values()))]))
        part = TaskContext.get().partitionId()
        yield from out.append_column("_part", pa.array([part] * len(out), pa.int32())).append_column("_row", pa.array(range(len(out)), pa.int64())).to_batches(max_chunksize=10_000)

    done = saved(runs.repartitionByRange(*order).mapInArrow(merged, shape), "histories")
    counts, before, firsts = {r["_part"]: r["count"] for r in done.groupBy("_part").count().collect()}, 0, []  # a row a range
    for part in sorted(counts):
        firsts.append((part, before))
        before += counts[part]
    first = spark.createDataFrame(firsts, "_part int, _first long")
    return done.join(F.broadcast(first), "_part").withColumn("place", F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")


def op11_warc_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and merged into capture histories."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    write_archives(pages, path)
    with bounded_batches(spark):
        found = histories(read_archives(spark, path))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP11_SQL = f"""
with r as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h,
         row_number() over (partition by sha1(coalesce(html, '')) order by page_id desc nulls last, url desc nulls last) as k,
         first_value(page_id) over (partition by sha1(coalesce(html, '')) order by page_id desc nulls last, url desc nulls last) as top from pages)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{ALPHABET}', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31), 1)), '') as payload_digest,
       case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then top end as refers_to
from r
"""
