"""WARC archives of pages, and capture histories by an external index merge.

``write_archives`` puts a record per page into WARC 1.1 files; ``read_archives``
reads any such files back, by walking their content lengths, into one index run
per archive, sorted by (URL key, capture time, record id). ``histories`` merges the
runs: splitters sampled from all runs cut every run into segments of the same key
ranges, and each range is merged from the k segments it gets by a loser tree, so
that no task sorts what another has sorted already. Ranges are cut by the whole
key with the record id at its end, so one URL with many captures spans several.

Of pages with equal payloads of at least ``MIN_REVISIT`` bytes that with the largest
page id is stored (``response``), the others refer to it (``revisit``).

Defined results. A null page id is the smallest, ties (rows that repeat an id) are
broken by row; null html is empty; pages without a URL sort first. Extra columns
are ignored. No pages give no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import time
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import numbered, saved

#: Smaller payloads are always stored.
MIN_REVISIT = 1000
#: Bytes of records in an archive, and index rows of a merged range.
ARCHIVE = 16 << 20
RANGE = 50_000
#: Payload digests with more than this share of all pages are joined apart.
HOT_SHARE = 1000
#: About so many sampled keys give the splitters.
SAMPLE = 20_000

#: Record id: page id (or null) and row, so that a reader finds the page again.
RECORD_ID = re.compile(r"<urn:page:(null|-?\d+):(\d+)>")
RUN = ("archive string, offset long, length long, url string, url_key string, captured string, "
       "record_type string, row long, page_id long, payload_bytes long, payload_digest string, "
       "refers_to long, intact boolean")


# ------------------------------------------------------------------ one record

def url_key(url: str | None) -> str:
    """Sort-friendly form: the host's labels from the top down, then the rest; all
    lower-case, without scheme, user, default port and fragment."""
    text = re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("#")[0]
    host, rest = re.match(r"([^/?]*)(.*)", text, re.S).groups()
    host = re.sub(r":(80|443)?$", "", host.rsplit("@", 1)[-1])
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def _header_safe(url: str) -> str:
    """A header value ends with its line: controls are written as %XX."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{row}>"


def format_record(url: str | None, captured: str, rid: str, payload: bytes | None, size: int,
                  sha1: bytes, refers_to: str | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit without a payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}",
            f"WARC-Record-ID: {rid}", f"WARC-Date: {captured}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_safe(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}")
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def walk(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(offset, length, header fields, block)`` of every record: what a payload
    contains, markers included, is never taken for a header. Blank lines between
    records are skipped; a broken header or a cut block raises."""
    at = 0
    while True:
        while data[at:at + 2] == b"\r\n" or data[at:at + 1] == b"\n":
            at += 2 if data[at:at + 1] == b"\r" else 1
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = _fields(data[at:end])
        size = int(fields["content-length"])
        start = end + 4
        if start + size > len(data):
            raise ValueError(f"the record at byte {at} is cut")
        yield at, start + size - at, fields, data[start:start + size]
        at = start + size


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """Payload and the payload length that its HTTP header states."""
    if "application/http" not in fields.get("content-type", ""):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    stated = _fields(head).get("content-length", "")
    return body, int(stated) if stated.isdigit() else len(body)


# ------------------------------------------------------------------ write and read

def _date(page_id: int | None) -> str:
    """A capture time where the table has none: so many seconds after 2020 began
    (mod 10^9) as the page id says."""
    return time.strftime("%Y-%m-%dT%H:%M:%SZ",
                         time.gmtime(1_577_836_800 + (page_id or 0) % 1_000_000_000))


def write_archives(pages: DataFrame, path: str, captured: str | None = None,
                   archive: int = ARCHIVE) -> None:
    """One record per row of ``pages`` (``page_id``, ``url``, ``html`` and, if
    named, the ISO time column ``captured``) as WARC files under ``path``.

    Repeats are found from digests alone; payloads are shuffled once, by row. A
    digest of more than a thousandth of all pages is joined by broadcast (there are
    fewer than a thousand), the others by shuffle, so that no key is hot."""
    when = (F.col(captured) if captured else F.lit(None)).cast("string")
    rows, row = numbered(pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                                      F.coalesce("html", F.lit("")).alias("html"),
                                      when.alias("captured")), "warc-pages")
    sums = saved(rows.select(F.col(row).alias("row"), "page_id",
                             F.octet_length("html").cast("long").alias("size"),
                             F.sha1(F.col("html").cast("binary")).alias("sha1")), "warc-digests")
    total = sums.count()
    large = sums.filter(F.col("size") >= MIN_REVISIT)
    # the first field tells null ids (smallest) from others
    last = F.max(F.struct(F.col("page_id").isNotNull().alias("set"), "page_id", "row"))
    kept = (large.groupBy("sha1", "size").agg(last.alias("m"), F.count("*").alias("n"))
            .filter("n > 1").select("sha1", "size", "n", F.col("m.page_id").alias("to_page"),
                                    F.col("m.row").alias("to_row")))
    hot = F.col("n") * HOT_SHARE > total
    key = ["sha1", "size"]
    first = F.broadcast(kept.filter(hot)).select(*key, F.lit(True).alias("hot"),
                                                 F.col("to_page").alias("p1"),
                                                 F.col("to_row").alias("r1"))
    marked = large.join(first, key, "left")
    rest = (marked.filter("hot IS NULL").drop("hot", "p1", "r1")
            .join(kept.filter(~hot).drop("n"), key))
    links = (marked.filter("hot").select("row", F.col("p1").alias("to_page"),
                                         F.col("r1").alias("to_row"))
             .unionByName(rest.select("row", "to_page", "to_row"))
             .filter("row <> to_row"))
    facts = sums.select("row", "size", "sha1").join(links, "row", "left")
    records = rows.withColumnRenamed(row, "row").join(facts, "row").select(
        "row", "page_id", "url", "captured", "size", "sha1", "to_page", "to_row",
        F.when(F.col("to_row").isNull(), F.col("html")).alias("html"))

    def packed(batches):
        """Archives of about ``archive`` bytes, one per row. The writer adds the
        separator, which is the blank line that ends the last record."""
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row, page, url, when, n, sha1, to_page, to_row, html = (
                    c[i].as_py() for c in batch.columns)
                to = None if to_row is None else record_id(to_page, to_row)
                held.append(format_record(url, when or _date(page), record_id(page, row),
                                          None if html is None else html.encode(), n,
                                          bytes.fromhex(sha1), to))
                size += len(held[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-4].decode()])],
                                                     names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-4].decode()])],
                                             names=["value"])

    (records.mapInArrow(packed, "value string").write.option("lineSep", "\r\n\r\n")
     .option("maxRecordsPerFile", 1).option("compression", "gzip").text(path))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all responses and revisits under ``path``, in one sorted run per
    archive: ``archive`` and ``place`` name the run and the position in it. A response
    whose payload does not have the stated digest and length is not ``intact``.
    Records with ids of other writers have no page id and go by their offset."""
    def runs(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = [_index_row(name, *record) for record in walk(data)
                        if record[2].get("warc-type") in ("response", "revisit")]
                rows.sort(key=_order)
                for place, row in enumerate(rows):
                    row["place"] = place
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kind = RUN + ", place long"
    schema = _arrow(spark, kind)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(runs, kind)


def _arrow(spark: SparkSession, kind: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], kind).schema)


def _index_row(name: str, offset: int, length: int, fields: dict, block: bytes) -> dict:
    body, size = _payload(fields, block)
    stored = fields.get("warc-type") != "revisit"
    stated = fields.get("warc-payload-digest", "").split(":")[-1]
    digest = base64.b32decode(stated) if stated else hashlib.sha1(body).digest()
    own = RECORD_ID.fullmatch(fields.get("warc-record-id", ""))
    page, row = own.groups() if own else ("null", offset)
    to = RECORD_ID.fullmatch(fields.get("warc-refers-to", ""))
    url = fields.get("warc-target-uri")
    return {"archive": name, "offset": offset, "length": length, "url": url,
            "url_key": url_key(url), "captured": fields["warc-date"],
            "record_type": "response" if stored else "revisit", "row": int(row),
            "page_id": None if page == "null" else int(page), "payload_bytes": size,
            "payload_digest": digest.hex(),
            "refers_to": int(to[1]) if to and to[1] != "null" else None,
            "intact": not stored or (len(body) == size
                                     and hashlib.sha1(body).digest() == digest)}


def _order(row: dict) -> tuple:
    return row["url_key"].encode(), row["captured"].encode(), row["row"]


# ------------------------------------------------------------------ index merge

class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, so that the next
    winner takes one comparison a level. ``runs``: sorted iterators of (key, item)."""

    def __init__(self, runs: Sequence[Iterator[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] or [None]
        self.losers = [0] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while self.head[self.winner] is not None:
            run = self.winner
            yield self.head[run][1]
            self.head[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:  # replay the matches on the way to the root
                if self._beats(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def histories(runs: DataFrame, range_rows: int = RANGE, sample: int = SAMPLE) -> DataFrame:
    """The rows of sorted ``runs`` (see ``read_archives``) in one global order of (URL
    key, capture time, row): ``ordinal`` counts it from 0, ``capture`` counts the
    captures of a URL key from 1."""
    runs = saved(runs, "warc-runs")
    total = runs.count()
    n = max(1, -(-total // range_rows))
    # splitters: quantiles of a bounded sample by hash (about ``sample`` keys)
    chosen = F.pmod(F.xxhash64("archive", "place"), F.lit(1 << 30)) < F.lit(
        int(min(1.0, sample / max(1, total)) * (1 << 30)))
    picked = runs.filter(chosen).select("url_key", "captured", "row").collect() if n > 1 else []
    keys = sorted(_order(r.asDict()) for r in picked)
    splitters = [keys[i * len(keys) // n] for i in range(1, n)] if keys else []
    columns = runs.columns
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    kind = f"{out}, part int, position long, nth long"
    schema, cut_schema = (_arrow(runs.sparkSession, k) for k in (kind, f"{out}, part int"))

    def cut(batches):
        """Segments of the runs: every row gets its range."""
        for batch in batches:
            keys = map(_order, batch.select(["url_key", "captured", "row"]).to_pylist())
            part = pa.array([bisect_right(splitters, k) for k in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], schema=cut_schema)

    def merged(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        table = table.sort_by([("archive", "ascending"), ("place", "ascending")])
        names = table.column("archive").to_pylist()
        ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "row"))))
        keys = [(k.encode(), c.encode(), r) for k, c, r in keys]
        segments = [((keys[i], i) for i in range(a, b))
                    for a, b in zip([0, *ends], [*ends, len(names)])]
        order = pa.array(list(LoserTree(segments)), pa.int64())
        nth, now = [], None  # of the captures of one URL key in this range
        for i in order.to_pylist():
            nth.append(nth[-1] + 1 if keys[i][0] == now else 1)
            now = keys[i][0]
        table = table.select(columns).take(order)
        for extra in ([part] * len(names), range(len(names)), nth):
            table = table.append_column(schema[table.num_columns], pa.array(
                extra, schema[table.num_columns].type))
        return table.cast(schema)

    ranges = saved(runs.mapInArrow(cut, f"{out}, part int").repartition(n, "part")
                   .groupBy("part").applyInArrow(merged, kind), "warc-merged")
    # one row per range: where it starts, and where its first URL key started
    sums = ranges.groupBy("part").agg(
        F.count("*").alias("n"), F.min("url_key").alias("first_key"),
        F.max("url_key").alias("last_key"), F.max_by("nth", "position").alias("last_n"))
    start = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    sums = saved(sums.withColumn("start", start), "warc-ranges")
    heads = sums.groupBy(F.col("last_key").alias("first_key")).agg(
        F.min(F.col("start") + F.col("n") - F.col("last_n")).alias("head"))
    facts = sums.join(heads, "first_key", "left").select("part", "start", "first_key", "head")
    # only the first key of a range can have captures in the ranges before it
    nth = F.when((F.col("url_key") == F.col("first_key")) & (F.col("head") <= F.col("start")),
                 F.col("ordinal") - F.col("head") + 1).otherwise(F.col("nth"))
    return (ranges.join(facts, "part").withColumn("ordinal", F.col("start") + F.col("position"))
            .withColumn("capture", nth)
            .drop("part", "position", "place", "nth", "start", "first_key", "head"))


def archived(pages: DataFrame, captured: str | None = None, archive: int = ARCHIVE) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge
    their index runs."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, captured, archive)
    return histories(read_archives(spark, path))
