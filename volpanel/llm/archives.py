"""WARC archives written and read back through Spark, and a globally ordered index of their captures.

An archive is a text file of whole records; Spark's writers commit it, so a lost executor leaves no half file. Each
write marks its records with a run token in the first header line. The reader splits at that line, in parallel and
without holding a file in memory, and checks every record against its Content-Length and digest.

The index is an external merge: every task sorts its captures into runs; splitters taken from all runs cut each run
into slices of one key range; the slices of a range are merged by a loser tree. Ranges are cut on (URL key, time,
id), so a host or URL with very many captures is spread over many ranges.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.session import scratch_path

LEAST_BYTES = 100
RUN_ROWS = 50_000
RANGE_ROWS = 4096
RANGES = 20_000
SAMPLES = 16
CRLF = "\r\n"
FIRST = "WARC/1.1\r\nCapture-Run: "


def roles(pages: DataFrame) -> DataFrame:
    """(id, url, time, payload) with payload digest and length, record type and the response that a revisit refers to.

    Among equal payloads of at least 100 bytes the smallest id is the response; rows that repeat it are, too.
    """
    sized = pages.withColumn("payload", F.coalesce("payload", F.lit(""))).selectExpr(
        "*", "sha2(encode(payload, 'UTF-8'), 256) AS digest", "bigint(octet_length(payload)) AS payload_bytes"
    )
    firsts = (
        sized.where(f"payload_bytes >= {LEAST_BYTES}")
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .selectExpr("digest AS same", "first_id")
    )
    key = f"CASE WHEN payload_bytes >= {LEAST_BYTES} THEN digest ELSE concat('-', coalesce(string(id), ''), '-', url) END"
    joined = sized.withColumn("same", F.expr(key)).join(firsts, "same", "left").drop("same")
    return joined.withColumn("refers_to", F.expr("CASE WHEN first_id <> id THEN first_id END")).drop("first_id")


def write_archives(captures: DataFrame, path: str, run: str) -> None:
    """A record per row of (id, url, time, payload, digest, payload_bytes, refers_to)."""
    clean = "regexp_replace(coalesce(url, ''), '[\\\\x00-\\\\x20\\\\x7F]', '%20')"
    http = (
        "concat('HTTP/1.1 200 OK\\r\\nContent-Type: text/html; charset=utf-8\\r\\nContent-Length: ', payload_bytes, '\\r\\n\\r\\n', "
        "CASE WHEN refers_to IS NULL THEN payload ELSE '' END)"
    )
    record = f"""concat('{FIRST.encode('unicode_escape').decode()}{run}\\r\\n',
        'WARC-Type: ', CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END, '\\r\\n',
        'WARC-Record-ID: <urn:capture:', coalesce(string(id), ''), '>\\r\\n',
        'WARC-Date: ', date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '\\r\\n',
        'WARC-Target-URI: ', {clean}, '\\r\\n',
        'WARC-Payload-Digest: sha256:', digest, '\\r\\n',
        CASE WHEN refers_to IS NULL THEN '' ELSE concat(
            'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\\r\\n',
            'WARC-Refers-To: <urn:capture:', refers_to, '>\\r\\n') END,
        'Content-Type: application/http;msgtype=response\\r\\nContent-Length: ', octet_length(http), '\\r\\n\\r\\n', http)"""
    captures.withColumn("http", F.expr(http)).select(F.expr(record).alias("value")).write.option("lineSep", CRLF * 2).option(
        "compression", "gzip"
    ).text(path)


def read_archives(spark, path: str, run: str, id_type: str = "bigint") -> DataFrame:
    """(id, url, time, payload_bytes, digest, record_type, refers_to, payload, archive) of every record.

    Fails on a record that is cut off or whose payload has another digest than its header says.
    """
    rows = spark.read.option("lineSep", f"{CRLF * 2}{FIRST}{run}{CRLF}").text(path).select("value", F.col("_metadata.file_name").alias("archive"))
    cut = rows.selectExpr(
        "archive",
        f"CASE WHEN startswith(value, '{FIRST.encode('unicode_escape').decode()}{run}\\r\\n') THEN substr(value, {len(FIRST) + len(run) + 3}) ELSE value END AS value",
    )
    parts = cut.selectExpr("archive", "substring_index(value, '\\r\\n\\r\\n', 1) AS head", "value").selectExpr(
        "archive", "head", "encode(substr(value, length(head) + 5), 'UTF-8') AS block"
    )
    field = lambda name, pattern="([^\\\\r]*)": f"nullif(regexp_extract(head, '{name}: {pattern}', 1), '')"
    parsed = parts.selectExpr(
        "archive",
        "block",
        f"{field('WARC-Type')} AS record_type",
        f"{field('WARC-Record-ID', '<urn:capture:([^>]*)>')} AS id",
        f"to_timestamp({field('WARC-Date')}) AS time",
        f"{field('WARC-Target-URI')} AS url",
        f"{field('WARC-Payload-Digest', 'sha256:([0-9a-f]*)')} AS said",
        f"{field('WARC-Refers-To', '<urn:capture:([^>]*)>')} AS refers_to",
        f"int({field('Content-Length')}) AS block_bytes",
    ).selectExpr("*", "decode(substring(block, 1, block_bytes), 'UTF-8') AS http")
    opened = parsed.selectExpr(
        "*", "substring_index(http, '\\r\\n\\r\\n', 1) AS http_head"
    ).selectExpr(
        "*",
        "encode(substr(http, length(http_head) + 5), 'UTF-8') AS payload",
        "bigint(regexp_extract(http_head, 'Content-Length: ([0-9]+)', 1)) AS payload_bytes",
    )
    whole = "octet_length(block) IN (block_bytes, block_bytes + 4) AND (record_type = 'revisit' OR (octet_length(payload) = payload_bytes AND sha2(payload, 256) = said))"
    return opened.selectExpr(
        f"cast(id AS {id_type}) AS id",
        "url",
        "time",
        "payload_bytes",
        f"CASE WHEN {whole} THEN said ELSE raise_error(concat('broken record ', id, ' in ', archive)) END AS digest",
        "record_type",
        f"cast(refers_to AS {id_type}) AS refers_to",
        "CASE WHEN record_type = 'response' THEN decode(payload, 'UTF-8') END AS payload",
        "archive",
    )


URL_KEY = """concat(array_join(reverse(split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '[.]')), ','), ')',
    lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1)))"""


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, so a step replays one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = max(1, len(runs))
        self.tree = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._first(a, b) else (b, a)
        self.tree[0] = winners[1] if self.size > 1 else 0

    def _first(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; a finished run goes last, ties go to the earlier run."""
        x = self.runs[a][self.at[a]] if a < len(self.runs) and self.at[a] < len(self.runs[a]) else None
        y = self.runs[b][self.at[b]] if b < len(self.runs) and self.at[b] < len(self.runs[b]) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Run and place of each item, in order."""
        for _ in range(sum(map(len, self.runs))):
            best = self.tree[0]
            yield best, self.at[best]
            self.at[best] += 1
            node = (best + self.size) // 2
            while node:
                if not self._first(best, self.tree[node]):
                    best, self.tree[node] = self.tree[node], best
                node //= 2
            self.tree[0] = best


def merge_index(captures: DataFrame, order: tuple[str, ...], run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All rows of ``captures`` with (``range``, ``place``): ascending in the order columns over the whole table.

    The order columns are strings or integers without nulls. Ties keep the order of runs.
    """
    spark = captures.sparkSession
    names = captures.columns
    path = scratch_path(spark, "captures")
    captures.write.parquet(path)
    stored = spark.read.parquet(path)
    total = stored.count()
    width = max(range_rows, -(-total // RANGES))
    every = max(1, width // SAMPLES)
    sample = stored.select(*order).where(F.expr(f"pmod(xxhash64({', '.join(order)}), {every}) = 0"))
    seen = sorted(tuple(r) for r in sample.collect())
    splitters = seen[SAMPLES - 1 :: SAMPLES]
    shared = spark.sparkContext.broadcast(splitters)
    key_at = [names.index(c) for c in order]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        held: list[pa.RecordBatch] = []

        def emit(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            one = pa.Table.from_batches(held)
            one = one.sort_by([(c, "ascending") for c in order]).combine_chunks()
            keys = list(zip(*(one.column(c).to_pylist() for c in order)))
            starts, ranges, at = [], [], 0
            while at < len(keys):
                r = bisect_right(cuts, keys[at])
                starts.append(at)
                ranges.append(r)
                at = bisect_right(keys, cuts[r], lo=at) if r < len(cuts) else len(keys)
                while at < len(keys) and bisect_right(cuts, keys[at]) == r:
                    at += 1
            rows = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in one.columns], names=names)
            lists = pa.ListArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), rows)
            return pa.RecordBatch.from_pydict(
                {"range": pa.array(ranges, pa.int32()), "run": pa.array([uuid.uuid4().hex] * len(ranges), pa.string()), "rows": lists}
            )

        held_rows = 0
        for batch in batches:
            held.append(batch)
            held_rows += batch.num_rows
            if held_rows >= run_rows:
                yield emit(held)
                held, held_rows = [], 0
        if held_rows:
            yield emit(held)

    slices = stored.mapInArrow(runs, f"range int, run string, rows array<struct<{fields.replace(' ', ':')}>>".replace(",:", ", "))
    path = scratch_path(spark, "runs")
    slices.write.parquet(path)
    dealt = spark.read.parquet(path).repartition(F.col("range")).sortWithinPartitions("range", "run")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(number: int, parts: list) -> pa.RecordBatch:
            columns = [[p.field(k).to_pylist() for k in key_at] for p in parts]
            sizes = [len(p) for p in parts]
            begin = [sum(sizes[:i]) for i in range(len(parts))]
            picks = [begin[r] + i for r, i in LoserTree([list(zip(*c)) for c in columns])]
            rows = pa.concat_arrays(parts).take(pa.array(picks, pa.int64()))
            out = {n: rows.field(k) for k, n in enumerate(names)}
            out["range"] = pa.array([number] * len(picks), pa.int32())
            out["place"] = pa.array(range(len(picks)), pa.int64())
            return pa.RecordBatch.from_pydict(out)

        current, parts = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("range")[i].as_py()
                if number != current and parts:
                    yield emit(current, parts)
                    parts = []
                current = number
                parts.append(batch.column("rows")[i].values)
        if parts:
            yield emit(current, parts)

    return dealt.mapInArrow(merged, f"{fields}, range int, place bigint")


def archive(
    pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", time: str = "timestamp_seconds(1700000000L + pmod(hash(id), 31536000))"
) -> DataFrame:
    """Writes all pages as archives, reads them back and returns the merged index, one row per page.

    Columns: the id, url_key, time, payload_bytes, payload_digest, record_type, refers_to, archive, range, place.
    ``time`` is an expression over (id, url, payload). A null payload is empty; a null URL has an empty key; a null id
    stays null and is never referred to; repeated rows are written one by one.
    """
    spark = pages.sparkSession
    source = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    kind = source.schema["id"].dataType.simpleString()
    token = uuid.uuid4().hex
    path = scratch_path(spark, "archives")
    write_archives(roles(source.withColumn("time", F.expr(time))), path, token)
    back = read_archives(spark, path, token, kind)
    index = back.selectExpr(
        f"coalesce({' '.join(URL_KEY.split())}, '') AS url_key", "time", "coalesce(unix_micros(time), 0L) AS micros", "coalesce(string(id), '') AS id_text", "id",
        "payload_bytes", "digest AS payload_digest", "record_type", "refers_to", "archive",
    )
    return merge_index(index, ("url_key", "micros", "id_text")).drop("micros", "id_text").withColumnRenamed("id", id)
