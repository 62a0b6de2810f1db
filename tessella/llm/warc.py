"""WARC archives of web pages: written with revisit records for copies, read back by boundary chains.

Writing: pages with equal payloads (SHA-256) of at least ``LEAST`` bytes are stored once, as the response with the
smallest id; the others become revisits that refer to it. Spark's text writer makes the files: a record is a row, the
blank lines between records are the line separator, so archives go wherever Spark writes and a lost task is redone.

Reading: Spark's text reader cuts files at the magic ``WARC/1.0``, in splits of any size. Every chunk between two magics
is a candidate record. Running sums of chunk sizes, inside a split and then over the splits of a file, give its offset,
and its ``Content-Length`` gives the offset of its successor. A payload may hold the magic, too, so candidates prove
nothing. Pointer jumping from each file's start keeps those that the chain reaches: in every round marked records mark
what their pointers name, and all pointers skip as far again; rounds grow with the logarithm of a file's records. Only
these few numbers of a candidate are joined. Payload bytes are digested in the scan where a chunk is a whole record; the
chunks of a record whose payload holds the magic are fetched by another scan and put together.

Defined cases: a null payload is empty; a row without an id is written without one and comes last among equal payloads;
rows repeated under the smallest id are responses all; control characters and blanks of an address are
percent-encoded; other columns are not read; without pages there is no record. A record whose end meets neither a record
nor the file's end is not returned, nor what follows it: ``broken_files`` names such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_table, join_counted, materialize

#: Bytes from which equal payloads are stored once.
LEAST = 100

# Fixed values of the archive format.
MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
# ---- end of fixed values ----


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """``pages`` as ``_id, _url, _payload, _digest, _first``: the id that a revisit refers to, null for responses."""
    rows = pages.select(pages[id_col].alias("_id"), (pages["url"] if "url" in pages.columns else F.lit(None)).cast("string").alias("_url"),
                        F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("_payload"))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    long = F.when(F.octet_length("_payload") >= least, F.col("_digest"))
    known = rows.select(long.alias("_key"), "_id").filter("_key IS NOT NULL")
    shared = materialize(known.groupBy("_key").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")).filter("_n > 1"), "shared_payloads")
    total = shared.agg(F.sum("_n")).first()[0] or 0
    met = join_counted(rows.withColumn("_key", long), shared, "_key", total, F.xxhash64("_id", "_url"))
    refers = F.col("_least").isNotNull() & ~F.col("_least").eqNullSafe(F.col("_id"))
    return met.select("_id", "_url", "_payload", "_digest", F.when(refers, F.col("_least")).alias("_first"))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(page.cast("string")), F.lit("")), F.lit(">"))


def _address(url: Column) -> Column:
    for code in (*range(33), 127):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def records_of(rows: DataFrame, date: str) -> DataFrame:
    """``value``: the record of each row of ``revisits``, without the blank lines after it."""
    revisit = F.col("_first").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.octet_length("_payload").cast("string")), F.lit("\r\n"))
    block = F.concat(head, F.when(revisit, "").otherwise(F.col("_payload")))
    lines = [_line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", _urn(F.col("_id"))), _line("WARC-Date", F.lit(date)),
             _line("WARC-Target-URI", _address(F.col("_url"))), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "_digest")),
             _line("WARC-Refers-To", F.when(revisit, _urn(F.col("_first")))), _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
             _line("Content-Type", F.lit(HTTP)), _line("Content-Length", F.octet_length("_block").cast("string"))]
    return rows.withColumn("_block", block).select(F.concat(F.lit(MAGIC), *lines, F.lit("\r\n"), "_block").alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", least: int = LEAST) -> None:
    """Write a record for every row of ``pages`` into archives below ``path``, one for each task that writes."""
    found = records_of(revisits(pages, id_col, payload_col, least), date)
    found.write.option("lineSep", BLANK).option("compression", compression).text(path)


def _field(head: Column, name: str, value: str = r"([^\r]*)") -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *{value}(?=\r|$)", 1)
    return F.when(found != "", found)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, next, ends`` and what a candidate's header says, for every chunk that follows a magic; ``ends``: the file's length.

    ``whole``: the chunk is as long as the header says; then ``payload_bytes`` and ``payload_sha256`` are the payload's.
    ``chunk``: digest of the chunk's bytes."""
    text = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    head = F.substring_index("value", BLANK, 1)
    rows = text.withColumns({"head": head, "size": F.octet_length("value").cast("long")})
    length = _field(F.col("head"), "Content-Length", r"([0-9]{1,18})").cast("long")
    rows = rows.withColumns({"head_bytes": F.octet_length("head").cast("long"), "length": F.when(F.octet_length("head") < F.col("size"), length)})
    whole = F.coalesce(F.col("size") == F.col("head_bytes") + F.col("length") + 2 * len(BLANK), F.lit(False))
    rows = rows.withColumns({"whole": whole, "_p": F.when(whole, _payload(F.col("value").cast("binary"), F.col("head"), F.col("length")))})
    rows = rows.select("file", "block", "seq", "size", "head_bytes", "length", "whole", F.sha2(F.col("value").cast("binary"), 256).alias("chunk"),
                       *_header_fields(F.col("head")), F.octet_length("_p").cast("long").alias("payload_bytes"), F.sha2("_p", 256).alias("payload_sha256"),
                       _field(F.substring_index(F.substring("value", F.length("head") + 1 + len(BLANK), F.lit(4096)), BLANK, 1), "Content-Length", r"([0-9]{1,18})").cast("long").alias("http_length"))
    rows = materialize(rows, "chunks")
    step = F.col("size") + len(MAGIC)
    splits = rows.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    in_file = Window.partitionBy("file")
    before = F.coalesce(F.sum("bytes").over(in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "block", before.alias("before"), (F.sum("bytes").over(in_file) - len(MAGIC)).alias("ends"))
    inside = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("inside", inside).join(splits, ["file", "block"]).withColumn("at", F.col("before") + F.col("inside") - len(MAGIC))
    # what stands before a file's first magic is no candidate
    follows = F.col("at") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 2 * len(BLANK)
    found = placed.filter("at >= 0").select("file", "at", follows.alias("next"), "ends", "size", "whole", "chunk", *FIELDS, "payload_bytes", "payload_sha256", "http_length")
    return materialize(found, "candidates")


FIELDS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest", "content_type": "Content-Type"}


def _header_fields(head: Column) -> list[Column]:
    return [_field(head, name).alias(column) for column, name in FIELDS.items()]


def _payload(raw: Column, head: Column, length: Column) -> Column:
    """Bytes of the payload in a record's bytes after the magic: its block, for a page without the headers of HTTP."""
    block = F.substring(raw, F.octet_length(head) + 1 + len(BLANK), length.cast("int"))
    inner = F.octet_length(F.substring_index(block.cast("string"), BLANK, 1)) + len(BLANK)
    page = F.startswith(_field(head, "Content-Type"), F.lit("application/http"))
    return F.when(page & (inner <= length), F.substring(block, inner + 1, length.cast("int"))).otherwise(block)


def reachable(found: DataFrame) -> DataFrame:
    """``file, at`` of the candidates that the chain from their file's start reaches.

    ``at, to, marked`` of each candidate: a pointer that spans 2, 4, 8, ... records after as many rounds."""
    state = materialize(found.select("file", "at", F.col("next").alias("to"), (F.col("at") == 0).alias("marked")), "pointers")
    while True:
        jump = state.select("file", F.col("at").alias("to"), F.col("to").alias("far"), F.lit(True).alias("met"))
        named = state.filter("marked").select("file", F.col("to").alias("at"), F.lit(True).alias("named"))
        after = state.join(jump, ["file", "to"], "left").join(named, ["file", "at"], "left")
        after = materialize(after.select("file", "at", F.col("far").alias("to"), (F.col("marked") | F.coalesce("named", F.lit(False))).alias("marked"), (F.col("marked") & F.coalesce("met", F.lit(False))).alias("goes_on")), "pointers")
        drop_table(state)
        if after.filter("goes_on").isEmpty():
            return after.filter("marked").select("file", "at")
        state = after.drop("goes_on")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below ``path``: ``file, at, type, record_id, refers_to, target_uri, digest, content_type, http_length,
    payload_bytes, payload_sha256``; with ``payload`` also its bytes, which costs another scan of all chunks."""
    found = candidates(spark, path)
    chain = materialize(reachable(found), "chain")
    ends = found.select("file", F.col("at").alias("next")).unionByName(found.select("file", F.col("ends").alias("next"))).distinct()
    kept = found.join(chain, ["file", "at"], "left_semi").join(ends, ["file", "next"], "left_semi")
    keys = ["file", "at", *FIELDS, "http_length"]
    if payload:
        needed = _owned(found, kept, chain, F.lit(True))
        return kept.select(*keys).join(_joined(spark, path, needed), ["file", "at"], "left")
    apart = materialize(_owned(found, kept.filter(~F.col("whole")), chain, ~F.col("whole")), "chunks_of_records")
    whole = kept.filter("whole").select(*keys, "payload_bytes", "payload_sha256")
    if apart.isEmpty():
        return whole
    cut = kept.filter(~F.col("whole")).select(*keys).join(_joined(spark, path, apart).drop("payload"), ["file", "at"])
    return whole.unionByName(cut)


def _owned(found: DataFrame, records: DataFrame, chain: DataFrame, in_question: Column) -> DataFrame:
    """``file, at, part, chunk``: the chunks of each of ``records``: its own and those that the magic in its payload cuts off."""
    files = records.select("file").distinct()
    rows = found.join(files, "file", "left_semi").join(chain.withColumn("own", F.lit(True)), ["file", "at"], "left")
    owner = F.last(F.when(F.col("own"), F.struct("at", in_question.alias("asked"))), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    return rows.withColumn("owner", owner).filter("owner.asked").select("file", F.col("owner.at").alias("at"), F.col("at").alias("part"), "chunk")


def _joined(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """``file, at, payload, payload_bytes, payload_sha256`` of records from the chunks that ``parts`` names by their digests."""
    text = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("raw"))
    text = text.withColumn("chunk", F.sha2("raw", 256))
    wanted = text.join(parts.select("file", "chunk").distinct(), ["file", "chunk"], "left_semi").groupBy("file", "chunk").agg(F.first("raw").alias("raw"))
    pieces = parts.join(wanted, ["file", "chunk"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("part", "raw"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda p: F.hex(p.getField("raw"))), MAGIC.encode().hex().upper())
    rows = pieces.select("file", "at", F.unhex(whole).alias("raw"))
    head = F.substring_index(F.col("raw").cast("string"), BLANK, 1)
    rows = rows.select("file", "at", _payload(F.col("raw"), head, _field(head, "Content-Length", r"([0-9]{1,18})").cast("long")).alias("payload"))
    return rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha256": F.sha2("payload", 256)})


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, at``: where the chain of a file stops before its end: no length, or an end that meets no record."""
    found = candidates(spark, path)
    chain = reachable(found)
    ends = found.select("file", F.col("at").alias("next")).unionByName(found.select("file", F.col("ends").alias("next"))).distinct()
    return found.join(chain, ["file", "at"], "left_semi").join(ends, ["file", "next"], "left_anti").select("file", "at")


def page_records(records: DataFrame, kind: T.DataType | str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from the records of ``write_archives``; a revisit says how long
    its payload is, and its digest."""
    page = lambda urn: F.url_decode(F.regexp_extract(urn, "^<urn:page:(.+)>$", 1))
    number = lambda urn: F.when(F.length(urn) > len("<urn:page:>"), page(F.col(urn))).cast(kind)
    revisit = F.col("type") == "revisit"
    return records.select(number("record_id").alias("page_id"), F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                          F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.col("payload_sha256")).alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", compression: str = "gzip") -> DataFrame:
    """Write ``pages`` as archives below ``path``, read them back and return ``page_records``."""
    write_archives(pages, path, id_col, payload_col, compression=compression)
    return page_records(read_archives(pages.sparkSession, path), pages.schema[id_col].dataType)


#: The same rows by DuckDB.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""
