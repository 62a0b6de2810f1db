"""Archives: round trips, magic inside payloads at every split size, broken chains."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from tessella.llm import queries, warc

SCHEMA = "page_id long, url string, html string"
FAKE = f"{warc.MAGIC}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def hostile_pages():
    rng = random.Random(5)
    bits = [warc.MAGIC, "\r\n\r\n", "\r\n", "WARC/1.0\r", "Content-Length: 5\r\n\r\nabcde\r\n\r\n", "x" * 30, "é", "WARC-Type: response\r\n"]
    pages = [(i, f"http://a/ {i}\r\n" if i % 7 else None, "".join(rng.choice(bits) for _ in range(rng.randrange(12))) if i % 11 else None) for i in range(40)]
    pages += [(1000, "u", FAKE * 5), (1001, "u", FAKE[:-4]), (1002, "u", FAKE * 5), (1003, "u", "line\n" * 250_000)]
    pages += [(1004, "u", "z" * 100), (1005, "u", "z" * 100), (None, "u", "z" * 100), (1004, "u", "z" * 100), (1006, "u", "y" * 99), (1007, "u", "y" * 99), (None, None, None)]
    return pages


def brute(pages):
    by = defaultdict(list)
    for i, _, html in pages:
        by[html or ""].append(i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = min((x for x in by[html or ""] if x is not None), default=None) if len(raw) >= 100 else None
        again = first is not None and first != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.fixture
def split(spark):
    """Sets the size of the pieces in which files are read."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, "0"))]
    for n in names:
        spark.conf.unset(n)


@pytest.mark.parametrize(("size", "compression"), [("3001", "none"), ("64k", "none"), ("128m", "gzip")])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, split, size, compression):
    pages = hostile_pages()
    if size == "3001":
        pages = [p for p in pages if p[0] != 1003]
    split(size)
    path = str(tmp_path / "w")
    got = warc.archive_round_trip(spark.createDataFrame(pages, SCHEMA).repartition(3), path, compression=compression)
    assert sorted(map(tuple, got.collect()), key=str) == brute(pages)
    records = warc.read_archives(spark, path, payload=True).filter("type = 'response'").collect()
    assert sorted(hashlib.sha256(r.payload).hexdigest() for r in records) == sorted(digest for _, _, digest, kind, _ in brute(pages) if kind == "response")
    assert all(r.payload_bytes == len(r.payload) for r in records)
    assert not any(set("\r\n ") & set(r.target_uri or "") for r in records)
    assert warc.broken_files(spark, path).isEmpty()


def test_broken_chains(spark, tmp_path):
    record = lambda body, n: f"{warc.MAGIC}WARC-Type: resource\r\nContent-Length: {n}\r\n\r\n{body}{warc.BLANK}"
    files = {"whole": record("abc", 3) + record("", 0), "short": record("abc", 3) + record("abc", 99) + record("d", 1), "garbage": "no archive", "none": f"{warc.MAGIC}Content-Length: 9", "cut": record("abc", 3) + record("abcdef", 6)[:-5]}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.payload_bytes) for r in rows) == [("cut", 3), ("short", 3), ("whole", 0), ("whole", 3)]
    broken = {(r.file.rsplit("/", 1)[1], r["at"]) for r in warc.broken_files(spark, str(tmp_path)).collect()}
    assert broken == {("short", len(record("abc", 3))), ("none", 0), ("cut", len(record("abc", 3)))}


def test_awkward_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.archive_round_trip(none, str(tmp_path / "none")).count() == 0
    extra = spark.createDataFrame([("b", "t" * 200, 1, 2), ("a<\r\n>ü", "t" * 200, 3, 4), ("c", None, 5, 6)], "page_id string, html string, _payload int, file int")
    got = sorted(map(tuple, warc.archive_round_trip(extra, str(tmp_path / "extra")).collect()))
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [("a<\r\n>ü", 200, "response", None), ("b", 200, "revisit", "a<\r\n>ü"), ("c", 0, "response", None)]


def test_query_against_sql(spark):
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{small}/pages.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLE_SQL['op13_warc']}) ORDER BY 1").fetchall()
    assert list(map(tuple, queries.op13_warc(spark, small).select(*names.split(", ")).orderBy("page_id").collect())) == want
