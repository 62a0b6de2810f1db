"""Collocations against counting all phrases, the parse against its definition."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tessella.llm import phrases, queries


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\n\v\f\r]", low)]


def brute(docs, least, top, longest=5, inside=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            for k in range(1, longest + 1):
                f[lang].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= least}
        rows = []
        for p, a in found.items():
            holds = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023,E731
            if len(p) < 2 or any(holds(q) and 100 * b >= inside * a for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def prose(seed=3):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "ä", "Éa", "x" * 300, "\x00", " ", "日本", "w"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" "] * 9 + [" \t ", ". ", ",", "\n", "?! "]) for _ in range(n))
    docs = [(text(rng.randrange(60)), rng.choice(["en", "de", None, ""])) for _ in range(60)]
    return docs + docs[:20] + [(docs[0][0] + docs[1][0], "en"), (None, "en"), ("", None), ("a " * 5000, "en"), ("a\tb " * 3000 + ".", "de"), (" ,. \n", "fr"), ("one", "fr")]


@pytest.mark.parametrize(("least", "period", "longest", "top"), [(3, 2, 5, 2000), (8, 16, 5, 7), (2, 1, 3, 2000)])
def test_against_counting(spark, least, period, longest, top):
    docs = prose()
    got = phrases.collocations(spark.createDataFrame(docs, "text string, lang string").repartition(3), least=least, period=period, longest=longest, top=top)
    want = brute(docs, least, top, longest)
    assert len(want) > 15 and sorted(map(tuple, got.collect())) == want


def test_inside_share(spark):
    docs = [("a b c", "en")] * 9 + [("a b", "en")] * 1 + [("b d", "en")] * 5
    frame = spark.createDataFrame(docs, "text string, lang string")
    frequent = phrases.frequent_phrases(phrases.dictionary(frame), least=2)
    inside = lambda share: {r.phrase for r in phrases.outside(frequent, share).collect()} - {"a", "b", "c", "d"}
    assert inside(100) == {"b c"} and inside(90) == {"a b", "b c"}


def chunk_words(texts, period):
    data, offsets, last, text_of = phrases.parse([t.encode() for t in texts], period)
    raw = data.tobytes()
    return [(raw[a:b].decode().split(" ")[:-1], e, i) for a, b, e, i in zip(offsets, offsets[1:], last, text_of)]


def test_parse_counts_every_start_once():
    texts = [t or "" for t, _ in prose()]
    for period in (1, 3, 16):
        starts = defaultdict(list)
        for words, last, i in chunk_words(texts, period):
            own = len(words) if last else len(words) - 4
            assert own > 0
            starts[i] += [tuple(words[j : j + 5]) for j in range(own)]
        for i, t in enumerate(texts):
            assert starts[i] == [tuple(p[j : j + 5]) for p in pieces(t) for j in range(len(p))]


def test_chunks_follow_content():
    """A passage gives the same chunks wherever it stands, but for those at its ends."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    passage = " ".join(word() for _ in range(2000))
    a, b = (chunk_words([" ".join(word() for _ in range(100)) + " " + passage + " " + word()], 16) for _ in range(2))
    shared = {tuple(w) for w, _, _ in a} & {tuple(w) for w, _, _ in b}
    assert sum(len(w) - 4 for w in shared) > 1800 and max(len(w) for w in shared) < 300


def test_word_hashes_differ():
    words = list({bytes(np.random.default_rng(i).integers(97, 100, i % 9 + 1, np.uint8)) for i in range(4000)})
    words += [b"a" * 300, b"a" * 299 + b"b", b"a" * 299]
    raw = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(raw == 32)[:-1] + 1])
    for seed in (0, 1):
        assert len(set(phrases.word_hashes(raw, starts, seed).tolist())) == len(words)


def test_bitmap_holds_its_hashes(spark):
    h = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 5000)
    bitmap = phrases.bitmap_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert phrases._passes(bitmap, h.view(np.uint64)).all()
    others = np.random.default_rng(5).integers(0, 1 << 63, 5000).view(np.uint64)
    assert phrases._passes(bitmap, others).mean() < 0.15


def test_awkward_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0
    clash = spark.createDataFrame([("a b " * 200, 7, "x", 1)] * 2, "text string, lang int, phrase string, times int")
    assert sorted(map(tuple, phrases.collocations(clash).collect())) == brute([("a b " * 200, "7")] * 2, 100, 2000)


def test_query_against_sql(spark):
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.ORACLE_SQL['op11_phrases']}) ORDER BY 1, 2").fetchall()
    assert len(want) > 10 and list(map(tuple, queries.op11_phrases(spark, small).orderBy("lang", "rank").collect())) == want
