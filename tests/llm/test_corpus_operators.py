"""The corpus operators against brute force, public libraries and held-out accuracy, on small tables with awkward rows."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import ann, bpe, components, decontaminate, langid, near, pii, quality, repeats, simhash, token_rollup, urls
from tessella.operators import components as tables_of

AWKWARD = [(900, None, "a", "x"), (901, "", None, "x"), (902, "  \n\t ", "b", "x"), (903, "word " * 4000, "b", None), (904, "same text here", "b", "x"), (904, "same text here", "b", "x"), (905, "same text here", None, "y"), (906, "Größe ΑΣ 日本 🙂 " * 20, "c", "z")]
SCHEMA = "doc_id bigint, text string, source string, lang string"
SMALL = "/root/testdata/sf0.001"


def table(spark, rows=None):
    return spark.createDataFrame(AWKWARD if rows is None else rows, SCHEMA)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    return rng, lambda n: " ".join(rng.choice(words) for _ in range(n))


# ---- op1 ----
def brute_repeats(docs, length, keep_first):
    seen = defaultdict(list)
    raws = [(d, i, (t or "").encode()) for i, (d, t) in enumerate(docs)]
    for d, i, b in raws:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((d, i, p))
    out = {}
    for d, i, b in raws:
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            where = seen[b[p : p + length]]
            if len(where) > 1 and (not keep_first or min(where) != (d, i, p)):
                covered[p : p + length] = b"\1" * length
        out[d] = (sum(covered), sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1])), bytes(x for x, c in zip(b, covered) if not c))
    return out


BOUNDS = [(2000, 800_000), (2, 800_000), (2, 900), (2, 1)]


@pytest.mark.parametrize("group_runs,array_bytes", BOUNDS)
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats(spark, prose, group_runs, array_bytes, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "COMMON", 10_000 if array_bytes > 900 else 20)
    rng, text = prose
    passages = [text(rng.randint(30, 80)) for _ in range(5)]
    docs = [(i, text(rng.randint(0, 50)) + " ".join(rng.choice([*passages, text(20), passages[0][:190]]) for _ in range(rng.randint(0, 3)))) for i in range(60)]
    docs += [(200 + i, text(4) + passages[1][20:240] + text(4)) for i in range(20)]  # one passage, each time in another place
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "z" * 199), (104, "z" * 400), (105, "ab" * 300), (106, docs[3][1] + "é")]
    want = brute_repeats(docs, 200, keep_first)
    rows = repeats.find_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), keep_first=keep_first, group_runs=group_runs, array_bytes=array_bytes).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert r.n_removed == sum(s.end - s.start for s in r.spans)


@pytest.mark.parametrize("length", [6, 8, 13, 20])
def test_suffix_order_and_factors(length):
    text = b"banana_bandana_banana_bandana_bandana_bananas"
    n = len(text) - length + 1
    order, classes = repeats.suffix_classes(np.frombuffer(text, np.uint8), np.arange(n), length)
    prefixes = [text[i : i + length] for i in order]
    assert prefixes == sorted(prefixes)
    assert [a != b for a, b in zip(prefixes, prefixes[1:])] == [bool(a != b) for a, b in zip(classes, classes[1:])]
    earlier, later = repeats.earlier_and_later(order, classes, np.arange(n))
    for i in range(n):
        assert earlier[i] == (text.find(text[i : i + length]) < i)
        assert later[i] == (text.rfind(text[i : i + length]) > i)


def test_remove_repeats_keeps_columns(spark):
    out = repeats.remove_repeats(table(spark))
    assert out.columns == ["doc_id", "text", "source", "lang"] and out.count() == len(AWKWARD)
    assert repeats.find_repeats(table(spark, [])).count() == 0
    clash = table(spark).withColumns({"kept": F.lit(1), "spans": F.lit("s"), "k_0": F.lit(2), "unit": F.lit(3), "_order": F.lit(4), "z": F.lit(5)})
    assert repeats.remove_repeats(clash).columns == clash.columns and {(r.kept, r.spans, r.unit) for r in repeats.remove_repeats(clash).collect()} == {(1, "s", 3)}


def test_repeats_with_string_ids_and_a_long_text(spark, prose):
    passage, long = prose[1](80), prose[1](160_000)
    rows = [("b", passage + "x"), ("a", passage + "y"), (None, passage), ("c", long), ("d", "q" * 300_000), ("e", long[500_000:500_300])]
    got = {r.doc_id: r.n_removed for r in repeats.find_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert len(long) > 1 << 19 and got == {"a": 0, "b": len(passage.encode()), None: len(passage.encode()), "c": 0, "d": 299_999, "e": len(rows[5][1].encode())}


@pytest.mark.parametrize("group_runs,array_bytes", BOUNDS)
def test_repeated_rows_are_all_first(spark, prose, group_runs, array_bytes):
    twin = prose[1](80)[:300]
    rows = [(1, twin), (1, twin), (None, twin + "é"), (None, twin + "é"), (5, twin)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), group_runs=group_runs, array_bytes=array_bytes).collect()
    assert sorted(r.text for r in got if r.doc_id == 1) == [twin, twin] and [r.text for r in got if r.doc_id == 5] == [""] and len(got) == 5


# ---- op2 ----
def test_language(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    languages, model = langid.train(docs, F.col("doc_id") % 3 != 0)
    rows = langid.documents_as_rows(docs.unionByName(table(spark), allowMissingColumns=True))
    got = langid.identify(rows, languages, model, ["doc_id", "page_id"])
    truth = docs.filter("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("truth"))
    assert got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("truth")).cast("double"))).first()[0] > 0.95
    assert got.filter("doc_id >= 900").count() == len(AWKWARD)
    assert got.filter("lang IS NULL OR probability > 1.000001").count() == 0
    assert langid.identify(rows, [], np.zeros((0, langid.GRAMS)), ["doc_id"]).filter("lang IS NOT NULL").count() == 0


def test_page_evidence(spark):
    rows = [(1, "http://a.example.de/x", '<html lang="DE-at"><style>p{}</style><p>das ist &amp; <b>so</b></p><script>var x="</p>"</script>'), (2, None, None), (3, "http://b", "<p>x")]
    got = {r.page_id: r for r in langid.pages_as_rows(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].declared == "de" and got[1].suffix == "de" and got[1].domain == "example.de" and got[1]._text.split() == ["das", "ist", "so"]
    assert got[2].declared is None and got[2].suffix is None and got[3].declared is None


# ---- op3 ----
def test_simhash(spark, prose):
    rng, text = prose
    base = text(60)
    docs = [(i, text(rng.randint(0, 40))) for i in range(80)] + [(100 + i, base + " " + text(i % 3)) for i in range(30)]
    rows = [(d, t, None, None) for d, t in docs] + AWKWARD
    got = simhash.near_duplicates(table(spark, rows), tile=7).collect()
    prints = [(r.doc_id, r.fp & (2**64 - 1)) for r in got]
    assert sorted(p for p in prints) == sorted((d, simhash.fingerprint(t) & (2**64 - 1)) for d, t, _, _ in rows)
    parent = {d: d for d, _ in prints}
    before = None
    while before != parent:
        before = dict(parent)
        for d, a in prints:
            for e, b in prints:
                if bin(a ^ b).count("1") <= 3:
                    parent[d] = parent[e] = min(parent[d], parent[e])
    assert {(r.doc_id, r.component_id) for r in got} == {(d, parent[d]) for d in parent}
    kept = simhash.keep_one(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({parent[d] for d in parent}) and kept.columns == ["doc_id", "text", "source", "lang"]


def brute_firsts(docs):
    """Smallest id of each group that pairs at Jaccard similarity 0.8 of five-word shingles join."""
    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, parent = [(d, grams(t)) for d, t in docs], list(range(len(docs)))
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        groups[root(i)].append(d)
    return sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("tile", [512, 3])
def test_near_stage_takes_all_pairs_at_four_fifths(spark, prose, tile, monkeypatch):
    rng, text = prose
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(d, t) for d, t, _, _ in AWKWARD] + [(950, "Same  TEXT\nhere"), (951, "two words"), (952, "other words")]
    for group in range(25):  # copies with more and more words replaced: similarities from 1 down to about 0.5
        words = text(150).split()
        for k in range(8):
            copy = list(words)
            for at in rng.sample(range(150), k):
                copy[at] = f"new{group}x{k}x{at}"
            docs.append((2000 + 10 * group + k, " ".join(copy)))
    base = text(200).split()
    for k in range(60):  # many copies of one text, most of them further from each other than from it
        copy = list(base)
        for at in rng.sample(range(200), rng.randint(2, 6)):
            copy[at] = f"other{k}x{at}"
        docs.append((5000 + k, " ".join(copy)))
    chain = text(120).split()
    for k in range(30):  # each near the one before only
        chain = chain[2:] + [f"link{k}", f"more{k}"]
        docs.append((6000 + k, " ".join(chain)))
    links = near.near_links
    monkeypatch.setattr(near, "near_links", lambda docs, text_col: links(docs, text_col, tile))
    import corpus_pipeline

    df = spark.createDataFrame([(d, t, None, None) for d, t in docs] + [(None, docs[0][1], None, None)], SCHEMA).withColumns({"_unit": F.lit(1), "_id": F.lit(2), "unit": F.lit(3)})
    out = corpus_pipeline.near_duplicate_stage(spark, df, SMALL)
    got = out.collect()
    assert out.columns == df.columns and {(r._unit, r._id, r.unit) for r in got} == {(1, 2, 3)}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == brute_firsts(docs) and sum(r.doc_id is None for r in got) == 1
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), SMALL).count() == 0


def test_near_stage_sends_no_growing_table_out(spark, prose, monkeypatch):
    """Joins go by shuffle, but for the bounded list of very common keys: a table that looks small as files may be too large for the driver."""
    _, text = prose
    sent, write = {}, near.materialize

    def seen(df, name):
        sent[name] = df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
        return write(df, name)

    for module in (near, tables_of):
        monkeypatch.setattr(module, "materialize", seen)
    own = [text(30) for _ in range(12)]
    rows = [(3 * i + k, t, None, None) for i, x in enumerate(own) for k, t in enumerate((x, x, x + " also"))]
    kept = near.keep_one(table(spark, rows))
    assert {"bit_pairs", "near_first", "near_more", "firsts", "pointers"} <= set(sent)
    assert {k for k, n in sent.items() if n} <= {"bit_pairs"} and sent["bit_pairs"] <= 2
    assert kept._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 0
    assert {r.doc_id for r in kept.collect()} == set(range(0, 36, 3))


def test_near_stage_compares_fingerprints(spark, prose, monkeypatch):
    """The stage asks the bit-sliced comparison, which joins all fingerprints within three bits, however many units have one."""
    import corpus_pipeline

    rng, text = prose
    docs = []
    for group in range(6):
        words = text(400).split()
        for k in range(9):  # one to four words replaced
            copy = list(words)
            for at in rng.sample(range(400), k % 5):
                copy[at] = f"new{k}x{at}"
            docs.append((100 * group + k, " ".join(copy)))
    prints = {f"{d:04}".encode(): simhash.majority(near.shingles(t)) for d, t in docs}
    got = near.bit_pairs(spark.createDataFrame(list(prints.items()), "unit binary, fp bigint")).collect()
    label = {u: u for u in prints}
    def root(u):
        while label[u] != u:
            u = label[u]
        return u
    def classes(links):
        label.update({u: u for u in prints})
        for a, b in links:
            label[max(root(a), root(b))] = min(root(a), root(b))
        return {u: root(u) for u in prints}
    want = [(a, b) for a in prints for b in prints if a < b and bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= 3]
    assert want and classes([(bytes(r.a), bytes(r.b)) for r in got]) == classes(want)
    links, asked = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda fps: asked.append(fps) or links(fps))
    df = spark.createDataFrame([(d, t, None, None) for d, t in docs], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, SMALL).collect()) == brute_firsts(docs) and asked


def test_fingerprint_hash_is_sparks(spark):
    assert spark.sql("SELECT xxhash64('ab cd ef') AS h").first().h == simhash.fingerprint("AB cd\tef")


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_sliced_distance(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(6):
        b ^= np.where(rng.random(3000) < 0.5, np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64), np.uint64(0))
    assert (simhash.within_radius(a, b, radius, 700) == (np.bitwise_count(a ^ b) <= radius)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == 100
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- op4 ----
def test_rollups(spark, tmp_path):
    versions = {"words": token_rollup.count_words}
    counts = token_rollup.count_tokens(table(spark), versions)
    log = token_rollup.RollupLog(spark, str(tmp_path / "log"))
    assert log.totals().count() == 0
    assert log.commit("a", token_rollup.inserted(counts)) and not log.commit("a", token_rollup.inserted(counts))
    assert sum(r.docs for r in log.totals().collect()) == len(AWKWARD)
    assert sum(r.tokens for r in log.totals().collect()) == sum(len((t or "").split()) for _, t, _, _ in AWKWARD)
    log.commit("b", token_rollup.deleted(counts.filter("doc_id = 904")))
    after = counts.filter("doc_id = 903").withColumn("n_tokens", F.lit(7).cast("long"))
    log.commit("c", token_rollup.revised(counts.filter("doc_id = 903"), after))
    total = {(r.source, r.lang): (r.docs, r.tokens) for r in log.totals().collect()}
    assert total[("b", None)] == (1, 7) and total[("b", "x")] == (1, 0) and log.batches() == ["a", "b", "c"]
    before = sorted(log.totals().collect(), key=str)
    log.compact()
    assert sorted(log.totals().collect(), key=str) == before and log.batches() == ["a", "b", "c"] and not log.commit("b", token_rollup.deleted(counts))
    assert log.commit("d", token_rollup.inserted(counts)) and sum(r.docs for r in log.totals().collect()) == sum(r.docs for r in before) + len(AWKWARD)
    before = sorted(log.totals().collect(), key=str)
    log.compact()
    assert sorted(log.totals().collect(), key=str) == before and log.batches() == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        log.commit("../x", counts)
    assert token_rollup.count_tokens(table(spark, []), versions).count() == 0


def test_text_parts_keep_counts():
    public = pytest.importorskip("public_tokenizers")
    count = token_rollup.rank_file_counter(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    text = "some words, and more of them 12 34. " * 6000
    whole = token_rollup._encoding(public.path("byte_bpe_50k.tiktoken"), public.PATTERN).encode_ordinary(text)
    assert count([text, ""]) == [len(whole), 0] and len(list(token_rollup.parts(text))) > 1
    assert [len(list(token_rollup.parts(t))) for t in ("", "a b", text)][:2] == [1, 1] and "".join(token_rollup.parts(text)) == text


# ---- op5 ----
def test_urls(spark):
    rows = [(1, "HTTP://A.Example.NET/en/x?q=/#f"), (2, "http://example.net/de/"), (3, "http://notexample.net"), (4, None), (5, "no scheme/"), (6, "x://b.example.com/de/1#a://c/"), (7, "http://z.org/fr/"), (8, "http://"), (9, "http://q.example.com/en/"), (1, "http://net/"), (10, "http://bad.host/1")]
    outcomes = spark.createDataFrame([("bad.host", 1)] * 60 + [("q.example.com", 0)] * 60 + [("other.com", 1)] * 3 + [("other.com", 0)] * 40, "host string, bad int")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), outcomes).collect()}
    assert got[(1, "a.example.net")] == ("/en/x", "example.net/en/", "allow") and got[(2, "example.net")] == ("/de/", "net/", "block")
    assert got[(3, "notexample.net")][:2] == ("", None) and got[(4, "")][:2] == ("", None) and got[(5, "")][:2] == ("", None) and got[(8, "")][:2] == ("", None)
    assert got[(6, "b.example.com")] == ("/de/1", "example.com/de/", "block") and got[(7, "z.org")] == ("/fr/", "org/fr/", "allow")
    assert got[(9, "q.example.com")] == ("/en/", None, "allow") and got[(10, "bad.host")] == ("/1", None, "block") and len(got) == len(rows)
    nothing = spark.createDataFrame([], "host string, bad int")
    assert {r.verdict for r in urls.judge(spark.createDataFrame(rows[8:], "page_id bigint, url string"), nothing).collect()} == {"allow", "block"}
    clash = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({c: F.lit(c) for c in ("_host", "_path", "host", "path", "verdict", "row", "_n", "_salt")})
    kept = urls.filter_pages(clash, outcomes)
    assert kept.columns == clash.columns and kept.filter("page_id IN (2, 6, 10) OR _host <> '_host' OR verdict <> 'verdict'").count() == 0 and kept.count() == 7
    assert urls.filter_pages(clash.limit(0), outcomes).count() == 0 and urls.judge(clash.select("page_id", "url").limit(0), nothing).count() == 0


def test_registered_domains(spark):
    hosts = ["a.example.com", "example.com", "www.bbc.co.uk", "co.uk", "x.y.ac.jp", "localhost", "", "a.com.example"]
    got = [r.d for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(urls.domain_of(F.col("h")).alias("d")).collect()]
    assert got == ["example.com", "example.com", "bbc.co.uk", "co.uk", "y.ac.jp", "localhost", "", "com.example"]


def test_reputation_blocks_by_host_and_domain(spark):
    """The method decides, not the rules: bad hosts go, their siblings without pages follow the domain, rare hosts are shrunk."""
    outcomes = [(f"h{i}.bad.example", 1) for i in range(6) for _ in range(30)] + [(f"h{i}.good.example", int(k == 0)) for i in range(20) for k in range(30)] + [("rare.good.example", 1)]
    pages = spark.createDataFrame([(1, "http://h1.bad.example/x"), (2, "http://new.bad.example/"), (3, "http://h1.good.example/x"), (4, "http://rare.good.example/"), (5, "http://elsewhere.example/")], "page_id bigint, url string")
    got = {r.page_id: (r.verdict, r.rule) for r in urls.judge(pages, spark.createDataFrame(outcomes, "host string, bad int")).collect()}
    assert got == {1: ("block", None), 2: ("block", None), 3: ("allow", None), 4: ("allow", None), 5: ("allow", None)}


# ---- op6 ----
def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels, keep=lambda i: i % 3 != 0)
    scored = quality.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert ((scored.score >= quality.CUT) == (scored.quality == 1)).mean() > 0.95
    rows = quality.score(table(spark), model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(table(spark), model).columns == ["doc_id", "text", "source", "lang"]
    twice = quality.train(docs.unionByName(docs), labels, keep=lambda i: i % 3 != 0)
    assert np.allclose(twice.weights, model.weights)  # rows repeated under one id are learnt from once
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(table(spark), empty).collect()} == {0.5}


def test_quality_threshold_covers_all_labels(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels, max_labelled=20)  # far fewer than there are
    rows = docs.join(labels, "doc_id").select("text", "quality").toPandas()
    strength = model.strength(np.array([quality.features(t) for t in rows.text], float))
    want = np.quantile(strength, (rows.quality == 0).mean())
    assert (rows.quality == 0).sum() > 20 and abs(model.threshold - want) < 1e-9
    assert abs(model.slope - 3 / np.median(np.abs(strength - want))) < 1e-6 * model.slope
    monkeypatch.setattr(quality, "FEW", 5)
    values = [0.5] * 30 + [-1e9, 1e-9, 2e-9, 3.0, 1e12] + np.random.default_rng(1).normal(size=60).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [quality.quantile(df, "v", len(values), q) for q in (0, 0.3, 0.77, 1)] == pytest.approx(np.quantile(values, (0, 0.3, 0.77, 1)).tolist(), rel=1e-12)


# ---- op7 ----
def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[50:90] = x[0]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [1.0] * 3), (1100, [None] * 16), (None, [1.0] * 16)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), lambda i: i % 50 == 0, shard=200).collect()
    y = x.astype(float)
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 50)) and all(len(v) == 10 for v in found.values())
    hit = 0
    for q, near in found.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort([np.arange(600), d])[:10]
        hit += len({v for v, _ in near} & set(want.tolist()))
        assert all(abs(s - d[v]) < 1e-9 for v, s in near) and near == sorted(near, key=lambda p: (p[1], p[0]))
    assert hit / (10 * len(found)) >= 0.95
    assert [v for v, _ in found[0]] == list(range(50, 60))
    clash = spark.createDataFrame(rows[:100], "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "v", "n", "shard", "score")})
    assert ann.nearest(clash, lambda i: i == 0, k=3).select("vec_id").collect() == [(50,), (51,), (52,)]
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>"), lambda i: i == 0).collect()
    assert len(few) == 2
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<float>"), lambda i: i == 0).count() == 0


# ---- op8 ----
@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    return path, tokenizers.Tokenizer.from_file(path), bpe.Transducer(path)


def test_bpe_like_the_library(tokenizer, monkeypatch):
    _, library, own = tokenizer
    rng = random.Random(1)
    texts = ["Hello world's it'LL I’M <|endoftext|>foo<|startoftext|>", "naïve Ça ΑΣ ΣΑΣ İ ½²³Ⅷ 日本語 é a\xa0b a\x85b a\x1cb", "", "'s''s'ss 123 4.5%$ ##a", "in" * 500, "don't <|endoftext|"]
    texts += ["".join(rng.choice("inthanerstcoaleu") for _ in range(rng.randint(100, 700))) for _ in range(30)]
    texts += ["".join(rng.choice("aAbEé .'s0́Σß<|\n日x!?\x1f\x00\t") for _ in range(60)) for _ in range(200)]
    for piece in (bpe.PIECE, 7):
        monkeypatch.setattr(bpe, "PIECE", piece)
        monkeypatch.setattr(bpe, "TOKENS", piece)
        for text in texts:
            want = library.encode(text, add_special_tokens=False).ids
            ids = own.render(text)
            assert ids == " ".join(map(str, want))
            assert "".join(bpe.decode_stream(ids, own.spelled)).removesuffix(" ") == library.decode(want, skip_special_tokens=False)


def test_every_word_streams(tokenizer):
    """Tokens come out as soon as their rules are decided, whatever the window; what is held stays bounded."""
    path, library, own = tokenizer
    rng = random.Random(2)
    small, held = bpe.Transducer(path, window=8), []
    merge = small._merge
    small._merge = lambda ids: held.append(len(ids)) or merge(ids)
    for k in range(200):
        letters = ["in", "the", "an", "er", "st", "x", "q", "é", "日"] if k % 2 else list("aeionst") + ["!", "?"][: k % 3]
        word = "".join(rng.choice(letters) for _ in range(rng.choice([3, 20, 60, 300])))
        for part in own._split(word):
            assert list(small.word(part.encode())) == library.encode(part, add_special_tokens=False).ids
    assert max(held) <= 2 * own.lookahead and sorted(held)[len(held) // 2] <= 64
    assert own.lookahead >= max(map(len, own.vocabulary)) - len(own.suffix)


def test_a_word_of_a_megabyte(tokenizer):
    _, library, own = tokenizer
    rng = random.Random(5)
    word = "".join(rng.choice(["in", "the", "an", "er", "st", "zq"]) for _ in range(480_000))
    held, merge = [], own._merge
    own._merge = lambda ids: held.append(len(ids)) or merge(ids)
    try:
        assert own.encode(word) == library.encode(word, add_special_tokens=False).ids
    finally:
        del own._merge
    assert len(word) > 1_000_000 and max(held) <= 2 * own.lookahead


def test_tokens_leave_before_the_word_ends(tokenizer):
    """More than half of the words of more than one token have given one before their end is read; states may be forgotten at any time."""
    path, library, own = tokenizer
    few = bpe.Transducer(path, states=20)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    several = early = 0
    for text in texts[:300]:
        ids = own.render(text)
        assert ids == " ".join(map(str, library.encode(text or "", add_special_tokens=False).ids))
        for word in {w for part in own.words(text or "") for w in part}:
            state, before = own._start, 0
            for byte in word.encode():
                state, ids = own.step(state, byte)
                before += len(ids.split())
            rest = own.step(state, bpe.END)[1].split()
            several += before + len(rest) > 1
            early += before > 0
            assert len(rest) > 0 and len(state[bpe.READ]) <= own.lookahead
    assert several > 5000 and early > several / 2
    for text in texts[:20]:
        assert few.render(text) == own.render(text) and len(few._states) <= 20


def test_stable_tokens_never_change(tokenizer):
    """Whatever follows, the ids that are out stay the first ones of the word."""
    _, library, own = tokenizer
    rng = random.Random(12)
    for k in range(300):
        word = "".join(rng.choice("inthanerstcoaleu" if k % 2 else "aabé") for _ in range(rng.randint(1, 40)))
        state, out = own._start, []
        for at, byte in enumerate(word.encode()):
            state, ids = own.step(state, byte)
            out += map(int, ids.split())
            if out and word.isascii():
                for tail in ("", "n", "ing", "".join(rng.choice("inthanerst") for _ in range(9))):
                    assert library.encode(word[: at + 1] + tail, add_special_tokens=False).ids[: len(out)] == out
    once = bpe.Transducer(own_path(), window=0)  # nothing remembered: each byte is decided anew
    assert once.render("in" * 400 + " tokenization") == own.render("in" * 400 + " tokenization") and not once._states


def own_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_round_trip(spark, tokenizer):
    path, _, own = tokenizer
    coded = bpe.encode(table(spark).withColumns({"ids": F.lit("no ids"), "decoded": F.lit(1)}), path)
    assert coded.count() == len(AWKWARD) and bpe.encode(table(spark, []), path).count() == 0
    for form in ("readable", "spelled"):
        assert sorted(bpe.encode(table(spark), path, form=form).collect(), key=str) == sorted(bpe.decode(bpe.encode(table(spark), path), path, form).collect(), key=str)
    back = bpe.decode(coded, path)
    assert back.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    bare = lambda t: re.sub(r"\s+", "", (t or "").replace("Σ", "σ").lower())
    texts = {r.doc_id: r.decoded for r in back.collect()}
    assert all(bare(texts[d]) == bare(t) for d, t, _, _ in AWKWARD)
    pieces = list(bpe.decode_stream(own.render("größe 日本"), own.readable))
    assert "".join(pieces) == "größe 日本 " and all("\ufffd" not in p for p in pieces)


# ---- op9 ----
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), i, m.end(), kind))
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(3)
    parts = ["a", "b", "@", ".", "1", "29", "255", "256", "00", "+", " ", "-", "(", ")", "é", "🙂", "_", "%", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "+1 (017) 555-7713"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(1500)] + ["a" * 50000, "1" * 50000, "1 " * 20000, "a@" + "a." * 20000]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for i, text in enumerate(texts):
        assert [(s.start, s.kind_no, s.end, s.kind) for s in got[i] if s.kind != "term"] == brute_spans(text), text[:80]


def test_disclosing_terms(spark):
    rng = random.Random(8)
    filler = lambda: " ".join(rng.choice(["one", "two", "six", "red", "sun", "sea"]) for _ in range(6))
    docs = [(i, f"{filler()} nickname Zorblax {filler()} zor@mail.example {filler()}") for i in range(6)] + [(10 + i, filler() + (" nickname" if i % 2 else "")) for i in range(60)]
    docs += [(100 + i, "copied words about quux quux@mail.example here") for i in range(5)] + [(None, "x zor@mail.example"), (200, None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = pii.find(df).collect()
    assert len(got) == len(docs)
    words = {(r.doc_id, s.value) for r in got for s in r.spans if s.kind == "term"}
    assert {(i, "Zorblax") for i in range(6)} <= words and not any(d is not None and d >= 10 for d, _ in words) and not any(w == "nickname" for _, w in words)
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert "Zorblax" not in clean[0] and "[term]" in clean[0] and "[email]" in clean[0] and clean[10] == docs[6][1] and clean[200] is None


def test_terms_far_from_the_value(spark):
    rng = random.Random(9)
    filler = lambda n: " ".join(rng.choice(["one", "two", "six", "red", "sun", "sea"]) for _ in range(n))
    docs = [(i, f"Dear Quuxley or 李 of B2x7, {filler(150)} write to zor@mail.example") for i in range(6)] + [(10 + i, filler(30)) for i in range(60)]
    docs += [(100 + i, f"copied plugh {'sun ' * 100} quux@mail.example") for i in range(5)]  # copies prove nothing
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = {(i, w) for i in range(6) for w in ("Dear", "Quuxley", "or", "李", "of", "B2x7", "write", "to")}
    got = {(r.doc_id, s.value) for r in pii.find(df).collect() for s in r.spans if s.kind == "term"}
    assert {(i, w) for i in range(6) for w in ("Quuxley", "or", "李", "of", "B2x7", "write")} - got == set(), got
    assert got <= want
    private = pii.with_base_spans(df.withColumn("_text", F.col("text")), "_text").filter("size(_spans) > 0").withColumn("_row", F.col("doc_id"))
    row = {r.term: r for r in pii.disclosures(df, private)[0].collect()}["write"]
    assert (row.n_together, row.n_term, row.n_entity) == (6, 6, 6)


def test_disclosure_counts(spark):
    """All counts by document and the set of disclosing terms, against counting in Python; values and terms repeat inside documents."""
    rng = random.Random(12)
    people = [f"p{i}@mail.example" for i in range(6)]
    nicknames = {p: f"nick{i}" for i, p in enumerate(people)}
    docs = []
    for i in range(240):
        words = [rng.choice(["one", "two", "six", "red", "sun", "sea"] + [f"rare{i}{k}" for k in range(3)]) for _ in range(rng.randint(3, 12))]
        for p in rng.sample(people, rng.choice([0, 0, 1, 1, 2])):
            words.insert(rng.randint(0, len(words)), p)
            if rng.random() < 0.4:
                words.insert(rng.randint(0, len(words)), p)
            if rng.random() < 0.8:
                words += [nicknames[p]] * rng.randint(1, 3)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    private = pii.with_base_spans(df.withColumn("_text", F.col("text")), "_text").filter("size(_spans) > 0").withColumn("_row", F.col("doc_id"))
    got = {(r.entity, r.term): (r.n_together, r.n_term, r.n_entity) for r in pii.disclosures(df, private, support=1)[0].collect()}
    tokens = {i: set(re.split(r"[\W_]+", t.lower())) for i, t in docs}
    holds = {p: [i for i, t in docs if p in t] for p in people}
    outside = {i: set(re.split(r"[\W_]+", re.sub("|".join(map(re.escape, people)), " ", t).lower())) - {""} for i, t in docs}
    want, n = {}, len(docs)
    for p in people:
        for term in set().union(*(outside[i] for i in holds[p])):
            together, alone = sum(term in outside[i] for i in holds[p]), sum(term in tokens[i] for i, _ in docs)
            if np.log2(together * n / (alone * len(holds[p]))) >= pii.ALPHA * np.log2(n / len(holds[p])) - 1e-12:
                want[(p, term)] = (together, alone, len(holds[p]))
    assert got == want and set(nicknames.items()) <= set(want)
    spans = {r.doc_id: {(s.start, s.end, s.value) for s in r.spans if s.kind == "term"} for r in pii.find(df).collect()}
    strong = {(r.entity, r.term) for r in pii.disclosures(df, private)[0].collect()}
    for i, t in docs:
        inside = [m.span() for p in people for m in re.finditer(re.escape(p), t)]
        terms = {term for p in people if p in t for e, term in strong if e == p}
        assert spans[i] == {(*m.span(), m[0]) for m in re.finditer(r"[^\W_]+", t) if m[0].lower() in terms and not any(a < m.end() and m.start() < b for a, b in inside)}


def test_redact_keeps_columns_of_any_name(spark):
    text = "write to zor@mail.example, +45 12 34 56 78 90 or 10.0.0.1"
    rows = [(1, text, "a", "x"), (1, text, "a", "x"), (None, text, None, None), *AWKWARD]
    df = table(spark, rows).withColumns({c: F.lit(c) for c in ("_spans", "_hits_email", "_key", "_terms", "_row", "_own", "kind", "term")})
    out = pii.redact(df)
    got = out.collect()
    assert out.columns == df.columns and len(got) == len(rows) and all(r._spans == "_spans" and r._own == "_own" and r.term == "term" for r in got)
    assert [r.text for r in got if r.doc_id in (1, None)] == ["write to [email], [phone] or [ip]"] * 3
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id and r.doc_id >= 900 and r.text) == sorted((d, t) for d, t, _, _ in AWKWARD if t)
    assert [r.text for r in got if r.doc_id == 900] == [None] and pii.redact(table(spark, [])).count() == 0 and pii.find(table(spark, [])).count() == 0


# ---- op10 ----
def brute_hits(text, items, window=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, item_text in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item_text or ""))
        k = min(window, len(own))
        for a in range(len(own) - k + 1 if own else 0):
            for p in range(len(words) - k + 1):
                if words[p : p + k] == own[a : a + k]:
                    hit |= set(range(p, p + k))
                    found.add(item)
    return len(words), len(hit), sorted(found, key=str)


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("block", [16_000_000, 300])
def test_decontamination(spark, prose, block, kind):
    rng, text = prose
    items = [(i, text(rng.choice([3, 9, 10, 14, 40]))) for i in range(20)] + [(20, None), (21, "..."), (3, "Ab cd"), (1000, text(12)), (None, text(11))]
    docs = [(i, text(rng.randint(0, 60)) + " " + (items[rng.randint(0, 19)][1].upper() if i % 2 else "") + "; " + text(5), None, None) for i in range(40)] + AWKWARD
    docs += [(800, items[-1][1], None, None), (801, text(60_000) + " " + items[4][1] + " " + text(60_000), None, None)]
    name = (lambda i: i) if kind == "bigint" else (lambda i: i if i is None else f"item {i}")
    bench = spark.createDataFrame([(name(i), t) for i, t in items], f"item_id {kind}, text string")
    df = table(spark, docs).withColumns({"_text": F.lit(1), "hit": F.lit(2), "item_ids": F.lit(3)})
    got = decontaminate.annotate(df, bench, block_chars=block).collect()
    want = defaultdict(set)
    for d, t, _, _ in docs:
        n, h, f = brute_hits(t, items) if d != 801 else (120_000 + len(items[4][1].split()), None, None)
        want[d].add((n, h, tuple(sorted((name(i) for i in f or () if i is not None), key=str))))
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id == 801:
            assert 4 in {int(str(i).removeprefix("item ")) for i in r.item_ids} and r.n_hit >= len(items[4][1].split())
            continue
        assert (r.n_words, r.n_hit, tuple(r.item_ids)) in want[r.doc_id]
        assert (r.n_hit > 0) == bool(r.matches)
    kept = decontaminate.remove_contaminated(df, bench, block_chars=block)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, t, _, _ in docs if d != 801 and not brute_hits(t, items)[1])
    assert decontaminate.annotate(table(spark, docs[:3]), spark.createDataFrame([], "item_id bigint, text string")).count() == 3
    assert decontaminate.annotate(table(spark, []), bench).count() == 0


def test_longest_matches(spark, prose):
    """Every maximal common word sequence of a window at least, with its places, against all pairs of positions."""
    rng, text = prose
    items = [(i, text(rng.randint(12, 40))) for i in range(6)]
    docs = []
    for i in range(12):
        own = items[i % 6][1].split()
        at = rng.randint(0, len(own) - 12)
        docs.append((i, f"{text(8)} {' '.join(own[at : at + rng.randint(8, 40)])} {text(8)} {items[(i + 1) % 6][1]}"))
    got = {r.doc_id: {(m.item_id, m.item_word, m.doc_word, m.n_words) for m in r.matches} for r in decontaminate.annotate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for d, t in docs:
        a, want = decontaminate.words(t), set()
        for item, item_text in items:
            b = decontaminate.words(item_text)
            for p in range(len(a)):
                for q in range(len(b)):
                    if a[p] == b[q] and (p == 0 or q == 0 or a[p - 1] != b[q - 1]):
                        n = next((n for n in range(len(b)) if p + n >= len(a) or q + n >= len(b) or a[p + n] != b[q + n]), min(len(a) - p, len(b) - q))
                        if n >= 10:
                            want.add((item, q, p, n))
        assert got[d] == want
