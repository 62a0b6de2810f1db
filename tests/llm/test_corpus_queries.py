"""The registered corpus queries: contract digests, SQL where there is some, and the pipeline against its parts."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_firsts, brute_repeats, brute_spans

import corpus_pipeline
from tessella.llm import decontaminate, langid, pii, quality, queries, simhash
from tessella.llm.common import read

SMALL = "/root/testdata/sf0.001"


def test_url_filter_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "labels", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    want = sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op5_url_filter']})").fetchall(), key=str)
    assert sorted(map(tuple, queries.op5_url_filter(spark, "/root/testdata/sf0.01").select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want


def texts_of(spark):
    return {r.doc_id: r.text for r in read(spark, SMALL, "documents").collect()}


def test_op1_against_brute_force(spark):
    texts = texts_of(spark)
    want = brute_repeats(list(texts.items()), 200, False)
    rows = queries.op1_repeats(spark, SMALL).collect()
    assert len(rows) == len(texts) and sum(r.n_removed > 0 for r in rows) > 10
    for r in rows:
        removed, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len((texts[r.doc_id] or "").encode()), removed, spans, hashlib.sha256(kept).hexdigest())


def test_op2_against_counting(spark):
    """The fusion written out row by row: tempered likelihoods, counts without the page itself, host shrunk to domain to everything."""
    docs = read(spark, SMALL, "documents")
    languages, model = langid.train(docs, queries._learnable(F.col("doc_id")))
    rows = langid.pages_as_rows(read(spark, SMALL, "pages")).unionByName(langid.documents_as_rows(docs)).collect()
    loglik = langid.text_likelihoods([r._text for r in rows], model)
    best, k = loglik.argmax(1), len(languages)
    counts = {key: defaultdict(lambda: np.zeros(k)) for key in ("declared", "suffix", "domain", "host")}
    for r, i in zip(rows, best):
        for key, by in counts.items():
            if r[key] is not None:
                by[r[key]][i] += 1
    everything = np.bincount(best, minlength=k) + 1.0
    got = {(r.doc_id, r.page_id): r for r in queries.op2_language(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r, ll, i in zip(rows, loglik, best):
        own = np.eye(k)[i]
        less = lambda key: np.maximum(counts[key][r[key]] - own, 0) if r[key] is not None else np.zeros(k)
        p = everything / everything.sum()
        for key in ("domain", "host"):
            p = less(key) + langid.PRIOR_PAGES * p
            p /= p.sum()
        score = ll + np.log(p)
        for key in ("declared", "suffix"):
            if r[key] is not None:
                score = score + np.log((less(key) + 0.5) / (everything + k))
        mine = got[(r.doc_id, r.page_id)]
        assert mine.text_lang == languages[i] and mine.lang == languages[int(score.argmax())]
        assert abs(mine.probability - 1 / np.exp(score - score.max()).sum()) < 1e-9
    labelled = {r.doc_id: r.lang for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang}
    assert np.mean([got[(d, None)].lang == lang for d, lang in labelled.items()]) > 0.95


def test_op3_against_all_pairs(spark):
    texts = texts_of(spark)
    prints = {d: simhash.fingerprint(t) & (2**64 - 1) for d, t in texts.items()}
    parent, before = {d: d for d in prints}, None
    while before != parent:
        before = dict(parent)
        for d, a in prints.items():
            for e, b in prints.items():
                if (a ^ b).bit_count() <= 3:
                    parent[d] = parent[e] = min(parent[d], parent[e])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, SMALL).collect()} == {(d, f"{p:016x}", parent[d]) for d, p in prints.items()}


def test_op4_against_the_final_state(spark):
    """Totals equal those of the documents as they are in the end, counted whole with the public encoder."""
    public, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("x", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    labels = read(spark, SMALL, "labels").collect()
    toxic, poor = {r.doc_id for r in labels if r.toxic == 1}, {r.doc_id for r in labels if r.quality == 0}
    docs, tokens, revised = Counter(), Counter(), 0
    for r in read(spark, SMALL, "documents").collect():
        if r.doc_id in toxic:
            continue
        text = r.text or ""
        if r.doc_id in poor:
            text, before = "\n".join(dict.fromkeys(text.split("\n"))), text
            revised += text != before
        for version, n in (("words", len(text.split())), ("byte_bpe_50k", len(encoding.encode_ordinary(text)))):
            docs[(r.source, r.lang, version)] += 1
            tokens[(r.source, r.lang, version)] += n
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in queries.op4_token_counts(spark, SMALL).collect()}
    assert revised and toxic and got == {k: (docs[k], tokens[k]) for k in docs}


def test_op5_columns(spark):
    rows = queries.op5_url_filter(spark, SMALL).collect()
    assert len(rows) == read(spark, SMALL, "pages").count() and {r.verdict for r in rows} == {"allow", "block"}


def test_op6_against_its_model(spark):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    texts, labelled = texts_of(spark), {r.doc_id: r.quality for r in labels.collect()}
    learnt = {d: q for d, q in labelled.items() if d in texts and zlib.crc32(str(d).encode()) % 5}
    rows = {r.doc_id: r for r in queries.op6_quality(spark, SMALL).collect()}
    x = {d: quality.features(t) for d, t in texts.items()}
    order = sorted(learnt, key=lambda d: (learnt[d], *x[d]))
    model = quality.fit(np.array([x[d] for d in order]), np.array([learnt[d] == 1 for d in order]))
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
        assert abs(r.score - model.score(np.array([x[d]]))[0]) < 1e-6
    other = quality.train(docs.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")}), labels.withColumn("quality", F.when(queries._learnable(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality"))), keep=queries._learnable)
    assert {r.doc_id: r.score for r in quality.score(docs, other).collect()} == pytest.approx({d: r.score for d, r in rows.items()}, abs=1e-9)
    held = [(labelled[d], r.predicted) for d, r in rows.items() if r.held_out and d in labelled]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_op7_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = read(spark, path, "embeddings").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(list)
    for r in queries.op7_neighbours(spark, path).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == {int(i) for i in ids if i % 100 == 0}
    hits = 0
    for q, near in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hits += len({v for _, v, _ in near} & set(ids[np.lexsort([ids, d])[:10]].tolist()))
        assert [r for r, _, _ in near] == list(range(1, 11)) and all(abs(s - d[ids == v][0]) < 1e-9 for _, v, s in near) and [(s, v) for _, v, s in near] == sorted((s, v) for _, v, s in near)
    assert hits / (10 * len(found)) >= 0.9


def test_op9_against_brute_force(spark):
    texts = texts_of(spark)
    terms = {r.doc_id: [(s.start, 4, s.end, "term") for s in r.spans if s.kind == "term"] for r in pii.find(read(spark, SMALL, "documents")).collect()}
    rows = queries.op9_pii(spark, SMALL).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 5
    for r in rows:
        base = brute_spans(texts[r.doc_id] or "")
        line = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and r.spans == line(sorted(base + terms[r.doc_id]))


def item_windows(spark):
    out = {}
    for r in read(spark, SMALL, "benchmark").collect():
        w = decontaminate.words(r.text)
        for i in range(max(1, len(w) - 9) if w else 0):
            out.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    return out


def hit_words(text, windows):
    w, hit, items = decontaminate.words(text), set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if (found := windows.get(tuple(w[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                items |= found
    return len(w), hit, items


def test_op10_against_brute_force(spark):
    texts, windows = texts_of(spark), item_windows(spark)
    rows = queries.op10_decontaminate(spark, SMALL).collect()
    assert len(rows) == len(texts) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, items = hit_words(texts[r.doc_id], windows)
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(items), digest, bool(hit))


def test_token_digests(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in read(spark, SMALL, "documents").collect()}
    for r in queries.op8_bpe(spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_against_brute_force(spark):
    """All five stages over: scores of the model, all pairs of shingle sets, all benchmark windows, spans from plain patterns, the public tokenizer."""
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    docs, texts, windows = read(spark, SMALL, "documents"), texts_of(spark), item_windows(spark)
    model = quality.train(docs, read(spark, SMALL, "labels"))
    good = [d for d, t in texts.items() if model.score(np.array([quality.features(t)]))[0] >= quality.CUT]
    clean = [d for d in brute_firsts([(d, texts[d]) for d in good]) if not hit_words(texts[d], windows)[1]]
    rest = docs.filter(F.col("doc_id").isin(clean))
    terms = {r.doc_id: [(s.start, 4, s.end, "term") for s in r.spans if s.kind == "term"] for r in pii.find(rest).collect()}
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want = {}
    for d in clean:
        text, at, out = texts[d] or "", 0, []
        for a, _, b, kind in sorted(brute_spans(text) + terms[d]):
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        ids = library.encode("".join(out) + text[at:], add_special_tokens=False).ids
        want[d] = (len(ids), " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in got.collect()} == want and 0 < len(want) < len(good) < len(texts)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]


def test_tokens_take_one_python_pass(spark, capsys):
    corpus_pipeline.token_stage(spark, read(spark, SMALL, "documents"), SMALL).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_stages_take_awkward_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, rows without an id, extra columns, empty tables: every stage gives the columns that it got."""
    long = "word and other words " * 20_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, "plain words of some length here", None, "s", 5), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(c) for c in ("_unit", "unit", "key", "spans", "_row", "score", "good", "x")})
    for data in (df, df.limit(0)):
        out = data
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SMALL)
            assert out.columns == df.columns, name
            kept = out.collect()
            assert len(kept) <= len(rows) and all(r.spans == "spans" and r.unit == "unit" for r in kept)
        assert corpus_pipeline.STAGES[-1][1](spark, out, SMALL).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, df, SMALL).collect()) == ["1", "3", "None", "None"]
    assert corpus_pipeline.decontamination_stage(spark, df, SMALL).count() == len(rows) and corpus_pipeline.pii_stage(spark, df, SMALL).count() == len(rows)
