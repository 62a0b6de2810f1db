"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, langid, phrases, pii, quality, repeats, simhash, token_rollup, urls, warc, whiten
from .common import materialize, read, shared_dir


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(read(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by all evidence, every document by text and source; learnt from the documents that op6 may learn from too."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    languages, model = langid.train(docs, _learnable(F.col("doc_id")))
    rows = langid.pages_as_rows(pages).unionByName(langid.documents_as_rows(docs))
    return langid.identify(rows, languages, model, ["doc_id", "page_id"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading all documents, deleting toxic ones, revising low-quality ones to their distinct lines, and replays."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    versions = {"words": token_rollup.count_words, "byte_bpe_50k": token_rollup.rank_file_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)}
    counts = materialize(token_rollup.count_tokens(docs, versions), "token_counts")
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    poor = labels.filter("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    # only documents with repeated lines change; their new counts are small rows, so no text is shuffled
    distinct_lines = F.array_join(F.array_distinct(F.split("text", "\\n")), "\n")
    changed = docs.withColumn("_lines", distinct_lines).filter(F.col("_lines") != F.col("text")).withColumn("text", F.col("_lines"))
    after = materialize(token_rollup.count_tokens(changed, versions).join(poor, "doc_id", "left_semi"), "token_counts_after")
    before = counts.join(after.select("doc_id").distinct(), "doc_id", "left_semi")
    log = token_rollup.RollupLog(spark, f"{shared_dir(spark)}/tessella/rollup-{uuid.uuid4().hex}")
    batches = {"load": lambda: token_rollup.inserted(counts), "toxic": lambda: token_rollup.deleted(counts.join(toxic, "doc_id", "left_semi")),
               "lines": lambda: token_rollup.revised(before, after)}
    for batch_id in ("load", "toxic", "lines", "toxic", "load"):
        log.commit(batch_id, batches[batch_id]())
    return log.totals()


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_outcomes(pages, read(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


def _learnable(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), keep=_learnable)
    return quality.score(docs, model).select("doc_id", (~_learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), form="spelled")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.getField("kind") != "term")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("end"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s.getField("kind") == kind)
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(read(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/tessella/warc-{uuid.uuid4().hex}")


QUERIES = {f.__name__: f for f in (op1_repeats, op2_language, op3_simhash, op4_token_counts, op5_url_filter, op6_quality, op7_neighbours, op8_bpe, op9_pii, op10_decontaminate, op11_phrases, op12_whitening, op13_warc)}
ORACLE_SQL: dict[str, str] = {"op5_url_filter": urls.ORACLE, "op11_phrases": phrases.ORACLE, "op13_warc": warc.ORACLE}
