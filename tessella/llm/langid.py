"""Language identification by Bayesian fusion of four kinds of evidence.

Text likelihoods come from byte-trigram counts of labelled documents, summed over the whole corpus. Web pages add the
language that their markup declares, their address suffix and their host. How far declarations and suffixes are to be
trusted is counted on the pages themselves (declared value or suffix against the language of the text), and each
host's mix of languages is smoothed hierarchically: host to registered domain to everything, leaving the page itself
out. Documents have their source for a host and neither markup nor suffix.

The model is two tables whose size does not depend on the data: languages (``MAX_LANGUAGES``) by ``GRAMS`` hashed trigrams.

Defined cases: null and empty texts have even text likelihoods and follow the other evidence; a missing declaration or
suffix says nothing; ties go to the language first in alphabet; rows are judged one by one, repeated ones alike; rows
without a language label teach nothing; other columns are not read; without any label the answer is null with probability null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, slices
from .urls import domain_of, host_of, suffix_of

GRAMS = 1 << 15
#: Distinct languages that a model can tell apart; more labels are an error.
MAX_LANGUAGES = 512
#: Trigrams of a text after which further ones count less, as they repeat each other: n count as EVIDENCE * log(1 + n / EVIDENCE).
EVIDENCE = 60
#: Pages that a parent level counts for in a child's prior.
PRIOR_PAGES = 10.0


def grams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a lower-cased text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((raw[:-2] * 0x9E3779B1 + raw[1:-1] * 0x85EBCA6B + raw[2:] * 0xC2B2AE35) >> 17 & (GRAMS - 1)).astype(np.int64)


def train(docs: DataFrame, keep: Column | None = None, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (languages by grams) from all labelled documents (those that ``keep`` admits)."""
    rows = docs.filter(F.col(lang_col).isNotNull())
    rows = rows if keep is None else rows.filter(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        sums.setdefault(lang, np.zeros(GRAMS, np.int64)).__iadd__(np.bincount(grams(text), minlength=GRAMS))
                    if len(sums) > MAX_LANGUAGES:
                        raise ValueError("too many languages")
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "gram", "n"])

    sums = (rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    got = sums.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()  # GRAMS entries a language
    if len(got) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    table = np.full((len(got), GRAMS), 0.5)
    for i, row in enumerate(got):
        for gram, n in row.grams:
            table[i, gram] += n
    return [r.lang for r in got], np.log(table / table.sum(1, keepdims=True)) if got else table


def text_likelihoods(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """Log-likelihoods, tempered by ``EVIDENCE``, languages in columns."""
    out = np.zeros((len(texts), len(model)))
    for i, text in enumerate(texts):
        if text and text.strip():
            counts = np.bincount(grams(text), minlength=GRAMS)
            total = counts.sum()
            out[i] = (model @ counts) * (EVIDENCE * np.log1p(total / EVIDENCE) / total)
    return out - out.max(1, keepdims=True) if len(model) else out


def with_likelihoods(rows: DataFrame, model: np.ndarray, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` and ``loglik array<double>`` for column ``_text``."""
    where = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, where)):
            loglik = text_likelihoods(batch.column(where).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:where], pa.array(list(loglik), pa.list_(pa.float64()))], [*columns, "loglik"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns) + ", loglik array<double>"
    return rows.select(*columns, "_text").mapInArrow(run, schema)


def page_text(html: Column) -> Column:
    """Text between the tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[a-z#0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """Primary subtag of the root element's lang attribute, lower-cased; null if there is none."""
    found = F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,8})""", 1)
    return F.nullif(F.lower(found), F.lit(""))


def identify(rows: DataFrame, languages: list[str], model: np.ndarray, keys: list[str]) -> DataFrame:
    """``keys``, ``host, declared, text_lang, lang, probability`` for rows with ``_text, host, domain, suffix, declared``."""
    columns = [*keys, "host", "domain", "suffix", "declared"]
    seen = with_likelihoods(rows, model, columns)
    if not languages:
        return seen.select(*keys, "host", "declared", F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    k = len(languages)
    seen = seen.withColumn("best", (F.array_position("loglik", F.lit(0.0)) - 1).cast("int"))
    seen = materialize(seen, "likelihoods")
    tally = [F.sum((F.col("best") == i).cast("double")).alias(f"n{i}") for i in range(k)]
    listed = F.array(*[F.col(f"n{i}") for i in range(k)])
    by = lambda key: seen.filter(F.col(key).isNotNull()).groupBy(key).agg(*tally, F.count("*").alias("_n")).select(key, listed.alias(f"_{key}"), "_n")
    total, rows_ = seen.agg(*tally, F.count("*").alias("rows")).select(listed.alias("n"), "rows").first()
    total = total or [0.0] * k
    everything = F.array(*[F.lit(float(n or 0) + 1.0) for n in total])
    joined = seen
    for key in ("declared", "suffix", "domain", "host"):
        joined = join_counted(joined, by(key), key, rows_, F.xxhash64(*keys))  # a source or host may hold a third of the rows
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (i == F.col("best")).cast("double"))
    less_own = lambda counts: F.zip_with(counts, own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
    normal = lambda counts: F.transform(counts, lambda n: n / F.aggregate(counts, F.lit(0.0), lambda s, x: s + x))
    none = F.array(*[F.lit(0.0)] * k)
    smoothed = lambda counts, prior: normal(F.zip_with(less_own(F.coalesce(counts, none)), prior, lambda n, p: n + PRIOR_PAGES * p))
    joined = joined.withColumn("p_all", normal(everything)).withColumn("p_domain", smoothed(F.col("_domain"), F.col("p_all"))).withColumn("p_host", smoothed(F.col("_host"), F.col("p_domain")))
    # P(value | language), up to a factor that no language changes
    given = lambda key: F.when(F.col(f"_{key}").isNull(), F.array(*[F.lit(1.0)] * k)).otherwise(
        F.zip_with(less_own(F.col(f"_{key}")), everything, lambda n, all_: (n + 0.5) / (all_ + k)))
    joined = joined.withColumns({"l_declared": given("declared"), "l_suffix": given("suffix")})
    score = F.zip_with(F.zip_with("loglik", "p_host", lambda a, p: a + F.ln(p)), F.zip_with("l_declared", "l_suffix", lambda a, b: F.ln(a) + F.ln(b)), lambda a, b: a + b)
    joined = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    probability = 1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    return joined.select(*keys, "host", "declared", F.get(names, F.col("best")).alias("text_lang"), F.get(names, (F.array_position("score", F.col("top")) - 1).cast("int")).alias("lang"), probability.alias("probability"))


def pages_as_rows(pages: DataFrame) -> DataFrame:
    """Pages with their evidence in the columns that ``identify`` reads."""
    host, html = host_of(F.col("url").cast("string")), F.col("html").cast("string")
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), page_text(html).alias("_text"), host.alias("host"),
                        domain_of(host).alias("domain"), F.nullif(suffix_of(host), F.lit("")).alias("suffix"), declared_language(html).alias("declared"))


def documents_as_rows(docs: DataFrame) -> DataFrame:
    """Documents with their source for a host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("_text"),
                       F.concat(F.lit("source:"), F.coalesce(F.col("source").cast("string"), F.lit(""))).alias("host"), F.lit("source:").alias("domain"), F.lit(None).cast("string").alias("suffix"), F.lit(None).cast("string").alias("declared"))
