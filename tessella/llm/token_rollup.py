"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

Inserted documents add, deleted ones subtract, revised ones subtract their old and add their new counts. A batch of
deltas is aggregated, written beside the log, and moved into it under its batch id in one step, so a batch is in the log whole or
not at all, and of two writers of one batch only one succeeds; a batch in the log is never applied again. Totals are the sum of
the batches, so they need no rewriting. ``compact`` writes the sums of all batches so far into one, which names those that it
stands for: totals then read it and what came later.

Counts come from tokenizer versions given as functions on lists of texts; partial sums precede the only shuffle, whose
keys are as few as the totals.

Defined cases: null texts have no tokens but count as documents; null sources and languages are groups of their own;
repeated rows count each; totals that come down to no document and no token vanish; an empty batch commits as empty; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

KEYS = ("source", "lang", "tokenizer")
Counter = Callable[[list[str]], list[int]]


def count_words(texts: list[str]) -> list[int]:
    """Tokenizer version ``words``: runs of characters that are not white space."""
    return [len(t.split()) for t in texts]


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def rank_file_counter(path: str, pattern: str) -> Counter:
    """A tokenizer version given by a file of ranks and its splitting pattern."""
    def count(texts: list[str]) -> list[int]:
        encode = _encoding(path, pattern).encode_ordinary
        return [sum(len(encode(part)) for part in parts(t)) for t in texts]
    return count


def parts(text: str, size: int = 100_000) -> Iterator[str]:
    """A text in parts of at least ``size`` characters that end before a blank between letters, where no token of the pattern goes
    across; the last part may be shorter."""
    at = 0
    for m in re.finditer(r"(?<=[^\W\d_])(?= [^\W\d_])", text):
        if m.start() - at >= size:
            yield text[at : m.start()]
            at = m.start()
    yield text[at:]


def count_tokens(docs: DataFrame, versions: dict[str, Counter], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, tokenizer, n_tokens``: a row for each document and version."""
    names = list(versions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            texts = [t or "" for t in batch.column(3).to_pylist()]
            for name in names:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * len(texts), pa.string()), pa.array(versions[name](texts), pa.int64())],
                                                 ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, lang string, tokenizer string, n_tokens bigint")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("n_tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    return deleted(before).unionByName(inserted(after))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


class RollupLog:
    """The log of committed batches in one folder of a store that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError(f"not a batch id: {batch_id!r}")
        return f"{self.path}/batch_id={batch_id}"

    def committed(self, batch_id: str) -> bool:
        return batch_id in self.batches()

    def _put(self, folder: str, rows: DataFrame) -> bool:
        """Write rows beside the log and move them in; whether this call's rows are the ones in the log."""
        aside = self._of(f"{self.path}/_aside/{uuid.uuid4().hex}")
        rows.write.parquet(aside.toString())
        self._fs.mkdirs(self._of(self.path))
        target = self._of(folder)
        moved = not self._fs.exists(target) and self._fs.rename(aside, target)
        # a rename onto a folder that came up in between puts the rows inside it, where nothing reads them
        inside = self._of(f"{folder}/{aside.getName()}")
        if moved and self._fs.exists(inside):
            self._fs.delete(inside, True)
            moved = False
        if not moved:
            self._fs.delete(aside, True)
        return moved

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Apply a batch once; whether this call applied it."""
        folder = self._folder(batch_id)
        return not self.committed(batch_id) and self._put(folder, _summed(deltas))

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._of(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._of(self.path))]
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def _compacted(self) -> tuple[str | None, list[str]]:
        """The newest compaction and the batches that it stands for."""
        found = self._names("compact=")
        if not found:
            return None, []
        names = self.spark.read.schema("id string").json(f"{self.path}/compact={found[-1]}/batches")
        return found[-1], [r.id for r in names.collect()]

    def batches(self) -> list[str]:
        return sorted({*self._names("batch_id="), *self._compacted()[1]})

    def compact(self) -> None:
        """Sum all batches so far into one file set; their ids stay committed.

        What is summed is the list taken first, so a batch that is committed meanwhile stays outside, with its own folder. Readers may still
        be at the folders of these batches and at the compaction before: the next compaction deletes them."""
        before, held = self._compacted()
        own = [b for b in self._names("batch_id=") if b not in held]
        number = f"{int(before or 0) + 1:09d}"
        aside = f"{self.path}/_aside/{uuid.uuid4().hex}"
        self._sum(own, before).coalesce(1).write.parquet(f"{aside}/totals")  # as few rows as the totals
        self.spark.createDataFrame([(b,) for b in sorted({*own, *held})], "id string").coalesce(1).write.json(f"{aside}/batches")
        if self._fs.exists(self._of(f"{self.path}/compact={number}")) or not self._fs.rename(self._of(aside), self._of(f"{self.path}/compact={number}")):
            raise RuntimeError("another compaction came first")
        for name in set(self._names("batch_id=")) & set(held):
            self._fs.delete(self._of(self._folder(name)), True)
        for old in self._names("compact="):
            if before and old < before:
                self._fs.delete(self._of(f"{self.path}/compact={old}"), True)

    def _sum(self, batches: list[str], compaction: str | None) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
        found = [self._folder(b) for b in batches] + ([f"{self.path}/compact={compaction}/totals"] if compaction else [])
        return _summed(self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches."""
        newest, held = self._compacted()
        return self._sum([b for b in self._names("batch_id=") if b not in held], newest)
