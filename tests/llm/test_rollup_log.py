"""Compaction beside commits and readers."""

from tessella.llm import token_rollup


def batch(spark, docs, tokens):
    return spark.createDataFrame([("web", "en", "words", docs, tokens)], "source string, lang string, tokenizer string, docs bigint, tokens bigint")


def totals(log):
    return [(r.docs, r.tokens) for r in log.totals().collect()]


def test_a_commit_during_compaction_counts_once(spark, tmp_path, monkeypatch):
    log = token_rollup.RollupLog(spark, str(tmp_path / "log"))
    log.commit("a", batch(spark, 1, 10))
    whole, late = log._sum, []

    def summed(*args):
        if not late:
            late.append(log.commit("b", batch(spark, 1, 10)))
        return whole(*args)

    monkeypatch.setattr(log, "_sum", summed)
    log.compact()
    monkeypatch.undo()
    assert late == [True] and totals(log) == [(2, 20)] and log.batches() == ["a", "b"]
    log.compact()
    assert totals(log) == [(2, 20)] and not log.commit("b", batch(spark, 1, 10)) and not log.commit("a", batch(spark, 5, 5))
    assert totals(log) == [(2, 20)]


def test_a_reader_outlives_a_compaction(spark, tmp_path):
    log = token_rollup.RollupLog(spark, str(tmp_path / "log"))
    for name in ("a", "b"):
        log.commit(name, batch(spark, 1, 10))
    plan = log.totals()
    log.compact()
    assert [(r.docs, r.tokens) for r in plan.collect()] == [(2, 20)]
    plan = log.totals()
    log.commit("c", batch(spark, 1, 1))
    log.compact()
    assert [(r.docs, r.tokens) for r in plan.collect()] == [(2, 20)] and totals(log) == [(3, 21)]
    log.compact()
    log.compact()
    assert totals(log) == [(3, 21)] and log.batches() == ["a", "b", "c"] and log._names("batch_id=") == [] and len(log._names("compact=")) == 2
