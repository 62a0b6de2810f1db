"""Personal data: pattern matches, and information-theoretic sanitisation of the terms that give them away.

Everything is DataFrame expressions. Four patterns give the base spans. Each matched value is a protected entity; the
words of the documents that hold it, however far from it, tell how strongly a term reveals it: with N documents, n(e),
n(t) and n(t, e) counted by document, a term's disclosure is PMI(t; e) = log2(n(t, e) N / (n(t) n(e))), and it discloses too much if that
reaches ``ALPHA`` times the entity's information content log2(N / n(e)), in at least ``SUPPORT`` differing contexts: the
``CONTEXT`` characters on either side of the value and the words on either side of the term, both where they first stand
(so that copies of one document prove nothing). Terms are runs of letters and digits of any length outside base spans. Such terms are spans of kind ``term`` in the documents that hold the
entity; redaction generalises every span to its kind.

Patterns carry the same matches as their plain forms but start only where a run starts and never give a run back, so
their time is linear in the text and their stack is flat. Word counts are aggregated before the shuffle; documents' entities
and words meet by document, so a value that a third of all documents share is no hot task. As n(t, e) <= n(e), only terms
with n(t) <= n(e)^ALPHA N^(1 - ALPHA) can disclose too much; no others are paired.

Defined cases: null is the empty text; a text without matches has no spans; overlapping kinds are all reported;
repeated rows and rows without an id count as documents of their own and are judged alike; other columns, of any name,
pass through ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_table, materialize

KINDS = ("email", "ip", "card", "phone", "term")
#: Share of an entity's information content that a term may disclose.
ALPHA = 0.9
#: Differing contexts that must show a term beside an entity.
SUPPORT = 3
#: Characters on either side of a value that tell one context from another; terms count wherever they stand.
CONTEXT = 60

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # whole runs of 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_SIGN = {"email": "@", "ip": ".", "phone": "+"}
_WORD, _NOT_WORD = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
_BLOCK = 128
SPAN = "struct<start:int,kind_no:int,end:int,kind:string,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(digits, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # leading zeros are fine, digits beyond three otherwise aren't
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda part: F.substring(F.concat(F.lit("000"), part), -3, 3).cast("int") <= 255)
    return _luhn(value) if kind == "card" else F.length(_digits(value)).between(10, 15)


def _normal(kind: str, value: Column) -> Column:
    return F.translate(value, UPPER, LOWER) if kind == "email" else _digits(value) if kind != "ip" else value


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _positions(text: Column, pattern: str, hits: Column, kind: str) -> Column:
    """Spans of ``hits``: between them stand the pieces of the text that splitting leaves."""
    gaps = F.transform(F.split(text, pattern), F.length)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    end, out = (lambda state: state.getField("end")), (lambda state: state.getField("out"))

    def step(state: Column, x: Column) -> Column:
        start = end(state) + x.getField("gap")
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (start + F.length(x.getField("hit"))).alias("end"), F.lit(kind).alias("kind"), x.getField("hit").alias("value"))
        return F.struct((start + F.length(x.getField("hit"))).alias("end"), F.concat(out(state), F.array(span)).alias("out"))

    def block(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(end(state).alias("end"), _none().alias("out")), step)
        return F.struct(done.getField("end").alias("end"), F.concat(out(state), F.array(done.getField("out"))).alias("out"))

    # in blocks, as appending one by one to a long array would copy it each time
    numbers = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _BLOCK).cast("int"))
    # the outer array of one binds the pairs to a variable, so that they are made once
    blocks = F.flatten(F.transform(F.array(pairs), lambda p: F.transform(numbers, lambda k: F.slice(p, k * _BLOCK + 1, F.lit(_BLOCK)))))
    walked = F.aggregate(blocks, F.struct(F.lit(0).alias("end"), F.array().cast(f"array<array<{SPAN}>>").alias("out")), block, lambda state: F.flatten(out(state)))
    return F.when(F.size(hits) > 0, walked).otherwise(_none())


def with_base_spans(docs: DataFrame, text_col: str, out: str = "_spans") -> DataFrame:
    """``docs`` with the base spans in column ``out``: start, kind, end (code points, end exclusive) and value."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = {}
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        hits[f"_hits_{kind}"] = F.when(F.contains(text, F.lit(_SIGN[kind])), found).otherwise(F.array().cast("array<string>")) if kind in _SIGN else found
    docs = docs.withColumns(hits)
    valid = lambda kind: lambda s: _valid(kind, s.getField("value"))
    spans = [F.filter(_positions(text, pattern, F.col(f"_hits_{kind}"), kind), valid(kind)) for kind, pattern in PATTERNS.items()]
    found = F.when(sum((F.size(h) for h in hits), F.lit(0)) > 0, F.array_sort(F.concat(*spans))).otherwise(_none())
    return docs.withColumn(out, found).drop(*hits)


def _words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _NOT_WORD)), lambda w: w != "")


def _entity(s: Column) -> Column:
    """A span's value as the protected entity: what differs in writing only is one."""
    return F.coalesce(*[F.when(s.getField("kind") == kind, _normal(kind, s.getField("value"))) for kind in PATTERNS])


def disclosures(docs: DataFrame, private: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``kind, entity, term, n_together, n_contexts, n_term, n_entity, pmi, information`` of the terms beyond the threshold, and
    ``_row, kind, entity`` of the rows that hold an entity (a table). ``private``: ``_row, _text, _spans`` of the documents with matches."""
    n = float(max(1, docs.count()))
    text, s = F.col("_text"), F.col("s")
    from_ = F.greatest(s.getField("start") - CONTEXT, F.lit(0))
    around = F.xxhash64(F.substring(text, from_ + 1, s.getField("start") - from_), F.substring(text, s.getField("end") + 1, F.lit(CONTEXT)))
    holders = (private.select("_row", "_text", F.explode("_spans").alias("s"))
               .select("_row", s.getField("kind").alias("kind"), _entity(s).alias("entity"), F.struct(s.getField("start").alias("at"), around.alias("hash")).alias("place"))
               .groupBy("_row", "kind", "entity").agg(F.min("place").getField("hash").alias("_beside")))
    holders = materialize(holders, "entities_of_rows")
    entities = holders.groupBy("kind", "entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= support)
    terms = docs.select(F.explode(_words(docs[text_col].cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term") >= support)
    tokens = F.filter(F.split(F.lower(_generalised(text, F.col("_spans"), F.lit(" "))), _NOT_WORD), lambda w: w != "")
    # only rows that hold an entity of enough documents; every token with the ones before and after it
    rows = private.join(holders.join(entities, ["kind", "entity"]).select("_row").distinct(), "_row", "left_semi").select("_row", tokens.alias("after"))
    rows = rows.select("_row", "after", F.concat(F.array(F.lit("")), "after").alias("term"), F.concat(F.array(F.lit(""), F.lit("")), "after").alias("before"))
    words = (rows.select("_row", F.posexplode(F.arrays_zip("after", "term", "before")).alias("at", "w")).filter("w.term <> ''")
             .groupBy("_row", F.col("w.term").alias("term")).agg(F.min(F.struct("at", F.xxhash64("w.before", "w.after").alias("hash"))).getField("hash").alias("_near")))
    some = F.pow(F.col("n_entity"), F.lit(alpha)) * n ** (1 - alpha) * 1.000001  # beyond it no term reaches the threshold
    pairs = (holders.join(entities, ["kind", "entity"]).join(words.join(terms, "term"), "_row").filter(F.col("n_term") <= some)
             .groupBy("kind", "entity", "term", "n_entity", "n_term", F.xxhash64("_beside", "_near").alias("_hash")).agg(F.count("*").alias("n"))
             .groupBy("kind", "entity", "term", "n_entity", "n_term").agg(F.sum("n").alias("n_together"), F.count("*").alias("n_contexts"))
             .filter(F.col("n_contexts") >= support))
    pmi, information = F.log2(F.col("n_together") * n / (F.col("n_term") * F.col("n_entity"))), F.log2(n / F.col("n_entity"))
    found = (pairs.withColumns({"pmi": pmi, "information": information}).filter((F.col("information") > 0) & (F.col("pmi") >= alpha * F.col("information")))
             .select("kind", "entity", "term", "n_together", "n_contexts", "n_term", "n_entity", "pmi", "information"))
    return found, holders.select("_row", "kind", "entity")


def _with_all_spans(base: DataFrame, docs: DataFrame, alpha: float, support: int, text_col: str) -> DataFrame:
    """The rows of ``base`` (a table with ``_row, _text, _spans``) that have base spans, with the disclosing terms among their spans."""
    private = base.filter("size(_spans) > 0")
    found, holders = disclosures(docs, private, alpha, support, text_col)
    per_row = materialize(holders.join(found.select("kind", "entity", "term"), ["kind", "entity"]).groupBy("_row").agg(F.collect_set("term").alias("_terms")), "terms_of_rows")
    drop_table(holders)
    text = F.col("_text")
    marked = F.filter(_positions(text, _WORD, F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), "term"), lambda w: F.array_contains(F.col("_terms"), F.lower(w.getField("value")))
                      & ~F.exists("_spans", lambda s: (s.getField("start") < w.getField("end")) & (w.getField("start") < s.getField("end"))))
    spans = F.when(F.col("_terms").isNull(), F.col("_spans")).otherwise(F.array_sort(F.concat("_spans", marked)))
    return private.join(per_row, "_row", "left").withColumn("_spans", spans).select(*base.columns)


def find(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, spans`` for every row: base spans and disclosing terms, by start and kind. ``keep_text``: the text too, where there are spans."""
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    base = with_base_spans(rows, "_text").withColumn("_text", F.when(F.size("_spans") > 0, F.col("_text")))
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "personal")
    result = _with_all_spans(base, docs, alpha, support, text_col).unionByName(base.filter("size(_spans) = 0"))
    return result.select(F.col("_id").alias("doc_id"), F.col("_spans").alias("spans"), *([F.col("_text").alias("text")] if keep_text else []))


def _generalised(text: Column, spans: Column, put: Column | None = None) -> Column:
    """The text with every span replaced by its kind in brackets or by ``put``; overlapping spans are replaced once, by the first one's kind."""
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda state, s: F.struct(
            F.greatest(state.getField("at"), s.getField("end")).alias("at"),
            F.when(s.getField("start") >= state.getField("at"),
                   F.concat(state.getField("out"), F.array(F.substring(text, state.getField("at") + 1, s.getField("start") - state.getField("at")), F.concat(F.lit("["), s.getField("kind"), F.lit("]")) if put is None else put)))
            .otherwise(state.getField("out")).alias("out")),
        lambda state: F.concat(F.array_join(state.getField("out"), ""), F.substring(text, state.getField("at") + 1, F.length(text))))
    return walked


def redact(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; in the texts every span stands generalised. A null text stays null. The texts are
    searched once: rows and their spans are written as a table."""
    own = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)])  # so that no name of the input clashes
    rows = docs.select(own.alias("_own"), docs[text_col].cast("string").alias("_text"))
    base = with_base_spans(rows, "_text").withColumn("_text", F.when(F.size("_spans") > 0, F.col("_text")))
    base = materialize(base.withColumn("_row", F.monotonically_increasing_id()), "personal")
    at = docs.columns.index(text_col)
    texts = base.select(F.col(f"_own.c{at}").alias(text_col))
    column = lambda i, c, text: (text if i == at and text is not None else F.col(f"_own.c{i}")).alias(c)
    changed = _with_all_spans(base, texts, alpha, support, text_col)
    changed = changed.select(*[column(i, c, _generalised(F.col("_text"), F.col("_spans"))) for i, c in enumerate(docs.columns)])
    return changed.unionByName(base.filter("size(_spans) = 0").select(*[column(i, c, None) for i, c in enumerate(docs.columns)]))
