"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the n-grams that a text holds twice or more; the
characters of the words that lie inside them (first occurrence included), over all characters in words,
are that length's coverage. The same goes for lines. A text is rejected where a coverage passes its limit.
One pass over the texts, no shuffle: hot keys do not matter and a lost task is just run again.

Null and empty texts have no words: all counts 0, coverage 0, and ``base_failed`` (fewer than 50 words).
Repeated rows are judged one by one. Very long texts form a block of their own (about 60 bytes of
working memory a byte of text). An empty table gives no rows. Input columns are untouched, so other columns' names cannot clash; the verdict is one struct column whose name the caller sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.blocks import Block, first_of_each, mix, repeated, text_blocks, windows

#: n-gram length -> largest share of word characters inside n-grams that occur twice or more.
NGRAM_LIMITS = {4: 0.12, 6: 0.11, 10: 0.1}
#: Largest share of word characters inside lines that occur twice or more.
LINE_LIMIT = 0.12
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STARTS = (np.arange(256) & 0xC0) != 0x80
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _doc_key(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + doc.astype(np.uint64) * GOLDEN)


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def judge_block(b: Block, limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> dict[str, np.ndarray]:
    """One array a field, one entry a text."""
    chars = _sums(b.in_word & STARTS[b.data])
    total = chars[b.offset[1:]] - chars[b.offset[:-1]]
    symbols = _sums(SYMBOLS[b.data])
    prefix = b.prefix(False)
    words, doc, first = b.span(prefix, b.start, b.end), b.word_doc, b.first_word
    n_words = np.diff(first)
    word_chars = chars[b.end] - chars[b.start]

    def covered(n: int) -> np.ndarray:
        h, at = windows(words, doc, first, n)
        twice = at[repeated(_doc_key(h, doc[at]))]
        step = np.zeros(len(words) + 1, np.int32)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + n, -1)
        return np.cumsum(step[:-1]) > 0

    newline = np.flatnonzero(b.data == 10)
    line_start = np.r_[b.offset[:-1], newline + 1]
    line_doc = np.r_[np.arange(b.docs), np.searchsorted(b.offset, newline, "right") - 1]
    line_end = np.minimum(np.r_[newline, len(b.data)][np.searchsorted(newline, line_start)], b.offset[1:][line_doc])
    with_word = chars[line_end] > chars[line_start]
    line_start, line_end, line_doc = line_start[with_word], line_end[with_word], line_doc[with_word]
    key = _doc_key(b.span(prefix, line_start, line_end), line_doc)
    twice = repeated(key)
    again = np.bincount(line_doc[~first_of_each(key)], minlength=b.docs)
    safe = np.maximum(total, 1)
    line_cover = np.bincount(line_doc[twice], (chars[line_end] - chars[line_start])[twice], minlength=b.docs) / safe
    repeat_words = np.bincount(doc[covered(3)], minlength=b.docs)
    out = {"word_chars": total, "n_symbols": symbols[b.offset[1:]] - symbols[b.offset[:-1]], "n_dup_lines": again, "n_repeat_words": repeat_words, "n_words": n_words}
    out["base_failed"] = (n_words < 50) | (100 * repeat_words > 50 * n_words)
    rejected = line_cover > line_limit
    out["line_coverage"] = line_cover
    for n, limit in limits.items():
        inside = covered(n)
        out[f"coverage_{n}"] = np.bincount(doc[inside], word_chars[inside], minlength=b.docs) / safe
        rejected |= out[f"coverage_{n}"] > limit
    out["kept"] = ~out["base_failed"] & ~rejected
    return out


def verdict_type(limits: dict[int, float] = NGRAM_LIMITS) -> T.StructType:
    longs = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_words")
    return T.StructType([*(T.StructField(x, T.LongType()) for x in longs), T.StructField("base_failed", T.BooleanType()), *(T.StructField(x, T.DoubleType()) for x in ("line_coverage", *(f"coverage_{n}" for n in limits))), T.StructField("kept", T.BooleanType())])


def quality_verdict(text: Column, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> Column:
    """A struct of counts, coverages, ``base_failed`` and ``kept`` for each text."""
    limits = limits or NGRAM_LIMITS
    kind = verdict_type(limits)

    @F.arrow_udf(kind)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [judge_block(b, limits, line_limit) for b in text_blocks(texts)]
            yield pa.StructArray.from_arrays([pa.array(np.concatenate([p[f.name] for p in parts]) if parts else [], pa.bool_() if f.dataType == T.BooleanType() else pa.float64() if f.dataType == T.DoubleType() else pa.int64()) for f in kind], kind.names)

    return judge(text)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    v = docs.select("doc_id", quality_verdict(F.col("text")).alias("verdict"))
    return v.select("doc_id", *(F.col(f"verdict.{x}").alias(x) for x in verdict_type().names))


def oracle() -> str:
    """The whole query in SQL: windows, lines and the verdict."""
    word = "[^\\x20\\x09-\\x0D]+"
    lengths = (3, *NGRAM_LIMITS)
    gram = lambda n: " || ' ' || ".join(["x", *(f"lead(x, {k}) OVER o" for k in range(1, n))])  # noqa: E731  null past the last word
    inside = "\n".join(
        f"""g{n} AS MATERIALIZED (SELECT k, i, {gram(n)} AS g FROM t WINDOW o AS (PARTITION BY k ORDER BY i)),
c{n} AS MATERIALIZED (SELECT k, sum(len(x)) AS chars, count(*) AS n FROM t JOIN (
  SELECT DISTINCT k, unnest(range(i, i + {n})) AS i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS times FROM g{n} WHERE g IS NOT NULL) WHERE times > 1) USING (k, i) GROUP BY k),"""
        for n in lengths
    )
    shares = ", ".join(f"coalesce(c{n}.chars, 0) / greatest(word_chars, 1) AS coverage_{n}" for n in NGRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN c{n} USING (k)" for n in lengths)
    fine = " AND ".join(f"coverage_{n} <= {limit}" for n, limit in NGRAM_LIMITS.items())
    return f"""
WITH w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
t AS MATERIALIZED (SELECT k, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w),
{inside}
l AS MATERIALIZED (SELECT k, line, len(array_to_string(regexp_extract_all(line, '{word}'), '')) AS chars, count(*) OVER (PARTITION BY k, line) AS times
  FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{word}')),
d AS MATERIALIZED (SELECT k, sum(chars) FILTER (times > 1) AS chars, count(*) - count(DISTINCT line) AS again FROM l GROUP BY k),
b AS MATERIALIZED (SELECT doc_id, k, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ws) AS BIGINT) AS n_words FROM w),
v AS (SELECT doc_id, word_chars, n_symbols, coalesce(again, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, n_words, coalesce(d.chars, 0) / greatest(word_chars, 1) AS line_coverage, {shares}
  FROM b LEFT JOIN d USING (k) {joins})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND line_coverage <= {LINE_LIMIT} AND {fine} AS kept FROM v
"""
