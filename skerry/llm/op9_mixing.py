"""Mixing sources to target weights by iterative proportional fitting.

Each document weighs its tokens (words). Token totals by source class, language class and topic are raked to the target
marginals: each iteration scales them to the source targets, then the language, then the topic targets, until no marginal is off by more than TOLERANCE or ITERATIONS are
done; ``residual`` tells how far off they end. A topic is a column of the caller's, or else told by what the text holds. A source or
language that the targets don't name belongs to class ``*``, so the table of totals has at most (named sources + 1) x (named languages + 1)
x topics cells, however large the corpus; it alone is collected, and the fitted cells alone are broadcast. A target of a class without tokens is
dropped and the others of its kind are scaled up.

A document is drawn with its cell's probability, ``min(1, rate * fitted share / actual share)``; the rate is the one at which the expected
sample holds ``sample_share`` of all tokens. A cell whose probability reaches 1 gives all it has. The draw compares it with a number from a digest of the id, so it is the same on every run.
Pre-aggregation by cell makes hot sources cheap; no join or shuffle carries texts.

Null or unnamed sources and languages are class ``*``; null and empty texts have 0 tokens, topic ``prose``, and are drawn with their cell's
probability (1 in a cell without tokens). A null id draws as if it were an empty string. Repeated rows get equal draws. Texts of any length are read whole, an empty table gives no rows. Columns besides
text, source, language and id are untouched; the result is one struct column, and an input that has one of its name is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITERATIONS, TOLERANCE = 25, 1e-12
OTHER = "*"
#: Topic -> pattern that the whole text is searched for; the first that fits, else ``prose``.
TOPICS = {"tabular": r" \| ", "technical": r"[0-9]{4}|://|@|=", "prose": None}


@dataclass(frozen=True)
class Targets:
    """Shares of tokens; each kind sums to 1."""

    source: dict[str, float] = field(default_factory=lambda: {"src0": 0.25, "*": 0.75})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.1, "*": 0.01})
    topic: dict[str, float] = field(default_factory=lambda: {"tabular": 0.05, "technical": 0.1, "prose": 0.85})
    sample_share: float = 0.8

    def kinds(self) -> tuple[tuple[str, dict[str, float]], ...]:
        return ("source_class", self.source), ("lang_class", self.lang), ("topic", self.topic)


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(list(TOPICS.items())):
        if pattern:
            out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def class_of(value: Column, named: dict[str, float]) -> Column:
    return F.when(value.isin([x for x in named if x != OTHER]), value).otherwise(F.lit(OTHER))


def residual(fitted: np.ndarray, kinds: list[list[tuple[np.ndarray, float]]]) -> float:
    """The largest difference between a marginal and its target."""
    return max((abs(float(fitted[rows].sum()) - goal) for kind in kinds for rows, goal in kind), default=0.0)


def rake(cells: list[tuple[str, str, str, float]], targets: Targets) -> dict[tuple[str, str, str], tuple[float, float]]:
    """Weight (fitted over actual share) and probability of each cell."""
    keys = [c[:3] for c in cells]
    actual = np.array([float(c[3]) for c in cells])
    if actual.sum() <= 0:
        return {k: (1.0, min(1.0, targets.sample_share)) for k in keys}
    share = actual / actual.sum()
    fitted = share.copy()
    kinds = []
    for k, (_, named) in enumerate(targets.kinds()):
        label = np.array([key[k] for key in keys])
        goal = {x: named.get(x, 0.0) for x in set(label) if share[label == x].sum() > 0}
        total = sum(goal.values()) or 1.0
        kinds.append([(label == x, g / total) for x, g in goal.items()])
    for _ in range(ITERATIONS):
        if residual(fitted, kinds) <= TOLERANCE:
            break
        for kind in kinds:
            for rows, goal in kind:
                mass = fitted[rows].sum()
                fitted[rows] *= goal / mass if mass > 0 else 0.0
    weight = np.divide(fitted, share, out=np.ones_like(share), where=share > 0)
    order = np.argsort(-weight, kind="stable")
    spent, left = np.cumsum(share[order]) - share[order], np.cumsum(fitted[order][::-1])[::-1]
    rates = [(targets.sample_share - a) / f for a, f in zip(spent, left, strict=True) if f > 0]
    rate = next((r for r, w in zip(rates, weight[order], strict=False) if r * w <= 1), float("inf"))
    return {k: (float(w), float(min(1.0, max(0.0, rate * w))) if a > 0 and w > 0 else float(a <= 0)) for k, w, a in zip(keys, weight, actual, strict=True)}


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the id's digest."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def mix_sources(docs: DataFrame, targets: Targets | None = None, id_col: str = "doc_id", topic_col: str | None = None) -> DataFrame:
    """The documents with one struct column ``mix``: source_class, lang_class, topic, tokens, weight, probability, sampled. ``topic_col``: a column of topics, if there is one."""
    if "mix" in (c.lower() for c in docs.columns):
        raise ValueError("there is a column mix already")
    targets = targets or Targets()
    topic = class_of(F.col(topic_col), targets.topic) if topic_col else topic_of(F.col("text"))
    text = F.coalesce("text", F.lit(""))
    cell = [class_of(F.col("source"), targets.source).alias("source_class"), class_of(F.col("lang"), targets.lang).alias("lang_class"), topic.alias("topic")]
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens")
    marked = docs.withColumn("mix", F.struct(*cell, tokens))
    names = ["source_class", "lang_class", "topic"]
    cells = marked.groupBy(*[F.col(f"mix.{x}").alias(x) for x in names]).agg(F.sum("mix.tokens").alias("tokens")).collect()  # bounded by the targets
    fitted = rake(sorted((r[0], r[1], r[2], r[3]) for r in cells), targets)
    m = F.col("mix")
    flat = F.concat_ws("\x01", m["source_class"], m["lang_class"], m["topic"])
    pairs = [(k, v) for k, v in fitted.items()] or [(("", "", ""), (1.0, 1.0))]
    weight, chance = (F.create_map(*[F.lit(x) for k, v in pairs for x in ("\x01".join(k), v[i])])[flat] for i in (0, 1))
    p = F.coalesce(chance, F.lit(1.0))
    return marked.withColumn("mix", m.withField("weight", F.coalesce(weight, F.lit(1.0))).withField("probability", p).withField("sampled", draw(F.col(id_col)) < p))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    m = F.col("mix")
    return mix_sources(docs).select("doc_id", m["source_class"].alias("source_class"), m["lang_class"].alias("lang_class"), m["topic"].alias("topic"), m["tokens"].alias("tokens"), F.round(m["weight"], 6).alias("weight"), F.round(m["probability"], 6).alias("probability"), m["sampled"].alias("sampled"))


def oracle(targets: Targets | None = None) -> str:
    """The same raking, written out iteration by iteration."""
    targets = targets or Targets()
    case = lambda col, named: f"CASE WHEN {col} IN ({', '.join(repr(x) for x in named if x != OTHER)}) THEN {col} ELSE '*' END"
    topic = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{t}'" for t, p in TOPICS.items() if p) + " ELSE 'prose' END"
    sql = [
        f"d AS MATERIALIZED (SELECT doc_id, {case('source', targets.source)} AS source_class, {case('lang', targets.lang)} AS lang_class, {topic} AS topic, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)",
        "cell AS MATERIALIZED (SELECT source_class, lang_class, topic, CAST(sum(tokens) AS DOUBLE) AS n FROM d GROUP BY ALL)",
        "f0 AS MATERIALIZED (SELECT source_class, lang_class, topic, n / sum(n) OVER () AS x FROM cell WHERE n > 0)",
    ]
    for k, named in targets.kinds():
        values = ", ".join(f"('{x}', CAST({g} AS DOUBLE))" for x, g in named.items())
        sql.append(f"t_{k} AS MATERIALIZED (SELECT v, g / sum(g) OVER () AS g FROM (VALUES {values}) AS t(v, g) WHERE v IN (SELECT {k} FROM f0))")
    n = 0
    for _ in range(ITERATIONS):
        for k, _named in targets.kinds():
            sql.append(f"f{n + 1} AS MATERIALIZED (SELECT source_class, lang_class, topic, CASE WHEN s > 0 THEN x * coalesce(g, 0) / s ELSE 0 END AS x FROM (SELECT *, sum(x) OVER (PARTITION BY {k}) AS s FROM f{n}) LEFT JOIN t_{k} ON v = {k})")
            n += 1
    sql.append(f"w AS MATERIALIZED (SELECT a.source_class, a.lang_class, a.topic, b.x / a.x AS weight, a.x AS a, b.x AS f FROM f0 a JOIN f{n} b USING (source_class, lang_class, topic))")
    order = "ORDER BY weight DESC, source_class, lang_class, topic ROWS BETWEEN"
    sql.append(f"k AS MATERIALIZED (SELECT weight, ({targets.sample_share} - coalesce(sum(a) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(f) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS r FROM w)")
    sql.append("rate AS MATERIALIZED (SELECT r FROM k WHERE r * weight <= 1 ORDER BY weight DESC LIMIT 1)")
    sql.append("p AS MATERIALIZED (SELECT *, least(1.0, greatest(0.0, r * weight)) AS probability FROM w, rate)")
    digest = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / 281474976710656.0"
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, source_class, lang_class, topic, tokens, round(coalesce(weight, 1.0), 6) AS weight, round(coalesce(probability, 1.0), 6) AS probability, {digest} < coalesce(probability, 1.0) AS sampled FROM d LEFT JOIN p USING (source_class, lang_class, topic)"
