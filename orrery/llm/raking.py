"""Mixing sources to target weights by iterative proportional fitting (raking).

Token totals are summed per (source, language, topic) cell, with map-side combining. The cells are
raked to source, language and topic marginals, and a document is sampled with its
cell's calibrated probability: fitted tokens over present tokens, never above one. Where a cell would need
more than it has, it is kept whole and raking shares the rest out again. ``marginals`` tells which targets were met.

A token is a white-space word unless a column of token counts is named. A source or language with under min_share of the tokens and without a target
of its own is pooled; the pool's weight is the sum of its members' own. So at most 1 / min_share of each and those with
targets stand alone, and the fitted table has at most (1 / min_share + targets + 1)**2 * topics rows whatever the corpus: that
bound is what the driver holds and what is broadcast. Whether a document is sampled depends on its id and the seed only.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import external_id, internal_id, prepared
from .line_frequency import word_count

DIMENSIONS = ("source", "lang", "topic")
POOLED = "(pooled)"
# The default topics, as patterns tried in order; the rest is prose.
TOPICS = {"legal": "(?i)licen[cs]e|copyright|rights reserved", "table": "\\|[^|\\n]*\\|", "contact": "[A-Za-z0-9]@[A-Za-z0-9]|\\+[0-9]"}


def default_topic(text: Column) -> Column:
    rule = F.lit("prose")
    for topic, pattern in reversed(TOPICS.items()):
        rule = F.when(text.rlike(pattern), topic).otherwise(rule)
    return rule


def rake(cells: np.ndarray, targets: list[np.ndarray], rounds: int = 300, tolerance: float = 1e-13) -> np.ndarray:
    """Fitted tokens per cell: marginals as in targets (absolute), no cell above what it has."""
    total = targets[0].sum()
    fitted = cells * (total / max(cells.sum(), 1e-300))
    for _ in range(rounds):
        before = fitted
        for axis, target in enumerate(targets):
            others = tuple(i for i in range(cells.ndim) if i != axis)
            have = fitted.sum(others)
            factor = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            fitted = fitted * factor.reshape([-1 if i == axis else 1 for i in range(cells.ndim)])
        fitted = np.minimum(fitted, cells)
        if np.abs(fitted - before).max(initial=0.0) <= tolerance * max(total, 1.0):
            break
    return fitted


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic_col: str | None, tokens_col: str | None = None) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    topic = F.coalesce(F.col(topic_col).cast("string"), F.lit("")) if topic_col else default_topic(text)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((source_col, "source"), (lang_col, "lang"))]
    tokens = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)), F.lit(0)) if tokens_col else word_count(text)
    return docs.select(internal_id(id_col).alias("did"), *named, topic.alias("topic"), tokens.alias("n_tokens"))


def fit(rows: DataFrame, *, fraction: float, alpha: float, min_share: float, targets: Mapping[str, Mapping[str, float]] | None) -> tuple[list[tuple], dict[str, list[str]], list[tuple]]:
    """Rows (source, lang, topic, probability) of the fitted table, the names that stand alone, and rows (dimension, name, present, wanted, fitted) of the marginals."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).checkpoint()
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    names, weights = {}, {}
    for d in DIMENSIONS:
        own = list((targets or {}).get(d) or {})
        each = cells.groupBy(d).agg(F.sum("tokens").alias("t"))
        alone = (F.col("t") >= F.lit(total * min_share)) | F.col(d).isin(own)
        names[d] = sorted(r[0] for r in each.where(alone).select(d).collect())
        tempered_sums = each.groupBy(pool(F.col(d), names[d]).alias("name")).agg(F.sum(F.when(F.col("t") > 0, F.pow("t", F.lit(alpha))).otherwise(0.0)).alias("w"))
        weights[d] = {r["name"]: r["w"] for r in tempered_sums.collect()}
    pooled = cells.select(*[pool(F.col(d), names[d]).alias(d) for d in DIMENSIONS], "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).collect()
    axes = [sorted({r[d] for r in pooled}) for d in DIMENSIONS]
    table = np.zeros([len(a) for a in axes])
    at = [{n: i for i, n in enumerate(a)} for a in axes]
    for r in pooled:
        table[tuple(at[i][r[d]] for i, d in enumerate(DIMENSIONS))] = r["tokens"]
    wanted = []
    for i, d in enumerate(DIMENSIONS):
        given = (targets or {}).get(d)
        shares = np.array([given.get(n, 0.0) if given else weights[d][n] for n in axes[i]], float)
        wanted.append(shares / max(shares.sum(), 1e-300) * fraction * total)
    fitted = rake(table, wanted) if total else table
    probability = np.divide(fitted, table, out=np.zeros_like(table), where=table > 0)
    met = []
    for i, d in enumerate(DIMENSIONS):
        others = tuple(j for j in range(3) if j != i)
        met += zip([d] * len(axes[i]), axes[i], table.sum(others).tolist(), wanted[i].tolist(), fitted.sum(others).tolist())
    return [(*(r[d] for d in DIMENSIONS), float(probability[tuple(at[i][r[d]] for i, d in enumerate(DIMENSIONS))])) for r in pooled], names, met


def pool(column: Column, names: list[str]) -> Column:
    return F.when(column.isin(names), column).otherwise(POOLED)


def uniform(did: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed: 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), did.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def marginals(docs: DataFrame, *, fraction: float = 0.8, alpha: float = 0.9, min_share: float = 1 / 200, targets: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """dimension, name, present, wanted, fitted (tokens), met (within a millionth) of the marginals that mix with these arguments rakes to.

    A marginal is not met if its cells have too few tokens, or if the targets contradict each other. An empty table gives an empty result."""
    spark = prepared(docs.sparkSession)
    rows = described(docs, id_col, text_col, source_col, lang_col, topic_col, tokens_col)
    met = fit(rows, fraction=fraction, alpha=alpha, min_share=min_share, targets=targets)[2]
    out = spark.createDataFrame(met, "dimension string, name string, present double, wanted double, fitted double")
    return out.withColumn("met", F.abs(F.col("wanted") - F.col("fitted")) <= F.lit(1e-6) * F.greatest("wanted", F.lit(1.0)))


def mix(docs: DataFrame, *, fraction: float = 0.8, alpha: float = 0.9, min_share: float = 1 / 200, targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, tokens_col: str | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, weight (1 / probability), sampled of every row of docs.

    Args:
        fraction: expected tokens of the sample over tokens of docs.
        alpha: without targets, marginals are made proportional to present tokens ** alpha.
        min_share: names with less, and without a target, are pooled as '(pooled)'.
        targets: shares by name for 'source', 'lang' or 'topic'; names not given get none.
        topic_col: a column of topics; else TOPICS are matched in the text.
        tokens_col: a column of token counts (null or negative: none); else white-space words are counted.

    Null sources and languages are ''; a null text has no tokens and the probability of its cell (0 in a cell
    without tokens); rows that repeat an id share one draw. An empty table gives an empty result."""
    spark = prepared(docs.sparkSession)
    rows = described(docs, id_col, text_col, source_col, lang_col, topic_col, tokens_col)
    fitted, names, _ = fit(rows, fraction=fraction, alpha=alpha, min_share=min_share, targets=targets)
    table = spark.createDataFrame(fitted, "p_source string, p_lang string, p_topic string, probability double")
    met = [pool(F.col(d), names[d]) == F.col(f"p_{d}") for d in DIMENSIONS]
    out = rows.join(F.broadcast(table), met[0] & met[1] & met[2], "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    drawn = uniform(F.col("did"), seed) < F.col("probability")
    weight = F.when(F.col("probability") > 0, 1 / F.col("probability"))
    return out.select(external_id("did").alias("doc_id"), *DIMENSIONS, "n_tokens", "probability", weight.alias("weight"), drawn.alias("sampled"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", **settings) -> DataFrame:
    """The sampled rows of docs; same columns."""
    kept = mix(docs, id_col=id_col, **settings).where("sampled").select(internal_id("doc_id").alias("did__")).distinct()
    return docs.join(kept, internal_id(id_col) == F.col("did__"), "left_semi")


def _oracle() -> str:
    """The query's rows in SQL: the cells as lists, raked by a recursive query."""
    topic = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{t}'" for t, p in TOPICS.items())
    pools = ", ".join(f"p{d} AS (SELECT {d}, CASE WHEN sum(n_tokens) >= any_value(total) * (1 / 200::DOUBLE) THEN {d} ELSE '{POOLED}' END AS p FROM d, total GROUP BY {d})" for d in DIMENSIONS)
    own = "SELECT {d}, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY {d}"
    sums = ", ".join(f"m{d} AS (SELECT p.p AS {d}, row_number() OVER (ORDER BY p.p) AS i, sum(pow(t, 0.9)) / sum(sum(pow(t, 0.9))) OVER () * 0.8 * any_value(total) AS want FROM ({own.format(d=d)}) AS x JOIN p{d} AS p ON x.{d} = p.{d}, total GROUP BY p.p)" for d in DIMENSIONS)
    order = "ORDER BY " + ", ".join(f"c.{d}" for d in DIMENSIONS)
    step = "SELECT k, f FROM it WHERE k < 300"
    for d in DIMENSIONS:
        step = f"SELECT k, f, list_transform(range(1, len(w{d}) + 1), lambda q: list_sum(list_filter(f, lambda v, j: g{d}[j] = q))) AS s FROM ({step}) AS x, a, t"
        step = f"SELECT k, list_transform(f, lambda v, i: v * w{d}[g{d}[i]] / s[g{d}[i]]) AS f FROM ({step}) AS x, a, t"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'prose' END AS topic,
    len(list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents)
), total AS (SELECT sum(n_tokens)::DOUBLE AS total FROM d), {pools}, c AS (
  SELECT psource.p AS source, plang.p AS lang, ptopic.p AS topic, sum(n_tokens)::DOUBLE AS n
  FROM d JOIN psource ON d.source = psource.source JOIN plang ON d.lang = plang.lang JOIN ptopic ON d.topic = ptopic.topic GROUP BY 1, 2, 3
), {sums}, a AS (
  SELECT list(n {order}) AS cells, {", ".join(f"list(m{d}.i {order}) AS g{d}" for d in DIMENSIONS)}
  FROM c {" ".join(f"JOIN m{d} ON c.{d} = m{d}.{d}" for d in DIMENSIONS)}
), t AS (SELECT {", ".join(f"(SELECT list(want ORDER BY i) FROM m{d}) AS w{d}" for d in DIMENSIONS)}
), it AS (
  SELECT 0 AS k, list_transform(cells, lambda v: v * 0.8 * total / list_sum(cells)) AS f FROM a, total
  UNION ALL
  SELECT k + 1, list_transform(f, lambda v, i: least(v, cells[i])) FROM ({step}) AS x, a
), ranked AS (SELECT c.*, row_number() OVER ({order}) AS i FROM c
), prob AS (SELECT r.source, r.lang, r.topic, CASE WHEN n > 0 THEN f[i] / n ELSE 0 END AS share FROM ranked r, (SELECT f FROM it WHERE k = 300) AS fitted
), u AS (SELECT *, ('0x' || md5('3:' || doc_id)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d)
SELECT doc_id, u.source, u.lang, u.topic, n_tokens, round(share, 6) AS probability, CASE WHEN share > 0 THEN round(1 / share, 6) END AS weight, u < share AS sampled
FROM u JOIN psource ON u.source = psource.source JOIN plang ON u.lang = plang.lang JOIN ptopic ON u.topic = ptopic.topic
  JOIN prob ON prob.source = psource.p AND prob.lang = plang.p AND prob.topic = ptopic.p
"""


ORACLE = _oracle()
