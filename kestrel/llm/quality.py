"""Quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kestrel.llm.names import fresh, own
from kestrel.session import cut, maybe_broadcast

#: Relative width of a sketch's buckets: a quantile is right to 1 %.
GAMMA = 1.02
#: A measure and what is added to it before the logarithm: near zero the scale is linear.
RULES = {"caps": 40, "symbols": 20, "repeats": 250}
#: A group of fewer texts is judged by its language's sketch, and that one by the whole corpus's.
LEAST = 200
#: The fence is q75 * max(q75 / q25, SPREAD) ** REACH.
SPREAD, REACH = 1.25, 3.0


def measures(text: Column) -> dict[str, Column]:
    """Per mille, drawn towards 0 for short texts: capitals and symbols among characters, repeated word triples among triples."""
    size = F.length(text) + 100
    bound = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  (evaluated once, not for every word)
    shared = lambda t: F.floor((F.size(t) - F.size(F.array_distinct(t))) * 1000 / (F.size(t) + 20)).cast("int")
    triples = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, w[i + 1], w[i + 2]))
    words = F.filter(F.split(text, "[ \\t\\n\\r\\f]+"), lambda w: w != "")
    return {
        "caps": F.floor(F.length(F.regexp_replace(text, "[^\\p{Lu}]+", "")) * 1000 / size).cast("int"),
        "symbols": F.floor((F.length(text) - F.length(F.regexp_replace(text, "[^\\p{L}\\p{M}\\p{N} \\t\\n\\r\\f]+", ""))) * 1000 / size).cast("int"),
        "repeats": bound(words, lambda w: bound(triples(w), shared)),
    }


def _measured(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct of the measures, null for a blank text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.withColumn(name, F.when(F.length(F.regexp_replace(text, "[ \\t\\n\\r\\f]+", "")) > 0, F.struct(*(c.alias(k) for k, c in measures(text).items()))))


def sketches(docs: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): a logarithmic histogram per language, source and rule, over all texts that aren't blank.

    Two tables of sketches are merged by adding n for equal keys.
    """
    return _sketched(_measured(docs.select(docs["text"].alias("text"), docs["lang"].alias("lang"), docs["source"].alias("source")), "q"))


def _sketched(rows: DataFrame) -> DataFrame:
    """The sketches of measured rows (lang, source, q)."""
    values = F.array(*(F.struct(F.lit(k).alias("rule"), (F.col(f"q.{k}") + s).alias("v")) for k, s in RULES.items()))
    one = rows.where("q is not null").select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.explode(values).alias("x"))
    return one.groupBy("lang", "source", F.col("x.rule").alias("rule"), F.ceil(F.ln(F.col("x.v")) / math.log(GAMMA)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, n, q25, q75) of sketches merged by keys."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    run = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), F.col("bucket")))
    value = lambda b: F.pow(F.lit(GAMMA), b) * 2 / (GAMMA + 1)
    return run.groupBy(*keys, "rule").agg(F.max("total").alias("n"), value(at(0.25)).alias("q25"), value(at(0.75)).alias("q75"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, level, caps, symbols, repeats): the highest allowed value of each measure.

    level is 2 where the group has LEAST texts, 1 where only its language has
    (sketches of all sources merged), else 0 (all merged). Null languages and
    sources are groups of their own.
    """
    fence = lambda d: F.col(f"{d}.q75") * F.pow(F.greatest(F.col(f"{d}.q75") / F.col(f"{d}.q25"), F.lit(SPREAD)), F.lit(REACH))
    own, by_lang, every = _quantiles(sketch, ["lang", "source"]).alias("a"), _quantiles(sketch, ["lang"]).alias("b"), _quantiles(sketch, []).alias("c")
    joined = own.join(by_lang, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.rule") == F.col("b.rule"))).join(F.broadcast(every), F.col("a.rule") == F.col("c.rule"))  # c has one row a rule
    level = F.when(F.col("a.n") >= LEAST, 2).when(F.col("b.n") >= LEAST, 1).otherwise(0)
    limit = F.when(F.col("a.n") >= LEAST, fence("a")).when(F.col("b.n") >= LEAST, fence("b")).otherwise(fence("c"))
    rows = joined.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("a.rule").alias("rule"), level.alias("level"), limit.alias("limit"))
    pick = lambda r: F.max(F.when(F.col("rule") == r, F.col("limit") - RULES[r])).alias(r)
    return rows.groupBy("lang", "source").agg(F.max("level").alias("level"), *(pick(r) for r in RULES))


def _judged(rows: DataFrame, sketch: DataFrame, q: str, t: str, keep: str) -> DataFrame:
    """Measured rows with the thresholds t and the verdict keep; a measure at its threshold is fine."""
    lang, source = fresh([*rows.columns, t, keep], "lang_of", "source_of")
    limits = maybe_broadcast(cut(thresholds(sketch), "thresholds").select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct("level", *RULES).alias(t)))
    joined = rows.join(limits, rows["lang"].cast("string").eqNullSafe(limits[lang]) & rows["source"].cast("string").eqNullSafe(limits[source]), "left")
    fine = F.lit(True)
    for r in RULES:
        fine = fine & (F.col(f"{q}.{r}") <= F.col(f"{t}.{r}"))
    return joined.withColumn(keep, F.coalesce(fine, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, caps, symbols, repeats, level, keep): each row's measures, which thresholds judged it, and whether it stays.

    A null or blank text has null measures and doesn't stay; one whose measure
    equals its threshold stays. A null language or source is a group of its
    own. Very long texts are measured whole. Repeated rows are judged alike
    and all returned; an empty table gives an empty one; other columns are
    ignored. Texts are read once: their measures go through a table.
    """
    some = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].alias("lang"), docs["source"].alias("source"))
    rows = cut(_measured(some, "q").drop("text"), "measures")
    d = _judged(rows, _sketched(rows), "q", "t", "keep")
    return d.select("doc_id", *(F.col(f"q.{r}").alias(r) for r in RULES), F.when(F.col("q").isNotNull(), F.col("t.level")).alias("level"), "keep")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    Nulls, blanks, ties, repeated rows, very long texts and empty tables are
    treated as there; columns may have any names. Texts are measured once:
    rows go through a table with their measures.
    """
    q, t, keep = fresh(docs.columns, "q", "t", "keep")
    made = _measured(docs, q)
    rows = cut(made.toDF(*(f"c{i}" for i in range(len(made.columns)))), "measured").toDF(*made.columns)
    sketch = _sketched(rows.select(rows["lang"].alias("lang"), rows["source"].alias("source"), F.col(q).alias("q")))
    return _judged(rows, sketch, q, t, keep).where(F.col(keep)).select(*own(docs))


def _sql_measures() -> str:
    return r"""
  measured AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, length(coalesce(text, '')) + 100 AS size,
           list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f]+'), lambda w: w <> '') AS w FROM documents),
  triples AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS t FROM measured),
  m AS (
    SELECT doc_id, lang, source, len(w) > 0 AS solid,
           floor(length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) * 1000 / size)::INT AS caps,
           floor((length(text) - length(regexp_replace(text, '[^\p{L}\p{M}\p{N} \t\n\r\f]+', '', 'g'))) * 1000 / size)::INT AS symbols,
           floor((len(t) - len(list_distinct(t))) * 1000 / (len(t) + 20))::INT AS repeats FROM triples)"""


def oracle_sql() -> str:
    """DuckDB SQL for quality_rules(documents)."""
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, ceil(ln({r} + {s}) / ln({GAMMA}))::INT AS bucket FROM m WHERE solid" for r, s in RULES.items())
    level = lambda keys: f"""(SELECT {keys} rule, max(total) AS n,
      pow({GAMMA}, min(CASE WHEN upto > floor(0.25 * (total - 1)) THEN bucket END)) * 2 / ({GAMMA} + 1) AS q25,
      pow({GAMMA}, min(CASE WHEN upto > floor(0.75 * (total - 1)) THEN bucket END)) * 2 / ({GAMMA} + 1) AS q75
      FROM (SELECT {keys} rule, bucket, sum(n) OVER (PARTITION BY {keys} rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys} rule) AS total
            FROM (SELECT {keys} rule, bucket, count(*) AS n FROM long GROUP BY ALL)) GROUP BY {keys} rule)"""  # noqa: E731
    fence = lambda a: f"{a}.q75 * pow(greatest({a}.q75 / {a}.q25, {SPREAD}), {REACH})"
    picks = ", ".join(f"max(CASE WHEN rule = '{r}' THEN lim - {s} END) AS {r}_most" for r, s in RULES.items())
    return f"""WITH {_sql_measures()},
  long AS ({long}),
  judged AS (SELECT a.lang, a.source, a.rule, CASE WHEN a.n >= {LEAST} THEN 2 WHEN b.n >= {LEAST} THEN 1 ELSE 0 END AS level,
             CASE WHEN a.n >= {LEAST} THEN {fence('a')} WHEN b.n >= {LEAST} THEN {fence('b')} ELSE {fence('c')} END AS lim
           FROM {level('lang, source,')} a JOIN {level('lang,')} b ON a.lang IS NOT DISTINCT FROM b.lang AND a.rule = b.rule JOIN {level('')} c ON a.rule = c.rule),
  most AS (SELECT lang, source, max(level) AS level, {picks} FROM judged GROUP BY lang, source)
  SELECT doc_id, CASE WHEN solid THEN caps END AS caps, CASE WHEN solid THEN symbols END AS symbols, CASE WHEN solid THEN repeats END AS repeats,
         CASE WHEN solid THEN level END AS level, coalesce(solid AND {' AND '.join(f'{r} <= {r}_most' for r in RULES)}, false) AS keep
  FROM m LEFT JOIN most ON m.lang IS NOT DISTINCT FROM most.lang AND m.source IS NOT DISTINCT FROM most.source"""
