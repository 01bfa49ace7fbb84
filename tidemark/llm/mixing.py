"""Mixing sources to target weights by iterative proportional fitting (operator 3), in DataFrame functions only.

Token weights are summed into cells (source, language, topic). Raking multiplies the cell weights, one dimension after the
other, by target share over present share until all three marginals fit. A document is kept with the probability
min(1, ratio / scale), ratio being its cell's raked weight over its tokens; a hash of its id decides, so a rerun keeps the same
documents. Cells with a ratio above the scale are kept whole and lack the rest of their target tokens; the scale is the least one at
which all these together lack at most `missing` of the target tokens. So no rare cell sets the yield of the whole table, and the
distribution of the kept tokens over cells is at most `missing` / (1 - `missing`) from the raked one (half the sum of absolute
differences). With `missing` 0 the scale is the largest ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
#: Rounds of raking, and how far each target leans from the present shares (1) to equal shares (0).
ROUNDS, LEAN = 8, 0.8
#: The share of target tokens that cells kept whole may lack; for a sample of a corpus also how far the raked marginals may be from their
#: targets (half the sum of absolute differences of shares), and the most rounds spent on that.
MISSING, FIT, MOST_ROUNDS = 0.01, 1e-3, 80
#: Candidates for the bound are the largest ratio times 2 ** (-k / BOUND_STEPS), k up to BOUNDS.
BOUND_STEPS, BOUNDS = 16, 640
#: Up to so many cells are raked in one task, where no window needs an exchange; more are dealt by their dimensions.
CELLS_AT_ONCE = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic for tables that carry none, from marks in the text."""
    return F.when(text.contains(" | "), "table").when(text.rlike("[$%&*#]{3}"), "symbols").when(text.rlike("!!"), "loud").when(text.rlike("[0-9]"), "numbers").otherwise("prose")


def cells_of(docs: DataFrame, id_col: str, text_col: str, seed: int) -> DataFrame:
    have = set(docs.columns)
    text = text_or_empty(text_col)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    topic = plain("topic") if "topic" in have else topic_of(text)
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return docs.select(F.col(id_col).alias("doc_id"), plain("source").alias("source"), plain("lang").alias("lang"), topic.alias("topic"), (F.regexp_count(text, F.lit(WORD)) + 1).cast("long").alias("tokens"), draw.alias("draw"))


def misfit(cells: DataFrame) -> float:
    """The largest distance of a marginal of the cells' weights from its goal: half the sum of absolute differences of shares."""
    worst = 0.0
    for d in DIMENSIONS:
        sides = cells.groupBy(d).agg(F.sum("weight").alias("w"), F.first(f"goal_{d}").alias("g"))
        w, g = sides.agg(F.sum("w"), F.sum("g")).first()
        if not w or not g:
            return 0.0
        worst = max(worst, sides.agg(F.sum(F.abs(F.col("w") / w - F.col("g") / g))).first()[0] / 2)
    return worst


def bound_of(raked: DataFrame, most: float, missing: float) -> float:
    """The least candidate for the scale at which cells of a larger ratio lack at most `missing` of the raked weight."""
    k = F.explode(F.sequence(F.lit(0), F.lit(BOUNDS))).alias("k")
    bound = F.lit(most) * F.pow(F.lit(2.0), -F.col("k") / BOUND_STEPS)
    lacks = raked.select("weight", "tokens", k).groupBy("k").agg((F.sum(F.greatest(F.lit(0.0), F.col("weight") - bound * F.col("tokens"))) / F.sum("weight")).alias("lack"))
    last = lacks.where(F.col("lack") <= missing).agg(F.max("k")).first()[0] or 0
    return most * 2.0 ** (-last / BOUND_STEPS)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, lean: float, fit: float | None = None) -> DataFrame:
    """Cells with `weight` raked to the targets. A dimension without targets leans its own shares towards equal ones.

    With `fit`, rounds go on in blocks of `rounds` until no marginal is farther from its target, at most MOST_ROUNDS.

    Given targets that still do not fit after MOST_ROUNDS contradict each other, which is an error.
    Values that the given targets do not name get none of the tokens; targets for values that do not occur are left out
    and the rest scaled up.
    """
    for d in DIMENSIONS:
        here = F.sum("tokens").over(Window.partitionBy(d))
        if d in targets:
            share = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets[d].items() for x in kv]), F.col(d)), F.lit(0.0)) if targets[d] else F.lit(0.0)
        else:
            share = F.pow(here.cast("double"), F.lit(lean))
        cells = cells.withColumn(f"goal_{d}", share)
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    done = 0
    while True:
        for i in range(rounds):
            for d in DIMENSIONS:
                now = F.sum("weight").over(Window.partitionBy(d))
                cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"goal_{d}") / now).otherwise(0.0))
            if i % 4 == 3:
                cells = cut(cells)
        done += max(1, rounds)
        if fit is None or misfit(cells) <= fit:
            return cells
        if done >= MOST_ROUNDS:
            if targets:
                raise ValueError(f"after {done} rounds of raking a marginal is still farther than {fit} from its target: the targets contradict each other on these cells")
            return cells


def mix(docs: DataFrame, *, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, lean: float = LEAN, seed: int = 11, missing: float = MISSING, fit: float | None = None) -> DataFrame:
    """Each document with its cell, token weight, calibrated probability and whether it is in the sample.

    Returns doc_id, source, lang, topic, tokens, probability, sampled.

    Defined cases: null source, language or topic is the empty string, a stratum of its own; a null or empty text weighs
    one token, any other its words plus one; a missing topic column is derived from the text, a missing source or lang is
    one stratum; rows that repeat an id share their fate; a null id draws like an empty one; an empty table gives no rows.
    Other columns are ignored.
    """
    rows = cells_of(docs, id_col, text_col, seed)
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    if cells.count() <= CELLS_AT_ONCE:
        cells = cells.coalesce(1)
    raked = cut(rake(cells, targets or {}, rounds, lean, fit).select(*DIMENSIONS, "tokens", "weight", (F.col("weight") / F.col("tokens")).alias("ratio")))
    most = raked.agg(F.max("ratio").alias("most")).first()["most"] or 1.0
    if missing > 0:
        most = bound_of(raked, most, missing)

    chance = F.least(F.lit(1.0), F.col("ratio") / F.lit(most))
    return rows.join(raked.select(*DIMENSIONS, "ratio"), list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", F.round(chance, 9).alias("probability"), (F.col("draw") < chance).alias("sampled"))


def sample_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents in the sample, with all their columns; rakes until the marginals fit."""
    id_col = options.get("id_col", "doc_id")
    chosen = mix(docs, **{"fit": FIT} | options).where("sampled").select(F.col("doc_id").alias("_chosen")).distinct()
    return docs.join(chosen, docs[id_col].eqNullSafe(chosen["_chosen"]), "left_semi")


def oracle(rounds: int = ROUNDS, lean: float = LEAN, seed: int = 11, missing: float = MISSING) -> str:
    """The same in ANSI SQL for DuckDB, with one step after another for the raking."""
    steps, last = [], "cells"
    for i in range(rounds):
        for d in DIMENSIONS:
            name = f"r{i}_{d}"
            steps.append(f"{name} AS (SELECT * REPLACE (weight * goal_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM {last})")
            last = name
    goals = ", ".join(f"pow(CAST(sum(sum(w)) OVER (PARTITION BY {d}) AS DOUBLE), {lean}) AS goal_{d}" for d in DIMENSIONS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
rows_ AS (SELECT doc_id, source, lang,
  CASE WHEN contains(t, ' | ') THEN 'table' WHEN regexp_matches(t, '[$%&*#]{{3}}') THEN 'symbols' WHEN contains(t, '!!') THEN 'loud' WHEN regexp_matches(t, '[0-9]') THEN 'numbers' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all(t, '[^ \\t-\\r]+')) + 1 AS BIGINT) AS w,
  CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{seed}'), 1, 12) AS BIGINT) AS DOUBLE) / {float(1 << 48)} AS draw FROM docs),
cells AS (SELECT source, lang, topic, sum(w) AS tokens, CAST(sum(w) AS DOUBLE) AS weight, {goals} FROM rows_ GROUP BY source, lang, topic),
{', '.join(steps)},
raked AS (SELECT source, lang, topic, tokens, weight, weight / tokens AS ratio FROM {last}),
bounds AS (SELECT k, (SELECT max(ratio) FROM raked) * pow(CAST(2 AS DOUBLE), -k / CAST({BOUND_STEPS} AS DOUBLE)) AS bound FROM range({BOUNDS} + 1) AS r(k)),
lacks AS (SELECT k, bound, sum(greatest(0, weight - bound * tokens)) / sum(weight) AS lack FROM raked CROSS JOIN bounds GROUP BY k, bound),
scale AS (SELECT min(bound) AS bound FROM lacks WHERE lack <= {missing}),
chances AS (SELECT source, lang, topic, least(CAST(1 AS DOUBLE), ratio / (SELECT bound FROM scale)) AS chance FROM raked)
SELECT doc_id, source, lang, topic, w AS tokens, round(chance, 9) AS probability, draw < chance AS sampled
FROM rows_ JOIN chances USING (source, lang, topic)"""
