"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Token masses by cell (source, language, topic) are raked to target marginals;
each cell's ratio of raked to actual share, scaled to the token budget and
capped at 1, is the probability with which its documents are drawn. Built-in
functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Marginal shares are the actual ones raised to this power and scaled to 1: below 1, small levels gain.
POWERS: Mapping[str, float] = {"source": 0.5, "lang": 0.7, "topic": 0.9}
RATE, ROUNDS, CAP_STEPS, SEED = 0.5, 10, 8, "mix-1"
#: Topics by the first rule that holds: name and a SQL condition on ``text``.
TOPICS = (("empty", "coalesce(text, '') = ''"), ("tabular", "instr(text, ' | ') > 0"),
          ("legal", "instr(lower(text), 'license') > 0 or instr(lower(text), 'copyright') > 0"),
          ("contact", "instr(text, '@') > 0"))
OTHER = "prose"


def topic() -> Column:
    rule = F
    for name, condition in TOPICS:
        rule = rule.when(F.expr(condition), name)
    return rule.otherwise(OTHER)


def token_weight() -> Column:
    """White-space separated words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def rake(cells: DataFrame, powers: Mapping[str, float], rounds: int, scratch: Scratch) -> DataFrame:
    """Cells with ``share`` (actual) and ``w`` (raked share); ``cells`` has the dimensions and ``mass``.

    A cell without mass keeps 0. Windows run over cells, which are aggregates:
    a hot source is as many rows as it has languages and topics.
    """
    total = cells.agg(F.sum("mass")).first()[0] or 0
    share = F.col("mass") / F.lit(float(total) or 1.0)
    cells = cells.withColumn("share", share).withColumn("w", F.col("share"))
    for d, power in powers.items():
        level = F.pow(F.sum("share").over(Window.partitionBy(d)), F.lit(float(power)))
        cells = cells.withColumn(f"__t_{d}", level)
    cells = scratch.put(cells, "cells0")
    for d in powers:
        goal = cells.groupBy(d).agg(F.first(f"__t_{d}").alias("t")).agg(F.sum("t")).first()[0]
        cells = cells.withColumn(f"__t_{d}", F.col(f"__t_{d}") / F.lit(float(goal or 1.0)))
    for i in range(rounds):
        for d in powers:
            have = F.sum("w").over(Window.partitionBy(d))
            cells = cells.withColumn("w", F.when(have > 0, F.col("w") * F.col(f"__t_{d}") / have).otherwise(F.lit(0.0)))
        if i % 2 or i == rounds - 1:
            cells = scratch.put(cells, f"cells{i + 1}")
    return cells.drop(*[f"__t_{d}" for d in powers])


def calibrate(cells: DataFrame, rate: float, steps: int) -> DataFrame:
    """Cells with ``ratio`` (raked over actual share) and ``prob``: the ratio scaled to the budget, 1 at most.

    The scale is raised ``steps`` times by what capped cells leave over; only
    two sums a step reach the driver.
    """
    cells = cells.withColumn("ratio", F.when(F.col("share") > 0, F.col("w") / F.col("share")).otherwise(F.lit(0.0)))
    scale = rate
    for _ in range(steps):
        capped = F.col("ratio") * F.lit(scale) >= 1
        full, rest = cells.agg(F.sum(F.when(capped, F.col("share")).otherwise(0.0)),
                               F.sum(F.when(capped, 0.0).otherwise(F.col("w")))).first()
        if not rest:
            break
        scale = max(rate - full, 0.0) / rest
    return cells.withColumn("prob", F.round(F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)), 9))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the id alone; rows of one id are drawn together."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0 ** 32


def probabilities(rows: DataFrame, scratch: Scratch, powers: Mapping[str, float], rate: float, rounds: int, steps: int) -> DataFrame:
    """Dimensions (as ``__name``), ratio and prob of each cell of ``rows`` (dimensions and tokens), written."""
    cells = rows.groupBy(*powers).agg(F.sum("tokens").alias("mass"))
    cells = calibrate(rake(cells, powers, rounds, scratch), rate, steps)
    return scratch.put(cells.select(*[F.col(d).alias(f"__{d}") for d in powers], F.col("ratio").alias("__ratio"),
                                    F.col("prob").alias("__prob")), "cells")


def mix(docs: DataFrame, powers: Mapping[str, float] = POWERS, rate: float = RATE, rounds: int = ROUNDS,
        steps: int = CAP_STEPS, seed: str = SEED) -> DataFrame:
    """Every row's doc_id, source, lang, topic, tokens, weight, prob and sampled.

    A null source or language is a level of its own. Null and empty texts
    weigh 0 tokens; a cell of only such texts has probability 0. Repeated rows
    count and are drawn each by its id; a null id is drawn as an empty one. An
    empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put(docs.select("doc_id", "source", "lang", topic().alias("topic"), token_weight().alias("tokens")), "rows")
    cells = probabilities(rows, scratch, powers, rate, rounds, steps)
    out = rows.join(cells, [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in powers], "left")
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("__ratio", 6).alias("weight"),
                      F.round("__prob", 6).alias("prob"), (draw(F.col("doc_id"), seed) < F.col("__prob")).alias("sampled"))


def sample(docs: DataFrame, powers: Mapping[str, float] = POWERS, rate: float = RATE, rounds: int = ROUNDS,
           steps: int = CAP_STEPS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, that ``mix`` draws."""
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = scratch.put(docs.select("source", "lang", topic().alias("topic"), token_weight().alias("tokens")), "rows")
    cells = probabilities(rows, scratch, powers, rate, rounds, steps)
    scratch.drop("rows")
    own = {d: topic() if d == "topic" else F.col(d) for d in powers}
    out = docs.select("*", *[c.alias(f"__own_{d}") for d, c in own.items()])
    out = out.join(cells, [F.col(f"__own_{d}").eqNullSafe(F.col(f"__{d}")) for d in powers], "left")
    return out.where(draw(F.col("doc_id"), seed) < F.col("__prob")).select(*docs.columns)
