"""Mix sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic) of tokens. The cells' weights are raked: in
turn each margin's sums are scaled to its targets, until all agree. A weight may not exceed
tokens / rate, so that every cell's probability rate * weight / tokens is at most 1; what the bound
cuts off is made up by the other cells of the margin in later rounds. Documents are then
drawn with their cell's probability by a seeded hash of their id.

Cells and margins are tables; a round is three groupings with map-side sums, each joined back to the
cells, and only its largest deviation and change reach the driver. A source of a third of all rows is
one row per task after the first sum.

Tokens are words. Targets are tables (value, share). Values without a target keep their observed
share, targets without documents are left out, and the shares of a margin are scaled to sum to 1.
NULL is a value like any other. Defined results: texts without words have weight 0 and
probability ``rate``. Rows with equal ids are drawn alike. An empty table gives an empty result; other
columns are ignored. Raking ends when all values that their tokens / rate can reach are met; values
beyond that do not hold it up or end it. Targets that the cells cannot meet together end with the weights reached
when the margins' sums stand still (SETTLED of the tolerance), or after ROUNDS rounds. Values that are
not met are in ``unmet``, and are logged.
"""

from __future__ import annotations

import logging

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import words
from longspan.session import cut_lineage

MARGINS = ("source", "lang", "topic")
RATE = 0.6
ROUNDS = 400
TOLERANCE = 1e-3
SETTLED = 1e-2
LOGGED = 20
SEED = 20
# The production mix. Sources and topics follow tokens ** POWER, which lifts small ones.
LANGUAGES = {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.12}
POWER = 0.9


def surface_topic(text: str, n_words: int) -> str:
    """Genre of a text by its surface, as the tables name no topic."""
    if 5 * text.count(" | ") > n_words:
        return "listing"
    if 10 * sum(map(text.count, "#*$%&<>{}=")) > n_words:
        return "markup"
    if 50 * sum(map(text.count, "0123456789")) > len(text):
        return "records"
    return "notes" if n_words < 100 else "prose"


def _measured(batches):  # type: ignore[no-untyped-def]
    for batch in batches:
        tokens, topics = [], []
        for text in batch["text"].to_pylist():
            n = len(words(text))
            tokens.append(n)
            topics.append(surface_topic(text, n) if text else None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["source"], batch["lang"], pa.array(topics, pa.string()), pa.array(tokens, pa.int64())],
            ["doc_id", "source", "lang", "topic", "tokens"],
        )


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of every row."""
    own = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("source", "lang", "text")])
    return own.mapInArrow(_measured, "doc_id long, source string, lang string, topic string, tokens long")


def _key(name: str) -> Column:
    """Joinable also where the value is NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def shares(cells: DataFrame, name: str, targets: DataFrame) -> DataFrame:
    """(key, goal, seen): the margin's target tokens and its own, over the values that occur."""
    observed = cells.groupBy(name).agg(F.sum("tokens").alias("seen"))
    wanted = targets.select(_key("value").alias("wanted"), F.col("share").cast("double").alias("share")).groupBy("wanted").agg(F.sum("share").alias("share"))
    total = cells.agg(F.sum("tokens").alias("all_tokens"))
    share = F.coalesce("share", F.col("seen") / F.col("all_tokens"))
    # One row of totals each; the cross joins only attach it.
    own = observed.join(wanted, F.col(name) == F.col("wanted"), "left").join(F.broadcast(total)).select(name, "all_tokens", "seen", share.alias("share"))
    scale = own.agg(F.sum("share").alias("sum_share"))
    return own.join(F.broadcast(scale)).select(
        name, (F.col("share") / F.col("sum_share") * F.col("all_tokens")).alias(f"{name}_goal"), F.col("seen").alias(f"{name}_seen")
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], rate: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (margins as keys, tokens > 0) with ``weight``, whose margin sums meet the targets, and the goals."""
    weighted = cells.withColumn("weight", F.least(F.col("tokens").cast("double"), F.col("tokens") / rate))
    for name, table in targets.items():
        weighted = weighted.join(shares(cells, name, table), name).withColumn(f"{name}_before", F.lit(None).cast("double"))
    goals = [f"{name}_goal" for name in targets]
    seen = [f"{name}_seen" for name in targets]
    weighted = cut_lineage(weighted)
    for _ in range(rounds):
        weighted = weighted.withColumns({"deviation": F.lit(0.0), "change": F.lit(0.0)})
        for name in targets:
            sums = weighted.groupBy(name).agg(F.sum("weight").alias("now"))
            goal, before = F.col(f"{name}_goal"), F.col(f"{name}_before")
            factor = goal / F.col("now")
            # A value whose bounds add up to less than its goal stays off in every round.
            off = F.when(goal <= F.col(f"{name}_seen") / rate, F.abs(factor - 1)).otherwise(0.0)
            moved = F.when(before.isNull(), F.lit(float("inf"))).when(goal > 0, F.abs(F.col("now") - before) / goal).otherwise(0.0)
            others = [f"{other}_before" for other in targets if other != name]
            # Each step reads the weights twice, so it becomes a table: chained, the plan would double each time.
            weighted = cut_lineage(
                weighted.join(sums, name).select(
                    *cells.columns, *goals, *seen, *others, F.col("now").alias(f"{name}_before"),
                    F.least(F.col("weight") * factor, F.col("tokens") / rate).alias("weight"),
                    F.greatest("deviation", off).alias("deviation"), F.greatest("change", moved).alias("change"),
                )
            )
        largest = weighted.agg(F.max("deviation").alias("deviation"), F.max("change").alias("change")).first()
        if largest.deviation is None or largest.deviation <= tolerance or largest.change <= SETTLED * tolerance:
            break
    return weighted.select(*cells.columns, "weight", *goals)


def unmet(raked: DataFrame, names: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(margin, value as key, goal, reached) of the values whose weights miss their goal."""
    parts = [
        raked.groupBy(F.lit(name).alias("margin"), F.col(name).alias("value")).agg(F.max(f"{name}_goal").alias("goal"), F.sum("weight").alias("reached"))
        for name in names
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.abs(F.col("reached") - F.col("goal")) > tolerance * F.col("goal"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and sampled of every row.

    ``targets`` has a table (value, share) for any of source, lang and topic; None is the production mix.
    """
    rows = cut_lineage(measured(docs).select("*", *[_key(name).alias(f"{name}_key") for name in MARGINS]))
    keys = [f"{name}_key" for name in MARGINS]
    cells = cut_lineage(rows.where("tokens > 0").groupBy(*keys).agg(F.sum("tokens").alias("tokens")).toDF(*MARGINS, "tokens"))
    given = targets if targets is not None else production_targets(cells)
    raked = rake(cells, {name: given[name] for name in MARGINS if name in given}, rate)
    missed = unmet(raked, [name for name in MARGINS if name in given]).orderBy("margin", "value").limit(LOGGED + 1).collect() if given else []
    for row in missed[:LOGGED]:
        logging.getLogger(__name__).warning("%s %s: goal %.0f tokens, reached %.0f", row.margin, row.value, row.goal, row.reached)
    if len(missed) > LOGGED:
        logging.getLogger(__name__).warning("further values miss their goals")
    chances = raked.select(*[F.col(name).alias(f"{name}_key") for name in MARGINS], F.round(F.lit(rate) * F.col("weight") / F.col("tokens"), 9).alias("chance"))
    probability = F.when(F.col("tokens") > 0, F.col("chance")).otherwise(F.lit(float(rate)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1).cast("long"))), 11) / F.lit(float(1 << 53))
    return (
        rows.join(chances, keys, "left")
        .withColumn("probability", probability)
        .select("doc_id", *MARGINS, "tokens", "probability", (draw < F.col("probability")).alias("sampled"))
    )


def damped(cells: DataFrame, name: str) -> DataFrame:
    """(value, share) in proportion to tokens ** POWER."""
    sizes = cells.groupBy(name).agg(F.sum("tokens").alias("n"))
    # Keys carry a leading mark, which targets do not; NULL has none and keeps its share.
    parts = sizes.where(F.col(name) != "").select(F.expr(f"substring({name}, 2)").alias("value"), F.pow("n", F.lit(POWER)).alias("part"))
    total = parts.agg(F.sum("part").alias("parts"))
    return parts.join(F.broadcast(total)).select("value", (F.col("part") / F.col("parts")).alias("share"))


def production_targets(cells: DataFrame) -> dict[str, DataFrame]:
    lang = cells.sparkSession.createDataFrame(list(LANGUAGES.items()), "value string, share double")
    return {"source": damped(cells, "source"), "lang": lang, "topic": damped(cells, "topic")}
