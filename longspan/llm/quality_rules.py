"""Quality rules: rule statistics of each text, and an isolation forest over them.

A tree divides the declared space of the statistics by random splits and stops where at most one
fitting row is left, so a text in a region that clean texts do not reach has a short path. Splits
are drawn from the range of the *cell* (seen over clean and bad labelled rows), not of the clean rows
in it: a statistic that is 0 in every clean text then still isolates the texts where it is not.

The forest is fitted on at most FIT_ROWS different labelled rows, those with the smallest hash; rows above a
bound computed from their number stay on the executors. This limit is the only one. The threshold covers all labelled rows: mean path lengths are rounded to
1/SCALE, counted by label in one grouping, and the cut that best separates the labels (a lost clean text weighs as CLEAN_WEIGHT bad ones) is taken, the
lower one of equals. Rows that the base rules reject take no part in either.

Defined results: NULL and empty texts have no words and fail the base rules. Rows keep their ids,
also NULL or repeated ones. Labels without a quality, and labels of unknown ids, count for nothing; a
repeated label counts as often as it stands. Without labels of both kinds the verdict is to keep.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspan.llm.common import doc_text, gram_hashes, word_hashes, words
from longspan.session import cut_lineage

FIT_ROWS = 16_384
SLACK = 1.05
TREES = 100
PER_TREE = 1024
DEPTH = 16
SCALE = 100
CLEAN_WEIGHT = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
REPEAT = 8

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The counts of _COUNTS for one whole text."""
    text = text or ""
    tokens = words(text)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    hashes = word_hashes(tokens)
    repeated = 0
    windows = gram_hashes(hashes, REPEAT)
    if len(windows):
        _, group, times = np.unique(windows, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[group] > 1)
        if len(starts):
            edge = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + REPEAT, -1)
            repeated = int((np.cumsum(edge) > 0).sum())
    return len(tokens), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), len(set(tokens))


def _count(batches):  # type: ignore[no-untyped-def]
    for batch in batches:
        rows = [rule_counts(text) for text in batch["text"].to_pylist()]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_COUNTS))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *_COUNTS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and base_failed: too short, or mostly repeated."""
    counts = doc_text(docs).mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return counts.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def features(batch) -> np.ndarray:  # type: ignore[no-untyped-def]
    """Scale-free statistics, one row per document; symbols on a root scale, as few already tell."""
    n, chars, symbols, dup, repeat, lines, distinct = (np.asarray(batch[c], np.float64) for c in _COUNTS)
    n, lines = np.maximum(n, 1), np.maximum(lines, 1)
    return np.stack([np.minimum(np.sqrt(symbols / n), 2.0), chars / n, repeat / n, dup / lines, distinct / n], axis=1)


def _rest(n: int) -> float:
    """Mean path length of n rows that are not divided any more."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays: per node the statistic (-1 at a leaf), split or path length, and its left child; the right one follows."""

    def __init__(self, clean: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 0):
        self.trees = []
        rng = np.random.default_rng(seed)
        for _ in range(TREES):
            rows = clean[rng.choice(len(clean), min(PER_TREE, len(clean)), replace=False)]
            self.trees.append(self._grown(rows, low, high, rng))

    @staticmethod
    def _grown(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> tuple[np.ndarray, ...]:  # type: ignore[no-untyped-def]
        feature, value, left = [-1], [0.0], [0]
        todo = [(0, rows, low, high, 0)]
        while todo:
            node, inside, lo, hi, depth = todo.pop()
            open_ = np.flatnonzero(hi > lo)
            if len(inside) < 2 or depth == DEPTH or not len(open_):
                value[node] = depth + _rest(len(inside))
                continue
            f = int(rng.choice(open_))
            split = rng.uniform(lo[f], hi[f])
            below = inside[:, f] < split
            feature[node], value[node], left[node] = f, split, len(feature)
            for part, edge in ((inside[below], hi), (inside[~below], lo)):
                cut = edge.copy()
                cut[f] = split
                todo.append((len(feature), part, lo if edge is hi else cut, cut if edge is hi else hi, depth + 1))
                feature.append(-1)
                value.append(0.0)
                left.append(0)
        return np.array(feature, np.int8), np.array(value), np.array(left, np.int32)

    def path_length(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length, in units of 1/SCALE."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, value, left in self.trees:
            node = np.zeros(len(rows), np.int32)
            for _ in range(DEPTH):
                f = feature[node]
                step = left[node] + (rows[each, np.maximum(f, 0)] >= value[node])
                node = np.where(f < 0, node, step)
            total += value[node]
        return np.rint(SCALE * total / len(self.trees)).astype(np.int64)


def fit_forest(labelled: DataFrame) -> IsolationForest | None:
    """From rows of rule statistics with ``quality``; None without rows of both kinds."""
    columns = ("doc_id", *_COUNTS, "quality")
    # Equal rows would share a hash and pass the bound together, however many they are.
    ranked = cut_lineage(labelled.select(*columns).distinct().withColumn("rank", F.shiftrightunsigned(F.xxhash64(*columns), 11)))
    # Some more than FIT_ROWS rows are under the bound, in all partitions together.
    bound = min(1.0, SLACK * FIT_ROWS / max(1, ranked.count())) * 2**53
    sample = ranked.where(F.col("rank") < bound).orderBy("rank", *columns).limit(FIT_ROWS).toPandas()
    good = sample["quality"].to_numpy() == 1
    if good.all() or not good.any():
        return None
    table = features(sample)
    return IsolationForest(table[good], table.min(axis=0), table.max(axis=0))


def _scored(forest: IsolationForest):  # type: ignore[no-untyped-def]
    def score(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            lengths = forest.path_length(features({c: batch[c].to_numpy() for c in _COUNTS}))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths, pa.int64())], [*batch.schema.names, "path_length"])

    return score


def threshold(counts: list[tuple[int, int, int]]) -> int:
    """Path length from which a row is kept, of rows (path length, quality, count)."""
    total = {q: max(1, sum(n for _, k, n in counts if k == q)) for q in (0, 1)}
    best, at, gain = 0.0, 0, 0.0
    lengths = sorted({p for p, _, _ in counts})
    by = {(p, q): n for p, q, n in counts}
    for i, p in enumerate(lengths):
        gain += by.get((p, 0), 0) / total[0] - CLEAN_WEIGHT * by.get((p, 1), 0) / total[1]
        if gain > best:
            # Between the two scores, so that rows like the nearest kept ones are kept.
            best, at = gain, (p + lengths[i + 1]) // 2 + 1 if i + 1 < len(lengths) else p + 1
    return at


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule counts, base_failed, kept, path_length; one row per input row."""
    # Read by the fit, the calibration and the verdict; a few numbers per document.
    stats = cut_lineage(rule_statistics(docs))
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)")
    labelled = cut_lineage(stats.where("NOT base_failed").join(marks, F.col("doc_id") == F.col("label_id")).drop("label_id"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean"
    forest = fit_forest(labelled)
    if forest is None:
        scored, cut = stats.withColumn("path_length", F.lit(None).cast("long")), None
    else:
        seen = labelled.mapInArrow(_scored(forest), schema + ", quality int, path_length long").groupBy("path_length", "quality").count()
        cut = threshold([tuple(r) for r in seen.collect()])  # at most SCALE * (DEPTH + 20) lengths for each label
        scored = stats.mapInArrow(_scored(forest), schema + ", path_length long")
    verdict = F.lit(True) if cut is None else F.col("path_length") >= cut
    return scored.withColumn("kept", ~F.col("base_failed") & verdict).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "path_length"
    )
