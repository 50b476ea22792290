"""Language identification by Bayesian evidence fusion.

For each page and language four factors multiply to the posterior:

* text: likelihood of the main text's character n-grams (orders 1 to 3, hashed), from a model counted
  over all labelled documents in bounded tables per task, tree-added to one of the same size;
* declared language of the html element: P(declared | language);
* address suffix: P(suffix | language);
* host prior: P(language | host), smoothed by its site's, and that by the whole corpus's.

The last three come from grouped sums of the text posteriors over all pages, in whole millionths
so that sums do not depend on order. A page's own part is taken off the host and site sums first
(leave one out), so that its text does not count twice.

Defined results: NULL or empty texts have even text likelihoods, and the other evidence decides. A missing
declaration, suffix or host is a value like any other. Equal posteriors go to the language that is first in
the alphabet. Without any labelled document the language is NULL. Rows keep their ids, also NULL or
repeated ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.llm.html_text import main_text
from longspan.session import cut_lineage

SLOTS = 1 << 16
PART = 500_000
ORDERS = (1, 2, 3)
STRENGTH = 5.0
RELIABILITY = 1.0
UNIT = 1_000_000


def gram_slots(text: str) -> np.ndarray:
    """Slots of all character n-grams of the lower-cased text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    out = []
    for n in ORDERS:
        size = len(points) - n + 1
        if size < 1:
            break
        h = np.full(size, n, np.uint32)
        for k in range(n):
            h = (h ^ points[k : k + size]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h & np.uint32(SLOTS - 1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _counted(batches):  # type: ignore[no-untyped-def]
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            own = counts.setdefault(lang, np.zeros(SLOTS, np.int64))
            for part in _parts(texts):
                own += np.bincount(gram_slots(part), minlength=SLOTS)
    yield pa.RecordBatch.from_pydict({"counts": pa.array([_packed(counts)], pa.binary())})


def _parts(texts: list[str]):  # type: ignore[no-untyped-def]
    """Texts joined to parts of about PART characters, which bounds the arrays over them."""
    waiting, size = [], 0
    for text in texts:
        waiting.append(text)
        size += len(text)
        if size >= PART:
            yield "\n".join(waiting)
            waiting, size = [], 0
    if waiting:
        yield "\n".join(waiting)


def _packed(counts: dict[str, np.ndarray]) -> bytes:
    return pickle.dumps(counts)


def _added(a: bytes, b: bytes) -> bytes:
    left, right = pickle.loads(a), pickle.loads(b)
    for lang, counts in right.items():
        left[lang] = left[lang] + counts if lang in left else counts
    return _packed(left)


class TextModel:
    """Log probabilities of the slots under each language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.stack([counts[k] for k in self.languages]).astype(np.float64) + 0.5 if counts else np.empty((0, SLOTS))
        self.log = np.ascontiguousarray(np.log(table / table.sum(axis=1, keepdims=True)).T.astype(np.float32)) if counts else None

    def posterior(self, text: str) -> np.ndarray:
        """Under an even prior; overlapping n-grams share their weight."""
        slots = gram_slots(text)
        if not len(slots):
            return np.full(len(self.languages), 1 / len(self.languages))
        score = self.log[slots].sum(axis=0, dtype=np.float64) / len(ORDERS)
        p = np.exp(score - score.max())
        return p / p.sum()


def fit_text_model(documents: DataFrame) -> TextModel:
    """From all rows with a language and a text."""
    labelled = documents.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # A table, so that adding up never reads the texts again.
    tables = cut_lineage(labelled.where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_counted, "counts binary"))
    rows = tables.rdd.map(lambda r: bytes(r.counts))
    parts, depth = rows.getNumPartitions(), 2
    while 16**depth < parts:
        depth += 1
    return TextModel(pickle.loads(rows.treeAggregate(_packed({}), _added, _added, depth)))


def _text_evidence(model: TextModel):  # type: ignore[no-untyped-def]
    def evidence(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            parts = [np.rint(UNIT * model.posterior(main_text(html))).astype(np.int64).tolist() for html in batch["html"].to_pylist()]
            kept = [batch[c] for c in ("page_id", "url", "declared")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(parts, pa.list_(pa.int64()))], ["page_id", "url", "declared", "parts"])

    return evidence


def _sums(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Sum of the text posteriors of each value of ``key``: combined in the map tasks, one row per value."""
    sums = [F.sum(F.col("parts")[i]).alias(f"s{i}") for i in range(size)]
    return rows.groupBy(key).agg(*sums).select(key, F.array(*[f"s{i}" for i in range(size)]).alias(name))


def _smoothed(counts: Column, prior: Column, strength: float) -> Column:
    """Counts in units, pulled to a prior that weighs ``strength`` rows."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda n, p: (n + F.lit(strength * UNIT) * p) / (total + F.lit(strength * UNIT)))


def identify_languages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """page_id, url, lang, confidence, text_lang, declared, suffix and host of every page."""
    model = fit_text_model(documents)
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    declared = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    size = len(model.languages)
    blank = own.withColumn("declared", F.coalesce(declared, F.lit("")))
    if not size:
        evidence = blank.select("page_id", "url", "declared", F.lit(None).cast("array<long>").alias("parts"))
    else:
        # Read by four groupings and the fusion; the pages are parsed once.
        evidence = cut_lineage(blank.mapInArrow(_text_evidence(model), "page_id long, url string, declared string, parts array<long>"))
    named = evidence.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("suffix", F.substring_index("host", ".", -1)).withColumn(
        "site", F.substring_index("host", ".", -2)
    )
    if not size:
        nothing = F.lit(None).cast("string")
        return named.select(
            "page_id", "url", nothing.alias("lang"), F.lit(None).cast("double").alias("confidence"), nothing.alias("text_lang"), "declared", "suffix", "host"
        )
    whole = named.agg(*[F.coalesce(F.sum(F.col("parts")[i]), F.lit(0)).alias(f"s{i}") for i in range(size)]).first()
    total = [(n + UNIT) / (sum(whole) + size * UNIT) for n in whole]
    prior = F.array(*map(F.lit, total))
    by_host, by_site = _sums(named, "host", size, "host_sum"), _sums(named, "site", size, "site_sum")
    by_declared, by_suffix = _sums(named, "declared", size, "declared_sum"), _sums(named, "suffix", size, "suffix_sum")
    joined = named.join(by_host, "host").join(by_site, "site").join(by_declared, "declared").join(by_suffix, "suffix")
    others = lambda c: F.zip_with(F.col(c), F.col("parts"), lambda n, x: n - x)
    site_prior = _smoothed(others("site_sum"), prior, STRENGTH)
    host_prior = _smoothed(others("host_sum"), site_prior, STRENGTH)
    # P(value | language) is the value's share of the language's sum; what does not differ between languages cancels out.
    given = lambda c: F.zip_with(_smoothed(F.col(c), prior, RELIABILITY), prior, lambda p, q: F.log(p / q))
    parts = joined.select(
        "page_id", "url", "declared", "suffix", "host", "parts",
        F.transform(F.col("parts"), lambda n: F.log((n + F.lit(1)) / F.lit(UNIT))).alias("l0"),
        F.transform(host_prior, lambda p: F.log(p)).alias("l1"), given("declared_sum").alias("l2"), given("suffix_sum").alias("l3"),
    )
    score = F.col("l0")
    for c in ("l1", "l2", "l3"):
        score = F.zip_with(score, F.col(c), lambda a, b: F.round(a + b, 9))
    scored = parts.withColumn("score", score)
    languages = F.array(*map(F.lit, model.languages))
    best = lambda values: languages[(F.array_position(values, F.array_max(values)) - 1).cast("int")]
    top = F.array_max("score")
    weight = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return scored.select(
        "page_id", "url", best(F.col("score")).alias("lang"), F.round(1 / weight, 6).alias("confidence"),
        best(F.col("parts")).alias("text_lang"), "declared", "suffix", "host",
    )
