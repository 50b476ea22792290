"""Source divergence, the BPE codec and lexical search against brute force and the library."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspan.llm import lexical_search as search_module
from longspan.llm import source_divergence as divergence_module
from longspan.llm.bpe_codec import Codec, PairTree, codec, default_tokenizer, encode_digests, encode_documents
from longspan.llm.lexical_search import EXACT, IMPACT_BOUND, Best, lexical_search, vocabulary_tiles
from longspan.llm.source_divergence import source_divergence

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---- source divergence


def plain_divergence(rows, min_docs, top_terms=50):
    docs = [(lang or "", source or "", LETTERS.findall((text or "").translate(UPPER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for own, _, words in docs if own == lang for t in set(words))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        groups = sorted({d[1] for d in docs if d[0] == lang})

        def shares(words):
            total = sum(words[t] for t in kept)
            return [1 + 10**9 * (words[t] + 5) // (total + 5 * len(kept)) for t in kept]

        counts = {g: Counter(t for own, s, words in docs if (own, s) == (lang, g) for t in words) for g in groups}
        p, q = {g: shares(c) for g, c in counts.items()}, shares(sum(counts.values(), Counter()))
        for g in groups:
            pairs = [(-sum(abs(a - b) for a, b in zip(p[g], p[h])), h.encode(), h) for h in groups if h != g]
            terms = [(-(a - b), t.encode(), t) for t, a, b in zip(kept, p[g], q) if counts[g][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top_terms)):
                out += [(lang, g, part, item, -value, i + 1) for i, (value, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def found_divergence(docs, **params):
    return sorted(tuple(r) for r in source_divergence(docs, **params).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def sourced():
    rng = random.Random(5)
    pool = ["Wort", "wort", "über", "Élan", "a", "b2b", "the", "THE", "naïve", "x_y", "日本", "Z"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "é", None, "", "z"])
        weights = [1 + (j * (1 + len(source or "")) % 7) for j in range(len(pool))]
        rows.append((lang, source, " ".join(rng.choices(pool, weights, k=rng.randrange(0, 30)))))
    rows += [("en", "hot", "the the cat")] * 80 + [("en", "s1", None), ("en", "only empty", ""), ("xx", "p", "rare"), ("xx", "q", ""), (None, None, None)]
    return rows


def with_clashes(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(["idx", "term", "p", "v", "n", "bucket", "value", "rank", "ci", "m", "item", "score"])})


def test_divergence_equals_brute_force(spark, sourced):
    docs = with_clashes(spark, sourced)
    want = plain_divergence(sourced, 5)
    assert found_divergence(docs, min_docs=5) == want
    # Chunks of two sources and small buckets give several cells and accumulators per pair.
    assert found_divergence(docs, min_docs=5, chunk=2, bucket_rows=7) == want
    assert found_divergence(docs, min_docs=1000) == plain_divergence(sourced, 1000)  # no kept term: pairs of value 0
    assert found_divergence(docs, min_docs=5, top_terms=2) == plain_divergence(sourced, 5, 2)


def test_divergence_of_nothing_and_of_long_texts(spark, monkeypatch):
    assert source_divergence(with_clashes(spark, []).limit(0)).count() == 0
    monkeypatch.setattr(divergence_module, "SLICE", 50)
    assert [p for p in divergence_module.slices(b"ab " * 60, bytes(range(256)))] != []
    assert b"".join(divergence_module.slices(b"ab " * 60, bytes(range(256)))) == b"ab " * 60
    rows = [("en", f"s{i % 3}", "long " * (20_000 if i == 0 else 2) + f"end{chr(97 + i % 3)}") for i in range(12)]
    assert found_divergence(with_clashes(spark, rows), min_docs=2) == plain_divergence(rows, 2)


def test_shares_beyond_64_bits(spark):
    big = 10**11
    row = spark.createDataFrame([(big, 10**13, 10**6)], "n long, total long, v long").select(
        divergence_module._share("n", "total", "v", 5, 10**9).alias("p")
    )
    assert row.first().p == 1 + 10**9 * (big + 5) // (10**13 + 5 * 10**6)


# ---- BPE codec


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    path = default_tokenizer()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return codec(path), library


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


ODD_TEXTS = [
    "", " ", "\n\n", "Hello, World!  don't we'LL I'm 'S it's!'s ''ve", "<|endoftext|> a<|startoftext|>B <|ENDOFTEXT|><|endoftext|>",
    "ÀÉ İstanbul ŞŞ Straße ΑΣ Σ ﬁ Å Å é", "日本語のテキスト 한국어 עברית", "é ä̈ ́x", "x²³ ¼ ٣٤ 12,345.67", "\x00\x1c\x1f\x85 a b",
    "a" * 3000, "ab" * 700 + "!" * 500, "​ zero‍width 👩‍👩‍👧 🙂🙂", "___ _a_ __b", "🏳️‍🌈\t\r\n x", "� ퟿ \U0010fffd",
]


def test_codec_equals_the_library_on_odd_texts(both):
    own, library = both
    rng = random.Random(3)
    more = ["".join(rng.choice("abcAB 's'tdre,.!1é\n") for _ in range(rng.randrange(200))) for _ in range(400)]
    more += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x10000, 0x1F9FF)])) for _ in range(40)) for _ in range(400)]
    for text in ODD_TEXTS + more:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        n, a, b = own.digests(text)
        assert (n, a, b) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_every_character_of_the_fast_path(both):
    from longspan.llm.pieces import UNUSUAL

    own, library = both
    plain = [chr(c) for c in range(0x3000) if UNUSUAL.search(chr(c)) is None]
    assert len(plain) > 500
    for c in plain:
        for text in (c, f"a{c}b", f"{c}{c}1", f"'{c} '", f"!{c}s {c}'s"):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pair_tree_finds_the_leftmost_lowest():
    rng = random.Random(1)
    for n in (1, 2, 3, 8, 13):
        ranks = [rng.choice([None, *range(5)]) for _ in range(n)]
        tree = PairTree(ranks)
        for _ in range(60):
            known = [(r, i) for i, r in enumerate(ranks) if r is not None]
            assert tree.lowest() == (min(known)[1] if known else None)
            place = rng.randrange(n)
            ranks[place] = rng.choice([None, *range(5)])
            tree.set(place, ranks[place])


def test_long_runs_and_slices(both, monkeypatch):
    own, library = both
    run = "".join(random.Random(2).choices("abcde", k=40_000))
    assert own.merge(run.encode()) == library.encode(run, add_special_tokens=False).ids
    monkeypatch.setattr("longspan.llm.bpe_codec.SLICE", 30)
    for text in [*ODD_TEXTS, "word " * 100 + "e ́ <|endoftext|> " * 20]:
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_codec_tables(spark, both):
    _, library = both
    texts = [*ODD_TEXTS, None, "same", "same"]
    rows = [(None if i == 3 else i % 15, "x", "y", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("n_tokens", F.lit("clash"))
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    want = [(r[0], len(i), digest(" ".join(map(str, i))), digest(library.decode(i, skip_special_tokens=False))) for r, i in zip(rows, ids)]
    assert sorted(map(tuple, encode_digests(df).collect()), key=repr) == sorted(want, key=repr)
    whole = sorted((r.doc_id, r.ids, r.decoded) for r in encode_documents(df.where("doc_id IS NOT NULL")).collect())
    assert whole == sorted((r[0], i, library.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids) if r[0] is not None)
    assert encode_digests(df.limit(0)).count() == 0


def test_codec_rejects_other_models(tmp_path):
    import json

    with open(default_tokenizer(), encoding="utf-8") as file:
        spec = json.load(file)
    spec["model"]["byte_fallback"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Codec(str(tmp_path / "t.json"))


# ---- lexical search


def plain_search(items, docs, k=10):
    words = [(i, Counter(TERMS.findall((t or "").translate(UPPER)))) for i, t in docs]
    held = [w for _, w in words if w]
    total, n_docs = sum(sum(w.values()) for w in held), len(held)
    out = []
    for item_id, text in items:
        asked = Counter(TERMS.findall((text or "").translate(UPPER)))
        df = {t: sum(t in w for w in held) for t in asked}
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked}
        scores = []
        for doc_id, w in words:
            m = 25 + 75 * sum(w.values()) * n_docs // max(1, total)
            score = sum(c * weight[t] * (10**9 * w[t] // (1000 * w[t] + 8 * m)) for t, c in asked.items() if w[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id if doc_id is not None else 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found_search(items, docs, **params):
    return sorted((tuple(r) for r in lexical_search(items, docs, **params).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def search_tables(spark, items, docs):
    a = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit("x"), "score": F.lit(1.5), "rank": F.lit("r")})
    b = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "m": F.lit(None).cast("long"), "columns": F.lit(0), "item_id": F.lit(3)})
    return a, b


def random_search_rows(seed, n_docs, n_items):
    rng = random.Random(seed)
    pool = [f"T{i}" for i in range(60)] + ["über", "Ü", "a_b", "x.y", "日本"]
    weights = [1 / (i + 1) for i in range(len(pool))]
    text = lambda most: " ".join(rng.choices(pool, weights, k=rng.randrange(most)))
    docs = [(i * 3 % n_docs, text(60)) for i in range(n_docs)]
    docs += [(None, docs[5][1]), (4, docs[5][1]), (10**18, docs[5][1]), (-7, docs[5][1]), (900, None), (901, ""), (902, "!!"), (903, "t1 " * 30_000)]
    items = [(i % (n_items - 1), text(25)) for i in range(n_items)] + [(None, "t1 t2"), (77, None), (78, ""), (79, "unheard word"), (80, "t3 " * 400 + "t4")]
    return items, docs


@pytest.mark.parametrize("tile", [None, 7])
def test_search_equals_brute_force(spark, monkeypatch, tile):
    items, docs = random_search_rows(1, 150, 90)
    if tile:
        monkeypatch.setattr(search_module, "DOC_TILE", tile)
    a, b = search_tables(spark, items, docs)
    assert found_search(a, b) == plain_search(items, docs)


def test_search_in_blocks_and_with_ties(spark):
    items, docs = random_search_rows(2, 60, 12)
    docs += [(1000 + i, "tie tie word") for i in range(40)]
    items += [(500, "tie"), (501, "word tie tie")]
    a, b = search_tables(spark, items, docs)
    assert found_search(a, b.repartition(9), k=3, block_bytes=300) == plain_search(items, docs, 3)


def test_search_of_empty_tables(spark):
    a, b = search_tables(spark, [(1, "a b")], [(1, "a")])
    assert found_search(a.limit(0), b) == [] and found_search(a, b.limit(0)) == []


def test_vocabulary_tiles_stay_exact():
    weight = np.array([25_000, 1, 7, 0, 30], np.int64)
    items = [{0: 10**6, 1: 3, 3: 5}, {c: 10**8 for c in range(5)}, {}]
    sums = np.zeros((5, 3), np.int64)
    for columns, dense in vocabulary_tiles(items, weight):
        assert (dense.sum(axis=0) * IMPACT_BOUND < EXACT).all()
        sums[columns] += dense.astype(np.int64)
    assert sums.tolist() == [[own.get(c, 0) * int(weight[c]) for own in items] for c in range(5)]


def test_tiles_end_at_the_vocabulary_bound(monkeypatch):
    monkeypatch.setattr(search_module, "VOCABULARY_TILE", 3)
    tiles = list(vocabulary_tiles([{c: 1 for c in range(10)}], np.full(10, 5)))
    assert [len(c) for c, _ in tiles] == [3, 3, 3, 1]


def test_best_keeps_the_smaller_id_of_a_tie():
    best = Best(2, 1)
    best.add(np.array([[5], [5], [0]]), np.array([9, 8, 1]), np.zeros(3, bool))
    best.add(np.array([[5], [4]]), np.array([3, 2]), np.zeros(2, bool))
    assert best.id.tolist() == [3, 8] and best.score.tolist() == [5, 5] and best.least.tolist() == [5]
