"""Operators on documents against brute force: NULLs, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from longspan.llm import ngram_jaccard
from longspan.llm import quality_rules as quality_rules_module
from longspan.llm.ngram_jaccard import _Classes, jaccard_components, upper_nodes
from longspan.llm.packing import pack, plan, slots
from longspan.llm.pieces import UNUSUAL, default_tokenizer, encoder
from longspan.llm.quality_rules import quality_rules, rule_counts
from longspan.llm.substring_dedup import remove_repeated_spans
from longspan.llm.token_counts import count_tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows(seed=0, n=60):
    """Texts over few words, so that windows repeat inside and across documents."""
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "the", "x\x1cy", "é", "naïve z", "<|endoftext|>", "42", "中文"]
    passage = [rng.choice(vocabulary) + str(i % 7) for i in range(60)]
    rows = []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0:
            at = rng.randrange(0, 30)
            own[3:3] = passage[at : at + rng.randrange(10, 30)]
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(own)))
    long_text = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    rows += [(500, None), (501, ""), (502, " \n "), (503, long_text), (504, long_text), (30, rows[10][1]), (None, rows[12][1]), (None, None)]
    return rows + [rows[5], rows[5]]


def covered(rows, size=13):
    key = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - size + 1):
            t = tuple(w[k : k + size])
            first[t] = min(first.get(t, float("inf")), key(i))
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key(i):
                gone[k : k + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 10, 1 << 23])
def test_substring_dedup(spark, documents, block_bytes):
    rows = odd_rows()
    found = remove_repeated_spans(documents(rows).repartition(3), block_bytes=block_bytes, carry=("lang", "block"))
    assert set(found.columns) >= {"lang", "block"}
    got = sorted((tuple(r) for r in found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == covered(rows)
    assert remove_repeated_spans(documents([])).count() == 0


def test_spans_point_at_equal_words(spark, documents):
    rows = [(i, " ".join(f"w{i}{k}" if k % 50 < 10 else f"c{k}" for k in range(100))) for i in range(5)]
    found = {r.doc_id: r for r in remove_repeated_spans(documents(rows)).collect()}
    assert found[0].spans == [] and found[0].kept_text is None
    for i in range(1, 5):
        assert [(s.start, s.n_words) for s in found[i].spans] == [(10, 40), (60, 40)]
        assert {s.source_row for s in found[i].spans} == {0}
        assert found[i].kept_text.split() == [f"w{i}{k}" for k in range(100) if k % 50 < 10]


def library_ids(rows):
    own = encoder(default_tokenizer())
    return [own.library_ids(text or "") for _, text in rows]


def test_pieces_equal_the_library():
    own = encoder(default_tokenizer())
    usual = [c for c in map(chr, range(0x3000)) if not UNUSUAL.match(c)]
    assert len(usual) > 600
    rng = random.Random(3)
    texts = [pattern.replace("%", c) for c in usual for pattern in ("a%b", " %%1 % ", "\n%\t \n% 'll%")]
    texts += ["".join(rng.choices(usual, k=40)) for _ in range(2000)] + ["a<|endoftext|>b", "²½", "中文 字", "\x1c \x85"]
    for text in texts:
        assert np.frombuffer(own.ids_of(text), "<u4").tolist() == own.library_ids(text)


def test_token_counts(spark, documents):
    rows = odd_rows()
    expected = sorted(((i, len((t or "").encode()), len(ids), len(ids) > 512) for (i, t), ids in zip(rows, library_ids(rows), strict=True)), key=str)
    assert sorted(map(tuple, count_tokens(documents(rows)).collect()), key=str) == expected
    assert count_tokens(documents([])).count() == 0


def test_packing_round_trip(spark, documents):
    rows = [(i, text) for i, (_, text) in enumerate(odd_rows())]
    ids = dict(zip((i for i, _ in rows), library_ids(rows), strict=True))
    placed = pack(documents(rows)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        stream, at = [*ids[i], 0], 0
        for number, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            part = np.array(stream[at : at + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (number, at, zlib.crc32(part)) and (r.length == 2048 or number == 0)
            at += r.length
        assert at == len(stream)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) == -(-sum(len(x) + 1 for x in ids.values()) // 2048)
    assert pack(documents([])).count() == 0


def test_packing_keeps_repeated_rows(spark, documents):
    placed = pack(documents([(1, "a b"), (1, "a b"), (None, None), (None, "c")])).collect()
    assert len(placed) == 4 and len({(r.sequence_id, r.offset) for r in placed}) == 4


def test_plan_uses_every_piece_and_is_near_the_bound():
    rng = random.Random(5)
    for trial in range(60):
        capacity = rng.choice([7, 20, 100, 2048])
        counts = defaultdict(int)
        for _ in range(rng.choice([1, 5, 50, 3000])):
            counts[min(capacity, max(1, int(rng.lognormvariate(np.log(capacity / 4), 1))))] += 1
        fillings, used = plan(dict(counts), capacity), defaultdict(int)
        for n, lengths in fillings:
            assert n > 0 and 0 < sum(lengths) <= capacity
            for length in lengths:
                used[length] += n
        assert used == counts
        bound = -(-sum(k * n for k, n in counts.items()) // capacity)
        halves = sum(n for k, n in counts.items() if 2 * k > capacity)
        assert sum(n for n, _ in fillings) <= max(bound, halves) * 1.12 + 1, trial
        assert sum(end - first for _, first, end, _, _ in slots(fillings)) == sum(counts.values())
    # A perfect pair dominates; plain best fit of the longest first would not take 6 + 4, 5 + 5.
    assert sorted(plan({6: 1, 5: 2, 4: 1}, 10)) == [(1, (5, 5)), (1, (6, 4))]


def jaccard(rows, percent):
    sets, inverse = [], defaultdict(list)
    for _, text in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        sets.append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    keys = [2**63 - 1 if i is None else i for i, _ in rows]
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for t in s:
            inverse[t].append(k)
    for k, s in enumerate(sets):
        for other in {j for t in s for j in inverse[t] if j < k}:
            both = len(s & sets[other])
            if 100 * both >= percent * (len(s) + len(sets[other]) - both):
                a, b = root(keys[k]), root(keys[other])
                parent[max(a, b)] = min(a, b)
    back = lambda x: None if x == 2**63 - 1 else x
    return sorted(((i, len(s), back(root(k))) for (i, _), s, k in zip(rows, sets, keys, strict=True)), key=str)


def near_copies(seed, groups=6, each=8, share=0.02):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(12, 300))]
        for _ in range(each):
            own = [f"n{rng.randrange(10**6)}" if rng.random() < share * rng.random() else w for w in base]
            rows.append((i, " ".join(own).upper() if i % 5 == 0 else " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize(("percent", "share"), [(90, 0.03), (80, 0.06)])
def test_jaccard_components(spark, documents, percent, share):
    rows = near_copies(1, share=share) + [(1000 + (i or 0), t) for i, t in odd_rows(2, 20)]
    rows += [(7, rows[20][1]), (None, rows[3][1]), (None, ""), (990, "one two"), (991, "ONE two"), (992, "one")]
    got = jaccard_components(documents(rows).repartition(3), percent=percent)
    assert sorted(map(tuple, got.collect()), key=str) == jaccard(rows, percent)


@pytest.mark.parametrize("percent", [50, 80, 90, 97])
def test_linked_sets_share_an_upper_node(percent):
    rng = np.random.default_rng(percent)
    classes = _Classes(percent)
    for size in [*range(1, 60), *rng.integers(60, 3000, 60).tolist()]:
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        # As many tokens go and come as the threshold allows.
        lost = int(rng.integers(0, (100 - percent) * len(a) // 100 + 1))
        kept = rng.permutation(a)[lost:]
        most = (100 * len(kept) - percent * len(a)) // percent
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, max(0, most), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        assert len(np.intersect1d(upper_nodes(a, classes), upper_nodes(b, classes)))


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("size", [60_000, 200_000])
def test_keys_stay_linear_in_the_tokens(percent, size):
    tokens = np.unique(np.random.default_rng(1).integers(0, 2**64, size, dtype=np.uint64))
    assert 0 < len(upper_nodes(tokens, _Classes(percent))) < size


def test_sets_leave_a_task_by_bytes(monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "HELD_BYTES", 2_000)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, None]), "text": pa.array([" ".join(f"w{i}" for i in range(3000)), None, "a b c d"])})
    out = list(ngram_jaccard._sets(3, 90)([batch]))
    assert [b.num_rows for b in out] == [1, 2] and out[1]["n_shingles"].to_pylist() == [0, 2]


def test_jaccard_of_an_empty_table(spark, documents):
    assert jaccard_components(documents([])).count() == 0
    assert [tuple(r) for r in jaccard_components(documents([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 0, 1), (2, 0, 2)]


def base_counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k : k + 8])].append(k)
    repeated = {k + d for starts in windows.values() if len(starts) > 1 for k in starts for d in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(repeated)


def test_rule_counts():
    texts = [t for _, t in odd_rows() if not t or len(t) < 10_000] + ["a\na\n\n \n\x0b\na", "x y " * 20, "# * | <> &"]
    for text in texts:
        assert rule_counts(text)[:5] == base_counts(text)


def test_quality_rules_hold_out(spark, documents):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(400):
        n = rng.randrange(30, 120)
        w = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(n)]
        truth[i] = int(i % 5 > 0)
        rows.append((i, " ".join(w if truth[i] else [x + rng.choice(["###", "$$", "%%%", " |"]) for x in w])))
    rows += [(900, None), (901, "short"), (902, "a b c d e f g h i j " * 5), (1, rows[1][1]), (None, rows[2][1])]
    labels = spark.createDataFrame([(i, truth[i], 0) for i in range(200)] + [(None, 1, 0), (5000, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_rules(documents(rows), labels).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 400]
    assert sum(r.kept == bool(truth[r.doc_id]) for r in held_out) >= 0.97 * len(held_out)
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (900, 901, 902))
    without = quality_rules(documents(rows), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in without)
    assert quality_rules(documents([]), labels).count() == 0


def test_fit_sample_is_bounded_and_independent_of_partitions(spark, monkeypatch):
    """A third of the rows is one row; the sample has different rows only, and the same for any partitioning."""
    rng = random.Random(8)
    columns = "doc_id long, " + ", ".join(f"{c} long" for c in quality_rules_module._COUNTS) + ", quality int"
    rows = [(i, *(rng.randrange(20, 90) for _ in quality_rules_module._COUNTS), i % 2) for i in range(400)]
    rows += [rows[7]] * 200
    monkeypatch.setattr(quality_rules_module, "FIT_ROWS", 100)
    seen = []
    monkeypatch.setattr(quality_rules_module, "features", lambda table: seen.append(sorted(map(tuple, table.to_numpy().tolist()))) or np.zeros((len(table), 5)))
    for parts in (1, 7):
        quality_rules_module.fit_forest(spark.createDataFrame(rows, columns).repartition(parts))
    assert seen[0] == seen[1]
    assert 60 < len(seen[0]) <= 100 and len(set(seen[0])) == len(seen[0])
    monkeypatch.setattr(quality_rules_module, "FIT_ROWS", 1000)
    quality_rules_module.fit_forest(spark.createDataFrame(rows, columns))
    assert len(seen[2]) == 400


def test_documents_below_the_threshold_make_few_candidate_pairs(monkeypatch):
    shared = [f"s{i}" for i in range(344)]
    texts = [" ".join([*shared, *(f"d{d}w{i}" for i in range(56))]) for d in range(80)]
    texts.append(texts[0].rsplit(" ", 5)[0] + " a b c d e")
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    maps = pa.Table.from_batches(ngram_jaccard._bitmaps(1)([batch]))
    table = maps.append_column("component", maps["doc"]).append_column("side", pa.array([0] * len(texts)))
    want = [{"a": 80, "b": 0, "more": False}]
    assert ngram_jaccard._pairs(80, 100)(table).to_pylist() == want
    monkeypatch.setattr(ngram_jaccard, "OPENED_PAIRS", 1)
    monkeypatch.setattr(ngram_jaccard, "COMPARED_WORDS", 1)
    assert ngram_jaccard._pairs(80, 100)(table).to_pylist() == want
    everyone = ngram_jaccard._pairs(70, 100)(table).select(["a", "b"]).to_pylist()
    assert len(everyone) == 81 * 80 // 2
    # Large sets have bounded bitmaps: two bits a token at least, more only up to the bound.
    assert [ngram_jaccard._bits(k) for k in (1, 8, 4096, 30_000, 40_000)] == [64, 128, 1 << 16, 1 << 16, 1 << 17]


def test_jaccard_of_groups_larger_than_a_block(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 3)
    rows = near_copies(4, groups=3, each=10, share=0.1) + [(1000, "a b c d"), (1000, "e f g h"), (None, "a b c e")]
    rows += [(5, near_copies(5, 1, 1)[0][1]), (None, rows[14][1] + " x")]
    got = jaccard_components(documents(rows).repartition(3), percent=80)
    assert sorted(map(tuple, got.collect()), key=str) == jaccard(rows, 80)


def test_documents_that_share_a_line_only_meet_in_no_node(spark):
    line = " ".join(f"line{i}" for i in range(12))
    copy = " ".join(f"c{i}" for i in range(300))
    rows = [(d, " ".join([*(f"d{d}w{i}" for i in range(300)), line])) for d in range(40)] + [(100, copy), (101, copy + " more"), (102, copy + " " + line)]
    source = spark.createDataFrame(rows, "doc_id long, text string")
    _, members, nearest = ngram_jaccard._shared_nodes(source, 3, 80)
    assert {r.doc for r in members.collect()} == {100, 101, 102}
    # Tied together they are one node of each class, not one of every slice.
    assert members.count() <= 3 * 2
    assert {tuple(r) for r in nearest.collect()} == {(101, 100), (102, 100)}


def test_linked_sets_keep_a_node_that_neither_spares():
    rng = np.random.default_rng(3)
    classes = _Classes(80)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[base[rng.permutation(400)[: rng.integers(330, 400)]], rng.integers(0, 2**64, rng.integers(0, 40), dtype=np.uint64)]) for _ in range(40)]
    nodes = [np.unique(upper_nodes(s, classes)) for s in sets]
    held = dict(zip(*np.unique(np.concatenate(nodes), return_counts=True), strict=True))
    needed = []
    for own in nodes:
        spare = {x["slot"]: x["spare"] for x in ngram_jaccard.spare_nodes(own, classes)}
        slots = {k: sorted((x for x in own if int(x) & ngram_jaccard.SLOT == k), key=lambda x: (held[x], x)) for k in spare}
        needed.append({x for k, of_slot in slots.items() for x in of_slot[: len(of_slot) - spare[k]]})
    linked = [(i, j) for i in range(40) for j in range(i) if ngram_jaccard._linked(sets[i], sets[j], 80)]
    assert linked and sum(map(len, needed)) < sum(map(len, nodes))
    assert all(needed[i] & needed[j] for i, j in linked)


def test_shuffle_files_go_when_their_write_ends(spark, tmp_path):
    from longspan.session import SHUFFLE_CLEANUP, temporary_tables

    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    with temporary_tables(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
