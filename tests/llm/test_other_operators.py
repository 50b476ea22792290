"""Pages, codes, licenses, mixing and the pipeline against brute force and planted cases."""

import random
import time
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from longspan.llm import binary_search, license_scan, queries
from longspan.llm.binary_search import search_embeddings, segments_for
from longspan.llm.components import components
from longspan.llm.html_text import extract_text, main_text
from longspan.llm.language_id import identify_languages
from longspan.llm.license_scan import TEMPLATES, WORD, scan, scan_licenses
from longspan.llm.mixing import mix, rake, unmet

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu one</a><li><a href="/b">menu two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- a comment --><div class="ad">Buy now</div>{body}
<aside>Sidebar words</aside><form><input value="x"><button>Send</button></form>
<div id="comments"><article class="comment">Reader says</article></div><footer>&copy; foot</footer></body></html>"""


def test_article_text():
    body = "<article><h1>Head &amp; title</h1><p>First  <b>bo</b>ld\n line<br>next &eacute;<p>Second<div class='share'>Tweet</div><ul><li>item</ul></article>"
    assert main_text(PAGE.format(body=body)) == "Head & title First bold line next é Second item"
    assert main_text(PAGE.format(body="<main><p>" + "long words here " * 30 + "</p></main><div><a>more</a></div>")) == ("long words here " * 30).strip()


def test_regions_without_article_marks():
    text = "A sentence of the story that goes on for a while. " * 5
    links = "".join(f"<b><a href='/{i}'>x{i}</a></b>" for i in range(8))
    html = f"<body><div>{links}</div><div>{links}</div><div>{links}</div><div><p>{text}</p><p>{text}</p><p>Short end.</p></div><div>{links}</div><div>{links}</div></body>"
    assert main_text(html) == f"{text}{text}Short end."


def test_cells_inside_a_chosen_container_stay():
    story = "Story text goes on and on here. " * 8
    page = f"<body><div class=post><p>{story}</p><table><tr><td>cell a<td>cell b</table></div><div><a>x</a></div></body>"
    assert main_text(page) == f"{story}cell a cell b"


@pytest.mark.parametrize("part", ["<div>", "<div class='ad'>x", "<p class='ad'><li>x", "<div><b>x</i>", "<table><tr><td>x", "<article><p>x"])
def test_long_pages_of_open_tags_take_linear_time(part):
    def seconds(times):
        begin = time.process_time()
        main_text(part * times + "text")
        return time.process_time() - begin

    seconds(2_000)
    # Ten times the page; a walk over the open elements at each tag would take a hundred times as long.
    assert seconds(60_000) < 40 * max(seconds(6_000), 0.05)


STORY = "A sentence of the story that goes on for a while. " * 5


@pytest.mark.parametrize(
    "wrapper", ["div class='content-sidebar-wrap'", "div class='layout has-sidebar'", "div id='page-header-fixed'", "section class='widget'", "div class='post no-comments'"]
)
def test_marked_wrappers_keep_their_article(wrapper):
    end = wrapper.split()[0]
    for tag in ("article", "main"):
        body = f"<{wrapper}><{tag}><p>{STORY}</p><div class='share'>Tweet</div></{tag}><div class='sidebar'>Links</div></{end}>"
        assert main_text(PAGE.format(body=body)) == STORY.strip()
    teaser = "<div class='{}'><article><p>Other story here.</p></article></div>"
    for name in ("sidebar", "related"):
        assert main_text(PAGE.format(body=f"<article><p>{STORY}</p></article>{teaser.format(name)}")) == STORY.strip()
        assert main_text(PAGE.format(body=f"<div><p>{STORY}</p></div>{teaser.format(name)}")) == STORY.strip()


@pytest.mark.parametrize(
    "html",
    [
        f"<html><head><title>T</title><body><p>{STORY}</p></body></html>",
        f"<html><head><title>T</title><meta name=x><p>{STORY}</p></html>",
        f"<body><div><p class='ad'>Buy<p>{STORY}</div></body>",
        f"<body><div><p class='ad'>Buy<div>{STORY}</div></div></body>",
        f"<body><ul><li class='share'>Tweet<li>{STORY}</ul></body>",
        f"<body><dl><dt class='share'>Tweet<dd>{STORY}</dl></body>",
        f"<body><table><tr><td class='ad'>Buy<td>{STORY}</table></body>",
        f"<body><table><tr class='ad'><td>Buy<tr><td>{STORY}</table></body>",
    ],
)
def test_omitted_end_tags(html):
    assert main_text(html) == STORY.strip()


def test_odd_pages(spark):
    odd = [None, "", "<", "plain", "<p>open <nav>never closed", "<article></article>", "<script>only code", "&#x41;&lt;&bogus;", "<div " + "x" * 100_000]
    rows = [(i, f"http://h/{i}", html) for i, html in enumerate(odd)] + [(None, None, "<p>a"), (1, "u", "<p>b"), (1, "u", "<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "'x' AS n_chars")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert got == sorted(((i, u, main_text(h), len(main_text(h))) for i, u, h in rows), key=str)
    assert [main_text(h) for h in odd[:8]] == ["", "", "<", "plain", "open", "", "", "A<&bogus;"]
    assert extract_text(pages.limit(0)).count() == 0


def language_tables(spark):
    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    write = lambda lang, n: " ".join("".join(rng.choices(letters[lang], k=5)) for _ in range(n))
    docs = [(lang, write(lang, 50)) for lang in letters for _ in range(10)] + [(None, "zzz"), ("aa", None)]
    pages = []
    for i in range(90):
        lang = sorted(letters)[i % 3]
        html = f"<html lang='{lang}-XX'><body><p>{write(lang, 20)}</p></body></html>"
        pages.append((i, f"https://www.{lang}.example.{lang}/{i}", html, lang))
    pages += [
        (200, "https://www.bb.example.bb/x", "<html><body></body></html>", "bb"),  # nothing but its host and suffix
        (201, "https://new.example.org/", "<html lang=cc></html>", "cc"),  # nothing but its declaration
        (202, "https://www.aa.example.aa/y", f"<html lang='bb'><p>{write('aa', 30)}</p></html>", "aa"),  # declared wrongly
        (203, None, f"<p>{write('cc', 30)}", "cc"),
    ]
    page_table = spark.createDataFrame(pages, "page_id long, url string, html string, truth string")
    return page_table, spark.createDataFrame(docs, "lang string, text string")


def test_language_evidence(spark):
    pages, docs = language_tables(spark)
    got = {r.page_id: r for r in identify_languages(pages.selectExpr("*", "1 AS lang", "2 AS host"), docs).collect()}
    truth = {r.page_id: r.truth for r in pages.collect()}
    assert {i: r.lang for i, r in got.items()} == truth
    assert got[202].declared == "bb" and got[200].confidence > 0.5
    assert len(got) == len(truth)


def test_language_of_odd_tables(spark):
    pages, docs = language_tables(spark)
    assert identify_languages(pages.limit(0), docs).count() == 0
    blank = identify_languages(pages, docs.limit(0)).collect()
    assert len(blank) == 94 and all(r.lang is None for r in blank)
    twice = identify_languages(pages.unionByName(pages).unionByName(spark.createDataFrame([(None, None, None, None)], pages.schema)), docs)
    assert twice.count() == 2 * 94 + 1


def nearest(rows, k):
    codes = [(i, sum(1 << b for b, x in enumerate(e) if x is not None and x > 0)) for i, e in rows if i is not None and e is not None]
    out = []
    for q, code in {(i, c) for i, c in codes if i % 100 == 0}:
        others = Counter((i, c) for i, c in codes)
        others[(q, code)] -= 1
        found = sorted(((code ^ c).bit_count(), i) for (i, c), n in others.items() for _ in range(n))[:k]
        out += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(found)]
    return sorted(out)


def test_exact_search(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 64))
    rows = [(int(i), [float(x) for x in centres[i % 6] + 0.7 * rng.normal(size=64)]) for i in range(400)]
    rows += [(1000 + i, rows[100][1]) for i in range(150)]  # one very common vector
    rows += [(None, rows[0][1]), (2000, None), (2001, []), (2100, [None, 1.0]), (7, rows[9][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS code", "2 AS value")
    got = sorted(map(tuple, search_embeddings(table, k=10).collect()))
    assert got == nearest(rows, 10)
    assert search_embeddings(table.limit(0)).count() == 0
    few = spark.createDataFrame(rows[100:103], table.schema[:2])
    assert sorted(map(tuple, search_embeddings(few, k=10).collect())) == nearest(rows[100:103], 10)


@pytest.mark.parametrize(("bucket", "chunk", "few", "most"), [(256, 1024, 256, 65_536), (4, 8, 256, 65_536), (1, 3, 3, 5)])
def test_outlying_codes_and_hot_segment_values(spark, monkeypatch, bucket, chunk, few, most):
    """Narrow and wide segments, hot values in many arrays, and the reading of all arrays give the brute-force result."""
    for name, value in (("BUCKET", bucket), ("CHUNK", chunk), ("FEW_MASKS", few), ("MOST_MASKS", most)):
        monkeypatch.setattr(binary_search, name, value)
    rng = random.Random(5)
    codes = [(i, rng.getrandbits(64) - 2**63) for i in range(400)]
    codes += [(5000 + i, codes[0][1]) for i in range(60)]  # one very common code
    codes += [(7000 + i, rng.getrandbits(30)) for i in range(400)]  # half of the bits alike
    table = spark.createDataFrame(codes, "id long, code long")
    asked = [c for c in codes if c[0] % 40 == 0]
    got = binary_search.top_k_codes(table, spark.createDataFrame(asked, table.schema), 10).collect()
    want = []
    for own, code in asked:
        ranked = sorted((bin((code ^ c) % 2**64).count("1"), i) for i, c in codes if i != own)[:10]
        want += [(own, rank, i, d) for rank, (d, i) in enumerate(ranked, 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_segments_cover_all_bits():
    for n in (0, 1, 10, 500, 50_000, 10**6, 10**10, 10**19):
        parts = segments_for(n)
        assert [b for low, width in parts for b in range(low, low + width)] == list(range(64))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for pair in links for x in pair}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("license_id", "template"), TEMPLATES)
def test_every_template_is_found(license_id, template):
    before, after = "Some words stand here first. ", " And other words follow it, as in any text at all."
    found = scan(before * 3 + template + after)
    assert [m["license"] for m in found] == [license_id] and found[0]["missing_words"] == 0 and found[0]["start"] == 15


@pytest.mark.parametrize("length", [60, 400, 3000])
@pytest.mark.parametrize("gap", [3, 12, 60])
def test_compression_finds_what_alignment_finds(monkeypatch, length, gap):
    """At least 0.9 of the planted places per template, and nearly all that aligning every template at every place finds."""
    rng = random.Random(length + gap)
    usual = "the of and to in a is that for it as was with be by on not he this have from or had an they which you were all her".split()
    spelled = [[w.lower() for w in WORD.findall(text)] for _, text in TEMPLATES]
    texts, planted = [], 0
    while planted < 900:
        words, places = ["license"], []
        while len(words) < length:
            words += rng.choices(usual, k=gap)
            i = rng.randrange(len(TEMPLATES))
            own = list(spelled[i])
            plain = [k for k in range(1, len(own)) if k not in names_of(TEMPLATES[i][1])]
            if len(own) >= 10 and plain and rng.random() < 0.5:
                del own[rng.choice(plain)]
            places.append((i, len(words), len(words) + len(own)))
            words += own
        texts.append((" ".join(words), places))
        planted += len(places)

    def caught(name, start, end, found):
        return any(m["license"] == name and m["start"] < end and start < m["end"] for m in found)

    by_winners = [scan(text) for text, _ in texts]
    monkeypatch.setattr(license_scan, "winners", lambda templates, plain, words: [(i, 0) for i in range(len(templates))])
    by_alignment = [scan(text) for text, _ in texts]
    met, hit = [0] * len(TEMPLATES), [0] * len(TEMPLATES)
    for (_, places), found in zip(texts, by_winners, strict=True):
        for i, start, end in places:
            met[i] += 1
            hit[i] += caught(TEMPLATES[i][0], start, end, found)
    assert all(h >= 0.9 * m - 1 for h, m in zip(hit, met, strict=True)), list(zip(TEMPLATES, hit, met, strict=True))
    pairs = [(m, found) for found, every in zip(by_winners, by_alignment, strict=True) for m in every]
    assert sum(caught(m["license"], m["start"], m["end"], found) for m, found in pairs) >= 0.99 * len(pairs)


def names_of(text):
    words = WORD.findall(text)
    return {i for i, w in enumerate(words) if any(c.isdigit() for c in w) or (i and w[0].isupper())}


def test_headers_tags_and_both_bsd_licenses():
    gpl = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."
    assert [m["license"] for m in scan(gpl)] == ["GPL-3.0-or-later"]
    assert [m["license"] for m in scan(gpl.replace("version 3", "version 2"))] == ["GPL-2.0-or-later"]
    assert [m["license"] for m in scan("// SPDX-License-Identifier: Apache-2.0\nint main")] == ["Apache-2.0"]
    assert [m["license"] for m in scan("# SPDX-License-Identifier: GPL-3.0-or-later")] == ["GPL-3.0-or-later"]
    assert [m["license"] for m in scan("It is licensed under the terms of the MIT license, see below")] == ["MIT"]
    head = next(text for _, text in TEMPLATES if text.startswith("Redistribution and use"))
    two = head + " 1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce the above copyright notice."
    three = two + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    assert {m["license"] for m in scan(two)} == {"BSD-2-Clause"}
    assert {m["license"] for m in scan(three)} == {"BSD-3-Clause"}


def test_wording_decides():
    assert scan("Licensed under the Apache License, Version 1.1.") == []
    assert scan("A licensed driver had permission to publish the story about a license.") == []
    two = scan("Released under the MIT License. " + "Then many words go by. " * 30 + "Licensed under CC BY-SA 4.0.")
    assert [m["license"] for m in two] == ["MIT", "CC-BY-SA-4.0"]
    assert [m["license"] for m in scan("licensed UNDER the   gnu general\npublic license (version 3)")] == ["GPL-3.0"]


def test_licenses_in_long_blocks():
    rng = random.Random(3)
    noise = lambda n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 10))) for _ in range(n)]
    notice = "Licensed under the MIT License.".split()
    listed = [w for _ in range(1200) for w in noise(12) + notice]
    assert len(" ".join(listed)) > 100_000
    assert [(m["license"], m["start"]) for m in scan(" ".join(listed))] == [("MIT", 12 + 17 * i) for i in range(1200)]
    dense = [w for _ in range(3000) for w in [*noise(5), "permission"]]
    for license_id, template in TEMPLATES:
        at = rng.randrange(len(dense))
        found = scan(" ".join(dense[:at] + [template] + dense[at:]))
        # A place may begin at an anchor close before, as a tenth of extra words is allowed.
        assert [(m["license"], m["end"], m["missing_words"]) for m in found] == [(license_id, at + len(WORD.findall(template)), 0)]
    mixed, expected, words = [], [], 0
    for license_id, template in (rng.choice(TEMPLATES) for _ in range(600)):
        mixed += [*noise(12), template]
        expected.append((license_id, words + 12))
        words += 12 + len(WORD.findall(template))
    assert [(m["license"], m["start"]) for m in scan(" ".join(mixed))] == expected
    assert scan("x" * 300_000 + " license " + "y" * 300_000 + " " + " ".join(notice))[0]["license"] == "MIT"


def test_license_table(spark, documents):
    long_text = "word " * 50_000 + "Released under the MIT License. " + "word " * 50_000
    rows = [(1, None), (2, ""), (3, long_text), (3, long_text), (None, "Licensed under CC BY 4.0."), (4, "no license")]
    got = scan_licenses(documents(rows)).select("doc_id", "licenses", "n_matches").collect()
    expected = [(1, [], 0), (2, [], 0), (3, ["MIT"], 1), (3, ["MIT"], 1), (None, ["CC-BY-4.0"], 1), (4, [], 0)]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert scan_licenses(documents([])).count() == 0


def test_raking_equals_plain_fitting(spark):
    rng = np.random.default_rng(1)
    tokens = rng.integers(50, 500, size=(4, 3, 2)).astype(float)
    cells = [(f"s{i}", f"l{j}", f"t{k}", int(tokens[i, j, k])) for i in range(4) for j in range(3) for k in range(2)]
    goals = {"source": [0.3, 0.3, 0.2, 0.2], "lang": [0.5, 0.3, 0.2], "topic": [0.55, 0.45]}
    letter = {"source": "s", "lang": "l", "topic": "t"}
    tables = {m: spark.createDataFrame([(f"{letter[m]}{i}", s) for i, s in enumerate(v)], "value string, share double") for m, v in goals.items()}
    keyed = spark.createDataFrame([(*("=" + x for x in c[:3]), c[3]) for c in cells], "source string, lang string, topic string, tokens long")
    got = {tuple(x[1:] for x in r[:3]): r.weight for r in rake(keyed, tables, rate=0.4, tolerance=1e-9).select("source", "lang", "topic", "weight").collect()}
    weight = tokens.copy()
    for _ in range(200):
        for axis, name in enumerate(goals):
            others = tuple(a for a in range(3) if a != axis)
            factor = np.array(goals[name]) * tokens.sum() / weight.sum(axis=others)
            weight *= factor.reshape([-1 if a == axis else 1 for a in range(3)])
    for (s, lang, t), w in got.items():
        assert w == pytest.approx(weight[int(s[1]), int(lang[1]), int(t[1])], rel=1e-6)


def test_raking_goes_on_beside_unreachable_values(spark):
    """A tiny source can never reach its goal; the others, tied 9:1 to languages, still meet theirs."""
    tokens = np.array([[450_000, 50_000], [50_000, 450_000], [50, 50]])
    goals = {"source": [0.55, 0.44975, 0.00025], "lang": [0.5, 0.5]}
    cells = [("=" + "abt"[i], "=" + "xy"[j], int(tokens[i, j])) for i in range(3) for j in range(2)]
    names = {"source": "abt", "lang": "xy"}
    tables = {m: spark.createDataFrame(list(zip(names[m], v, strict=True)), "value string, share double") for m, v in goals.items()}
    got = rake(spark.createDataFrame(cells, "source string, lang string, tokens long"), tables, rate=0.6).cache()
    rows = got.collect()
    assert all(r.weight <= r.tokens / 0.6 * (1 + 1e-9) for r in rows)
    for margin, values in names.items():
        for value, share in zip(values, goals[margin], strict=True):
            if value != "t":
                reached = sum(r.weight for r in rows if r[margin] == "=" + value)
                assert reached == pytest.approx(share * tokens.sum(), rel=2e-3)
    assert [(r.margin, r.value) for r in unmet(got, list(goals), 2e-3).collect()] == [("source", "=t")]


def test_mixing_draws_by_probability(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(50, 300)), rng.choice(["en", "de", None]), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    rows += [(9000, None, "en", "big"), (9001, "", None, None), (5, rows[5][1], rows[5][2], rows[5][3]), (None, "a b c", "en", "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS probability", "2 AS tokens")
    goal = {"lang": spark.createDataFrame([("en", 0.4), ("de", 0.3), ("xx", 0.3)], "value string, share double")}
    got = mix(docs, goal, rate=0.5).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    expected = sum(r.probability for r in got)
    assert abs(sum(r.sampled for r in got) - expected) < 4 * sum(r.probability * (1 - r.probability) for r in got) ** 0.5
    drawn = Counter()
    for r in got:
        drawn[r.lang] += r.tokens * r.probability
    # No target names NULL, so it keeps its observed share; "xx" does not occur.
    observed = sum(r.tokens for r in got if r.lang is None) / sum(r.tokens for r in got)
    scale = 0.7 + observed
    for lang, share in (("en", 0.4), ("de", 0.3), (None, observed)):
        assert drawn[lang] / sum(drawn.values()) == pytest.approx(share / scale, rel=2e-3)
    assert mix(docs.limit(0), goal).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    shared, rows = prose(60), []
    for i in range(120):
        rows.append((i, prose(60) + " " + shared + " " + prose(20), "en", f"s{i % 4}", 0))
    rows += [(200 + i, " ".join(w + "###" for w in prose(50).split()), "en", "s0", 0) for i in range(20)]
    rows += [(300, rows[0][1], "en", "s1", 0), (301, rows[1][1] + " tail", "de", "s1", 0), (302, None, None, None, None), (None, prose(80), "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    current, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path)).cache()
        assert current.columns == list(corpus_pipeline.COLUMNS), name
        kept.append({r.doc_id: r for r in current.collect()})
    quality, copies, spans, drawn = kept
    assert set(quality) == {*range(120), 300, 301, None}
    assert set(copies) == {*range(120), None}
    assert set(spans) == set(copies)
    for i in range(120):
        # Words beside the passage may agree with an earlier text's by chance and go too.
        left = spans[i].text.split()
        assert (shared in spans[i].text) == (i == 0) and len(left) <= (140 if i == 0 else 80) and len(left) >= 72
        assert spans[i].n_chars == (0 if i == 0 else len(spans[i].text))
    assert set(drawn) < set(spans) and 30 < len(drawn)
    last = corpus_pipeline.STAGES[-1][1](spark, current, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(drawn)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline_near_copies(spark, documents):
    """Brute force at five words and 0.8, with pairs just above and below."""
    rng = random.Random(12)
    shape = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    texts = []
    # An edit amid 300 words changes five of 296 shingles: 266 / 326 = 0.816 after six, 261 / 331 = 0.789 after seven.
    for edits in (5, 6, 7, 8, 6, 7):
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        for k in range(edits):
            copy[20 + 30 * k] = f"n{rng.randrange(10**6)}"
        texts += [base, copy]
    sets = [shape(t) for t in texts]
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if 5 * len(sets[i] & sets[k]) >= 4 * len(sets[i] | sets[k]):
                first[i] = min(first[i], first[k])
    expected = {i for i, f in enumerate(first) if i == f}
    assert expected == set(range(len(texts))) - {1, 3, 9}
    docs = documents([(i, " ".join(t)) for i, t in enumerate(texts)])
    assert {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()} == expected


def test_registered_names():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copy_join_leaves_only_its_result_on_disk(spark, tmp_path, monkeypatch):
    from longspan import session
    from longspan.llm.ngram_jaccard import jaccard_components

    written = []
    path_of = session.fresh_path
    monkeypatch.setattr(session, "_shared_folder", lambda _: f"file:{tmp_path}")
    monkeypatch.setattr(session, "fresh_path", lambda s: written.append(path_of(s)) or written[-1])
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "a b c d"), (None, None)], "doc_id long, text string")
    got = jaccard_components(docs)
    left = [p for p in written if (tmp_path / "longspan" / p.rsplit("/", 1)[1]).exists()]
    assert len(written) > 3 and left == written[-1:]
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, None: None}
