"""License scans, personal data, quality, pages and languages."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import html_text, language_id, license_scan, pii, quality
from tests.llm import brute


@pytest.fixture(scope="module")
def noted(spark, documents):
    """Documents with license lines and personal data added."""
    lines = [
        (9001, "cc by cc by CC-BY all rights reserved. ALL RIGHTS RESERVED general\npublic license"), (9002, "Released under the MIT License."), (9003, "Licensed under the Apache License, Version 2.0.\nwords"),
        (9004, "a@b.c.@d.e x+1@q-1.co.uk. 1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.255 4111 1111 1111 1111 1 +1 (415) 555-2671x +49 30 901820"),
        (9005, "é😀 x@y.zz DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432, ssn 078-05-1120 password: 'abcdEFGH12345678xx'"),
        (9006, "1234567890" * 300 + " " + "a" * 20000 + "@" + "b.c" * 5000 + " " + "9" * 20000 + ".1.2.3"), (9007, "the public general license of all by rights cc"), (9008, None), (9009, ""),
    ]
    extra = spark.createDataFrame([(i, t, "en", "src0") for i, t in lines], documents.schema)
    return documents.unionByName(extra)


def test_licenses_equal_brute_force(noted):
    want = {r.doc_id: brute.licenses(r.text, license_scan.TEMPLATES, license_scan.PHRASES) for r in noted.collect()}
    out = license_scan.license_matches(noted).collect()
    assert len(out) == len(want)
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in out} == want
    assert want[9001][1] == 6 and "mit" in want[9002][5]


def test_licenses_in_wrapped_texts_and_their_variants(spark):
    """Statements are found over line breaks and far inside a text; names and variants are told apart."""
    import textwrap

    from pyspark.sql.types import LongType, StringType, StructType

    cases = [(textwrap.fill(f"{'lorem ipsum ' * k}{t}{' dolor sit' * 40}", 30), label) for t, label in license_scan.TEMPLATES for k in (0, 31)]
    cases += [
        ("Licensed under the GNU General Public License", "gpl"), ("Licensed under the GNU Lesser General Public License", "gpl,lgpl"), ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by"), ("Licensed under CC BY 4.0 or under CC BY-SA 4.0", "cc-by,cc-by-4.0,cc-by-sa-4.0"), ("released " + "word " * 30 + "under the old license", ""), ("released under the apache license", ""),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gpl,lgpl"),
    ]
    docs = spark.createDataFrame(list(enumerate(x for x, _ in cases)), StructType().add("doc_id", LongType()).add("text", StringType()))
    out = {r.doc_id: r for r in license_scan.license_matches(docs).collect()}
    for k, (_, label) in enumerate(cases):
        got, base = set(out[k].labels.split(",")) - {""}, set(out[k].base_labels.split(","))
        assert got - base == set(label.split(",")) - base - {""} and set(label.split(",")) <= got | {""}, (cases[k], got)


def test_licenses_of_repeated_rows_and_empty_table(spark, no_documents):
    assert license_scan.license_matches(no_documents).count() == 0
    rows = [(1, "all rights reserved", "x"), (1, "all rights reserved", "x"), (1, "other", "x"), (None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token string").selectExpr("*", "1 AS label", "2 AS n", "3 AS h", "4 AS low")
    out = sorted((r.doc_id or 0, r.n_base, r.n_words) for r in license_scan.license_matches(docs).collect())
    assert out == [(0, 0, 0), (1, 0, 1), (1, 1, 3), (1, 1, 3)]


def test_only_ascii_capitals_are_folded(spark):
    """KELVIN SIGN isn't k; words are counted alike whatever their case."""
    docs = spark.createDataFrame([(1, "All rıghts reserved. ALL RIGHTS RESERVED"), (2, "this wor\u212a is licensed under the gnu general public license version 3"), (3, "\u0130 cc by")], "doc_id long, text string")
    out = {r.doc_id: r for r in license_scan.license_matches(docs).collect()}
    want = {r.doc_id: brute.licenses(r.text, license_scan.TEMPLATES, license_scan.PHRASES) for r in docs.collect()}
    assert {i: tuple(r)[1:6] for i, r in out.items()} == {i: w[:5] for i, w in want.items()}


def test_personal_data_equals_brute_force(noted):
    out = {r.doc_id: r for r in pii.digests(noted).collect()}
    for r in noted.collect():
        counts, digest = brute.base_spans(r.text or "")
        got = out[r.doc_id]
        assert ([got.n_email, got.n_ip, got.n_card, got.n_phone], got.base_sha256) == (counts, digest), r.doc_id


def test_added_spans_are_checked(noted):
    text = noted.filter("doc_id = 9005").first().text
    found = pii.find_spans(noted.filter("doc_id = 9005")).first().pii
    assert [(s.kind, text[s.start : s.end]) for s in found] == [("email", "x@y.zz"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"), ("ssn", "078-05-1120"), ("secret", "abcdEFGH12345678xx")]


def test_many_matches_in_one_text(spark):
    """A text with 100,000 addresses of two kinds: whole results, in time that follows their number."""
    import time

    from tests.llm import brute

    took = {}
    for n in (12_500, 50_000):
        text = "call 1.2.3.4 or é@x a.b@c.de, " * n
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.time()
        row = pii.digests(docs).first()
        took[n] = time.time() - began
        assert (row.n_ip, row.n_email) == (n, n) and ([row.n_email, row.n_ip, row.n_card, row.n_phone], row.base_sha256) == brute.base_spans(text)
        assert row.spans.count(",") == 2 * n - 1 and set(row.scores.split(",")) == {"0.60", "0.90"}
    assert took[50_000] < 8 * max(took[12_500], 1)


def test_context_is_found_over_tiles(spark):
    """The word beside a span counts wherever the span stands."""
    pads = (*range(500, 516), 1020, 1024, 5000)
    texts = [(3 * pad + k, "é" * pad + text) for pad in pads for k, text in enumerate((" visa 4111 1111 1111 1111", " 4111 1111 1111 1111 visa", " 4111 1111 1111 1111"))]
    found = {r.doc_id: r.pii[0] for r in pii.find_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for pad in pads:
        assert [round(found[3 * pad + k].score, 2) for k in (0, 1, 2)] == [1.0, 1.0, 0.7] and found[3 * pad + 2].start == pad + 1


def test_checksums(spark):
    df = spark.createDataFrame([("DE89370400440532013000", True), ("DE89370400440532013001", False), ("DE8937040", False)], "v string, ok boolean")
    assert df.filter(pii.mod97_ok(F.col("v")) != F.col("ok")).count() == 0
    cards = spark.createDataFrame([("4111111111111111", True), ("4111111111111112", False), ("79927398713", True)], "v string, ok boolean")
    assert cards.filter(pii.luhn_ok(F.col("v")) != F.col("ok")).count() == 0


def test_context_raises_score(spark):
    docs = spark.createDataFrame([(1, "please pay by card 4111 1111 1111 1111 today"), (2, "number 4111 1111 1111 1111 there")], "doc_id long, text string").selectExpr("*", "'x' AS pii")
    scores = {r.doc_id: r.pii[0].score for r in pii.find_spans(docs).collect()}
    assert scores[1] > scores[2]


def test_quality_statistics_equal_brute_force(documents, rows):
    out = {r.doc_id: r for r in quality.verdicts(documents).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        want, got = brute.quality(text), out[i]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == want
        assert got.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got.base_failed and got.kept)


def test_quality_rejects_outliers_and_keeps_the_rest(spark, rows):
    """One hot source, one junk document in forty: the junk goes, all else stays."""
    clean = [(1000 + k, next(r[1] for r in rows if r[0] == 600)[k * 300 : k * 300 + 900], "en", "src0") for k in range(400)]
    junk = [(9000 + k, clean[k][1].replace(" ", "### $$$ "), "en", "src0") for k in range(10)]
    out = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(out[i] for i, *_ in junk) and all(out[i] for i, *_ in clean)


def test_quality_of_small_groups_and_empty_table(spark, no_documents):
    assert quality.verdicts(no_documents).count() == 0
    text = "word " * 60 + " ".join(f"x{i}" for i in range(200))
    few = spark.createDataFrame([(1, text, None, None), (1, text, None, None), (2, "too short", "en", "s")], no_documents.schema).selectExpr("*", "1 AS key", "2 AS centre", "3 AS n_words", "4 AS start")
    assert sorted((r.doc_id, r.kept, round(r.distance, 6) if r.doc_id == 1 else 0) for r in quality.verdicts(few).collect()) == [(1, True, 0.0), (1, True, 0.0), (2, False, 0)]


def test_estimate_resists_contamination(spark):
    """A third of far outliers doesn't move the centre."""
    import random

    rng = random.Random(2)
    rows = [("k", *(rng.gauss(0, 1) + (50 if k % 3 == 0 else 0) for _ in range(quality._P))) for k in range(1500)]
    cloud = spark.createDataFrame(rows, "key string, " + ", ".join(f"f{i} double" for i in range(quality._P)))
    centre = quality.estimates(cloud, core=0.6).first().centre
    assert max(map(abs, centre)) < 0.5


def plain_mcd(x, core=0.75):
    """The estimate of one cloud with numpy alone: (centre, scatter, log-determinants of the starts after the first steps)."""
    p, floors = x.shape[1], np.diag(np.square(quality.FLOORS))
    at = lambda v, q: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    middle = np.array([at(c, 0.5) for c in x.T])
    spread = np.maximum([(at(c, 0.75) - at(c, 0.25)) / 1.349 for c in x.T], quality.FLOORS)
    z = (x - middle) / spread
    signs = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    starts = [np.diag(spread**2), np.outer(spread, spread) * np.cov(np.tanh(z).T, bias=True) + floors, np.outer(spread, spread) * (signs.T @ signs) / len(x) * p + floors]

    def step(centre, scatter):
        gap = x - centre
        d = (gap @ np.linalg.inv(scatter) * gap).sum(1)
        near = x[d <= at(d, core)]
        return near.mean(0), quality.consistency(core) * np.cov(near.T, bias=True) + floors

    done = []
    for scatter in starts:
        now = step(*step(middle, scatter))
        done.append((np.linalg.slogdet(now[1])[1], now))
    least, now = min(done, key=lambda r: r[0])
    for _ in range(quality.MORE_STEPS):
        now, was = step(*now), np.linalg.slogdet(now[1])[1]
        if abs(np.linalg.slogdet(now[1])[1] - was) < quality.SETTLED:
            break
    return now, [r[0] for r in done]


def test_estimates_and_verdicts_equal_plain_mcd(spark):
    """Small clouds of different shapes, one with a statistic that is always 0 and one with a cluster of outliers."""
    rng = np.random.default_rng(8)
    clouds = {"a": rng.normal(size=(160, 6)) @ rng.normal(size=(6, 6)), "b": rng.normal(3, 0.2, (90, 6)), "c": np.vstack([rng.normal(0, 1, (150, 6)), rng.normal(9, 0.5, (40, 6))]), "d": rng.normal(size=(1, 6))}
    clouds["b"][:, 2] = 0
    rows = [(k, *map(float, r)) for k, x in clouds.items() for r in x]
    cloud = spark.createDataFrame(rows, "key string, " + ", ".join(f"f{i} double" for i in range(6)))
    for r in quality.estimates(cloud).collect():
        (centre, scatter), dets = plain_mcd(clouds[r.key])
        if r.key != "d":  # other clouds settle at the same step
            assert r.centre == pytest.approx(centre.tolist(), abs=0.02) and quality._full(r.scatter) == pytest.approx(scatter, abs=0.05)
            assert r.logdet <= min(dets) + 1e-6
    parent = quality.drawn(10, [1.0] * 6, np.eye(6)[quality._UPPER_AT], None)
    mean, scatter = quality.drawn(200, [3.0] * 6, np.eye(6)[quality._UPPER_AT], parent)
    both = np.vstack([rng.normal(1, 1, (200_000, 6)), rng.normal(3, 1, (200_000, 6))])
    assert mean == pytest.approx([2.0] * 6) and scatter == pytest.approx(np.cov(both.T), abs=0.03)


def test_chi_square_and_consistency():
    assert quality.chi_square_quantile(0.999, 6) == pytest.approx(22.4577, abs=1e-3) and quality.chi_square_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)
    x = np.random.default_rng(1).normal(size=(400_000, 6))
    d = (x * x).sum(1)
    assert np.cov(x[d <= np.quantile(d, 0.75)].T).diagonal().mean() * quality.consistency(0.75) == pytest.approx(1, abs=0.02)


def test_quality_labels_agree(spark):
    """Of labelled documents the good ones stay and the bad ones go, at the fixed chi-square quantile."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.verdicts(docs).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 200 and sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar"><nav><ul><li><a href="/a">Home page of it</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now, it is very cheap indeed today.</div><article><h1>Short &amp; head</h1><p><b>First   paragraph,
with more&nbsp;words in it, and a <a href="x">link</a>.<br><p>Second one &lt;here&gt; goes on for a while, as texts do; it ends.</p><aside>Related</aside>
<form><input name="q"><button>Go</button></form><div class="comments"><p>First! What a great text this is, really, I mean it.</p></div></article><footer>&copy; someone</footer></body></html>"""


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (PAGE, "Short & head\nFirst paragraph, with more words in it, and a link.\nSecond one <here> goes on for a while, as texts do; it ends."), ("", ""), (None, ""), ("plain only", "plain only"), ("<p>a<br>b", "a b"),
        ("</div></p>x", "x"), ("<div>" * 3000 + "deep", "deep"), ("<div><p>one", "one"), ("<script>x", ""), ("<!-- open", ""),
        ("<body><h1>Title</h1><div id='menu'><a href=1>One</a></div><div><p>Some text of the page, long enough.</p><p>More of it.</p></div></body>", "Title\nSome text of the page, long enough.\nMore of it."),
    ],
)
def test_main_text(source, text):
    assert html_text.main_text(source or "") == text


_LONG = "A paragraph of the article, with words enough to count as one. " * 3
_ARTICLE = f"<h1>Head</h1><p>{_LONG}</p><h2 id='social-history'>Social history</h2><section id='related-work'><p id='notice-period' title='the hidden cost'>{_LONG}<math><mi>a</mi><mo>+</mo><mi>b</mi></math></p></section>"


@pytest.mark.parametrize("wrapper", ["class='has-sidebar'", "class='content no-comments'", "id='page-with-sidebar'", "class='layout sidebar'", "role='search'"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_only_propose_furniture(wrapper, tag):
    """A wrapper's name doesn't take the article along, nor an id its sections; what stands beside it goes."""
    page = f"<body><div class='menu'>Menu of it</div><div {wrapper}><{tag}>{_ARTICLE}<p hidden=''>Not shown</p></{tag}><div class='comments'><p>First! What a text.</p></div></div></body>"
    long = _LONG.strip()
    assert html_text.main_text(page) == f"Head\n{long}\nSocial history\n{long} a+b"


def test_names_never_take_all_text():
    half = "<p>Some text of the page, long enough.</p>"
    assert html_text.main_text(f"<div class='promo'>{half}</div>") == "Some text of the page, long enough."
    assert html_text.main_text(f"<div class='promo'>{half}</div><div class='related'>{half}</div>")
    assert html_text.main_text("<div class='ad'>An advert with far more text than that.</div><article><p>A short text.</p></article>") == "A short text."


def test_densities_decide(spark, small_dir, monkeypatch):
    """With all densities equal, the text of every page is another one; so the densities choose, not the names."""
    pages = [r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()]
    want = [html_text.main_text(h) for h in pages]
    monkeypatch.setattr(html_text._Page, "densities", lambda page: [1.0] * len(page.tag))
    assert all(html_text.main_text(h) != w for h, w in zip(pages, want, strict=True))


_CHARS, _PER_TAG = lambda page: [float(x) for x in page.chars], lambda page: [c / max(1, t) for c, t in zip(page.chars, page.tags, strict=True)]


@pytest.mark.parametrize(("links", "other"), [(60, lambda page: [1.0] * len(page.tag)), (1, _CHARS), (60, _PER_TAG), (1, _PER_TAG)])
def test_tags_and_links_matter(monkeypatch, links, other):
    """More text in links than in paragraphs: without the adjustment for links they come along."""
    menu = "".join(f"<a href='/{k}'>{'A link with a text of its own that goes on and on. ' * (60 // links)}</a>" for k in range(links))
    page = f"<body><div>{menu}</div><div><p>{_LONG}</p><p>{_LONG}</p></div></body>"
    assert html_text.main_text(page) == f"{_LONG.strip()}\n{_LONG.strip()}"
    monkeypatch.setattr(html_text._Page, "densities", other)
    assert html_text.main_text(page) != f"{_LONG.strip()}\n{_LONG.strip()}"


_LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Link number {k}</a></li>" for k in range(12)) + "</ul>"


@pytest.mark.parametrize("where", ["<div>{links}{text}</div>", "<div><div>{links}</div><div>{text}</div></div>", "<table><tr><td>{links}</td><td>{text}</td></tr></table>", "<div><div>{text}</div><div>Short words</div>{links}</div>"])
def test_pages_without_article_or_names(where):
    """Link lists go by density alone; the paragraphs stay together."""
    text = f"<h2>Head</h2><p>{_LONG}</p><p>Short one.</p><p>{_LONG}</p>"
    out = html_text.main_text("<body>" + where.format(links=_LINKS, text=text) + "</body>")
    assert "Link number" not in out and f"Head\n{_LONG.strip()}\nShort one.\n{_LONG.strip()}" in out


def test_names_inside_an_article_say_what_it_is_about():
    page = f"<body><article><p>{_LONG}</p><div class='search-results-study'><p>{_LONG}</p></div><div class='related-posts'><p>See this one too.</p></div><p>Also: a <math><mi>x</mi></math></p></article></body>"
    assert html_text.main_text(page) == f"{_LONG.strip()}\n{_LONG.strip()}\nAlso: a x"


def test_long_pages():
    assert html_text.main_text(f"<body><nav>{_LINKS}</nav><article>" + f"<p>{_LONG}</p>" * 20_000 + "</article></body>") == "\n".join([_LONG.strip()] * 20_000)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    out = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, *[len(html_text.main_text(PAGE))] * 2]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_article_of_every_real_page(spark, small_dir):
    """The pages' articles have one block for the heading and one for each paragraph."""
    import html as h
    import re

    for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        want = [" ".join(h.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert html_text.main_text(r.html) == "\n".join(x for x in want if x)


def test_languages_on_held_out_documents(spark, small_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_mixture_equals_plain_expectation_maximisation():
    """The proportions, their likelihood and the chosen languages, against loops over single trigrams."""
    import math

    rng = np.random.default_rng(4)
    for languages in (2, 5):
        p = rng.dirichlet(np.full(40, 0.3), languages)
        n = rng.multinomial(300, p[0] * 0.6 + p[1] * 0.4).astype(float)
        seen = np.flatnonzero(n)

        def plain(of):
            share = [1 / len(of)] * len(of)
            for _ in range(language_id.STEPS):
                new = [0.0] * len(of)
                for g in seen:
                    whole = sum(share[k] * p[i][g] for k, i in enumerate(of))
                    for k, i in enumerate(of):
                        new[k] += n[g] * share[k] * p[i][g] / whole
                share = [x / n.sum() for x in new]
            return share, sum(n[g] * math.log(sum(share[k] * p[i][g] for k, i in enumerate(of))) for g in seen)

        share, fit = language_id.mixture(p[:, seen], n[seen])
        want, want_fit = plain(range(languages))
        assert share == pytest.approx(want) and fit == pytest.approx(want_fit)
        alone = [sum(n[g] * math.log(p[i][g]) for g in seen) for i in range(languages)]
        order = [int(np.argmax(alone)), *(k for k in sorted(range(languages), key=lambda i: -want[i]) if k != int(np.argmax(alone)))]
        best, chosen = max(alone), {order[0]: 1.0}
        for size in range(2, languages + 1):
            s, f = plain(order[:size])
            if f - best <= language_id.PENALTY * math.log(n.sum()) / 2:
                break
            best, chosen = f, dict(zip(order[:size], s, strict=True))
        assert dict(language_id.languages_of(p, np.log(p), seen, n[seen])) == pytest.approx(chosen)


def invented(seed: int, languages: int, each: int) -> list[tuple]:
    """Documents in languages that each have their own letters' frequencies."""
    rng, out = np.random.default_rng(seed), []
    for k in range(languages):
        weights = rng.dirichlet(np.full(26, 0.3))
        for j in range(each):
            word = ["".join(chr(97 + c) for c in rng.choice(26, 5, p=weights)) for _ in range(30)]
            out.append((k * each + j, " ".join(word), f"l{k:03d}"))
    return out


def test_any_number_of_languages_is_learned(spark, monkeypatch):
    """200 languages: all learned; sparse and dense probabilities, and a model joined by trigram, say the same."""
    docs = spark.createDataFrame(invented(2, 200, 12), "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs)
    assert len(model.languages) == 200 > language_id.DENSE_LANGUAGES
    out = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert sum(r.lang_pred == r.lang for r in out.values()) >= 0.9 * len(out)
    table = language_id.train(docs, model_entries=10)
    assert table.start is None and table.table is not None
    joined = {r.doc_id: r for r in language_id.identify(docs.unionByName(spark.createDataFrame([(5000, None, "x"), (5001, "12", "x")], docs.schema)), table).collect()}
    assert [joined.pop(k).lang_pred for k in (5000, 5001)] == ["und", "und"]
    dense = model.dense()
    log_p = np.log(dense)
    for i, r in out.items():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        at, n = language_id._counts(language_id._trigrams(raw, np.array([0, len(raw)]))[0])
        want = language_id._named(model.languages, language_id.languages_of(dense, log_p, at, n.astype(float)))
        for got in (r, joined[i]):
            assert (got.lang_pred, got.lang_mix) == (want[0], want[2]) and got.score == pytest.approx(want[1])


def test_language_of_a_very_long_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    long = {r.lang: r.text * (2_000_000 // len(r.text)) for r in docs.filter("n_chars > 3000 AND lang IN ('en', 'fr')").collect()}
    rows = spark.createDataFrame([(1, long["en"]), (2, long["fr"])], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(rows, language_id.train(docs)).collect()} == {1: "en", 2: "fr"}


def test_mixed_texts_name_both_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    one = {r.lang: r.text for r in docs.filter("n_chars > 3000 AND lang IN ('en', 'es')").collect()}
    row = language_id.identify(spark.createDataFrame([(one["en"][:2000] + " " + one["es"][:1500],)], "text string"), model).first()
    shares = {k: float(v) for k, v in (x.split(":") for x in row.lang_mix.split(","))}
    assert set(shares) == {"en", "es"} and 0.4 < shares["en"] < 0.75 and row.lang_pred == "en"


def test_languages_of_awkward_rows(spark, documents, rows, no_documents):
    out = {r.doc_id: r for r in language_id.predictions(documents).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (1, 2, 3))
    assert language_id.predictions(no_documents).count() == 0
    odd = spark.createDataFrame([(None, "words of a text", "en"), (3, "123 !!", "en")], "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    assert [r.lang_pred for r in language_id.predictions(odd).orderBy("doc_id").collect()][1] == "und"
    kept = language_id.accepted(documents.selectExpr("*", "7 AS score"))
    assert kept.columns == [*documents.columns, "score"] and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3}) and kept.filter("score <> 7").count() == 0
