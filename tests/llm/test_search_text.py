import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewatch.llm import dimension_scan as D
from zonewatch.llm import html_text as H
from zonewatch.llm import licences as L
from tests.llm.cases import AWKWARD, documents, prose


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 24))
    v = [(centres[rng.integers(20)] + 0.5 * rng.standard_normal(24)).astype(np.float32).tolist() for _ in range(1500)]
    v += [v[0]] * 300 + [[0.0] * 24, None, [1.0] * 23 + [None], [float("nan")] * 24, [float("inf")] * 24, [1.0, 2.0], []]
    rows = [(k, x, k) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = D.nearest(spark, df, F.col("id") % 50 == 0, D.Scan(block=200, least_seen=100)).collect()
    fine = [k for k, x in enumerate(v) if k < 1800]
    m = np.array([v[k] for k in fine], dtype=float)
    hit = 0
    queries = [k for k in fine if k % 50 == 0]
    assert {r.query_id for r in got} == set(queries)
    for q in queries:
        s = (m @ m[q]) / (np.linalg.norm(m, axis=1) * np.linalg.norm(m[q]))
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in mine]
        assert [r.score for r in mine] == pytest.approx([s[r.vec_id] for r in mine], abs=1e-12)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = sorted((-round(s[k], 9), k) for k in fine if k != q)[:5]
        hit += len({k for _, k in best} & {r.vec_id for r in mine})
    assert hit >= 0.9 * 5 * len(queries)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = sorted(map(tuple, D.nearest(spark, df, F.col("id") % 50 == 0).select("query_id", "rank", "vec_id").collect()))
    assert rows == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert D.nearest(spark, df.where("false"), F.col("id") % 50 == 0).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu {k}</a></li></ul></nav>'
    '<!-- ad --><div class="ad">Buy {k}</div>{open}<h1>Title &amp; more</h1><p><b>First\n  {k} pa</b>ra.<br><p>Second &lt;{k}&gt; &quo</p><form>Mail</form>{close}'
    '<div class="comments">Nice!</div><footer>&copy; us</footer>'
)


def test_html(spark):
    rows = []
    for k in range(30):
        kind = ("<article>", "</article>") if k % 2 else ('<div class="story">', "</div>")
        rows.append((k, f"https://{'a' if k % 3 else 'B'}.example.org:80/{k}", PAGE.format(k=k, open=kind[0], close=kind[1]), 1, "x"))
    rows += [(100, None, None, 1, "x"), (101, "odd", "", 1, "x"), (102, "https://c.d/", "no tags & all", 1, "x"), (103, "https://c.d/", "<p>cut &amp", 1, "x"), (103, "https://c.d/", "<p>cut &amp", 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string")
    got = sorted(map(tuple, H.extracted(df.drop("host", "text")).select("page_id", "text", "n_chars").collect()))
    want = []
    for k in range(30):
        want.append((k, f"Title & more First {k} para. Second <{k}> &quo"))
    want += [(100, ""), (101, ""), (102, "no tags & all"), (103, "cut &"), (103, "cut &")]
    assert got == [(k, t, len(t)) for k, t in want]
    assert H.extracted(df.where("false")).count() == 0


def test_html_host_template(spark):
    """Without article elements the slot with the most varying words is the article; text common to all pages stays in it."""
    rows = [(k, "https://h.org/", f'<body><div class="top">Site name</div><div class="main-text"><p>{t}</p><p>Same on all.</p></div><div class="more">See {k}</div></body>') for k, t in enumerate(prose(12, 3, 30, 40))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extracted(df).collect()}
    assert got == {k: f"{t} Same on all." for k, t in enumerate(prose(12, 3, 30, 40))}


def test_html_template_inside_main(spark):
    """The host's template decides on every page: what repeats or stands beside the article goes, whatever its class is called."""
    texts = prose(24, 4, 30, 40)
    page = (
        '<body><main><div class="row1">Read {k} more</div><article><h1>Head {k}</h1><div class="x1">Tell your friends</div><p>{t}</p>'
        '<div class="text"><p>End {k}.</p><p>Same on all.</p></div></article><div class="col2"><p>Always here</p></div></main></body>'
    )
    bare = '<body><main><p>{t}</p><div class="x1"><ul><li>Tell</li><li>Friends</li></ul></div><section><h2>Part {k}</h2></section></main></body>'
    rows = [(k, f"https://{'a' if k < 12 else 'b'}.org/", (page if k < 12 else bare).format(k=k, t=t)) for k, t in enumerate(texts)]
    rows += [(100, "https://one.org/", page.format(k=1, t="Alone")), *[(k, "https://copies.org/", page.format(k=1, t="Copied")) for k in range(101, 108)]]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(12)] == [f"Head {k} {texts[k]} End {k}. Same on all." for k in range(12)]
    assert [got[k] for k in range(12, 24)] == [f"{texts[k]} Part {k}" for k in range(12, 24)]
    # One page, or copies alone, don't tell what is template: the article is taken whole.
    assert got[100] == "Head 1 Tell your friends Alone End 1. Same on all."
    assert {got[k] for k in range(101, 108)} == {"Head 1 Tell your friends Copied End 1. Same on all."}


@pytest.mark.parametrize("wrapper", [
    'class="site no-sidebar"', 'id="page-with-header"', 'class="layout-sidebar"', 'class="post social-share"', 'data-id="comments-3"', 'title="a class=ad b"', "class='sidebar'",
])
@pytest.mark.parametrize("inner", ["article", "main", 'div role="main"', 'article class="post comments-open"'])
def test_html_wrapped_article(wrapper, inner):
    """An article is found whatever the names around it hold; what is named as boilerplate in or beside it goes."""
    page = f'<div {wrapper}><nav>Menu</nav><{inner}><p>Words</p><div class="x cookie-banner">Eat</div></{inner.split()[0]}></div><div class="comments">Nice</div>'
    assert H.chosen(page, None) == "Words"


def test_html_never_empty():
    assert H.chosen('<article class="comment"><p>Only this.</p></article>', None) == "Only this."
    assert H.chosen('<div class="data-list"><p>Plain</p></div><aside><article>Teaser</article></aside>', None) == "Plain"
    assert H.chosen('<div data-class="ad" class="no-ads"><p>Plain text</p></div>', None) == "Plain text"


def test_html_wrapped_article_on_a_host(spark):
    rows = [
        (k, "https://h.org/", f'<body><div class="sidebar"><article><p>{t}</p></article></div><div class="foot">About us {k}</div></body>')
        for k, t in enumerate(prose(12, 5, 30, 40))
    ]
    got = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(prose(12, 5, 30, 40)))


def plain_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, L.BASE[p]) for i in range(len(w)) for p in L.BASE if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licences(spark):
    texts = AWKWARD + prose(5) + [
        "Released under the MIT License.", "MIT\nlicense MIT license mit-license", "Apache-License; see GNU General Public License, version 3",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under CC BY-NC 4.0. " + prose(1)[0], "public license general", "free software is good", "the license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    got = L.scanned(documents(spark, texts)).orderBy("doc_id").select("licence.*").collect()
    for r, t in zip(got, texts, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    k = len(AWKWARD) + 5
    assert [r.labels for r in got[k:]] == ["mit", "mit", "apache,gpl", "mit", "cc-by-nc", "", "", "", "bsd"]
    assert got[k].score == pytest.approx(1.0)
    assert L.scanned(documents(spark, [None]).where("false")).count() == 0


def test_html_formulas_stay():
    from zonewatch.llm.html_text import chosen

    page = "<body><article><p>Formula <math><mi>x</mi></math> and <svg><text>label</text></svg> drawn</p></article></body>"
    assert chosen(page, None) == "Formula x and label drawn"


def test_html_tables_without_end_tags():
    """End tags that may be left out are implied, so that long tables stay flat; and nesting has an end."""
    import tracemalloc

    from zonewatch.llm.html_text import blocks

    flat, paths, _ = blocks("<table><thead><tr><th>h<th>i<tbody><tr><td>a<td>b<table><tr><td>in</table><tr><td>c</table>end")
    assert [b.text for b in flat] == ["h", "i", "a", "b", "in", "c", "end"]
    assert paths[">table>tbody>tr"] == 2 and paths[">table>tbody>tr>td"] == 3 and flat[-1].path == ""
    tracemalloc.start()
    found, paths, _ = blocks("<article><table>" + "<tr><td>x" * 100_000 + "</table></article>")
    assert len(found) == 100_000 and len(paths) == 4
    found, paths, _ = blocks("<div>x" * 50_000)
    assert len(found) == 50_000 and len(paths) < 600
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
