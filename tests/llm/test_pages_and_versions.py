"""HTML extraction and fingerprints."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from rolecall.llm import fingerprint, html_text

PAGES = "page_id long, url string, html string"


def text_of(html, templates=frozenset()):
    return html_text.main_text(html_text.Page(html), templates)


def test_formulas_are_text():
    assert text_of("<article><p>Energy <math><mi>E</mi> = <mi>m</mi></math> holds</p></article>") == "Energy E = m holds"


def test_main_text_of_a_page():
    html = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a>Menu</a></li></ul></nav><div class="ad-box ad">Buy</div>
    <article><h1>Head&amp;line</h1><p>One <b>bold
    </b>word &lt;b&gt; &#233;&nbsp;x<br>after<p>Unclosed <i>two<ul><li>a<li>b</ul><aside>side</aside><form>f <input></form>
    <div class="cookie-notice">ok?</div><table><tr><td>c1<td>c2</table><section id="comments"><article class="comment">me too</article></section>
    <div role="navigation">x</div><blockquote>said</blockquote>tail &am &copy</article><footer>f</footer></body>"""
    assert text_of(html).split("\n") == ["Head&line", "One bold word <b> é x after", "Unclosed two", "a", "b", "c1", "c2", "said", "tail &am ©"]


def test_pages_without_an_article_and_broken_ones():
    assert text_of("<body><main><p>in</p></main><p>out</p>") == "in"
    assert text_of("<p>a</p>b<div hidden>c</div>") == "a\nb"
    assert text_of("") == text_of("<article></article>") == text_of("<nav>only</nav>") == ""
    assert text_of("plain & simple </div></p> text") == "plain & simple\ntext" or text_of("plain & simple </div></p> text") == "plain & simple text"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert text_of(deep) == "x" and text_of("<article>" + "<p>y" * 2000).count("y") == 2000


def site_pages():
    rows = []
    for k in range(30):
        box = f"<div class='box'><span>All about us since 1999</span></div><div class='story'><p>story {k} {k * k}</p></div>"
        rows.append((k, f"https://Site.example/{k}", f"<body><article><h2>T{k}</h2>{box}<p>end</p></article></body>"))
    rows += [(100 + k, f"https://few.example/{k}", rows[k][2]) for k in range(3)]
    return rows


def test_a_branch_that_a_host_repeats_is_removed(spark):
    pages = spark.createDataFrame(site_pages(), PAGES).withColumns({"host": F.lit("clash"), "keys": F.lit("clash"), "text": F.lit("clash")})
    tree = {(r.host, round(r.importance, 2)) for r in html_text.style_tree(pages.withColumn("host", html_text.host())).collect()}
    assert ("site.example", 0.0) in tree and ("site.example", 1.0) in tree
    got = {r.page_id: r for r in html_text.extract(pages.repartition(4)).collect()}
    assert got[7].text == "T7\nstory 7 49\nend" and got[7].n_chars == len(got[7].text)
    assert got[101].text == "T1\nAll about us since 1999\nstory 1 1\nend"  # too few pages to tell


def test_copies_of_a_page_make_no_template(spark):
    bodies = {
        "div": "<body><div><p>story {0}</p><ul><li>one {0}<li>two</ul></div></body>",
        "holder": "<body><div><article><section><p>story {0}</p><table><tr><td>c {0}</table></section></article></div></body>",
    }
    rows = [(k, f"https://{name}.example/{k}", body.format(0 if k < 90 else k)) for name, body in bodies.items() for k in range(100)]
    rows += [(k, f"https://{name}.copies/{k}", body.format(0)) for name, body in bodies.items() for k in range(8)]
    got = {r.url: r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 216
    for _, url, html in rows:
        assert got[url] == text_of(html) and "story" in got[url] and got[url].count("\n") >= 1


def test_lists_of_an_article_are_never_judged(spark):
    # one list in each article of a host
    rows = [(k, f"https://h.example/{k}", f"<body><article><p>story {k}</p><ul><li>always</ul><div class='box'>since 1999</div></article></body>") for k in range(30)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(rows, PAGES)).collect()} == {f"story {k}\nalways" for k in range(30)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://h/", ""), (None, "nonsense", "<p>x</p>"), (3, "http://h/", "<p>☃ y</p>"), (3, "http://h/", "<p>☃ y</p>"), (4, "http://h/", "<p>" + "z " * 50_000)]
    got = html_text.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.text[:5], r.n_chars) for r in got) == sorted([("1", "", 0), ("2", "", 0), ("None", "x", 1), ("3", "☃ y", 3), ("3", "☃ y", 3), ("4", "z z z", 99_999)])
    assert html_text.extract(spark.createDataFrame([], PAGES)).isEmpty()


def test_peeling_recovers_what_differs_and_fails_when_it_is_too_much():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**64, 500, dtype=np.uint64)
    for extra in (0, 1, 5, 12, 300):
        a = [np.r_[common, rng.integers(0, 2**64, extra, dtype=np.uint64)]]
        b = [np.r_[common[3:], rng.integers(0, 2**64, extra // 2, dtype=np.uint64)]]
        base = fingerprint.sketches(a, fingerprint.CELLS), fingerprint.sketches(b, fingerprint.CELLS)
        found, done = fingerprint.peel(base[0] - base[1])
        want = len(set(a[0].tolist()) ^ set(b[0].tolist()))
        assert not done[0] or found[0] == want
        assert done[0] or extra > 5
        assert fingerprint.differing(a, b, *base).tolist() == [want]


def plain_likeness(a, b, cuts):
    x, y = (set(fingerprint.digests(t, cuts).tolist()) for t in (a, b))
    return 1 - len(x ^ y) / max(1, len(x) + len(y))


def test_versions_equal_a_plain_comparison(docs_of):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    rows = [(k * 13 % 997, " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(rng.choice([0, 1, 5, 60, 400])))) for k in range(300)]
    rows += [(5000, None), (5001, "same " * 50), (5002, "same " * 50), (5003, "q" * 3000)]
    rows = list(dict(rows).items())
    got = {r.doc_id: r for r in fingerprint.versions(docs_of(rows).repartition(5)).collect()}
    ordered = sorted((k, t or "") for k, t in rows)
    cuts = fingerprint.Cuts()
    assert len(got) == len(rows)
    for (k, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        r, new = got[k], fingerprint.edited(text, following)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(r.near_edited - plain_likeness(text, new, cuts)) < 1e-12 and abs(r.near_next - plain_likeness(text, following, cuts)) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)
    assert got[5001].fingerprint == got[5002].fingerprint and got[5001].near_next == 1


def test_ranges_hand_their_first_document_to_the_range_before(docs_of, monkeypatch):
    rows = [(k, f"text number {k} " * 20) for k in range(200)]
    docs = docs_of(rows).repartition(6)
    one = sorted(map(tuple, fingerprint.versions(docs).collect()))
    dealt = fingerprint.dealt(docs, range_bytes=5000)
    assert dealt.select("part").distinct().count() > 5 and dealt.where("guest").count() == dealt.select("part").distinct().count()
    monkeypatch.setattr(fingerprint.dealt, "__defaults__", (5000,))
    monkeypatch.setattr(fingerprint, "SLICE", 7)
    assert sorted(map(tuple, fingerprint.versions(docs).collect())) == one


def test_what_an_edit_keeps_is_cut_as_in_the_whole():
    rng, cuts, reused = random.Random(6), fingerprint.Cuts(), 0
    for _ in range(400):
        pick = lambda n: "".join(rng.choice(["word", "é", "a", "Long" * 30, " ", " ", " ", ".", "!", "?!", "\n", "..."]) for _ in range(n))
        old, following = pick(rng.choice([3, 40, 200])), pick(rng.choice([0, 30, 200]))
        new = fingerprint.edited(old, following)
        own = fingerprint.Cut(old, cuts)
        part = fingerprint.Cut(new, cuts, own, len(old) - len(old) // 4)
        assert part.digests().tolist() == fingerprint.digests(new, cuts).tolist()
        reused += len(part.starts) < len(fingerprint.Cut(new, cuts).starts)
    assert reused > 100


def test_fingerprints_of_odd_and_empty_tables(odd_docs, docs_of):
    got = fingerprint.versions(odd_docs).collect()
    assert len(got) == 12 and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].n_chars == 0 and by_id[2].near_next == 1  # null and empty texts are alike
    last = odd_docs.where("doc_id = 10").first().text
    assert by_id[10].edited_sha256 == hashlib.sha256(fingerprint.edited(last, "nobody's words are here").encode()).hexdigest()
    assert fingerprint.versions(docs_of([])).isEmpty()
    lone = fingerprint.versions(docs_of([(1, "only one here")])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1


def test_names_that_hold_a_noise_word_are_not_noise():
    for attributes in ('class="content with-sidebar"', 'id="no-sidebar"', 'class="has-header"', 'class="sidebar"', 'id="main_nav"'):
        assert text_of(f"<body><div {attributes}><article><h1 class='entry-header'>t</h1><section class='promotion'>s</section></article></div></body>") == "t\ns"
    # names still tell where the article is elsewhere, or where they hold less than the rest
    assert text_of("<article>a</article><div class='sidebar'><article>b</article></div>") == "a"
    assert text_of("<main><p>the long text</p><div class='related-posts'><article>b</article></div></main>") == "the long text"
    assert text_of("<p>x</p><div class='Cookie_Notice'>b</div><div class='big ad'>c</div>") == "x"
