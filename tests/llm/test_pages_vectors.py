import numpy as np
import pytest

from quillspark.llm import embeddings, html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href=x>Home</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>One two.<br><p>Three&nbsp;<i>fo</i>ur</p><p class="notice">No</p><aside>Side</aside><form><p>Field</p></form><div id="comments"><p>Said</p></div><p>Five</p></article><footer>&copy;</footer>"""


def test_article_text():
    assert html.extract(PAGE) == "Head & more\nOne two.\nThree four\nFive"


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>", ""), ("no tags at all", "no tags at all"), ("<article><p>a<p>b", "a\nb"), ("<article><script>x", "")])
def test_odd_pages(page, want):
    assert html.extract(page) == want


def test_region_without_article():
    page = "<div id=t><a>Home</a> <a>About</a></div><div><p>" + "long text here " * 20 + "</p><p>Short.</p></div><div class=footer>c</div>"
    assert html.extract(page) == ("long text here " * 20).strip() + "\nShort."


@pytest.mark.parametrize("wrapper", ['div class="page has-sidebar"', 'div id="content-sidebar-wrap"', 'article class="post comments-open"', 'article class="comments"'])
def test_wrappers_named_after_the_layout(wrapper):
    page = f"<body><{wrapper}><p>{'long text here ' * 20}</p><div class='widget sidebar'>Links</div></{wrapper.split()[0]}></body>"
    assert html.extract(page) == ("long text here " * 20).strip()


def test_wrappers_of_noise_are_skipped():
    assert html.extract("<div><p>text</p></div><div class='sidebar-wrapper'>Links</div><div id='footer-wrap'>c</div>") == "text"
    assert html.extract("<article><p>text</p><article class='comment'>Said</article></article>") == "text"


BARE = "<body><div>Jan</div><div>Feb</div><div>Mar</div><div>Apr</div><p>" + "long text here " * 20 + "</p><p>" + "more of it now " * 20 + "</p><div>May</div><div>Jun</div><div>Jul</div><div>Aug</div></body>"


def test_the_clusters_choose_lines(monkeypatch):
    want = ("long text here " * 20).strip() + "\n" + ("more of it now " * 20).strip()
    assert html.extract(BARE) == want
    # Two articles: the one with more text of the upper cluster is the region.
    assert html.extract(f"<article><ul>{'<li><a>x y</a></li>' * 400}</ul></article><article><p>{'long text here ' * 20}</p></article>") == ("long text here " * 20).strip()
    monkeypatch.setattr(html, "threshold", lambda values: float("-inf"))
    assert html.extract(BARE).startswith("Jan")


def test_comments_and_links_inside_the_text():
    links = "<div><p>" + "long text here " * 20 + "</p><p><a>all of this is a link</a></p><p>" + "long text here " * 20 + "</p></div>"
    assert "all of this is a link" in html.extract(links)
    assert html.extract(f"<article><p>{'text ' * 20}</p><div id='comments'><p>{'said ' * 400}</p></div></article>") == ("text " * 20).strip()


@pytest.mark.parametrize("deep", ["<div>" * 100_000 + "end", "<div>" * 50_000 + "</section>" * 50_000 + "end", "<article>" * 30_000 + "<p>end", "<p>" + "<b>" * 100_000 + "end"])
def test_deep_pages_take_time_in_proportion(deep):
    import time

    began = time.time()
    assert html.extract(deep) == "end" and time.time() - began < 20


@pytest.mark.parametrize("name", ['div class="share-price"', 'section id="alert-systems"', 'section class="discussion"', 'ul id="menu-for-dinner"', 'p class="notice-period"', 'div class="header-files"', 'div class="commentary"'])
def test_names_that_only_begin_like_noise_are_content(name):
    tag = name.split()[0]
    assert html.extract(f"<article><p>{'text ' * 20}</p><{name}>kept words</{tag}><p>end</p></article>").split("\n")[1] == "kept words"


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "google-ad", "cookie-banner", "cookie_notice", "newsletter-signup", "post-comments", "comment-list", "site-footer", "top-nav", "main-menu", "breadcrumb", "related-posts", "social-share", "share-buttons", "left-sidebar", "widget", "widget-3"])
def test_customary_names_are_noise(name):
    assert html.extract(f"<article><p>{'text ' * 20}</p><div class='x {name}'><p>noise</p></div></article>") == ("text " * 20).strip()


def test_lists_and_tables_at_the_end_without_an_article():
    text = "<p>" + "long text here " * 20 + "</p><p>" + "more of it now " * 20 + "</p>"
    rest = "<h2>In short</h2><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table>"
    menu = "<ul><li><a>Home</a></li><li><a>About</a></li></ul>"
    out = html.extract(f"<body><div>Jan</div><div id=c>{menu}{text}{rest}{menu}</div><div>Feb</div></body>").split("\n")
    assert out[2:] == ["In short", "one", "two", "a", "b"] and len(out) == 7


def test_the_ratio_decides_on_pages_without_articles(monkeypatch):
    """A labelled set: text of a few long paragraphs among many short lines in containers of their own, in all orders."""
    import random

    rng = random.Random(5)
    pages = []
    for i in range(60):
        before, after = ([f"<div><span>{w}</span></div>" for w in rng.sample(["Jan", "Feb", "Mar", "Home", "Log in", "Top", "Next", "Tags"], rng.randrange(2, 6))] for _ in range(2))
        paragraphs = [" ".join(rng.choice(["words", "of", "a", "long", "story"]) for _ in range(rng.randrange(30, 90))) for _ in range(rng.randrange(2, 5))]
        pages.append(("<body>" + "".join(before) + "".join(f"<p>{x}</p>" for x in paragraphs) + "".join(after) + "</body>", "\n".join(paragraphs)))
    right = [html.extract(page) == want for page, want in pages]
    assert sum(right) == len(pages)
    monkeypatch.setattr(html, "smoothed", lambda ratios: [1.0] * len(ratios))
    assert sum(html.extract(page) == want for page, want in pages) < len(pages) / 10


@pytest.mark.parametrize("mark", ["<!--", "<a ", '<a href="', "<b x='", "</a ", "<![CDATA[", "<?", "<!doctype "])
@pytest.mark.parametrize("end", ["", "<p>end</p>"])
def test_markup_that_nothing_ends_takes_time_in_proportion(mark, end):
    import time

    began = time.time()
    out = html.extract("<article><p>text</p>" + mark * 20_000 + end)
    assert time.time() - began < 5 and out.startswith("text")


def test_comments_end_or_are_text():
    assert html.extract("<article><p>a<!-- x --></p><p>b<!-- y\n--></p><p>c<!-- z</p><p>d</p>") == "a\nb\nc<!-- z\nd"


def test_very_long_page():
    page = "<article>" + "<p>some words here</p>" * 50_000 + "</article>"
    assert html.extract(page).count("\n") == 49_999


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (None, None, None, 2), (1, "u", PAGE, 1)], "page_id long, url string, html string, TEXT long")
    rows = html.extract_pages(pages).collect()
    assert sorted(r.n_chars for r in rows) == [0, 36, 36] and html.extract_pages(pages.limit(0)).count() == 0


def _brute(ids, x, label):
    ok = np.array([v is not None and lab is not None and i is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v, lab in zip(ids, x, label, strict=True)])
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(ids)
    for i in range(len(ids)):
        for j in range(i):
            if ok[i] and ok[j] and label[i] == label[j] and len(x[i]) == len(x[j]):
                a, b = np.array(x[i], float), np.array(x[j], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= embeddings.COSINE:
                    n[i] += 1
                    n[j] += 1
                    r, s = root(i), root(j)
                    up[max(r, s)] = min(r, s)
    return n, [root(i) for i in range(len(ids))]


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    x = [list(map(float, b + rng.standard_normal(16) * s)) for b in base for s in (0, 0.05, 0.1, 0.2)]
    label = [i // 4 % 3 for i in range(len(x))]
    x += [x[0], x[0], None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [], x[0], [1e300 * v for v in x[0]]]
    label += [label[0], label[0], 0, 0, 0, 0, 0, None, label[0]]
    rows = spark.createDataFrame(list(zip(range(len(x)), x, label, ["q"] * len(x), strict=True)), "vec_id long, embedding array<double>, label int, LABEL string".replace("LABEL string", "size string"))
    got = {r.vec_id: r for r in embeddings.near_duplicate_vectors(rows).collect()}
    with np.errstate(all="ignore"):
        x[-1] = x[0]  # the same direction
        n, root = _brute(list(range(len(x))), x, label)
    assert len(got) == len(x)
    found, there = sum(r.n_links for r in got.values()), sum(n)
    assert all(got[i].n_links <= n[i] for i in got) and found >= 0.9 * there
    assert sum(got[i].component_id == root[i] for i in got) >= 0.95 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_split_buckets_count_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    b = rng.standard_normal(16)
    rows = spark.createDataFrame([(i, list(map(float, b + rng.standard_normal(16) * 0.02)), 1) for i in range(60)], "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, embeddings.near_duplicate_vectors(rows).collect()))
    monkeypatch.setattr(embeddings, "SPLIT", 10)
    assert sorted(map(tuple, embeddings.near_duplicate_vectors(rows).collect())) == whole and whole[0][1] == 59


def test_no_vectors(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
