import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import html as h


def pages(spark, rows):
    return spark.createDataFrame([(i, u, x, "t", 1) for i, u, x in rows], "page_id long, url string, html string, text string, host int")


CASES = [
    ("<html><body><nav><ul><li>Home</li></ul></nav><article><h1>T &amp; U</h1><p>One\n two<p>Th<b>r</b>ee<br>four</article><footer>f</footer></body>", "T & U\n\nOne two\n\nThree four"),
    ("<script>var t=\"</p><p>x\";</script><style>p{}</style><!-- <p>no</p> --><main><p>yes</p><div class='comments'>c<p>d</p></div><p>end</main>", "yes\n\nend"),
    ('<div class="ad top">a</div><article><header><h1>H</h1></header><p title="a > b">text</p><aside>s</aside><form>f</form><p>t2</article>', "H\n\ntext\n\nt2"),
    ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>&#233;&lt;p&gt;&nbsp;x</article>", "a b\n\nc\n\né<p> x"),
    ("", ""), (None, ""), ("plain &amp; text", "plain & text"), ("<article><p>un<p>closed", "un\n\nclosed"), ("<nav>only", ""),
    ("<article><p>shared words</p></article><div id=cookie-notice>ok</div>", "shared words"),
    ('<article><div class="post-header"><h1>Title</h1></div><section id="search-results-study">a study</section><div class=share-price>up</div></article>', "Title\n\na study\n\nup"),
    ('<main><div class="header">Head</div><p>text</p><div class="social-share-buttons">s</div><ul class="related-links"><li>r</ul><div role=complementary>c</div></main>', "Head\n\ntext"),
    ('<div class="site-header">h</div><div class="header-image-study">kept</div><div class="ad-slot-3">a</div><p>loose</p>', "kept\n\nloose"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_text_of_one_page(html, text):
    assert h.main_text(h.lines(html), None) == text


def test_lines_shared_with_the_nearest_page_go(spark):
    page = lambda body: f"<body><div>Site name</div><div>{body}</div><p>{body} again</p><div>All rights</div></body>"
    rows = [(1, "http://a.org/x/1", page("one")), (2, "https://A.org/x/2?q=1", page("two")), (3, "http://a.org/y/9", page("nine")), (4, "http://b.org/", page("alone")), (5, None, None), (6, "http://a.org/x/1", "")]
    got = {r.page_id: r for r in h.extract(pages(spark, rows).repartition(3)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[2].text == "two\n\ntwo again" and got[3].text == "nine\n\nnine again" and got[5].text == "" and got[6].text == ""
    assert got[4].text.startswith("Site name") and all(r.n_chars == len(r.text) for r in got.values())
    assert h.extract(pages(spark, [])).count() == 0


def test_articles_that_are_copies_stay(spark):
    a = "<nav>n</nav><article><p>the same text</p></article>"
    assert [r.text for r in h.extract(pages(spark, [(i, f"http://a.org/{i}", a) for i in range(9)])).collect()] == ["the same text"] * 9


def test_differencing_decides_about_marked_articles(spark):
    """A marked teaser that all pages show goes; an article that quotes its neighbour's stays whole, and so do copies."""
    page = lambda body: f"<nav>n</nav><article class=teaser><p>Read our best stories</p></article><main><p>{body}</p><p>shared quote</p></main>"
    rows = [(k, f"http://a.org/{k}", page(f"a story of its own, number {k}")) for k in range(5)] + [(9, "http://b.org/", page("alone"))]
    got = {r.page_id: r.text for r in h.extract(pages(spark, rows).repartition(2)).collect()}
    assert h.main_text(h.lines(rows[0][2]), h.lines(rows[1][2])) == "a story of its own, number 0\n\nshared quote"
    assert h.main_text(h.lines(rows[0][2]), h.lines(rows[0][2])) == "Read our best stories\n\na story of its own, number 0\n\nshared quote"
    assert got[9] == "Read our best stories\n\nalone\n\nshared quote" and all(got[k].endswith(f"number {k}\n\nshared quote") for k in range(5))
    assert sum(not got[k].startswith("Read") for k in range(5)) >= 2  # all but those alone in their range partition


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_longest_common_subsequence(a, b):
    got = h.common(a, b)
    assert all(a[i] == b[j] for i, j in got) and len(got) == longest(a, b)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_equal_pages_do_not_empty_each_other():
    page = h.lines("<div>Menu</div><p>one</p><p>two</p>")
    assert h.main_text(page, page) == "Menu\n\none\n\ntwo"


def plain(a, b):
    """What differencing keeps of page a beside b: all but one longest common subsequence, by a full table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return len(a) - best[0][0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["aa", "bb", "cc", "dd"]), min_size=1, max_size=12), st.lists(st.sampled_from(["aa", "bb", "cc", "dd"]), max_size=12))
def test_differencing_against_a_full_table(a, b):
    kept = h.main_text([(h.LOOSE, x) for x in a], [(h.LOOSE, x) for x in b]).split("\n\n")
    left = plain(a, b)
    assert len([x for x in kept if x]) == (left if left >= h.COPY * len(a) else len(a))
    rest = iter(a)
    assert all(x in rest for x in kept if x)


def test_very_long_and_tied_pages(spark):
    long = "<article>" + "".join(f"<p>paragraph {k} of many</p>" for k in range(20_000)) + "</article>"
    rows = [(1, "http://a.org/1", long), (2, "http://a.org/1", long), (2, "http://a.org/1", long)]
    got = [(r.page_id, r.text.count("\n\n")) for r in h.extract(pages(spark, rows)).orderBy("page_id").collect()]
    assert got == [(1, 19_999), (2, 19_999), (2, 19_999)]


def test_copies_are_no_neighbours(spark):
    page = lambda body, more="": f"<div>Site name</div><div>Home</div><p>{body} is a long main text of words</p><p>{body} goes on for another line</p><div>{more}</div><div>All rights</div>"
    text = lambda body: f"{body} is a long main text of words\n\n{body} goes on for another line"
    rows = [(k, f"http://a.org/x?q={k}", page("one")) for k in range(50)] + [(100 + k, f"http://a.org/y/{k}", page("two", f"n{k}")) for k in range(50)]
    rows += [(200, "http://a.org/z", page("three"))] + [(300 + k, f"http://b.org/{k}", page("four")) for k in range(2)]
    got = {r.page_id: r.text for r in h.extract(pages(spark, rows).coalesce(1)).coalesce(1).collect()}
    assert len(got) == len(rows) and all(text("four") in got[300 + k] for k in range(2))
    assert all(text("one") in got[k] and text("two") in got[100 + k] for k in range(50)) and text("three") in got[200]
    import zlib

    packed = lambda x: zlib.compress("\n".join(f"{z}{t}" for z, t in h.lines(x)).encode())
    own = [(u, i, u, packed(x)) for i, u, x in rows if "a.org" in u]
    before, after = h.nearest(own, -1), h.nearest(own, 1)
    assert before == [None] * 50 + [49] * 50 + [99] and after == [50] * 50 + [100] * 50 + [None]
    assert h.main_text(h.unpack(own[60][3]), h.unpack(own[before[60]][3])) == text("two") + "\n\nn10"


def test_many_partial_copies_cost_few_comparisons(monkeypatch):
    import zlib

    own = [(f"/{k}", k, "u", zlib.compress(f"1{'main text ' * 30}\n1note {k}".encode())) for k in range(400)]
    calls, real = [], h.common
    monkeypatch.setattr(h, "common", lambda a, b: calls.append(1) or real(a, b))
    assert h.nearest(own, -1) == [None] * 400 and len(calls) < 800
