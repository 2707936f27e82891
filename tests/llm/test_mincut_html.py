"""Operator 11: the cut against exhaustive labelling, the reader and the extraction against planted pages."""
import itertools
import random

import pytest
from venturelens.llm import mincut_html as M

SF = "/root/testdata/sf0.01"
LONG = "Real text here, with some words in it. "


@pytest.fixture(scope="module")
def labeller(spark):
    return M.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def energy(side, caps, edges):
    return (sum(max(c, 0) if not s else max(-c, 0) for s, c in zip(side, caps))
            + sum(c for a, b, c in edges if side[a] != side[b]))


def test_min_cut_against_all_labellings():
    rng = random.Random(2)
    unsettled = 0
    for _ in range(400):
        n = rng.randint(1, 9)
        caps = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 7)) for _ in range(rng.randint(0, 2 * n))]
        least = min(energy(s, caps, edges) for s in itertools.product([False, True], repeat=n))
        near = [sum(c for a, b, c in edges if v in (a, b) and a != b) for v in range(n)]
        unsettled += all(abs(c) < d for c, d in zip(caps, near))
        got = M.min_cut(caps, edges)
        assert all(isinstance(s, bool) for s in got) and energy(got, caps, edges) == least
    assert unsettled > 10                      # the blocking flows were needed


def test_large_chain_of_undecided_blocks():
    rng = random.Random(1)
    n = 30_000
    caps = [rng.choice([-3, 3]) for _ in range(n)]
    edges = [(i, i + 1, 4) for i in range(n - 1)]
    got = M.min_cut(caps, edges)
    # the chain alone, by dynamic programming
    cost = [0, 0]
    for i, c in enumerate(caps):
        step = [min(cost[s], cost[1 - s] + (4 if i else 0)) for s in (0, 1)]
        cost = [step[0] + max(c, 0), step[1] + max(-c, 0)]
    assert energy(got, caps, edges) == min(cost)


def blocks(source):
    return M.Page(source).text


def test_reader_decodes_and_splits_blocks():
    assert blocks("a &lt;b&gt;&amp;&nbsp; c<br>d&eacute;&#233;&#x4e2d; &am &amp") == ["a <b>& c déé中 &am &"]
    assert blocks("<p>one<b>two<p>three</b> four<div>five</div>six") == ["onetwo", "three four", "five", "six"]
    assert blocks("x<script>var t='</p><p>no'</script>y<style>p{}</style><!-- <p>no</p> -->z<!-->w") == ["xyzw"]
    assert blocks("<title>No</title><textarea>no</textarea><select><option>no<option>no</select>yes") == ["yes"]
    assert blocks("<p title='a>b' data-x=\"</p>\">in</p><p class=it's>out") == ["in", "out"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks("1 < 2 <3 <> </ > <p") == ["1 < 2 <3 <>"]
    assert blocks("a<script>never ends <p>x") == ["a"] and blocks("") == [] and blocks("<p>  \n\t</p>") == []
    assert blocks("<button>no<p>no</button>yes") == ["yes"] and blocks("a<svg><text>no</text></svg>b") == ["ab"]


def hints(source):
    page = M.Page(source)
    told = page.resolved()
    return {t: told[node] for t, node in zip(page.text, page.node)}


def test_containers_say_what_they_hold():
    got = hints("<body class=has-sidebar><nav>n</nav><main><header><h1>t</h1></header><p>c</p><aside>s</aside>"
                "<div id=comments><article class=comment><p>r</p></article></div><div class=entry-footer>f</div></main>"
                "<div class='cookie-notice'>k</div><div class=page>p</div><form>q</form><div hidden>h</div></body>")
    assert got == {"n": -1, "t": 1, "c": 1, "s": -1, "r": -1, "f": -1, "k": -1, "p": 0, "q": -1, "h": -1}
    assert M.word_hint("post-with-sidebar") == 1 and M.word_hint("articleComments") == -1 and M.word_hint("adobe") == 0
    wrapped = hints(f"<form id=f><div class=post>{LONG * 5}</div><p>x</p></form>")
    assert wrapped[(LONG * 5).strip()] == 1 and wrapped["x"] == 0


def page(*parts):
    return "<html><head><title>T</title></head><body>" + "".join(parts) + "</body></html>"


MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>About us</a><li><a href=/c>Contact</a></ul>"
BODY = [LONG * 6, "Short one.", LONG * 4, LONG * 9]


@pytest.mark.parametrize("source", [
    page("<nav>", MENU, "</nav><article>", *(f"<p>{b}</p>" for b in BODY), "</article><footer>&copy; Us</footer>"),
    page("<div>", MENU, "</div><div>", *(f"<div>{b}</div>" for b in BODY), "</div><div>© 2020 | <a href=x>Privacy</a></div>"),
    page("<header>Site</header><form>Search <input></form><main>", *(f"<p>{b}" for b in BODY),
         f"<section class=comments><p>{LONG * 3}</p></section></main><aside><p>{LONG}</p></aside>"),
    page(f"<div class=cookie-banner><p>{LONG * 2}</p></div><div id=content>", *(f"<p>{b}</p>" for b in BODY),
         f"<div class=ad>{LONG}</div></div><div id=sidebar>", MENU, "</div>"),
])
def test_planted_pages(labeller, source):
    assert labeller.text(source).split("\n") == [b.strip() for b in BODY]


def test_extraction_of_awkward_tables(spark, labeller):
    article = page("<nav>", MENU, "</nav><article>", *(f"<p>{b}</p>" for b in BODY), "</article>")
    want = "\n".join(b.strip() for b in BODY)
    deep = "<div>" * 50_000 + f"<article><p>{LONG}</p></article>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "u", ""), (None, "u", article), (4, "u", "<p"),
            (5, "u", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>"), (6, "u", deep), (7, "u", "<a b=\"" * 50_000),
            (8, "u", "</b>" * 100_000 + "<!-- " * 50_000)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = M.extract(frame, labeller)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {}
    for r in got.collect():
        assert r.n_chars == len(r.text)
        found.setdefault(r.page_id, []).append(r.text)
    assert found[1] == [want, want] and found[None] == [want] and found[2] == found[3] == found[4] == [""]
    assert found[5] == ["\n".join([LONG.strip()] * 20_000)] and found[6] == [LONG.strip()] and found[7] == [""] and found[8] == [""]
    assert M.extract(frame.limit(0), M.fit(frame.limit(0))).collect() == []
    assert M.fit(frame.limit(0)).weights == M.PLAIN


def test_all_given_pages_against_their_article(spark, labeller):
    """The given pages mark their article: every block of it, and nothing else."""
    import html
    import re

    rows = M.extract(spark.read.parquet(f"{SF}/pages.parquet"), labeller).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(p for p in parts if p)
    assert len(rows) == len(source)
