"""Main text of pages against written-out expectations and a plain reading of the driver's pages."""

import html
import re

import pytest

from terrastate.llm import webtext as W

SCHEMA = "page_id long, url string, html string, host string, path string, text string"
PROSE = "Some words that make a sentence of the usual length, as one finds in articles."


def run(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "h", "p", "t") for r in rows], SCHEMA)
    out = W.page_texts(spark, frame, **more)
    assert out.columns == ["page_id", "url", "text"]
    return {r.page_id: r.text for r in out.collect()}


def alone(page):
    p = W.read_page(page)
    best, score = p.candidate()
    return p.text_of({best}) if score else ""


@pytest.mark.parametrize("page, text", [
    ("<article><h1>A &amp; B</h1><p>one\n <b>two</b>&nbsp;three<br>four<p>five &lt;x&gt;</article>", "A & B\none two three four\nfive <x>"),
    ("<body><nav><a href=x>menu</a></nav><div class='post'><p>" + PROSE + "</p><div class=ad>Buy!</div><p>More.</p></div><footer>c</footer>", PROSE + "\nMore."),
    ("<main><p>" + PROSE + "<script>var a = '<p>no</p>';</script> end<style>p{}</style></p><!-- <p>no</p> --><form><label>Name</label></form></main>", PROSE + " end"),
    ("<article><p title='a > b' data-x=\"</p>\">in</p><aside>side</aside><ul><li>one<li>two</ul></article>", "in\none\ntwo"),
    ("<article><p>" + PROSE + "</p><section id=comments><p>First! " + PROSE + "</p></section></article>", PROSE),
    ("<article><p>" + PROSE + "</p><div class='comment-list'><article class=comment><p>" + PROSE * 9 + "</p></article></div></article>", PROSE),
    ("<div class='layout sidebar-right'><h1>T</h1><p>" + PROSE + "</p><div class=sidebar>links</div></div>", "T\n" + PROSE),
    ("<article><table><tr><td>a<td>b<tr><td>c</table>tail &#x41;&#66;</article>", "a\nb\nc\ntail AB"),
    ("<article><p>&amp;lt; a &lt b 1 < 2 <3</p></article>", "&lt; a < b 1 < 2 <3"),
    ("<div class=cookie-notice>We use cookies " + PROSE + "</div><p>" + PROSE + "</p>", PROSE),
    ("<article></article><nav>a</nav>", ""), ("", ""), ("no tags at all", "no tags at all"),
    ("<article><p>" + PROSE + "</p>", PROSE), ("<article><p class='x" + "y" * 2_000_000 + "'>" + PROSE, PROSE),
])
def test_single_pages(page, text):
    assert alone(page) == text


def test_deep_and_long_pages():
    assert alone("<div>" * 50_000 + PROSE) == PROSE
    assert alone("<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>") == "\n".join([PROSE] * 20_000)


def site(k, extra=""):
    return f"<body><div class='c{k}'><h1>Title {k}</h1><p>{PROSE} {k}</p></div><div class=x>{extra}</div></body>"


def test_the_hosts_path_wins_over_a_page_of_its_own(spark):
    rows = [(k, f"https://a.org/{k}", site(k)) for k in range(20)]
    rows.append((50, "https://A.org:80/odd", site(50, f"<p>{PROSE * 30}</p>")))  # a long notice without a name
    rows.append((51, "https://b.org/odd", site(50, f"<p>{PROSE * 30}</p>")))
    got = run(spark, rows)
    assert got[50] == f"Title 50\n{PROSE} 50" and got[51] == PROSE * 30
    assert all(got[k] == f"Title {k}\n{PROSE} {k}" for k in range(20))


def test_many_hosts_meet_their_paths_in_a_join(spark):
    rows = [(k, f"https://h{k % 7}.org/{k}", site(k, f"<p>{PROSE * 9}</p>" if k >= 60 else "")) for k in range(66)]
    rows += [(100 + k, "https://busy.org", site(k)) for k in range(60)] + [(200, None, None), (201, "odd", "<p>x</p>"), (201, "odd", "<p>x</p>")]
    assert run(spark, rows, most_hosts=3) == run(spark, rows)


def test_votes_are_few_rows(spark):
    rows = [(k, "https://a.org/", site(k)) for k in range(200)]
    frame = spark.createDataFrame([(u, h) for _, u, h in rows], "host string, html string").repartition(4)
    votes = frame.mapInArrow(W.vote, W.VOTES).collect()
    assert len(votes) <= 4 and sum(v.votes for v in votes) == 200


def test_empty_table(spark):
    assert run(spark, []) == {}


def plain(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", article)
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts) if t)


def test_query_on_the_table(spark):
    import duckdb

    from terrastate.llm.queries import QUERIES

    rows = duckdb.sql("SELECT page_id, url, html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    got = {tuple(r) for r in QUERIES["op11_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {(i, u, plain(h), len(plain(h))) for i, u, h in rows} and len(got) == len(rows)
