"""What is article and what is not, by votes: names, tags, links, places, and the host."""

import random

import pytest

from clickloom.llm import html_extract

LONG = "Running text that is long enough to count, with more of it and a comma. "


def article(inner, n=8):
    paragraphs = "".join(f"<p>Paragraph {i}. {LONG}</p>" for i in range(n))
    return f"<html><body><div class='site'><nav><a href=/>Home</a></nav><article><h1>Head</h1>{paragraphs}{inner}<p>Last words of it all.</p></article></div></body></html>"


KEPT = [
    "<section id='side-effects'><h2>Side effects</h2><p>{}</p></section>",
    "<section id='related-work'><p>{}</p></section>",
    "<section id='search-algorithms'><h2>Search</h2><p>{}</p></section>",
    "<section id='social-impact'><p>{}</p></section>",
    "<section id='comments'><h2>Comments</h2><p>{}</p></section>",
    "<div class='hidden-costs'><p>{}</p></div>",
    "<h2 id='cookies'>{}</h2>",
    "<h2 id='navigation'>{}</h2>",
    "<h2 id='comments-in-code'>{}</h2>",
    "<p id='sponsors'>{}</p>",
    "<p>So <span class='ad'>{}</span> it is.</p>",
    "<aside>{}</aside>",
    "<aside><p>{}</p></aside>",
    "<fieldset><p>{}</p></fieldset>",
    "<ul><li><a href=1>{}</a></li><li><a href=2>A treatise on the second matter of the field</a></li><li><a href=3>Third words on the field by the same hand</a></li></ul>",
]


@pytest.mark.parametrize("inner", KEPT)
def test_article_text_stays(inner):
    assert "KEEP this text" in html_extract.page_text(article(inner.format("KEEP this text of the field and the matter")), None)


GONE = "read-more author-bio user-reviews responses discussion reply widget disclaimer promobox adbox paywall tags acme-footer page__sidebar comment-list shareBar".split()


@pytest.mark.parametrize("name", GONE)
@pytest.mark.parametrize("how", ["class", "id"])
def test_what_is_no_article_goes(name, how):
    text = html_extract.page_text(article(f"<div {how}='{name}'><p>AWAY with this. {LONG}</p></div>"), None)
    assert "AWAY" not in text and text.startswith("Head") and text.endswith("Last words of it all.")


@pytest.mark.parametrize("inner", ["<aside><a href=1>AWAY</a> <a href=2>AWAY too</a></aside>", "<fieldset>AWAY <input name=x></fieldset>", "<form>AWAY</form>", "<aside class='related'>AWAY</aside>", "<nav>AWAY</nav>", "<footer>AWAY</footer>", "<div role=search>AWAY</div>"])
def test_two_votes_agree(inner):
    assert "AWAY" not in html_extract.page_text(article(inner), None)


def test_a_section_s_id_counts_at_the_end_only():
    page = f"<article><h1>Head</h1><p>{LONG}</p><section id='discussion'><p>ONE {LONG}</p></section><section id='reviews'><p>TWO {LONG}</p></section></article>"
    text = html_extract.page_text(page, None)
    assert "ONE" in text and "TWO" not in text


def site(n, inner, host="a"):
    return [(i, f"https://{host}.example/{i}", article(inner.format(i=i), 3 + i % 3)) for i in range(n)]


def test_the_host_decides_on_doubtful_places(spark):
    rows = site(6, "<aside>DOUBT number {i} of the field</aside>") + [(100 + i, f"https://b.example/{i}", article("<aside>DOUBT once</aside>" if i == 0 else "")) for i in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("DOUBT" not in got[i] for i in range(6)) and "DOUBT" in got[100]


def test_places_are_joined_where_they_are_many(spark):
    rows = site(6, "<aside>DOUBT number {i}</aside><div class=line><p>One text of the site.</p></div>") + site(3, "<aside>DOUBT {i}</aside>", "c")
    table = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "page_id long, url string, html string")
    one, two = (sorted(map(tuple, html_extract.extract(table, most).collect())) for most in (200_000, 0))
    assert one == two and len(one) == 9
    assert all(("DOUBT" in r[2]) == ("//c." in r[1]) and ("One text" not in r[2]) for r in one)


def test_tied_votes_go_to_the_shallower_path(spark):
    page = f"<html><body><div class=x><div class=y><p>{LONG}</p></div></div></body></html>"
    rows = spark.createDataFrame([(i, f"https://t.example/{i}", page) for i in range(3)], "page_id long, url string, html string")
    winners, _ = html_extract.winning_paths(rows)
    assert winners.count() == 1
    assert {r["text"] for r in html_extract.extract(rows).collect()} == {LONG.strip()}


def generated(rng, host, n):
    """Pages of one made-up site with the article's text beside each."""
    frame, body = rng.choice(["sidebar", "c-rail", "leftSidebar"]), rng.choice(["entry", "post-body", "text"])
    tag = rng.choice(["article", "div class=content", "main"])
    out = []
    for i in range(n):
        blocks = [f"Title {host} {i}"] + [f"{LONG}{rng.randrange(10**6)}." for _ in range(rng.randrange(3, 9))]
        inner = f"<h1>{blocks[0]}</h1><div class={body}>"
        for b in blocks[1:]:
            inner += rng.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<section id=s{i}><p>{}</p></section>"]).format(b, i=rng.randrange(99))
            if rng.random() < 0.3:
                inner += rng.choice([f"<div class='ad-slot'>Buy {rng.randrange(99)}</div>", f"<script>var x = '{i}';</script>", "<div class='share-links'><a href=#>Share</a></div>", "<form><input><button>Go</button></form>"])
        inner += f"</div><div class='author-bio'>Written by {rng.choice('ABC')}, who lives here.</div><div class='comments'><p>Reader says {LONG}</p></div>"
        page = f"<html><head><title>x</title></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a></li></ul></nav><div class='{frame}'><p>{LONG}{rng.randrange(10**6)}</p></div><{tag}>{inner}</{tag.split()[0]}><footer>Imprint</footer></body></html>"
        out.append((f"https://{host}.example/{i}", page, "\n\n".join(" ".join(b.split()) for b in blocks)))
    return out


def test_generated_sites_give_their_articles(spark):
    rng = random.Random(6)
    pages = [p for k in range(8) for p in generated(rng, f"h{k}", rng.randrange(2, 7))]
    table = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(table).collect()}
    for i, (_, _, want) in enumerate(pages):
        assert got[i] == want, i
