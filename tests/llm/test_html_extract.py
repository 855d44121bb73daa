import itertools
import os
import sys
import time
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from pages_by_hand import PAGES  # noqa: E402

from wayline.llm.common import read  # noqa: E402
from wayline.llm.html_blocks import BIT, leaf_blocks  # noqa: E402
from wayline.llm.html_extract import Extractor, Field, block_labels, extract_main_text, op8_html_extract, train_field, trained_field, viterbi  # noqa: E402
from wayline.llm.html_training import training_pages  # noqa: E402

SF = "/root/testdata/sf0.001"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>Fish &amp; chips&nbsp;today</h1><p><b>The first
paragraph &lt;here&gt; is long enough.<br><p>Be.<!-- <p>hidden</p> --><div class=ad>Buy this now, it is very good indeed.</div>
<p>Caf&eacute; &#233; a < b.</p></article><section id="comments"><article class="comment"><p>I did not like it at all, sorry.</p></article></section>
<form><label>Name</label></form><footer>&copy; 2024 Site</footer>"""
MAIN = "Fish & chips today\n\nThe first paragraph <here> is long enough.\n\nBe.\n\nCafé é a < b."


def test_blocks():
    texts = [b.text for b in leaf_blocks(PAGE)]
    assert texts[:4] == ["Site", "One", "Two", "We use cookies."] and texts[-1] == "© 2024 Site"
    marks = {b.text: b.marks for b in leaf_blocks(PAGE)}
    assert marks["Be."] & BIT["in_article"] and marks["Be."] & BIT["own_p"] and not marks["Be."] & BIT["in_nav"]
    assert marks["I did not like it at all, sorry."] & BIT["in_comment"]
    assert marks["One"] & BIT["links_4"]


@pytest.mark.parametrize("page,blocks", [
    (None, []), ("", []), ("  \n ", []), ("just text", ["just text"]), ("<p>a<p>b</i></p>c", ["a", "b", "c"]), ("x<br>y", ["x y"]),
    ("<p>cut <a href='", ["cut"]), ("<p>a</p><scr", ["a"]), ("<script>x", []), ("<table><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<li>a<li>b<ul><li>c</ul>d", ["a", "b", "c", "d"]), ("a &lt; b &#x41; &unknown; &amp;amp;", ["a < b A &unknown; &amp;"]),
    ("<!-- a --><p title='>'>q</p><!-- open <p>z", ["q"]), ("<P CLASS=Nav>İ<SCRIPT>q</SCRIPT >w</P>", ["İw"]),
])
def test_odd_pages(page, blocks):
    assert [b.text for b in leaf_blocks(page)] == blocks


@pytest.mark.parametrize("piece", ["<a", "<div>", "<p>", "</b>", "<li>", '<a "', "<a '>", "<!--", "&", "<script>", "<p class='a b'>x", "<b><p>x", "="])
def test_long_pages_take_linear_time(piece):
    start = time.process_time()
    leaf_blocks(piece * (300_000 // len(piece)))
    leaf_blocks("<" + piece * (300_000 // len(piece)) + ">")
    assert time.process_time() - start < 8


@pytest.mark.parametrize("page,blocks", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn></math> holds<p>b", ["so x=2 holds", "b"]), ("<p>a<xmp><b>1 &lt; 2</b></xmp>c", ["a", "<b>1 &lt; 2</b>", "c"]),
    ("<object data=x><p>Fallback</object><p>b", ["Fallback", "b"]), ("<p>a<noscript>no script</noscript><p>b", ["ano script", "b"]), ("<p>a<object><p>b", ["a", "b"]),
    ("<p>a<svg><title>t</title><text>la</text><text>bel</text></svg><p>b", ["a la bel", "b"]), ("<div><svg><path d='M0'><p>after</p></div>b", ["after", "b"]),
    ("<svg/><p>a<svg><foreignObject><div>in</div></foreignObject></svg>b<p>c", ["a", "in", "b", "c"]), ("<select><option>a<p>b", ["a", "b"]), ("<select><option>a</select><p>b", ["b"]),
    ("<xmp>open<p>b", ["open", "b"]), ("<p>a<textarea>x<p>b", ["a"]), ("<svg><style>s{}</style><script>x</script></svg>a", ["a"]),
])
def test_only_scripts_styles_frames_and_controls_are_raw(page, blocks):
    assert [b.text for b in leaf_blocks(page)] == blocks


def test_marks_of_a_drawing_end_with_it():
    page = "<svg class=nav><path class=ad /><g class=comment></svg><p>a</p><svg class=nav><g class=ad><p>b</p><xmp>c</xmp>"
    marks = {b.text: b.marks for b in leaf_blocks(page)}
    assert all(not marks[t] & (BIT["in_nav"] | BIT["in_ad"] | BIT["in_comment"]) for t in "ab") and marks["c"] & BIT["own_pre"]


@pytest.mark.parametrize("piece", ["<select>", "<svg>", "<math><mi>", "<object><p>", "<xmp>", "<svg><g></object>", "<noscript>"])
def test_open_elements_take_linear_time(piece):
    start = time.process_time()
    leaf_blocks(piece * (300_000 // len(piece)) + ">")
    assert time.process_time() - start < 8


def test_elements_of_any_depth_are_opened():
    deep = "<article>" + "<div>" * 700 + "<nav>menu</nav><div class=ad>buy</div>x" + "</div>" * 700 + "still inside</article>out"
    marks = {b.text: b.marks for b in leaf_blocks(deep)}
    assert marks["menu"] & BIT["in_nav"] and marks["buy"] & BIT["in_ad"] and not marks["x"] & BIT["in_nav"]
    assert marks["still inside"] & BIT["own_article"] and not marks["out"] & BIT["in_article"]


@pytest.mark.parametrize("piece", ["<a><div>", "<li><ul>", "<td><table>", "<b></i>", "<i><div></i>", "<span>x<p>", "<li><div>", "<option><b>", "<dt><div>x"])
def test_deep_pages_take_linear_time(piece):
    start = time.process_time()
    leaf_blocks("<i><li><ul>" + piece * (300_000 // len(piece)) + ">")
    assert time.process_time() - start < 8


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        scores, step = rng.normal(size=n).tolist(), rng.normal(size=(2, 2)).tolist()
        value = lambda y: sum(s for s, a in zip(scores, y) if a) + sum(step[a][b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert [int(a) for a in viterbi(scores, step)] == list(best)
    assert viterbi([], ((0, 0), (0, 0))) == []


def test_field_against_held_out_pages():
    extractor, right, blocks = Extractor(trained_field()), 0, 0
    for page, text in training_pages(200, seed=77):
        found = leaf_blocks(page)
        labels = block_labels(found, text)
        got = viterbi([extractor.score(b.marks) for b in found], extractor.field.step)
        right += int((np.array(got, int) == labels).sum())
        blocks += len(found)
    assert right / blocks > 0.985
    assert extractor.main_text(PAGE) == MAIN


STATES = ["has-sidebar", "layout with-sidebar", "comments-open", "widget-content", "page-template ads-enabled", "sticky-nav", "no-cookie", "dialog-open", "search-results", "menu-open", "promo-page", "recent-post single"]
PARAGRAPHS = ["The stone bridge over the river opened to walkers on Monday, two years after a flood.", "Masons rebuilt the piers with blocks from the same quarry that served the first builders.", "Cars will have to wait until autumn, said the mayor."]


@pytest.mark.parametrize("heading", ["h1", "h2"])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_names_of_wrappers_empty_no_article(heading, inner):
    extractor = Extractor(trained_field())
    body = f"<{inner}><{heading}>Old bridge reopens</{heading}>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + f"</{inner}>"
    around = '<!doctype html><html><head><title>x</title></head><body{}><nav><a href=/>Home</a> <a href=/n>News</a></nav>{}<footer>© 2024 The Courier</footer></body></html>'
    want = "\n\n".join(["Old bridge reopens", *PARAGRAPHS])
    for name in STATES:
        assert extractor.main_text(around.format("", f'<div class="{name}">{body}</div>')) == want, name
    assert extractor.main_text(around.format(' class="single has-sidebar comments-open header-fixed"', body)) == want
    # the same names do mark what they name
    for name in ("sidebar", "comments", "cookie-banner", "ads"):
        box = f'<div class="{name}">' + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[1:]) + "</div>"
        assert extractor.main_text(around.format("", f"<div>{body}</div>{box}")) == want, name


def test_remarks_that_only_a_heading_gives_away():
    body = "<h1>Old bridge reopens</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<html><body><nav><a href=/>Home</a></nav><article>{body}</article><div><h3>4 replies</h3><div><p>I liked it a lot, thank you.</p></div><div><p>Me too, but it was dear.</p></div></div><footer>© 2024</footer></body></html>"
    assert Extractor(trained_field()).main_text(page) == "\n\n".join(["Old bridge reopens", *PARAGRAPHS])


def by_layout():
    """(layout, precision, recall) over blocks of the pages labelled by hand."""
    extractor = Extractor(trained_field())
    for name, (page, main) in PAGES.items():
        got = Counter(extractor.main_text(page).split("\n\n"))
        right = sum((got & Counter(main)).values())
        yield name, right / max(1, sum(got.values())), right / len(main)


def test_field_on_pages_labelled_by_hand():
    found = list(by_layout())
    print(*(f"{n}: precision {p:.2f}, recall {r:.2f}" for n, p, r in found), sep="\n")
    for name, (page, main) in PAGES.items():
        assert not set(main) - {b.text for b in leaf_blocks(page)}, name
    assert all(r >= 0.75 for _, _, r in found) and np.mean([r for _, _, r in found]) > 0.9 and np.mean([p for _, p, _ in found]) > 0.85


def test_query_against_all_labellings(spark):
    """The whole query against the best labelling of every short page by enumeration, and its own pages otherwise."""
    field = trained_field()
    extractor = Extractor(field)
    rows = {r["page_id"]: r for r in op8_html_extract(spark, SF).collect()}
    pages = read(spark, SF, "pages").collect()
    assert len(rows) == len(pages)
    short = 0
    for r in pages:
        blocks = leaf_blocks(r["html"])
        scores = [extractor.score(b.marks) for b in blocks]
        got = rows[r["page_id"]]
        assert got["url"] == r["url"] and got["n_chars"] == len(got["text"])
        if len(blocks) <= 14:
            value = lambda y: sum(s for s, a in zip(scores, y) if a) + sum(field.step[a][b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
            best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
            assert got["text"] == "\n\n".join(b.text for b, m in zip(blocks, best) if m)
            short += 1
    assert short > 10


def test_training_fits_the_likelihood():
    pages = [("<div class=ad>x</div><p>Some words here.</p>", "Some words here."), ("<nav>a</nav><p>More text.</p><footer>c</footer>", "More text."), ("", ""), (None, "")]
    extractor = Extractor(train_field(pages))
    assert [extractor.main_text(p) for p, _ in pages] == ["Some words here.", "More text.", "", ""]
    assert Extractor(train_field([])).main_text("<p>a</p>") == ""


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "", "x"), (3, "w", "<nav><a href=x>menu</a></nav>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, Text string")
    out = extract_main_text(df, trained_field())
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted((r["page_id"] or 0, r["text"]) for r in out.collect()) == [(0, ""), (1, MAIN), (1, MAIN), (2, ""), (3, "")]
    assert extract_main_text(df.limit(0), Field((0.0,) * len(BIT), ((0, 0), (0, 0)))).count() == 0
