"""Pages whose elements have no end tag, without Spark."""

import itertools
import time

import numpy as np
import pytest

from tillproof.llm import html_text

ARTICLE = "<article><h1>On rivers</h1><p>Rivers carry sand and stones down to the sea, and they do so for thousands of years without rest.</p></article>"
SAID = "On rivers\nRivers carry sand and stones down to the sea, and they do so for thousands of years without rest."


def text(page):
    return html_text.trained().text([html_text.Page(page)], {})[0]


@pytest.mark.parametrize(
    "before",
    [
        "<header><form><datalist id=q><option value=a><option value=b></datalist></form></header>",
        "<header><form><datalist id=q><option value=a>one<option value=b>two</form></header>",
        "<header><form><select><option>one<option>two</select></form></header>",
        "<select><optgroup label=x><option>one<optgroup label=y><option>two",
        "<noscript>",
        "<header><button></header>",
        "<video src=a>",
    ],
)
def test_an_element_without_end_tag_keeps_the_article(before):
    assert text(f"<html><body>{before}{ARTICLE}<footer><p>&copy; A</p></footer></body></html>") == SAID


def test_formulas_stay():
    page = "<article><p>The area of a circle is <math><mi>pi</mi> <mi>r</mi> <mn>2</mn></math> for every radius, as is well known since long ago.</p></article>"
    assert text(f"<html><body>{page}</body></html>") == "The area of a circle is pi r 2 for every radius, as is well known since long ago."


def test_scripts_without_end_tag_run_to_the_end():
    assert text(f"<html><body>{ARTICLE}<script>let a = '<p>no</p>'") == SAID


def test_text_of_choices_is_dropped():
    assert text("<article><p>Rivers carry sand and stones down to the sea for thousands of years.</p><select><option>one<option>two</select></article>") == "Rivers carry sand and stones down to the sea for thousands of years."


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(4)
    sources = ["<div><p>one</p><ul><li>two<li>three</ul></div><nav>x</nav>", "plain", "<article><h1>a</h1><p>b<p>c</article><footer>d</footer>"]
    f = html_text.Forest([html_text.Page(s) for s in sources], {})
    model = html_text.Model(draw.normal(size=html_text.WIDTH), draw.normal(size=(html_text.EDGES, 2, 2)))
    p, both, _ = model.marginals(f)
    s = f.x @ model.unary
    cuts = [*f.first.tolist(), len(s)]
    for a, b in zip(cuts, cuts[1:]):
        want, pairs, total = np.zeros(b - a), np.zeros((b - a, 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(s[a + k] * y[k] + (0 if f.root[a + k] else model.pair[f.edge[a + k], y[f.parent[a + k] - a], y[k]]) for k in range(b - a)))
            total += w
            for k in range(b - a):
                want[k] += w * y[k]
                if not f.root[a + k]:
                    pairs[k, y[f.parent[a + k] - a], y[k]] += w
        assert np.allclose(p[a:b], want / total)
        inner = ~f.root[a:b]
        assert np.allclose(both[a:b][inner], pairs[inner] / total)


def test_deep_and_unclosed_pages_take_seconds():
    model = html_text.trained()
    start = time.process_time()
    for page in ("<div>" * 20_000 + "text", "<p>" * 50_000, "<b><button>" * 20_000 + "x", "<ul><li>" * 10_000, "<table><tr><td>" * 8_000):
        model.text([html_text.Page(page)], {})
    assert time.process_time() - start < 60


def test_the_content_of_pages_of_other_draws_is_found():
    model, right, total = html_text.trained(), 0, 0
    for source, content in html_text.labelled_pages(60, seed=99):
        got = set(model.text([html_text.Page(source)], {})[0].split("\n")) - {""}
        right, total = right + len(got & content), total + len(got | content)
    assert right / total > 0.95, right / total
