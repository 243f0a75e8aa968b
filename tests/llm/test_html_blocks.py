"""Nothing but scripts, styles, templates, drawings and comments is left out of the blocks."""

import pytest

from seamount.llm import html_labeller


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', ["one two", "three"]),
        ('<p>one <svg a="/>"><text>x</text></svg> two</p>', ["one two"]),
        ("<p>one <svg><g> two</p><p>three</p>", ["one two", "three"]),
        ("<p>one <svg-icon n=a></svg-icon> two</p><p>three</p>", ["one two", "three"]),
        ("<template-card><p>one</p></template-card><math-inline>x</math-inline><p>two</p>", ["one", "x", "two"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds <math/> here</p><p>three</p>", ["so x=1 holds here", "three"]),
        ("<p>write <xmp><b>&amp;</b></xmp> here</p>", ["write <b>&amp;</b> here"]),
        ("<p>one <script>x</script y> two <!--> three <style/>p{}</style></p>", ["one two three"]),
        ("<template><p>x</p></template><svg viewBox='0'><title>x</title></svg><p>one</p>", ["one"]),
    ],
)
def test_blocks_beside_foreign_elements(page, want):
    assert [b[1] for b in html_labeller.blocks_of(page)] == want


def test_pages_of_broken_tags_take_linear_time():
    import time

    began = time.process_time()
    for piece, last in [("<a ", ""), ("<script ", ""), ("<a x ", "'>"), ("<a '\"", ""), ("</script ", ""), ("<div>x", ""), ("</p>", ""), ("<!-", ""), ("<script></script ", ""), ("<svg>", ""), ("<a b='\">", "")]:
        html_labeller.blocks_of(piece * (2_000_000 // len(piece)) + last)
    assert time.process_time() - began < 60
    assert [b[1] for b in html_labeller.blocks_of("<p>a <b 'c <i>d</i> e' >f</p>")] == ["a f"]
    assert [b[1] for b in html_labeller.blocks_of("<p>a < b <c 'd <i>e</i></p>")] == ["a < b <c 'd e"]


def test_class_names_are_all_read():
    path = html_labeller.blocks_of(f"<div class='{' '.join(f'n{chr(97 + i)}' for i in range(26))}'>x</div>")[0][0]
    assert len(path) == 27


def test_accuracy_on_forms_that_training_has_not():
    """Blocks of made pages whose menus, notices, comments, forms and so on bear names that no training page has."""
    import numpy as np

    w, r = html_labeller.model(), np.random.default_rng(99)
    names = html_labeller._FURNITURE
    other = {
        "nav": ["nav class=site-links", "div class=mainnav"], "header": ["header class=hd", "div id=top-strip"], "footer": ["footer class=ft", "div class=legal"], "side": ["aside class=rail", "div class=more-stories"],
        "notice": ["div class=cookie-wall", "div class=consent-box"], "ad": ["div class=ad-unit", "aside class=sponsor-box"], "form": ["form class=newsletter-signup", "form class=contact-us"],
        "comments": ["section class=user-comments", "div id=comments-area"],
    }
    html_labeller._FURNITURE = other
    try:
        pages = [p for p in (html_labeller.blocks_of(html_labeller.synthetic_page(r)) for _ in range(200)) if p]
    finally:
        html_labeller._FURNITURE = names
    right = [(b[3] == "1") == y for p, own in zip(pages, html_labeller.label(pages, w)) for b, y in zip(p, own)]
    print(np.mean(right))
    assert np.mean(right) >= 0.95
