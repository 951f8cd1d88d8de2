"""Whole articles of several site styles, labelled by hand, and time in proportion to a page's length."""

import time

import pytest

from gridloom.llm import html_text

SITES = [
    ("<article><h1>Tides</h1><section><h2>North</h2><p>High at noon.</p></section><section><h2>South</h2><p>Low at dusk.</p></section></article>", ["Tides", "North", "High at noon.", "South", "Low at dusk."]),
    ("<body><nav><a href=x>Menu</a></nav><main><h1>Tides</h1><section><h3>North</h3><p>High water at noon.</p></section></main><footer>&copy; 2020</footer></body>", ["Tides", "North", "High water at noon."]),
    ("<body><div><p>The first words.</p><p>The second words.</p><p>The third words.</p></div></body>", ["The first words.", "The second words.", "The third words."]),
    ("a page of plain text without any markup at all", ["a page of plain text without any markup at all"]),
    ("<article><h1>A</h1><h3>Three</h3><p>Some text here.</p><h4>Four</h4><p>More text here.</p><h5>Five</h5><p>Text.</p><h6>Six</h6><p>End of it.</p></article>", ["A", "Three", "Some text here.", "Four", "More text here.", "Five", "Text.", "Six", "End of it."]),
    ("<article><h1>A</h1><p>Some text.</p><figure><img src=a><figcaption>What it shows</figcaption></figure></article>", ["A", "Some text.", "What it shows"]),
    ("<article><h1>A</h1><dl><dt>Ebb</dt><dd>Falling water</dd></dl><p>Write to:</p><address>1 Quay</address></article>", ["A", "Ebb", "Falling water", "Write to:", "1 Quay"]),
    ("<article><h1>A</h1><table><caption>Heights</caption><tr><th>Port</th><th>Metres</th></tr><tr><td>Leith</td><td>5</td></tr></table></article>", ["A", "Heights", "Port", "Metres", "Leith", "5"]),
    ("<article><h1>A</h1><details><summary>More on this</summary><p>Hidden words.</p></details></article>", ["A", "More on this", "Hidden words."]),
    ("<article><header><h1>The title</h1></header><p>Some text here and more.</p></article>", ["The title", "Some text here and more."]),
    ("<body><header><h1>Site</h1><p>A slogan</p></header><div class=content><h1>Title</h1><p>Body text here.</p><div class=ad>Buy now</div></div><div class=sidebar><h4>Popular</h4><p>Other things</p></div><form><p>Subscribe</p></form></body>", ["Title", "Body text here."]),
    ("<body><article><h1>Title</h1><p>Body text here.</p></article><section class=comments><h3>Comments</h3><div class=comment><p>Nice post</p></div></section><aside><h3>Related</h3><p>Other things to read</p></aside></body>", ["Title", "Body text here."]),
]


@pytest.mark.parametrize(("html", "want"), SITES)
def test_articles_are_kept_whole(html, want):
    assert html_text.extract(html, html_text.trained()) == want


@pytest.mark.parametrize("page", ["<svg>" + "<g>" * 64_000 + "<option>" * 64_000, "<b><p>" + "<i>" * 64_000 + "</b>" * 64_000, "<li><ul>" + "<x>" * 64_000 + "<li></li>" * 64_000, "<p>" * 64_000 + "<select>" + "<option>" * 64_000])
def test_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_text.parse(page)
    assert time.process_time() - began < 20
