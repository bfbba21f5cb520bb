"""Main texts of small pages of many shapes, and densities against a naive computation."""

import math
import random

import pytest

from tapewright.llm import html_density
from tapewright.llm.html_density import main_text

LONG = "The quick brown fox jumps over the lazy dog near the bank of the river. " * 4
P, T = f"<p>{LONG}</p>", LONG.strip()

PAGES = [
    (f"<body><h1>Title</h1><div>{P}{P}</div></body>", ["Title", T, T]),
    (f"<body><article><div>{P}</div><ul><li>one</li><li>two</li></ul></article></body>", [T, "one", "two"]),
    (f'<body><article><h1>A</h1><div class="market-share">{P}</div>{P}</article></body>', ["A", T, T]),
    (f'<body><div class="content"><div class="content-header"><h1>A</h1></div>{P}{P}</div></body>', ["A", T, T]),
    (f"<body><article><p>Press the <button>Save</button> key and <math><mi>x</mi></math>.</p>{P}</article></body>", ["Press the Save key and x.", T]),
    (f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div>{P}{P}</div></body>", [T, T]),
    (f"<body><article><h1>A</h1><p>In short.</p><section><h2>B</h2>{P * 6}</section><section><h2>C</h2>{P}</section><ol><li>x</li></ol></article></body>", ["A", "In short.", "B", *[T] * 6, "C", T, "x"]),
    (f'<body><form><div class="header"><h1>Site</h1></div><div class="main"><h2>A</h2>{P * 3}</div><div class="footer">foot</div></form></body>', ["A", T, T, T]),
    (f'<body><div class="sidebar-layout"><div class="c"><h1>A</h1>{P * 3}</div><div class="sidebar">{P}</div></div></body>', ["A", T, T, T]),
    (f'<body><div id="content"><h1>A</h1>{P * 2}</div><div id="comments"><h3>Comments</h3>{P * 6}</div></body>', ["A", T, T]),
    (f'<body><article><h1>A</h1>{P * 2}</article><section class="comments"><article class="comment">{P * 6}</article></section></body>', ["A", T, T]),
    (f'<body><div id="wrap"><h1>A</h1><div class="meta">By Ann</div>{P}<div class="ad-slot">Buy</div><blockquote>Q</blockquote>{P}<table><tr><td>1</td><td>2</td></tr></table></div><div class="site-footer">f</div></body>', ["A", "By Ann", T, "Q", T, "1", "2"]),
    (f"<body><h1>A</h1><article>{P * 2}</article><div>An advert without a name that runs on for quite a while to look dense.</div></body>", ["A", T, T]),
    (f"<body><header><h1>Site</h1></header><main><h1>A</h1><article>{P}</article><aside>{P}</aside></main><footer>f</footer></body>", ["A", T]),
    (f'<body><div class="cookie-notice"><p>We use cookies</p></div><div class="story"><h1>A</h1>{P}</div><div class="relatedPosts"><h3>R</h3></div></body>', ["A", T]),
    (f"<body><article><header><h1>A</h1><p>Sub</p></header>{P}<footer>f</footer></article></body>", ["A", "Sub", T]),
    (f"<body><div>Loose text <br>here{P}and behind</div></body>", ["Loose text here", T, "and behind"]),
    (f'<body><article><h1>A</h1>{P}<section id="discussion"><h2>Discussion</h2>{P}</section></article></body>', ["A", T, "Discussion", T]),
    (f'<body><article><h1>A</h1>{P}<section class="related-work"><h2>Related work</h2>{P}</section></article></body>', ["A", T, "Related work", T]),
    (f'<body><main><h1>A</h1>{P}<section id="social-policy"><h2>Policy</h2>{P}</section></main></body>', ["A", T, "Policy", T]),
    (f'<body><article><h1>A</h1>{P}<p class="share">{LONG}</p></article></body>', ["A", T, T]),
    (f"<body><article><h1>A</h1>{P}<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>{P}</article></body>", ["A", T, "One", "Two", T]),
    (f'<body><article><h1>A</h1>{P * 2}<div class="share">Share <a href=1>on this</a> <a href=2>on that</a></div><div id="comments">{P}</div></article></body>', ["A", T, T]),
    ("<p>Hello <b>big</b> &amp; &#8212; world</p>", ["Hello big & — world"]),
]


@pytest.mark.parametrize("html, want", PAGES)
def test_pages(html, want):
    assert main_text(html) == "\n\n".join(want)


def test_names_count_as_whole_words():
    name = html_density.furniture_name
    for value in ("ad", "ad-slot", "sidebar_left", "main-nav", "site-header", "post-comments", "shareBar", "wide cookie-banner", "footer2", "legal-notice"):
        assert name(value)[0], value
    for value in ("", "market-share", "adhesive", "headline", "road-sharing", "navy-blue", "content", "commentary", "socialism", "wrap main"):
        assert not name(value)[0], value
    assert name("entry-header") == ("header", True) and name("site-header") == ("header", False)


def naive_density(tree, out, ratio, i):
    """By looking at every node below, for every node anew."""
    def above(k):
        found = []
        while k >= 0:
            found.append(k)
            k = tree.parents[k]
        return found

    below = [k for k in range(len(tree.tags)) if k != i and i in above(k) and not out[k]]
    chars = links = 0
    for node, _, text in tree.texts:
        if i in above(node) and not out[node]:
            size = sum(c not in " \n" for c in text)
            chars += size
            links += size * any(tree.tags[k] == "a" for k in above(node))
    if not chars:
        return 0.0
    n_tags, n_links = max(len(below), 1), max(sum(tree.tags[k] == "a" for k in below), 1)
    base = math.log(chars * links / max(chars - links, 1) + ratio * chars + math.e)  # of the logarithm
    gain = max(math.log(chars * n_tags / (max(links, 1) * n_links)), 0)
    return chars / n_tags * (gain / math.log(base) if base > 1 else gain)


def test_densities_against_a_naive_computation():
    rng = random.Random(6)
    for _ in range(40):
        html = "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "<div class=ad>", "words here ", "a longer run of words ", "<br>"]) for _ in range(60))
        tree = html_density._Tree()
        tree.feed(html)
        tree.close()
        out, ratio = html_density._furniture(tree)
        got = html_density.densities(tree, out, ratio)
        assert all(math.isclose(got[i], 0.0 if out[i] else naive_density(tree, out, ratio, i), rel_tol=1e-6, abs_tol=1e-9) for i in range(len(got)))


def test_deep_and_broad_pages():
    assert main_text("<div>" * 50_000 + LONG + "</div>" * 50_000) == T
    assert main_text(f"<body>{P * 5000}</body>") == "\n\n".join([T] * 5000)
    assert main_text("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"


def test_nothing():
    for html in (None, "", " ", "<html></html>", "<nav>only a menu</nav><article> </article>", "<script>x</script>"):
        assert main_text(html) == ""
