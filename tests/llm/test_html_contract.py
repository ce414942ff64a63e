"""What an article is and isn't: lists of links within it, comments, notices and adverts under compound names, pages without containers; small pages against
all their labellings."""

import itertools

import pytest

from rillet.llm import html_extract
from rillet.llm.html_extract import extract

LONG = "The first long sentence of the article stands here and says quite a lot. " * 3
P = f"<p>{LONG}</p>"
COMMENT = "I do not agree with this at all, and I have said so before. Thanks for writing it anyway, it made my day a better one."


def article(inner):
    return f"<body><nav><a href=x>Home</a></nav><article>{P}{inner}{P}</article><footer>Foot</footer></body>"


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_lists_of_links_between_paragraphs_stay(n):
    told = extract(article("<ul>" + "".join(f"<li><a href=x>Item{i}</a></li>" for i in range(n)) + "</ul>"))
    assert all(f"Item{i}" in told for i in range(n)) and "Home" not in told and "Foot" not in told


@pytest.mark.parametrize("name", ["reader-comments", "comments", "user_comments_list", "advert-inline", "inline-ads", "sponsored-story", "cookie-consent-wrapper", "newsletter-signup-box"])
@pytest.mark.parametrize("kind", ["class", "id"])
def test_named_parts_go(name, kind):
    told = extract(f"<body><main>{P}{P}<div {kind}='{name}'><p>{COMMENT}</p><p>{COMMENT}</p></div></main></body>")
    assert "agree" not in told and told.count("first long") == 6


def test_notices_go():
    assert "cookies" not in extract(f"<body><main>{P}<div class='notice'><p>We use cookies on this site. By going on you accept them. Read more in our policy.</p></div>{P}</main></body>")


@pytest.mark.parametrize("name", ["post-with-comments", "has-ads", "no-comments", "comments-open", "page-cookie"])
def test_names_that_tell_of_having_something_stay(name):
    assert extract(f"<body><div class='{name}'>{P}{P}</div></body>").count("first long") == 6


def test_pages_without_containers():
    told = extract(f"<body><div>Home | About | Contact</div><div>{LONG}</div><div>{LONG}</div><div>Copyright 2024 All rights reserved</div></body>")
    assert told == " ".join((LONG + LONG).split())
    assert extract("<body><p>Short text.</p></body>") == "Short text."


def test_whole_small_pages_against_all_labellings():
    """The labels of a page are the cheapest of all, edges included, whatever its texts' lengths."""
    parts = [P, "<p>Short.</p>", "<ul><li><a href=x>A</a></li><li><a href=y>B</a></li></ul>", "<div class='notice'><p>Look here.</p></div>", "<div class=sidebar><p>Side.</p></div>", "<div>Home | About | Us</div>"]
    for chosen in itertools.product(parts, repeat=3):
        texts, prices, near = html_extract.priced("<body><div>" + "".join(chosen) + "</div></body>")
        cost = lambda keep: sum(p for p, k in zip(prices, keep) if p > 0 and not k) + sum(-p for p, k in zip(prices, keep) if p < 0 and k) + sum(w for u, v, w in near if keep[u] != keep[v])
        best = min(map(cost, itertools.product((True, False), repeat=len(texts)))) if texts else 0.0
        assert cost(html_extract.cut_labels(prices, near)) == pytest.approx(best)
