import pytest

from peakloom.llm.dom import Page


def text_of(html):
    page = Page(html)
    return page.text([True] * len(page.tag))


@pytest.mark.parametrize("html", [
    "<head><title>t</title><body><article>x</article>", "<html><head><meta charset=a><title>t</title><script>s</script><p>x", "<head><title>t</title> x",
    "<head><noscript><img src=a><body>x", "<head><link href=a><br/>x</head>",
])
def test_head_without_end(html):
    assert text_of(html) == "x"


@pytest.mark.parametrize("tag", "svg button object select video template".split())
def test_unseen_without_end(tag):
    assert text_of(f"<div>a<{tag}>lost</div>b<p>c") == "a b c"
    assert text_of(f"<p>a<a href=u><{tag}>lost</a>b</p>") == "ab"
    assert text_of(f"<div>a<{tag}><div>lost</div>lost<p>lost</{tag}>b</div>c") == "ab c"


def test_unseen_within_unseen():
    assert text_of("<button><svg><path/></button>a<svg/>b<svg><title>t</title><g><path></g></svg>c</svg>d") == "abcd"
    assert text_of("<head><noscript><img src=a></noscript><style>s</style></head>a<noscript><p>lost</noscript>b") == "ab"


def test_descending_keeps_what_the_likelihood_keeps():
    """Against all choices in which nothing is kept in what is dropped, and no kept element is without text."""
    import math

    import numpy as np

    from peakloom.llm.dom import descend

    r = np.random.default_rng(1)
    for _ in range(400):
        n = int(r.integers(1, 9))
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, n)]
        p, text = r.uniform(0.01, 0.99, n), [bool(x) for x in r.integers(0, 2, n)]
        best = -math.inf
        worth = lambda z: sum(math.log(p[i] if z[i] else 1 - p[i]) for i in range(n) if not i or z[parent[i]])
        for m in range(1 << n):
            z = [m >> i & 1 for i in range(n)]
            sound = all(not i or z[i] <= z[parent[i]] for i in range(n))
            if sound and all(not z[i] or text[i] or any(z[k] and parent[k] == i for k in range(n)) for i in range(n)):
                best = max(best, worth(z))
        kept = descend(parent, p.tolist(), text)
        assert all(not i or kept[i] <= kept[parent[i]] for i in range(n))
        assert all(not kept[i] or text[i] or any(kept[k] and parent[k] == i for k in range(n)) for i in range(n))
        assert abs(worth(kept) - best) < 1e-9


def test_elements_with_text_of_their_own():
    from peakloom.llm.dom import Page
    from peakloom.llm.html_extraction import owns_text

    page = Page("<div> <p>a</p> <ul> <li> </li></ul></div>b")
    assert [t for t, own in zip(page.tag, owns_text(page)) if own] == ["#page", "p"]
