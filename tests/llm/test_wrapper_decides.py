"""What the inferred wrapper decides, odd markup, deep and long pages."""

import itertools
import random

from tessera.llm import html_wrapper as hw


def text(source):
    return hw.main_text(hw.Page(source), "")


def wrapped(sources):
    wrapper = hw.Wrapper()
    pages = [hw.Page(s) for s in sources]
    for page in pages:
        wrapper.add(page)
    return wrapper, [hw.main_text(p, wrapper.article(), wrapper.template()) for p in pages]


def test_the_expression_parts_template_from_content(monkeypatch):
    page = "<body><article><h1>T{n}</h1><div class=strap>Always the same line</div><p>Text {n}, longer than the strap</p>{extra}</article></body>"
    sources = [page.format(n=n, extra="<div class=box>Same box</div>" if n % 2 else "") for n in range(6)]
    wrapper, got = wrapped(sources)
    assert got == [f"T{n}\nText {n}, longer than the strap" + ("\nSame box" if n % 2 else "") for n in range(6)]
    # without optional items the box would look like the template's
    monkeypatch.setattr(hw, "mandatory", lambda items: set())
    assert all("Always the same line" in t for t in wrapped(sources)[1])


def test_copies_of_one_page_keep_their_text():
    wrapper, got = wrapped(["<article><h1>T</h1><p>Text</p></article>"] * 5)
    assert got == ["T\nText"] * 5


def test_names_count_whole_or_by_the_wrapper():
    kept = ['<article><p class="related-work">A</p></article>', '<article><div class="search-results">A</div></article>', '<article><div class="rail-station">A</div></article>', '<div class="post" id="comments-2"><p>A</p></div>',
            '<p data-hidden="false">A</p>', '<p data-role="banner">A</p>', '<p data-id="nav">A</p>', '<p title="role=search">A</p>', "<p title='hidden'>A</p>"]
    assert [text(f"<body>{s}</body>") for s in kept] == ["A"] * len(kept)
    gone = ['<div class="ad">x</div>', "<div class='big comments'>x</div>", "<p hidden>x</p>", '<div role="search">x</div>', "<div aria-hidden=true>x</div>", "<section class=sidebar>x</section>"]
    assert [text(f"<body><article><p>A</p>{s}</article></body>") for s in gone] == ["A"] * len(gone)
    menu = "<body><article><p>A {n}</p><div class='post-nav'><a href=/{n}>Next {n}</a></div></article></body>"
    assert wrapped([menu.format(n=n) for n in range(4)])[1] == [f"A {n}" for n in range(4)]


def test_deep_and_long_pages():
    deep = "<div>" * 10_000 + "<p>inner</p>" + "</div>" * 10_000 + "<p>after</p>"
    assert text(f"<body>{deep}</body>") == "inner\nafter"
    long = ["<body>" + "".join(f"<p class=c{chr(97 + (i * k) % 26)}{chr(97 + i % 25)}>{i}</p>" for i in range(3000)) + "</body>" for k in (1, 3)]
    wrapper, got = wrapped(long)
    assert got == ["\n".join(map(str, range(3000)))] * 2


def test_alignment_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(1)

    def longest(a, b):
        for k in range(min(len(a), len(b)), -1, -1):
            if {tuple(a[i] for i in c) for c in itertools.combinations(range(len(a)), k)} & {tuple(b[i] for i in c) for c in itertools.combinations(range(len(b)), k)}:
                return k

    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 7))] for _ in range(2))
        pairs = hw.matched(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    monkeypatch.setattr(hw, "TABLE", 20)
    for _ in range(60):
        a, b = (rng.sample("abcdefghijklmnop", 12) for _ in range(2))
        pairs = hw.matched(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_dated_copies_keep_title_and_body():
    body = "<h1>One title</h1><p>One body of several words that every copy has.</p>"
    sources = [f"<html><body><article>{body}<span>{d} May</span></article></body></html>" for d in range(1, 7)]
    wrapper = hw.Wrapper()
    for s in sources:
        wrapper.add(hw.Page(s))
    texts = [hw.main_text(hw.Page(s), wrapper.article(), wrapper.template()) for s in sources]
    assert texts == [f"One title\nOne body of several words that every copy has.\n{d} May" for d in range(1, 7)]


def test_names_inside_an_article_are_the_wrappers_to_judge():
    parts = ["<section class='discussion'><h2>Discussion</h2><p>Our results show {0}.</p></section>", "<div class='related'>Related work by {0}.</div>", "<div class='follow'>We follow {0}.</div>", "<table class='header'><tr><td>Column {0}</td></tr></table>"]
    menu = "<div class='related'><a href='/a'>Another page</a> <a href='/b'>One more page</a></div>"
    page = lambda k: f"<html><body><div class='related'>Outside {k}</div><article><p>{'word' + str(k)} stands here with more words of its own.</p>{''.join(p.format(f'study {k}') for p in parts)}<section>{menu}</section></article></body></html>"
    wrapper = hw.Wrapper()
    for k in range(6):
        wrapper.add(hw.Page(page(k)))
    text = hw.main_text(hw.Page(page(3)), wrapper.article(), wrapper.template())
    assert text == "word3 stands here with more words of its own.\nDiscussion\nOur results show study 3.\nRelated work by study 3.\nWe follow study 3.\nColumn study 3"
    assert "Another page" not in text and "Outside" not in text


def test_hashed_class_names_share_slots():
    wrapper = hw.Wrapper()
    for k in range(200):
        wrapper.add(hw.Page(f"<article class='css-{k}x{k * 7}a'><p class='t{k}b'>text {k}</p></article>"))
    assert len(wrapper.slots) == 1
