import pytest

from txnrules.llm import html_text as H

BODY = "First paragraph of the story, long enough to be text &amp; more of it here.", "Second one, with <a href='/x'>a link</a> inside and\n\n some   spaces, also quite long."
WANT = "A title First paragraph of the story, long enough to be text & more of it here. Second one, with a link inside and some spaces, also quite long."
STORY = f"<h1>A title</h1><p>{BODY[0]}</p><p>{BODY[1]}</p>"
JUNK = {
    "script": "<script>var x = '</p><p>no';</script>",
    "style": "<style>p{}</style>",
    "nav": "<nav><ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav>",
    "header": "<header><a href=/>Site name</a><p>slogan of the site</p></header>",
    "footer": "<footer>&copy; all rights</footer>",
    "aside": "<aside><p>A sidebar with a rather long text that is not the story at all.</p></aside>",
    "ad": "<div class='ad'>Buy this now, it is cheap and good for you.</div>",
    "cookie": "<div id=cookie-notice><p>We use cookies for all kinds of things here.</p></div>",
    "form": "<form><label>Mail</label><input><button>Send</button></form>",
    "comments": "<section id='comments'><h2>Comments</h2><div class='comment'><p>Reader one says a lot of things about this story.</p></div></section>",
    "comment": "<!-- <p>hidden</p> -->",
    "related": "<ul class='related'><li><a href=/1>Another story</a></li><li><a href=/2>And another</a></li></ul>",
}


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", "<div id='content'>%s</div>", "<div><div class='post'>%s</div></div>", "%s"])
def test_story_alone_stays(shell):
    junk = "".join(JUNK.values())
    page = f"<!DOCTYPE html><html><head><title>T</title>{JUNK['style']}</head><body>{junk}{shell % STORY}{junk}</body></html>"
    assert H.extract(page) == WANT


@pytest.mark.parametrize("name", JUNK)
def test_junk_within_the_article(name):
    assert H.extract(f"<body><article><h1>A title</h1><p>{BODY[0]}</p>{JUNK[name]}<p>{BODY[1]}</p></article></body>").replace("slogan of the site ", "").replace("Site name ", "") == WANT


def test_tag_soup_and_references():
    assert H.extract("<article><h1>T</h1><p><b>one<br><p>two &eacute;&#233;<li>x</article>") == "T one two éé x"
    assert H.extract("<article><p>cut off in the mid") == "cut off in the mid"
    assert H.extract("plain  text\n only") == "plain text only"
    assert H.extract("<table><tr><td>a<td>b<tr><td>c</table>") == "a b c"
    assert H.extract("<p>a<b>b</b>c</p>") == "abc"


WRAPPERS = ['<div class="layout with-sidebar">%s</div>', '<div class="no-sidebar">%s</div>', '<div class="has-nav menu-open">%s</div>', '<form action="/x">%s</form>', '<div class="sidebar">%s</div>', "%s"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("shell", ["<article>%s</article>", "<main>%s</main>", "<div><div class='post'>%s</div></div>"])
def test_what_wraps_the_page_stays(wrapper, shell):
    junk = "".join(JUNK[k] for k in ("nav", "aside", "ad", "comments", "related"))
    assert H.extract(f"<html><head><title>T</title></head><body>{wrapper % (junk + shell % STORY + junk)}</body></html>") == WANT


@pytest.mark.parametrize("shell", ["<article>%s</article>", "<div><div class='post'>%s</div></div>"])
def test_long_comments_and_teasers_do_not_replace_the_story(shell):
    more = "<section class='comment-list'>" + "<article><p>A reader writes at length about this and that and more.</p></article>" * 40 + "</section>"
    teasers = "<aside><article><h2>Other</h2><p>A teaser.</p></article></aside>"
    assert H.extract(f"<body><div>{shell % STORY}</div>{more}{teasers}</body>") == WANT


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=utf-8>", "<head><title>T</title><noscript><link href=x></noscript>", "<head><script>a()</script>", "<head>"])
@pytest.mark.parametrize("body", ["<body>%s</body>", "%s"])
def test_open_head(head, body):
    assert H.extract(f"<!DOCTYPE html><html>{head}{body % f'<article>{STORY}</article>'}</html>") == WANT
    assert H.extract(f"<html>{head}plain text") == "plain text"


def test_deep_and_long_pages():
    assert H.extract("<div>" * 5000 + "deep") == "deep"
    assert len(H.extract("<article>" + "<p>word word</p>" * 50_000)) == 10 * 50_000 - 1


def test_rows(spark):
    rows = [(1, "u", f"<article>{STORY}</article>", "k", "t"), (2, None, None, "", ""), (2, None, None, "", ""), (None, "v", "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string, text string")
    got = sorted(((r.key or 0), r.url, r.text) for r in H.main_text(pages).fillna("").collect())
    assert got == [(0, "v", ""), (1, "u", WANT), (2, "", ""), (2, "", "")]
    assert H.main_text(pages.limit(0)).count() == 0


def random_page(rng):
    """A well-formed page as nested lists [tag, attributes, children]."""
    words = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "a&b", "amet"]) for _ in range(n))
    inline = lambda: rng.choice([words(rng.randrange(1, 9)), ["b", {}, [words(2)]], ["a", {"href": "/x"}, [words(rng.randrange(1, 4))]], ["span", {}, [words(3), ["i", {}, [words(1)]]]]])
    para = lambda: ["p", {}, [inline() for _ in range(rng.randrange(1, 6))]]

    def block(depth):
        kind = rng.randrange(8)
        if depth == 0 or kind < 3:
            return para()
        if kind == 3:
            return ["ul", {}, [["li", {}, [["a", {"href": "/"}, [words(2)]]]] for _ in range(rng.randrange(1, 6))]]
        if kind == 4:
            return [rng.choice(["h1", "h2", "h3"]), {}, [words(4)]]
        if kind == 5:
            return [rng.choice(["nav", "aside", "script", "form"]), {}, [words(5) if rng.random() < 0.5 else para()]]
        tag, attributes = rng.choice([("div", {}), ("section", {}), ("div", {"class": "ad"}), ("article", {}), ("div", {"id": "left-sidebar"})])
        return [tag, attributes, [block(depth - 1) for _ in range(rng.randrange(1, 5))]]

    return ["html", {}, [["head", {}, [["title", {}, [words(3)]]]], ["body", {}, [block(3) for _ in range(rng.randrange(1, 6))]]]]


def markup(node):
    if isinstance(node, str):
        return node.replace("&", "&amp;")
    tag, attributes, children = node
    return f"<{tag}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in attributes.items())}>{''.join(map(markup, children))}</{tag}>"


def brute_text(page):
    """The definition, by recursion over a tree whose elements set aside are taken out."""
    import math

    tree = H.Tree()
    tree.feed(markup(page))
    tree.close()
    H.settle(tree)  # what is set aside has tests of its own

    def copy(n):
        return [n.tag, [c if isinstance(c, str) else copy(c) for c in n.children if isinstance(c, str) or not c.aside]]

    root = copy(tree.root)
    inline = lambda n: n[0] in H.INLINE

    def counts(n):
        c, t, lc, lt = sum(len(" ".join(x.split())) for x in n[1] if isinstance(x, str)), 0, 0, 0
        for x in n[1]:
            if not isinstance(x, str):
                a, b, d, e = counts(x)
                c, t, lc, lt = c + a, t + b + 1, lc + d, lt + e
        return (c, t, c, t + 1) if n[0] == "a" else (c, t, lc, lt)

    c, _, lc, _ = counts(root)
    share = lc / max(c, 1)

    def dense(n):
        c, t, lc, lt = counts(n)
        if not c:
            return 0.0
        t = max(t, 1)
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / max(math.log(base + math.e - 1), 1.0)

    def nodes(n, path=()):
        yield n, path
        for x in n[1]:
            if not isinstance(x, str):
                yield from nodes(x, (*path, n))

    every = [(n, p) for n, p in nodes(root) if not inline(n) and not any(map(inline, p))]
    children = lambda n: [x for x in n[1] if not isinstance(x, str) and not inline(x)]
    top, path = max(every, key=lambda x: dense(x[0]))
    threshold = min([dense(top), *[d for n in path if (d := dense(n)) > 0]])
    best, path = max((x for x in every if dense(x[0]) >= threshold), key=lambda x: sum(map(dense, children(x[0]))))
    chain, at = [*path, best], len(path)
    for k in range(len(chain) - 1, 0, -1):
        if chain[k][0] in ("article", "main"):
            break
        if any(x is not chain[k] and counts(x)[0] and dense(x) >= threshold for x in children(chain[k - 1]) if x[0] not in ("h1", "h2", "h3", "h4", "h5", "h6")):
            at = k - 1
    best, chain = chain[at], chain[: at + 1]
    head = []
    if not any(n[0] in ("h1", "h2") for n, _ in nodes(best)):
        for k in range(len(chain) - 1, 0, -1):
            beside = children(chain[k - 1])
            before = [x for x in beside[: [x is chain[k] for x in beside].index(True)] if x[0] in ("h1", "h2")]
            if before:
                head = [before[-1]]
                break
    texts = []

    def write(n):
        run = []
        for x in n[1]:
            if isinstance(x, str):
                run.append(x)
            elif inline(x):
                run.append(flat(x))
            else:
                texts.append("".join(run))
                run = []
                write(x)
        texts.append("".join(run))

    def flat(n):
        return "".join(x if isinstance(x, str) else flat(x) for x in n[1])

    for n in [*head, best]:
        write(n)
    return " ".join(" ".join(x.split()) for x in texts if x.split())


def test_random_pages_match_the_definition():
    import random

    rng = random.Random(71)
    for _ in range(400):
        page = random_page(rng)
        assert H.extract(markup(page)) == brute_text(page), markup(page)


def test_sections_and_headings_belong_together():
    p = "<p>" + "some words of a long paragraph of the text, " * 4 + "</p>"
    page = f"<body><div class=top><a href=/>home</a></div><div><h1>The title</h1><div><section>{p * 6}</section><section>{p * 2}</section></div></div></body>"
    assert H.extract(page).startswith("The title some words") and H.extract(page).count("some words") == 4 * 8


LONG = "<p>" + "some words of a long paragraph of the text, " * 4 + "</p>"
BROKEN = ["<![foo[x]]>", "<![foo[x", "<![", "<![CDATA[a > b]]>", "<![if !IE]>", "<![endif]>", "<!foo bar>", "<!", "<!-", "<!-->", "<!DOCTYPE", "<!ELEMENT x (y)>", "<!ATTLIST", "<?xml x ?>", "<?", "</>", "</ x>", "<>", "< p>", "<p/", "<a href='x", "&#x;", "&#99999999;", "&", "<!--", "<![%x;[y]]>"]


def test_broken_declarations_are_comments():
    assert H.extract(f"<body><article>{LONG}<![foo[x]]><p>The end of it</p></article></body>").endswith("text, The end of it")
    for mark in BROKEN:
        assert H.extract(f"<body><article>{LONG}</article>{mark}").startswith("some words of a long paragraph"), mark


def test_random_markup_never_fails():
    import random

    rng = random.Random(72)
    parts = [*BROKEN, "<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</i>", "<table>", "<tr>", "<td>", "</table>", "<head>", "<noscript>", "<script>", "</script>", "words ", "é", "\0", "<body>", "<svg>", "<li>", "<main>", "<textarea>"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert isinstance(H.extract(page), str), page


def test_a_script_in_a_word_leaves_it_whole():
    assert H.extract("<body><p>foo<script>x()</script>bar <b hidden>no</b>more</p></body>") == "foobar more"


def test_deep_and_stray_tags_take_linear_time():
    import time

    n = 60_000
    for page in ("<div>" * n + "words" + "</span>" * n, "<b><p>" + "<i>" * n + "words" + "</b>" * n, "<ul>" + "<div>" * n + "<li>words" * n, "words" + "<noscript>" * n + "<br>" * n):
        began = time.time()
        assert "words" in H.extract(page)
        assert time.time() - began < 20
