import pytest

from docloom.llm import html as H

W = H.learn(H.LABELLED)

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="page"><header><h1>Site</h1><p>The site's slogan, a good long one for everyone to read.</p></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies and say so at great length, with many words, to annoy.</div>
%s
<aside><p>Read also something else that we have written about this.</p></aside><section id="comments"><h2>Comments</h2><article class="comment"><p>I read this and have quite a lot of words to say about it, in a long remark.</p></article></section>
<form><label>Name</label><input><p>Sign up now to get more of these fine words.</p></form><footer>&copy; 2020 nobody</footer></body></html>"""
BODY = '<h1>Title &eacute;t&eacute;</h1><p><b>First</b>\n para&shy;graph   of <a href="x">some words</a>, and more.</p><div class="ad">Buy this thing now, you will not regret it.</div><p>Second &lt;one&gt; here with a few words.<p>End.</p>'
WANT = "Title été\nFirst para\xadgraph of some words, and more.\nSecond <one> here with a few words.\nEnd."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', '<div id="main">%s</div>', "<div>%s</div>", "<main><article>%s</article></main>"])
def test_containers(wrap):
    assert H.main_text(PAGE % (wrap % BODY), W) == WANT


def test_cut_off_and_empty_pages():
    whole = PAGE % ("<article>%s</article>" % BODY)
    assert H.main_text(whole[: whole.index("End.") + 4], W) == WANT
    assert H.main_text(whole[: whole.index("</article>")] + "<p>x &am", W).endswith("x &am")
    for page in (None, "", "<html>", "<nav>a b c</nav>", "<script>var a", "<p class='x", "<!--", "<", "plain <"):
        assert isinstance(H.main_text(page, W), str)
    assert H.main_text(None, W) == H.main_text("<nav>a b c</nav>", W) == ""
    assert H.main_text("just words without markup", W) == "just words without markup"


def test_hints_of_wrappers():
    assert H.main_text(PAGE.replace('class="page"', 'class="page has-sidebar"').replace("<header>", '<div class="wrap no-menu"><header>') % ("<article>%s</article>" % BODY), W) == WANT
    assert H.main_text('<div class="menu"><p>The whole page stands in a menu, oddly.</p></div>', W) == "The whole page stands in a menu, oddly."


@pytest.mark.parametrize("page", [PAGE.replace("</head>", ""), PAGE.replace("</head>\n<body class=\"page\">", "")])
def test_head_without_its_end(page):
    assert page != PAGE and H.main_text(page % ("<article>%s</article>" % BODY), W) == WANT


def test_best_run():
    assert H.best([1, -2, 3, 4, -1, 2, -9, 5]) == (2, 6)
    assert H.best([-1, -2]) == (0, 0)
    xs = [3, -1, -1, 2, -5, 4, -2, 4, 0, -9, 1]
    sums = {(i, j): sum(xs[i:j]) for i in range(len(xs)) for j in range(i + 1, len(xs) + 1)}
    assert sums[H.best(xs)] == max(sums.values())


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE % ("<article>%s</article>" % BODY), "x"), (None, None, None, "y"), (2, "v", "<p>" + "word " * 60_000, "z"), (2, "v", "", "z")], "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert [(r.text, r.n_chars) for r in got[:2]] == [(WANT, len(WANT)), ("", 0)]
    assert got[2].n_chars == 60_000 * 5 - 1 and got[3].text == ""
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["related-work", "social-history", "alert-systems", "copyright-law", "menu-recipes", "no-ads", "text-block"])
def test_names_of_what_an_article_is_about(name):
    body = BODY.replace("<p>End.", f'<section id="{name}"><p>A section of the article on its very own matter.</p></section><p>End.')
    want = WANT.replace("\nEnd.", "\nA section of the article on its very own matter.\nEnd.")
    assert H.main_text(PAGE % f"<article>{body}</article>", W) == want
    assert H.main_text(PAGE % f"<article>{body}</article>".replace("id=", "class="), W) == want


@pytest.mark.parametrize("name", ["related-posts", "recommendedArticles", "ad", "ad-slot-3", "post-comments", "commentList", "social-share", "sidebar-left", "site-footer", "article-nav"])
def test_names_of_what_stands_beside_one(name):
    body = BODY.replace("<p>End.", f'<div class="x {name}"><p>Something else, of as many words as one cares to read.</p></div><p>End.')
    assert H.main_text(PAGE % f"<article>{body}</article>", W) == WANT


def test_weights_come_from_labelled_pages():
    turned = H.learn(H.LABELLED, [H.LABELLED_NAMES[0].replace("ad", "zz")])
    body = BODY.replace('class="ad"', 'class="zz"')
    assert H.main_text(PAGE % f"<article>{body}</article>", turned) == WANT
    assert "Buy this thing" in H.main_text(PAGE % f"<article>{body}</article>", W)


@pytest.mark.parametrize("name", ["noscript", "svg", "iframe", "template", "math"])
def test_what_is_never_closed_hides_nothing(name):
    assert H.main_text(PAGE % f"<article><{name}>{BODY}</article>", W).endswith("End.")


def test_time_grows_with_length_however_deep_it_nests():
    import time

    def took(n):
        page = "<div>" * n + "<p>A paragraph of some words down here.</p>" + "<p>x y</p></div></i>" * n
        t = time.process_time()
        assert H.main_text(page, W).startswith("A paragraph of some words")
        return time.process_time() - t

    took(500)
    assert took(20_000) < 12 * took(4_000)


def test_made_pages():
    """Pages put together at random of an article and what stands around and inside it: exactly the article comes out."""
    import html as std
    import random

    rng = random.Random(17)
    word = lambda: rng.choice(["über", "to", "a&b", "<x>", "don't", "lé", "of", "longerword", "in", "x.", "why?"])
    words = lambda a, b: [word() for _ in range(rng.randint(a, b))]
    esc = lambda ws: rng.choice([" ", "  ", "\n"]).join(std.escape(w) for w in ws)

    def furniture():
        text = esc(words(1, 40))
        return rng.choice([
            f"<nav><ul><li><a href=x>{text}</a></li></ul></nav>", f'<div class="ad">{text}</div>', f"<aside><p>{text}</p></aside>", f"<form><p>{text}</p><input></form>", f"<script>var a='<p>{text}</p>';</script>", f"<style>p{{}}</style><!-- <p>{text}</p> -->",
            f'<div class="sidebar widget"><p>{text}</p></div>', f'<section id="comments"><p>{text}</p></section>', f'<div class="cookie-notice"><p>{text}</p></div>', f'<ul class="share-buttons"><li>{text}</li></ul>', f"<footer>{text}</footer>",
        ])

    for _ in range(300):
        blocks, want = [], []
        for k in range(rng.randint(1, 9)):
            ws = words(3, 60)
            tag = "h1" if k == 0 else rng.choice(["p", "p", "p", "h2", "blockquote", "li"])
            cut = rng.randint(0, len(ws) - 1)
            inner = esc(ws[:cut]) + (" " if cut else "") + rng.choice(["<b>%s</b>", "<i>%s</i>", '<a href="/y">%s</a>', "%s"]) % esc(ws[cut:])
            blocks.append(f"<ul><li>{inner}</li></ul>" if tag == "li" else f"<{tag}>{inner}</{tag}>" if tag != "p" or rng.random() < 0.7 else f"<p>{inner}")
            want.append(" ".join(" ".join(ws).split()))
            if rng.random() < 0.3:
                blocks.append(furniture())
        around = ["".join(furniture() for _ in range(rng.randint(0, 4))) for _ in range(2)]
        wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", '<div class="post-content">%s</div>', "<main><article>%s</article></main>"])
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{around[0]}{wrap % ''.join(blocks)}{around[1]}</body></html>"
        assert H.main_text(page, W) == "\n".join(want), page
