import random
import time

import pytest

from panelyard.llm import wrapper


def page(rng, i, shape="article"):
    w = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + str(rng.randint(0, 99)) for _ in range(n))
    title, paras = w(4), [w(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f'<li><a href="/{k}">{w(1)}</a></li>' for k in range(rng.randint(2, 6)))
    body = f"<h1>{title}</h1><p><b>{paras[0]}.<br><p>" + "</p><p>".join(paras[1:]) + "</p>"
    main = {"article": f"<article>{body}</article>", "div": f'<div class="content">{body}<div class="foo">Printed on recycled pixels</div></div>'}[shape]
    html = (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><nav><ul>{menu}</ul></nav><!-- x --><div class="ad">{w(6)}</div>'
        f'<header><p>Site header</p></header>{main}<aside>{w(5)}</aside><div class="comments"><p>{w(9)}</p></div><form><p>{w(3)}</p></form><footer>&copy; {w(3)}</footer></body></html>'
    )
    return html, "\n\n".join(x for x in [title, paras[0] + ".", *paras[1:]] if x)


def test_articles_of_one_host(spark):
    rng = random.Random(1)
    made = [page(rng, i) for i in range(30)]
    rows = [(i, f"http://h{i % 2}.org/{i}", h) for i, (h, _) in enumerate(made)] + [(100, "http://only.org/", made[0][0]), (101, None, made[1][0]), (102, "http://h0.org/e", None), (103, "http://h0.org/e", ""), (3, "http://h1.org/3", made[3][0])]
    got = {r["page_id"]: r for r in wrapper.extract(spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, host string, root int")).collect()}
    for i, (_, text) in enumerate(made):
        assert got[i]["text"] == text and got[i]["n_chars"] == len(text)
    assert got[100]["text"] == made[0][1] and got[101]["text"] == made[1][1] and got[102]["text"] == "" == got[103]["text"]


def test_a_wrapper_without_an_article_drops_its_template(spark):
    rng = random.Random(2)
    made = [page(rng, i, "div") for i in range(20)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame([(i, "http://h.org/", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(20)] == [t for _, t in made]


def test_copies_do_not_become_template(spark):
    rng = random.Random(3)
    html, text = page(rng, 0)
    rows = [(i, "http://h.org/", html) for i in range(15)] + [(99, "http://h.org/", page(rng, 1)[0])]
    got = wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == text for r in got if r["page_id"] != 99)


def furnished(rng, i, article):
    """A page without telling names: constant furniture among the paragraphs, a menu that varies, adverts from a small pool."""
    w = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + str(rng.randint(0, 999)) for _ in range(n))
    title, paras = w(4), [w(rng.randint(12, 40)) for _ in range(rng.randint(2, 5))]
    text = f"<h1>{title}</h1><p>{paras[0]}</p><p>Print this page or send it to a friend</p>" + "".join(f"<p>{x}</p>" for x in paras[1:]) + "<div>Rate this: <b>1 2 3 4 5</b></div>"
    main = f"<article>{text}</article>" if article else f"<div>{text}</div>"
    menu = "".join(f'<div><a href="/{k}">{w(1)}</a></div>' for k in range(rng.randint(2, 6)))
    return f"<html><body><div>{menu}</div><div>The daily paper of the town</div><table><tr><td>Offer {i % 3}: all you can carry</td></tr></table>{main}</body></html>", "\n\n".join([title, *paras])


@pytest.mark.parametrize("article", [True, False])
def test_slots_and_template_decide(spark, article):
    rng = random.Random(6)
    made = [furnished(rng, i, article) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(40)] == [t for _, t in made]
    assert all(wrapper.main_text(h) != t for h, t in made)  # without the wrapper no page comes out right


def test_a_paragraph_that_some_pages_share_is_no_template(spark):
    rng = random.Random(7)
    made = [page(rng, i) for i in range(30)]
    rows = [(i, "http://h.org/", h.replace("</article>", "<p>A licence line.</p></article>") if i % 3 else h, t + "\n\nA licence line." if i % 3 else t) for i, (h, t) in enumerate(made)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(30)] == [r[3] for r in rows]


def test_names_inside_an_article():
    html = '<div class="content"><h2 id="related-work">Related</h2><p id="comment-syntax">one <span class="search-term">two</span></p><div class="post-comments">no</div><div class="siteFooter">no</div></div>'
    assert wrapper.main_text(html) == "Related\n\none two"


def test_references_spaces_and_broken_markup():
    def own(html):
        return wrapper.main_text(html)

    assert own("<p>a&amp;b &#233;&nbsp;x\n\n  y</p><p> </p>z") == "a&b é x y\n\nz"
    assert own('<article><p>one<p>two<li>three<i>four</i></article><p class="x>y">five') == "one\n\ntwo\n\nthreefour"
    assert own("plain text") == "plain text" and own("") == "" and own("<") == "<" and own("<p") == "<p"
    assert own("<article>a<script>if (a<b) {}</script>b<!-- c --><div>d</div></article>") == "ab\n\nd"


def plain_match(a, b, i=0, j=0):
    """The recurrence of simple tree matching, by dynamic programming."""
    if a[1][i] != b[1][j]:
        return 0
    ka, kb = ([k for k, up in enumerate(t[0]) if up == n] for t, n in ((a, i), (b, j)))
    best = [[0] * (len(kb) + 1) for _ in range(len(ka) + 1)]
    for x in range(len(ka)):
        for y in range(len(kb)):
            best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + plain_match(a, b, ka[x], kb[y]))
    return best[-1][-1] + 1


def test_simple_tree_matching():
    rng = random.Random(8)

    def tree():
        parents, labels, seen = [-1], [""], set()
        for _ in range(rng.randint(0, 25)):
            key = (rng.randrange(len(labels)), rng.choice("abcdef"))
            if key not in seen:
                seen.add(key), parents.append(key[0]), labels.append(key[1])
        return parents, labels

    for _ in range(300):
        a, b = tree(), tree()
        size, to = wrapper.match(a, b)
        assert size == plain_match(a, b) == sum(x >= 0 for x in to)
        assert all(a[1][i] == b[1][j] and (i == 0 or to[a[0][i]] == b[0][j]) for i, j in enumerate(to) if j >= 0)


@pytest.mark.parametrize("html", ["<div x='" * 100_000, "<div>" * 150_000, "<div>" * 90_000 + "</p>" * 60_000 + "</b>" * 60_000, "<a" * 400_000, "<p a=\"" * 100_000 + ">", "<" * 1_000_000, "<p>x</p>" * 100_000], ids=range(7))
def test_long_and_unbalanced_pages_take_linear_time(html):
    began = time.process_time()
    _, shape, *_ = wrapper.summary(html)
    wrapper.main_text(html, shape)
    assert time.process_time() - began < 20


def test_empty(spark):
    assert wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_inside_an_article_need_to_be_whole():
    html = '<article><div class="comment-syntax">a</div><div class="banner-image">b</div><ul class="navigation-list"><li>c</li></ul><table><tr><td class="alert">d</td></tr></table><div class="comments">no</div></article><div class="top-banner">no</div>'
    assert wrapper.main_text(html) == "a\n\nb\n\nc\n\nd"


def test_an_inline_advert_splits_no_paragraph():
    assert wrapper.main_text('<p>one <span class="ad">buy <span>now</span></span>two</p><p>three</p>') == "one two\n\nthree"
    assert wrapper.main_text('<p>one <span class="ad">buy</p><p>three</p>') == "one\n\nthree"
    assert wrapper.main_text('<div><b class="ads">x<i>y</i></b>z</div>w <b class="ad">never closed') == "z\n\nw"


def structured(rng, i):
    """An article of a structured site: a constant heading and a constant last paragraph of its own, named furniture around it."""
    w = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "amet", "sit"]) + str(rng.randint(0, 999)) for _ in range(n))
    title, paras = w(4), [w(rng.randint(12, 40)) for _ in range(3)]
    end = "Readers may write to the desk."
    article = f"<article><h1>{title}</h1><p>{paras[0]}</p><h2>Summary</h2><p>{paras[1]}</p><p>{paras[2]}</p><p>{end}</p></article>"
    html = f'<html><body><nav><ul><li><a href="/">{w(1)}</a></li><li><a href="/b">{w(1)}</a></li></ul></nav><div class="ad">Offer {i % 3}</div>{article}<footer>The daily paper</footer></body></html>'
    return html, [title, paras[0], "Summary", paras[1], paras[2], end]


@pytest.mark.parametrize("pages", [6, 12, 30])
def test_constant_headings_and_ends_of_articles(spark, pages):
    rng = random.Random(pages)
    made = [structured(rng, i) for i in range(pages)]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame([(i, f"http://h.org/{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")).collect()}
    for i, (_, blocks) in enumerate(made):
        want = blocks if pages < wrapper.INNER_PAGES else blocks[:-1]  # by then the end is template
        assert got[i].text == "\n\n".join(want)
        # Menus are told by their links, adverts and the footer by counts where there are pages enough, by names where not.
        assert (got[i].n_template, got[i].n_named) == ((4 + (pages >= wrapper.INNER_PAGES), 0) if pages >= wrapper.LEAST_PAGES else (2, 2))
