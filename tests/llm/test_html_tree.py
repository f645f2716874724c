import math
import random
import time
from collections import Counter, defaultdict

import pytest

from cuewright.llm import htmlmain as H

CASES = {
    '<article><p>Story</p><p class="advert">Buy now</p><p class="cookie-notice">We use</p></article>': "Story",
    '<article class="post"><p>Main story text is here</p></article><article class="comment"><p>Reader says</p></article>': "Main story text is here",
    '<article><div class="legal"><p>Body about legal things that is most of it all</p></div><p>x</p></article>': "Body about legal things that is most of it all\nx",
    "<article><p>Let <math><mi>x</mi></math> be</p></article>": "Let x be",
    '<article><p>Story is long enough here</p><section class="comments"><p>Nice</p></section><div id="comment-12"><p>hm</p></div></article>': "Story is long enough here",
    '<div><p>Story that is short</p></div><div class="user-comments"><p>One reader says much more than the story</p><article class="comment">So does another</article></div>': "Story that is short",
    '<div><h1>Head</h1><p>Story of the page</p><ul class="commentlist"><li>x</ul><div id="cookie-bar">y</div><div class="box top-ad">z</div><p class="alert_box">w</p></div>': "Head\nStory of the page",
    '<article><p>A story of some length</p><section class="related-work"><p>Part of it</p></section><p class="share-price">rose</p></article>': "A story of some length\nPart of it\nrose",
    '<div class="comments"><h1>On comments</h1><p>All of the text</p></div><p>end</p>': "On comments\nAll of the text\nend",
    '<div class="layout has-sidebar"><div class="post comments-open"><p>All of it</p></div></div>': "All of it",
    "<article><header><h1>Head</h1></header><p>a&nbsp;b\n\tc &lt;d&gt; &#x1F600;</p><footer>f</footer><form>g</form><nav>n</nav><aside>s</aside></article>": "Head\na b c <d> 😀",
}


@pytest.mark.parametrize("html", CASES)
def test_contract(html):
    assert H.main_text(html, {}) == CASES[html]


def test_deep_and_long_pages():
    start = time.time()
    deep = "<div><b class=x>" * 100_000
    assert H.main_text(deep + "text" + "</i>" * 100_000, {}) == "text"
    assert len({path for path, *_ in H.features(H.parse(deep))[1]}) < 500
    long = "".join(f"<p>word {i}" for i in range(200_000))
    assert H.main_text(long, {}).count("\n") == 199_999
    assert time.time() - start < 90


def test_names_decide_alike_at_any_number_of_pages(spark):
    parts = ["user-comments", "commentlist", "cookie-bar", "top-ad", "alert-box", "related-work"]
    form = lambda host, i, name, tag: (i, f"http://{host}/{i}", f'<body><{tag}><p>Own story {host} {i} and more words</p></{tag}><{tag}><div class="{name}"><p>said {name} {i}</p></div></{tag}></body>')
    rows = [form(f"{tag}{name}{n}.org", i, name, tag) for tag in ("div", "article") for name in parts for n in (1, 3, 4, 8) for i in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in H.extract(df).collect():
        assert ("said" in r.text) == ("related-work" in r.url) and "Own story" in r.text


def test_text_of_small_hosts_against_the_definition(spark):
    made = random.Random(9)

    def page(i):
        parts = ["<div class=x><p>Same notes</p></div>", f"<section class=s><h2>Story {i}</h2><p>own {i}</p></section>", "<ul class=m><li>One</li><li>Two</li></ul>", f"<div class=z><p>tail {i}</p><p>{'end' * (1 + i % 2)}</p></div>", "<div class=top-ad><p>Buy</p></div>"]
        return "<body>" + "".join(x for x in parts if made.random() < 0.9) + "</body>"

    pages = [(n * 100 + i, f"http://h{n}.org/", page(i)) for n in (1, 3, 4, 9, 25) for i in range(n)]
    want, changed = {}, 0
    for host in {url for _, url, _ in pages}:
        own = [x for x in pages if x[1] == host]
        weight = importances([html for *_, html in own], H.MIN_PAGES)
        for page_id, _, html in own:
            blocks, texts = [], []

            def kept(node, below):
                """Whether something in a branch is of importance; its blocks."""
                if "top-ad" in node.attrs:
                    return False, []
                inner = [kept(x, weight) for x in node.children if isinstance(x, H.Node)]
                found = any(k for k, _ in inner) or bool(H.own_text(node)) and weight.get(node.path, 1.0) >= H.MIN_IMPORTANCE
                found = found or bool(sum((b for _, b in inner), [])) and weight.get(node.path, 1.0) >= H.MIN_IMPORTANCE
                text = [H.own_text(node)] if H.own_text(node) else []
                return found, (text + sum((b for k, b in inner if k), [])) if found else []

            texts = kept(H.parse(html), weight)[1]
            blocks = kept(H.parse(html), {})[1]
            want[page_id] = "\n".join(texts)
            changed += len(blocks) and "Same notes" in html and "Same notes" not in want[page_id]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want and changed > 10


def importances(pages, min_pages):
    """By the definition, from the pages themselves."""
    seen, looks, texts, known = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), [H.parse(html) for html in pages]
    for page, root in ((H.features(root)[0], root) for root in known):  # pages of one text are one
        todo = [(root, False)]
        while todo:
            node, inside = todo.pop()
            inside = inside or node.tag in ("article", "main")
            inner = [x for x in node.children if isinstance(x, H.Node)]
            todo += [(x, inside) for x in inner if not H.meaningless(x, inside)]
            seen[node.path].add(page)
            if inner:
                looks[node.path][tuple(dict.fromkeys(x.path for x in inner))].add(page)
            if text := H.own_text(node):
                texts[node.path][text].add(page)

    def entropy(by, pages):
        total = sum(len(x) for x in by.values())
        return max(0.0, 1 - sum(len(x) * math.log(len(x)) for x in by.values()) / total / math.log(pages)) if pages > 1 and total else 1.0

    below = defaultdict(list)
    for path in seen:
        if path:
            below[path.rpartition("/")[0]].append(path)

    def of(path):
        weight = total = 0.0
        for child in below[path]:
            n = len(seen[child])
            if n < min_pages:
                some = n if looks[child] or texts[child] else 0
                weight, total = weight + some, total + some
            elif (inner := of(child)) is not None:
                weight, total = weight + n, total + n * inner
        if texts[path]:
            n = len(set().union(*texts[path].values()))
            weight, total = weight + n, total + n * (entropy(texts[path], n) if n >= min_pages else 1.0)
        if not weight:
            return None
        inner = total / weight
        if looks[path]:
            share = H.DECAY ** len(looks[path])
            inner = (1 - share) * entropy(looks[path], len(seen[path])) + share * inner
        return inner

    return {path: got for path in seen if len(seen[path]) >= min_pages and (got := of(path)) is not None}


def test_tree_against_its_definition(spark):
    made = random.Random(8)

    def page(i):
        parts = ["<div class=x><p>Same <b>notice</b></p></div>", f"<section><h2>Story</h2><p>own {i}</p></section>", "<ul class=m><li>One<li>Two</ul>", f"<div class=z>tail {i % 3}<span>end</span></div>", "<footer>f</footer>"]
        return "<body>" + "".join(x for x in parts if made.random() < 0.8) + "</body>"

    pages = [page(i) for i in range(30)] + [page(0)] * 3
    df = spark.createDataFrame([(i, "http://h.org/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    want = importances(pages, H.MIN_PAGES)
    got = {r.path: r.importance for r in H.low_importance(H.style_trees(df), least=9.0).collect() if not r.path.endswith(H.OWN_TEXT)}
    assert want.keys() == got.keys() and len(want) > 8
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "http://a.org/", ""), (1, "http://a.org/", ""), (2, "no host", "<p>x"), (3, "http://a.org/", "<p>y" + " z" * 500_000), (4, None, "<!-- only -->")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as low", "2 as path", "3 as n")
    got = sorted(((str(r.page_id), str(r.url), r.text, r.n_chars) for r in H.extract(df).collect()))
    long = "y" + " z" * 500_000
    assert got == sorted([("None", "None", "", 0), ("1", "http://a.org/", "", 0), ("1", "http://a.org/", "", 0), ("2", "no host", "x", 1), ("3", "http://a.org/", long, len(long)), ("4", "None", "", 0)])
