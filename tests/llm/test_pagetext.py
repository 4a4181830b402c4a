"""Main text of pages: the tree model against enumeration, the parser, and pages laid out in ways it has not seen."""

import re
from itertools import product

import numpy as np
import pytest

from deskmill.llm import pagetext as P

PAGES = "page_id long, url string, html string, text string"
WORDS = "over the hills a river runs and people walk along its banks in autumn when leaves fall slowly into cold water".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n)) + "."


def article(k):
    rng = np.random.default_rng(k)
    return [sentence(rng, 6), *(sentence(rng, int(rng.integers(4, 60))) for _ in range(int(rng.integers(2, 7))))]


def page(blocks):
    body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{x}</p>" for x in blocks[1:])
    return f"<!DOCTYPE html><html><head><title>{blocks[0]}</title><style>p{{}}</style></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav><div class='ad'>Buy this now.</div><article>{body}</article><footer>&copy; site &middot; Some words.</footer></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(k, f"http://a/{k}", page(article(k)), "x") for k in range(60)], PAGES)


@pytest.fixture(scope="module")
def model(pages):
    return P.train(P.labelled_pages(pages))


def test_marginals_are_exact(model):
    """Messages give the same marginals as summing over all labels of all nodes."""
    source = "<body><nav><a href=x>Home</a></nav><div class='comments'><p>Nice words.</p></div>A run of text.</body>"
    forest = P.Forest([P.parse("<p>x</p>"), P.parse(source)])
    f, e, r = model
    mine = np.flatnonzero(forest.page == 1)
    weight = np.zeros((len(mine), P.STATES))
    for node, feature in zip(forest.node, forest.feature):
        if forest.page[node] == 1:
            weight[node - mine[0]] += f[feature]
    total = np.zeros((len(mine), P.STATES))
    for y in product(range(P.STATES), repeat=len(mine)):
        s = sum(weight[i, y[i]] for i in range(len(mine)))
        for i, n in enumerate(mine):
            s += r[y[i]] if forest.root[n] else e[forest.edge[n], y[forest.parent[n] - mine[0]], y[i]]
        for i in range(len(mine)):
            total[i, y[i]] += np.exp(s)
    assert np.allclose(P.infer(forest, model)[mine], total[:, 1] / total.sum(axis=1))


def test_potentials_are_frequencies():
    sources = [page(article(k)) for k in range(4)]
    parsed = [P.parse(x) for x in sources]
    contents = [set(article(k)) for k in range(4)]
    counts = P.tally(parsed, contents)
    assert (counts == sum(P.tally([p], [c]) for p, c in zip(parsed, contents))).all()  # partial sums
    at = P.STATES * P.FEATURES["tag=article"]
    assert counts[at : at + 3].tolist() == [0, 4, 0]
    at = P.STATES * P.FEATURES["tag=body"]
    assert counts[at : at + 3].tolist() == [0, 0, 4]
    at = P.STATES * P.FEATURES["name=ad"]
    assert counts[at : at + 3].tolist() == [4, 0, 0]


def texts(source):
    page = P.parse(source)
    return [x for x in page.text if x is not None]


def test_parse():
    assert texts("<p>a&nbsp;&amp;&lt;b&#233;<b>c\n d</b><br>e<p>f") == ["a &<bé" + "c d e", "f"]
    assert texts("<ul><li>a<li>b <ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert texts("x<!-- no --> y<script>if (a</b) {'<p>'}</script >z<SCRIPT>never</p>") == ["x y" + "z"]
    assert texts("a<title>no</title>b<textarea>no</textarea><svg><p>no</p></svg>c<svg/>d") == ["abcd"]
    assert texts("1 < 2 <3 & 4 &am") == ["1 < 2 <3 & 4 &am"]
    assert texts("<p title='a>b' data-x=\"<p>\">in</p></div></p></>out</ p><?php x?><![CDATA[y]]>") == ["in", "out"]
    assert texts("") == [] and texts(" \n\t") == [] and texts("<") == ["<"] and texts("<p") == [] and texts("a<!-- b") == ["a"]
    assert texts("<p>&amp</p>&quot;") == ["&", '"']
    deep = P.parse("<div>" * 3000 + "x")
    assert max(deep.depth) == 3001 and P.Forest([deep]).total[0] == 1
    assert P._names(""" class="siteHeader main-nav" id='x9'""") == {"head", "main", "nav", "other"} and P._names(' data-class="ad" href="/id=ad"') == set()


def unseen(k):
    """Page layouts written by hand, other than those of training."""
    b = article(1000 + k)
    rng = np.random.default_rng(k)
    body = "".join(f"<p>{x}</p>\n" for x in b[1:])
    note, reply = sentence(rng, 18), sentence(rng, 25)
    link = "".join(f'<a href="/{w}">{w}</a> ' for w in rng.choice(WORDS, 6))
    top = f'<div id="cookie-consent"><p>{note}</p><button>OK</button></div><div class="site-header"><div class="logo">Site</div><div class="main-menu"><ul><li>{link}</li></ul></div></div>'
    end = f'<div class="comments-area" id="comments"><h3>2 replies</h3><div class="comment"><p>Ann</p><p>{reply}</p></div><div class="comment"><p>{note}</p></div></div><div class="site-footer"><p>© 2024 {note}</p></div>'
    return b, (
        f'<body>{top}<div class="row"><div class="post-content"><h1>{b[0]}</h1>{body}</div><div class="sidebar"><h3>More</h3><ul><li>{link}</li></ul></div></div>{end}</body>',
        f'<body><header><p>Site</p></header><nav>{link}</nav><main><h1>{b[0]}</h1>{body}<aside>{link}</aside></main><form action="/s"><p>{note}</p><input></form>{end}</body>',
        f'<body>{top}<section id="story"><h1>{b[0]}</h1><div class="promo">{note}</div>{body}</section><div class="newsletter-signup"><p>{note}</p></div><footer>{note}</footer></body>',
    )


def test_unseen_layouts(model):
    """Nearly all main text and little else, on named containers, sidebars, notices, forms and comments not laid out like this in training."""
    right = wrong = lost = 0
    for k in range(20):
        b, sources = unseen(k)
        for got in P.main_texts(list(sources), model):
            found = got.split("\n")
            right += sum(len(x) for x in found if x in b)
            wrong += sum(len(x) for x in found if x not in b)
            lost += sum(len(x) for x in b if x not in found)
    assert right / (right + lost) > 0.97 and right / (right + wrong) > 0.97


def test_extract(spark, pages, model):
    long = article(7) + ["word " * 300_000 + "end."]
    odd = [(100, None, None), (101, "u", ""), (102, None, " \n "), (103, "u", "plain"), (104, "u", "<nav><a href=x>only menus</a></nav><script>x"), (None, "u", page(article(3))), (5, "http://a/5", page(article(5))), (105, "u", page(long)), (106, "u", page(["One", "One"]))]
    every = pages.unionByName(spark.createDataFrame([(*r, "y") for r in odd], PAGES))
    out = P.extract(every)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and dict(out.dtypes)["n_chars"] == "bigint"
    got = out.collect()
    assert len(got) == 60 + len(odd)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    for k in range(60):
        assert {r["text"] for r in by[k]} == {"\n".join(article(k))}
    assert len(by[5]) == 2 and by[None][0]["text"] == "\n".join(article(3))
    assert [by[k][0]["text"] for k in (100, 101, 102, 104)] == [""] * 4
    assert by[105][0]["text"] == "\n".join(re.sub(r"\s+", " ", x) for x in long)
    assert by[106][0]["text"] == "One\nOne"
    assert P.extract(spark.createDataFrame([], PAGES)).count() == 0
    none = spark.createDataFrame([(1, "u", "<body><nav><a href=x>menu</a></nav><div class='content'><p>" + " ".join(article(9)) + "</p></div></body>", "z")], PAGES)
    assert P.extract(none).first()["text"] == " ".join(article(9))  # no page marks its article; made-up pages are learned from
    given = P.extract(none, labelled=spark.createDataFrame([(page(article(k)), "\n".join(article(k))) for k in range(5)], "html string, content string"))
    assert given.first()["text"] == " ".join(article(9))
