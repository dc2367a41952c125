"""Toxicity on held-out labels (some labels of junk texts are noise), page
extraction, role repair."""

import html
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrolith.llm import chat, extract, toxicity
from hydrolith.llm.markup import Block, blocks, node_id
from hydrolith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]), max_size=24))
def test_segments_are_all_maximal_ones(scores):
    """A maximal segment is better than every part of it, and no larger
    segment that holds it is so."""
    total = np.r_[0.0, np.cumsum(scores)]
    n = len(scores)

    def proper(a, b):
        s = total[b] - total[a]
        return s > 0 and all(total[k] > total[a] for k in range(a + 1, b + 1)) and all(total[k] < total[b] for k in range(a, b))

    good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if proper(a, b)]
    want = {(a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good)}
    assert {(a, b) for a, b, _ in toxicity.segments(np.array(scores))} == want


def test_scale_solves_its_equation():
    v, p = np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.4, 0.3, 0.2, 0.1])
    lam = toxicity.karlin_scale(v, p)
    assert abs((p * np.exp(lam * v)).sum() - 1) < 1e-6


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op2_toxicity"](spark, sf).filter("held_out").collect()
    import zlib

    own = [(r.score, lab[r.doc_id]) for r in got if r.doc_id in lab]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    bad, good = [s for s, y in own if y], [s for s, y in own if not y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9
    assert np.mean([s >= 0.5 for s in good]) < 0.02


PAGE = """<!doctype html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
<div class="cookie-notice">We use cookies</div><header><a href=/>Site</a></header><nav><ul><li>Home<li>About</ul></nav>
<main><article><h1>A &amp; B</h1><p>First <b>bold</b>
 line<p>Second&nbsp;one &lt;x&gt;<div class="ad-box">Buy</div><blockquote>Quote</blockquote><table><tr><td>c1<td>c2</table>
<p class='share-price'>Up<p id='alert-level'>High<div class='notice-of-award'>Won</div>one<span class='tag social'>two</span> three<section id="comments"><p>Nice!</p></section></article><aside>More</aside></main><form><label>Mail</label><input></form><footer>(c)</footer></body></html>"""


def texts(page):
    """With no tree."""
    return extract.main_blocks(page, {})[0]


def test_article_of_a_page():
    assert texts(PAGE) == ["A & B", "First bold line", "Second one <x>", "Quote", "c1", "c2", "Up", "High", "Won", "onetwo three"]


def test_broken_markup():
    assert texts("<p>a<p>b<ul><li>c<li>d") == ["a", "b", "c", "d"]
    assert texts("<article><p>x <!-- open") == ["x"]
    assert texts("a < b & c > d") == ["a < b & c > d"]
    assert texts("<form><article><p>in a form</article></form>") == ["in a form"]
    assert len(texts("<div>" * 5000 + "deep")) == 1


def test_small_containers_do_not_stand_for_the_page():
    """A byline or a teaser in a container that names itself the article."""
    body = "The body of the page, which is much longer than what stands beside it."
    meta = f"<div class=entry-meta>By X</div><div class=wrap><p>{body}</p></div>"
    assert texts(meta) == ["By X", body]
    teaser = f"<div class=page><p>{body}</p></div><article><h2>Next story</h2></article>"
    assert texts(teaser) == [body, "Next story"]
    nested = f"<main><article><p>Teaser</p></article><p>{body}</p></main><div>Made by us</div>"
    assert texts(nested) == ["Teaser", body]
    assert texts(f"<article><p>{body}</p></article><div>Made by us</div>") == [body]


def test_tree_removes_what_a_host_repeats(spark):
    """Pages without telling tags: the same menu on all pages goes, what each
    page has of its own stays, and another host is not touched."""
    def page(i):
        return f"<body><div class=x1>Home News Contact us today</div><div class=x2><p>Story {i} about {i * 7} things.</p></div><div class=x3>All rights reserved by us</div></body>"

    rows = [(i, f"https://A.example:80/{i}", page(i)) for i in range(12)] + [(100, "https://b.example/", page(100))]
    got = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} about {i * 7} things." for i in range(12))
    assert got[100].count("\n") == 2


def merged(pages):
    """The style tree of a host's pages, merged and scored recursively: a dict of
    node to (pages, composite, top)."""
    out = {}

    def score(node, held):
        """``held`` has, for each page, the elements or texts that are this node."""
        m = len(held)
        if all(isinstance(x, Block) for own in held for x in own):
            on: dict[str, int] = {}
            for own in held:
                for t in {x.text for x in own}:
                    on[t] = on.get(t, 0) + 1
            value = 1 - sum(math.log(k, m) for k in on.values()) / len(on) if m >= extract.PAGES else 1.0
            if m >= extract.PAGES:
                out[node] = (m, value, value)
            return value, value
        styles: dict[tuple, list] = {}
        for own in held:
            by: dict[tuple, list] = {}
            for x in own:
                runs = tuple(k for k, _ in itertools.groupby("#" if isinstance(i, Block) else i.key for i in x.items))
                by.setdefault(runs, []).append(x)
            for runs, xs in by.items():
                styles.setdefault(runs, []).append(xs)
        if m < extract.PAGES:
            return 1.0, 1.0
        total = sum(map(len, styles.values()))
        entropy = -sum(len(p) / total * math.log(len(p) / total, m) for p in styles.values())
        below, top = 0.0, 0.0
        for runs, on_pages in styles.items():
            name = node_id(f"{node} {' '.join(runs)}")
            values = []
            for at in range(1, len(runs) + 1):
                child = []
                for xs in on_pages:
                    found = []
                    for x in xs:
                        groups = [list(g) for _, g in itertools.groupby(x.items, key=lambda i: "#" if isinstance(i, Block) else i.key)]
                        found += groups[at - 1]
                    child.append(found)
                c, t = score(node_id(f"{name} {at}"), child)
                values.append(c if len(on_pages) >= extract.PAGES else 1.0)
                top = max(top, t if len(on_pages) >= extract.PAGES else 1.0)
            if not runs or len(on_pages) < extract.PAGES:
                values, top = ([1.0] if runs or len(on_pages) < extract.PAGES else [0.0]), max(top, 1.0 if len(on_pages) < extract.PAGES else 0.0)
            below += len(on_pages) / total * sum(values) / len(values)
        part = extract.GAMMA ** len(styles)
        out[node] = (m, (1 - part) * entropy + part * below, top)
        return out[node][1:]

    score(node_id(""), [[blocks(p)[0]] for p in pages])
    return out


def test_tree_equals_recursive_merge(spark):
    """Composites of a whole host of the table, and of odd pages."""
    own = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("url LIKE '%blog.tionsh.example.com%'").collect()]
    odd = [f"<div>same</div><p>own {i}</p>{'<ul><li>a<li>b</ul>' if i % 3 else ''}{'<p>x' * (i % 2)}<div class=c7><p>Subscribe</p></div>" for i in range(9)]
    rows = [(h, "a") for h in own] + [(h, "b") for h in odd]
    got = extract.site_tree(spark.createDataFrame(rows, "html string, host string").repartition(3)).collect()
    for host, pages in (("a", own), ("b", odd)):
        want = merged(pages)
        assert len(pages) > 8 and {r.node for r in got if r.host == host} == set(want)
        for r in got:
            if r.host == host:
                assert (r.pages, r.composite, r.top) == pytest.approx(want[r.node], abs=1e-9)


def test_boilerplate_without_a_name_goes(spark):
    """A part inside the article that says nothing of itself, by the tree alone;
    both ways of meeting the nodes agree."""
    page = lambda i: f"<body><article><h1>Title {i}</h1><p>Text {i} of its own.</p><div class=c7><p>Subscribe to our letter</p></div></article></body>"
    rows = [(i, f"https://h{i % 2}.example/{i}", page(i)) for i in range(20)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (extract.BROADCAST_NODES, 0):
        got = {r.page_id: r for r in extract.extract(p, few).collect()}
        assert all(r.text == f"Title {i}\nText {i} of its own." and r.n_tree == 1 for i, r in got.items())
    assert texts(page(1)).count("Subscribe to our letter") == 1


def test_articles_of_the_table(spark):
    """Every page of the table has one article: its blocks come out, all of them."""
    tag = re.compile(r"<[^>]*>")
    for r in QUERIES["op4_html_extraction"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        lines = [" ".join(x for x in re.split(r"[ \t\r\n\f\v]+", html.unescape(tag.sub(" " if "<br>" in part else "", part))) if x) for part in parts]
        assert r.text.replace(" ", "") == "\n".join(x for x in lines if x).replace(" ", "")


def cheapest(roles, costs):
    """All ways, spelled out."""
    best = None
    for to in itertools.product(range(3), repeat=len(roles)):
        price = sum(0 if t == r else costs.name if r is None else costs.relabel for t, r in zip(to, roles, strict=True))
        for merges in itertools.product([False, True], repeat=len(roles)):
            state, extra, ok = chat.START, 0, True
            for t, m in zip(to, merges, strict=True):
                if m:
                    ok = ok and t == state
                    extra += costs.merge
                elif (state, t) in chat.INSERTED:
                    extra += costs.insert * len(chat.INSERTED[state, t])
                else:
                    ok = False
                state = t
            if ok:
                c = price + extra + costs.insert * len(chat.AT_END[state])
                best = c if best is None else min(best, c)
    return best


def test_repair_is_the_cheapest():
    r = random.Random(3)
    costs = chat.Costs()
    for _ in range(150):
        names = [r.choice(["system", "user", "assistant", "tool", None]) for _ in range(r.randint(1, 5))]
        out = chat.repaired([(i, n, "x") for i, n in enumerate(names)], None, costs, chat.Template())
        assert sum(x[6] for x in out) == cheapest([chat.role_of(n) for n in names], costs)
        legal("".join(x[5] for x in out))


def legal(text):
    roles = [p.split("|>")[0] for p in text.split("<|")[1:] if not p.startswith("end")]
    rest = roles[1:] if roles and roles[0] == "system" else roles
    assert rest and all(x == ("user", "assistant")[i % 2] for i, x in enumerate(rest)), roles


def test_conversations_over_many_tasks(spark):
    """One conversation with most of the turns gives the same in one task as
    in sixteen, turn for turn."""
    r = random.Random(4)
    rows = [(1, i, r.choice(["system", "user", "user", "assistant", "tool"]), f"t{i}") for i in range(400)]
    rows += [(c, i, r.choice(["user", "assistant"]), "y") for c in range(2, 40) for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for c in {x[0] for x in rows}:
        for x in chat.repaired([x[1:] for x in rows if x[0] == c], None, chat.Costs(), chat.Template()):
            want[c, x[0]] = x[1:]
    for n in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = {(x.conv_id, x.turn): tuple(x[2:]) for x in chat.format_chats(df).collect()}
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert sum(v[5] for v in got.values()) == sum(v[5] for v in want.values())
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        legal("".join(got[1, i][4] for i in range(400)))
