import random
import re
from collections import Counter

import pytest

from pagewright.llm import wrappers as W


def tree(r, depth=3):
    label = r.choice("abc")
    return W.Tree(label, [tree(r, depth - 1) for _ in range(r.randint(0, 3))] if depth else [])


def most_pairs(a, b):
    """Simple tree matching by its recursive definition."""
    if a.label != b.label:
        return 0

    def forest(i, j):
        if not i or not j:
            return 0
        return max(forest(i - 1, j), forest(i, j - 1), forest(i - 1, j - 1) + most_pairs(a.children[i - 1], b.children[j - 1]))

    return 1 + forest(len(a.children), len(b.children))


def test_matching_equals_its_definition():
    r = random.Random(2)
    for _ in range(150):
        a, b = tree(r), tree(r)
        assert W.matched(a, b, {}) == most_pairs(a, b)


def test_merging_pairs_as_many_nodes_as_match(monkeypatch):
    r = random.Random(8)
    for cells in (W.CELLS, 2):  # whole tables, and halved alignments
        monkeypatch.setattr(W, "CELLS", cells)
        for _ in range(150):
            a, b = tree(r), tree(r)
            if a.label == b.label:
                assert a.size + b.size - W.merge(a, b, {}, [0], {}).size == most_pairs(a, b)


def test_like_siblings_are_aligned_one_by_one(spark):
    rows = [(i, f"http://a.example/{i}", f"<div>Our notice</div><div>text {i}</div><div>Our terms</div><table><tr><td>{'Our notice' if i == 1 else i}<td>Print</table>") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", f"<ul><li>{'Menu' if i % 5 else 'Terms'}<li>Help<li>{'Terms' if i % 5 else 'Menu'}</ul><p>words {i}") for i in range(20)]
    got = {r.page_id: r.content for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"text {i}\n{'Our notice' if i == 1 else i}" for i in range(20))
    assert all(got[100 + i] == (f"words {i}" if i % 5 else f"Terms\nMenu\nwords {i}") for i in range(20))  # what stands elsewhere is no template


def test_alignment_keeps_all_slots_apart():
    pages = ["<div><p>x</p><h1>t</h1></div>", "<div><h1>t</h1><p>x</p><table><tr><td>1</td></tr></table></div>", "<div><h1>t</h1></div><p>end</p>"]
    skeletons = [W.skeleton(p)[0] for p in pages]
    for to in W.induce(skeletons):
        assert len(set(to.values())) == len(to)


def page(title, body, nav="<nav><a href=/>Home</a><a href=/x>About us</a></nav>"):
    return f"<!DOCTYPE html><html><head><title>no</title><script>var a='</p>';</script></head><body>{nav}<h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in body)}<footer>All rights reserved</footer></body></html>"


def test_template_and_content(spark):
    rows = [(i, f"http://Host{i % 2}.example/{i}", page(f"Title {i}", [f"text {i} {k} &amp; more" for k in range(1 + i % 3)])) for i in range(40)]
    rows += [(100 + i, f"http://host0.example/ad{i}", page(f"Title {100 + i}", [f"one {i}"], nav="<nav><a href=/>Home</a></nav><aside>Buy now</aside>")) for i in range(20)]
    got = {r.page_id: r for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert got[i].content == "\n".join([f"Title {i}", *(f"text {i} {k} & more" for k in range(1 + i % 3))])
        assert got[i].content_chars == sum(map(len, got[i].content.split("\n")))
        assert got[i].template_chars == len("HomeAbout usAll rights reserved")
    assert got[100].content == "Title 100\none 0"


def test_verdict_is_by_text_at_every_host_size(spark):
    line = lambda author, body: f"<body><div class=author>{author}</div><div class=text>{body}</div><footer>All rights reserved</footer></body>"
    rows = []
    for host, n in (("small", 8), ("large", 400)):
        rows += [(host, i, f"http://{host}.example/{i}", line(f"author {i % 8}", f"body {i}")) for i in range(n)]
    rows += [("copies", i, f"http://copies.example/{i}", line(f"author {i}", "the same" if i < 90 else f"body {i}")) for i in range(100)]
    df = spark.createDataFrame(rows, "host string, page_id long, url string, html string")
    got = {(r.url.split("/")[2].split(".")[0], r.page_id): r.content for r in W.extract(df).collect()}
    assert all(got[h, i] == f"author {i % 8}\nbody {i}" for h, n in (("small", 8), ("large", 400)) for i in range(n))
    assert all(got["copies", i] == f"author {i}\nbody {i}" for i in range(90, 100))


def test_every_visible_text_is_content_or_template(load):
    rows = {r.page_id: r for r in W.extract(load("pages")).collect()}
    pages = load("pages").collect()
    assert len(rows) == len(pages)
    for p in pages:
        texts = W.skeleton(p.html)[2]
        assert rows[p.page_id].content_chars + rows[p.page_id].template_chars == sum(map(len, texts))
        left = iter(texts)
        assert all(x in left for x in rows[p.page_id].content.split("\n") if x)  # in page order


def test_elements_nested_too_deep_end_like_others():
    html = "<div class=main>" + "<div>" * 150 + "deep" + "</div>" * 150 + "<span>inside</span></div><span>outside</span>"
    root, texts = W.parse(html)
    assert [t.text for t in texts] == ["deep", "inside", "outside"]
    main, after = root.children
    assert (main.label, after.label) == ("div.main", "span") and main.children[-1].label == "span"
    depth = lambda n: 1 + max(map(depth, n.children), default=0)
    assert depth(root) <= W.DEPTH + 2
    unended = "<b>" * 300 + "x" + "</i>" * 300 + "</b>" * 299 + "y</b>z"
    assert [t.text for t in W.parse(unended)[1]] == ["x", "y", "z"] and W.parse(unended)[0].children[-1].text == "z"


def by_brute_force(pages):
    """Contents by the rule: the wrapper's slots, and how many pages have a text in one of them."""
    hosts, out = {}, {}
    for p in pages:
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", p.url or "")
        hosts.setdefault(found.group(1).lower() if found else "", []).append((p.page_id, *W.skeleton(p.html)))
    for own in hosts.values():
        times = Counter(tree for _, tree, _, texts in own if texts)
        order = sorted(times, key=lambda t: (-times[t], t))
        slots = dict(zip(order, W.induce(order)))
        seen = Counter(x for _, tree, at, texts in own if texts for x in {(slots[tree][k], t) for k, t in zip(at, texts)})
        n = sum(times.values())
        for page, tree, at, texts in own:
            out[page] = "\n".join(t for k, t in zip(at, texts) if not (seen[slots[tree][k], t] > 1 and seen[slots[tree][k], t] >= W.SHARE * n))
    return out


@pytest.mark.parametrize("d", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_whole_query_against_brute_force(load, d):
    pages = load("pages", d)
    assert {r.page_id: r.content for r in W.extract(pages).collect()} == by_brute_force(pages.collect())


def test_skeletons_of_a_large_host_are_folded_in_turn(spark, monkeypatch):
    """In several rounds, which find what one would."""
    rows = [(i, f"http://big.example/{i}", page(f"Title {i}", [f"text {i} {k}" for k in range(1 + i % 37)])) for i in range(150)]
    rows += [(1000 + i, f"http://one.example/{i}", page(f"T {i}", ["x"])) for i in range(3)] + [(2000 + i, None, f"<p>no host {i}</p><p>All alike</p>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.content for r in W.extract(df).collect()}
    assert want[7] == "\n".join(["Title 7", *(f"text 7 {k}" for k in range(8))])
    monkeypatch.setattr(W, "MEET", 4)
    assert {r.page_id: r.content for r in W.extract(df).collect()} == want


def test_just_the_share_is_template(spark):
    rows = [(i, f"http://a.example/{i}", f"<p>{'Notice' if i < 5 else 'other'} </p><div>{i}</div>") for i in range(10)] + [(100 + i, f"http://b.example/{i}", f"<p>{'Notice' if i < 5 else f'other {i}'}</p>") for i in range(11)]
    got = {r.page_id: r.content for r in W.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == str(i) for i in range(10)) and all(got[100 + i] == "Notice" for i in range(5))


def test_odd_rows(spark):
    rows = [(1, "http://a.example/1", None), (2, None, "<p>no url</p>"), (2, None, "<p>no url</p>"), (None, "http://a.example/2", ""), (3, "http://b.example/", "<p>only page"), (4, "http://c.example/", "<div>" * 5000 + "deep" + "</div>" * 5000), (5, "http://d.example/", "<p>" + "word " * 400_000), (6, "http://e.example/", "<<>></ <p <b>x</b"), (7, "nonsense", "plain text")]
    df = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "page_id long, url string, html string, content string, h string")
    got = W.extract(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].content, by[1].content_chars, by[1].template_chars) == (None, None, None)
    assert (by[None].content, by[None].content_chars) == ("", 0)
    assert by[3].content == "only page" and by[4].content == "deep" and by[5].content_chars == 5 * 400_000 - 1
    assert by[2].content in ("", "no url")
    assert W.extract(df.limit(0)).collect() == []
