import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import mainbody, packing

PAGE = """<!doctype html><html><head><title>T</title></head><body><div class=q><ul><li><a href=/a>Home</a><li><a href=/b>Shop</a><li><a href=/c>News</a></ul></div>
<div class="consent"><p>We use cookies to improve your visit.</p><button>OK</button></div>
<div class=x><h1>A heading of the page</h1><p>The first paragraph has <b>bold</b> words &amp; a <a href=/x>link</a> in it.<p>The second one
 is wrapped&nbsp;here.<script>var a="<p>no</p>";</script><ul><li>an item of the list</li><li>another item of it</li></ul><table><tr><td>gate</td><td>91 kg</td></tr></table>
<div style="display:none">hidden words hidden words</div><div>Line one of text here.<br>Line two of text here.</div></div>
<div class=y><h4>About the author</h4><p>The site is run by readers since 1998. They answer every letter about any lens.</p></div>
<div><div><p>Great post, thanks a lot!</p><small>Reply</small></div><div><p>I do not agree with this part at all.</p><small>Reply</small></div></div>
<footer>All rights reserved 1991</footer></body></html>"""
BLOCKS = ["A heading of the page", "The first paragraph has bold words & a link in it.", "The second one is wrapped here.", "an item of the list", "another item of it", "gate", "91 kg", "Line one of text here.", "Line two of text here."]


def test_main_body_blocks_of_a_page():
    assert mainbody.main_body(PAGE) == BLOCKS


def test_pages_without_an_article():
    nav = "<ul>" + "".join(f"<li><a href=/{i}>Home</a></li>" for i in range(9)) + "</ul>"
    for page in ("", "<html>", "<p>404</p>" + nav, "<body><p>Please log in to read on.</p>" + nav, nav, "<<<>>>", "</div></p><p"):
        assert mainbody.main_body(page) == []


def test_deeply_nested_pages():
    """Unclosed elements by the thousand neither crash nor hide the text, and cost no more than in proportion."""
    p = "The council never agreed on the colour of the lens because the rules had changed."
    for tag in ("b", "div", "span", "li", "a"):
        assert p in mainbody.main_body(f"<body>{f'<{tag}>' * 1500}<p>{p}</p><p>{p}</p>{'x' if tag != 'a' else ''}") or tag == "a"
    assert p in mainbody.main_body("<div><b>" * 20000 + f"<p>{p}</p>" * 3)


def test_charsets():
    t = "Öl für <p>Größe"
    assert mainbody.decode(t.encode()) == t and mainbody.decode(t.encode("latin-1"), "text/html; charset=iso-8859-1") == t
    assert mainbody.decode(b'<meta charset="windows-1252">' + t.encode("cp1252")).endswith(t) and mainbody.decode(t.encode("cp1252")) == t
    assert mainbody.decode("page é".encode()[:-1]) == "page " and mainbody.decode(b"\xef\xbb\xbfx") == "x" and mainbody.decode(b"\xe9", "charset=nonsense") == "é"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="<>/ap!div-\"'= \n&;b", max_size=200))
def test_any_markup_is_parsed(page):
    mainbody.main_body(page)


def test_records(spark):
    h = {"Content-Type": "text/html"}
    rows = [(1, "response", h, bytearray(PAGE, "utf-8"), "a"), (2, "request", h, bytearray(PAGE, "utf-8"), "a"), (3, "response", None, bytearray(PAGE, "utf-8"), "a"), (4, "response", h, None, "a"), (5, "response", h, bytearray(), "a"), (None, "response", h, bytearray(PAGE, "utf-8"), "a"), (1, "response", h, bytearray(PAGE, "utf-8"), "a"), (6, None, h, None, "a"), (7, "response", h, bytearray(PAGE * 300, "utf-8"), "a")]
    schema = "record_id long, warc_type string, headers map<string,string>, payload binary, block string"
    got = mainbody.main_body_blocks(spark.createDataFrame(rows, schema)).collect()
    assert [r["block"] for r in sorted((r for r in got if r["record_id"] == 3), key=lambda r: r["pos"])] == BLOCKS
    assert len([r for r in got if r["record_id"] == 1]) == 2 * len(BLOCKS) and {r["record_id"] for r in got} >= {1, 3} and not {2, 4, 5, 6, None} & {r["record_id"] for r in got}
    assert got[0]["block_md5"] == hashlib.md5(got[0]["block"].encode()).hexdigest()
    assert mainbody.main_body_blocks(spark.createDataFrame([], schema)).count() == 0


def optimum(sizes, capacity):
    """Fewest containers, by trying all ways."""
    best = [len(sizes)]
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_lower_bound_never_exceeds_the_optimum(sizes):
    x = np.array(sizes)
    where, n = packing.best_fit_decreasing(x, 20)
    assert packing.lower_bound(x, 20) <= optimum(sizes, 20) <= n
    assert all(x[where == b].sum() <= 20 for b in range(n))


def test_lower_bound_of_many_sizes():
    """All thresholds count, however many items there are: sizes just over half and just under, and counted sizes."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(52, 60, 4050), rng.integers(20, 40, 4050)])

    def slow(x, capacity):
        return max(int((x > capacity - e).sum()) + -(-int(x[(x >= e) & (x <= capacity - e)].sum()) // capacity) for e in [0, *np.unique(x[x <= capacity // 2])])

    assert packing.lower_bound(x, 100) >= max(slow(x, 100), 4050)
    few = np.concatenate([rng.integers(34, 48, 6000), rng.integers(60, 66, 3000)])  # beyond an eighth of the capacity
    assert packing.lower_bound(few, 100) >= slow(few, 100) > -(-int(few.sum()) // 100)
    sizes, n = np.unique(x, return_counts=True)
    assert packing.lower_bound(sizes, 100, n) == packing.lower_bound(x, 100)


def test_report_certifies(spark):
    df = spark.createDataFrame([(i, 51 if i % 2 else 200) for i in range(50)], "doc_id long, n_tokens int")
    w = spark.createDataFrame([(1, 100)], "window_id long, capacity_tokens int")
    packed = packing.pack(df, w, per_partition=10)
    r = packing.packing_report(packed, w).collect()[0]
    assert (r["n_containers"], r["dff_bound"], r["certified"]) == (75, 75, 1.0) and r["volume_bound"] < 75
    assert packed.groupBy("container").count().count() == 75


def test_bound_certifies_what_volume_does_not():
    assert packing.lower_bound(np.array([11] * 6), 20) == 6 and packing.lower_bound(np.array([7] * 6), 20) == 3


def test_packing(spark):
    rng = random.Random(4)
    sizes = [(i, rng.randrange(0, 90)) for i in range(400)] + [(1000, 230), (1001, 200), (None, 5), (7, 12)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens int")
    windows = spark.createDataFrame([(1, 100), (2, 64), (3, None), (4, 0)], "window_id long, capacity_tokens int")
    for per in (20000, 100):
        got = packing.pack(df, windows, per_partition=per).collect()
        for w, cap in ((1, 100), (2, 64)):
            rows = [r for r in got if r["window_id"] == w]
            assert sorted((r["doc_id"], r["n_tokens"]) for r in rows if r["part"] == 0 and r["doc_id"] < 1000 and r["n_tokens"] < cap) == sorted(x for x in sizes if x[0] is not None and x[0] < 1000 and x[1] < cap)
            for d, n in sizes[:402]:
                assert sum(r["n_tokens"] for r in rows if r["doc_id"] == d) == n + (12 if d == 7 else 0)
            assert all(r["part"] == 0 for r in rows if dict((d, n) for d, n in sizes if d != 7).get(r["doc_id"], 0) <= cap)
            by = {}
            for r in rows:
                by.setdefault(r["container"], []).append(r)
            assert all(sum(r["n_tokens"] for r in b) <= cap and sorted(r["position"] for r in b) == list(range(len(b))) for b in by.values())
            assert len(by) <= 1.08 * -(-sum(r["n_tokens"] for r in rows) // cap) + 2
        assert {r["window_id"] for r in got} == {1, 2}
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int"), windows).count() == 0


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "ab " * 20000, "x")], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_sizes(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 10000
