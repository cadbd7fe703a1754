import random

from pyspark.sql import functions as F

from lodestone.llm import htmldiff as hd

SCHEMA = "page_id bigint, url string, html string"


def brute_keep(a, b):
    """The same walk over a full table."""
    keep = [True] * len(a)
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        keep[lead] = False
        lead += 1
    x, y = a[lead:], b[lead:]
    common = set(x) & set(y)
    at = [i for i, v in enumerate(x) if v in common]
    x, y = [x[i] for i in at], [v for v in y if v in common]
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            keep[lead + at[i]] = False
            i, j = i + 1, j + 1
        elif t[i][j + 1] == t[i][j]:
            j += 1
        else:
            i += 1
    return keep


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_against_a_full_table():
    rng = random.Random(7)
    for _ in range(400):
        size = rng.choice([2, 4, 30])
        a, b = ([rng.randrange(size) for _ in range(rng.randrange(40))] for _ in range(2))
        keep = hd.lcs_keep(a, b)
        assert keep == brute_keep(a, b)
        assert keep.count(False) == lcs(a, b)


def test_alignment_of_long_pages_is_quick_and_small():
    rng = random.Random(1)
    a = [rng.randrange(4000) for _ in range(12_000)]
    b = [x for x in a if rng.random() < 0.7]
    assert hd.lcs_keep(a, b).count(False) == len(b)


def test_lines():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script><nav><ul><li><a href="/x">One</a></li>
    <li>Two</li></ul></nav><!-- <p>no</p> --><p>A <b>bold</b>&amp;amp;  text<br>next<p>3 < 4 &eacute;</body>"""
    assert hd.text_lines(page) == ["One", "Two", "A bold&amp; text", "next", "3 < 4 é"]
    assert hd.text_lines("") == [] and hd.text_lines("<p></p>") == [] and hd.text_lines("<script>x") == []


def test_urls(spark):
    rows = ["http://H.example/a/b/?q=1#f", "https://u@h.example:80/", "http://h.example", "mailto:x", "", None, "https://h.example/a.html?x/y"]
    host, path = hd.url_parts(F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "u string").select(host, path).collect()]
    assert got == [("h.example", "/a/b"), ("h.example", ""), ("h.example", ""), (None, ""), (None, ""), (None, None), ("h.example", "/a.html")]


def shared(a, b):
    n = 0
    x, y = a.split("/"), b.split("/")
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) and a[m] == b[m]:
        m += 1
    return n, m


def partners(rows):
    out = {}
    keyed = sorted((h, p, i) for i, h, p in rows)
    for at, (h, p, i) in enumerate(keyed):
        near = [keyed[j] for j in (at - 1, at + 1) if 0 <= j < len(keyed) and keyed[j][0] == h]
        if near:
            out[i] = max(near, key=lambda k: (shared(p, k[1]), -keyed.index(k)))[2]
    return out


def test_nearest_pages_against_a_sorted_list(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a.org", "b.org", "hot.org"] + ["hot.org"] * 5), "/".join(["", *(rng.choice(["x", "xy", "news", "é"]) for _ in range(rng.randrange(4)))])) for i in range(300)]
    rows.append((900, "alone.org", "/x"))
    keys = spark.createDataFrame([(i, i, h, p) for i, h, p in rows], "page_id bigint, mark bigint, host string, path string")
    got = {r.page_id: r.partner for r in hd.nearest_pages(keys).collect()}
    assert got == partners(rows) and 900 not in got


TEMPLATE = "<body><nav><li>Home<li>News</nav>{}<footer>Imprint</footer></body>"


def test_templates_go_and_own_lines_stay(spark):
    rows = [(1, "http://h.org/news/1", TEMPLATE.format("<p>first story")), (2, "http://h.org/news/2", TEMPLATE.format("<p>second story<p>more")), (3, "http://other.org/x", TEMPLATE.format("<p>alone"))]
    got = {r.page_id: (r.partner_id, r.n_lines, r.n_kept, r.text) for r in hd.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (2, 4, 1, "first story"), 2: (1, 5, 2, "second story\nmore"), 3: (None, 4, 4, "Home\nNews\nalone\nImprint")}


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (2, "nonsense", "<p>a"), (3, "http://h.org/a", None), (4, "http://h.org/b", ""), (5, "http://h.org/c", "<p>x"), (5, "http://h.org/c", "<p>x"), (None, "http://h.org/d", "<p>y"), (6, "http://t.org/a", "<p>same"), (7, "http://t.org/a", "<p>same"), (8, "http://l.org/", "<p>w" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit(1)).withColumn("lines", F.lit(2)).withColumn("mark", F.lit("m"))
    out = [r.asDict() for r in hd.extract(df).collect()]
    got = {r["page_id"]: r for r in out}
    assert len(out) == len(rows)
    assert got[1]["text"] == "a" and got[2]["text"] == "a" and got[1]["partner_id"] is None
    assert got[3]["text"] is None and got[3]["n_lines"] is None and got[4]["text"] == "" and got[4]["n_lines"] == 0
    assert got[5]["text"] == "x" and got[None]["text"] == "y" and got[None]["partner_id"] is None
    assert (got[6]["partner_id"], got[7]["partner_id"], got[6]["text"], got[7]["text"]) == (7, 6, "", "")
    assert got[8]["n_kept"] == 50_000
    assert hd.extract(df.limit(0)).count() == 0


def test_a_page_is_not_compared_with_its_other_addresses_or_copies(spark):
    page = lambda story, ad: TEMPLATE.format(f"<p>{story}<p>{ad}")
    rows = [(1, "http://h.org/news/1?a", page("story", "ad one")), (2, "http://h.org/news/1#b", page("story", "ad two")), (3, "http://h.org/news/9", page("other", "ad three")), (4, "http://h.org/news/8", page("story", "ad one"))]
    got = {r.page_id: (r.partner_id, r.text) for r in hd.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (3, "story\nad one"), 2: (3, "story\nad two"), 3: (1, "other\nad three"), 4: (3, "story\nad one")}


def test_text_is_kept_where_tags_are_left_open():
    body = "<p>one</p><p>two</p>"
    for head in ("<head><title>t</title><meta charset=x><body>", "<head><title>t</title></head><body>", "<head><script>document.write('<div>no</div>')</script>", "<title>t</title>", "<svg/>", "<svg width=1 />", "<noscript>", "<template>", "<svg><path>", "<title>"):
        assert hd.text_lines(f"<html>{head}{body}")[-2:] == ["one", "two"], head
    assert hd.text_lines(f"<svg><title>no</title><text>no</text></svg><noscript>no</noscript>{body}") == ["one", "two"]
    assert hd.text_lines(f"{body}<!-- no") == hd.text_lines(f"{body}<script>no") == hd.text_lines(f"{body}<style>no") == ["one", "two"]
    assert hd.text_lines(f"<!-->no-->{body}<SCRIPT>no</SCRIPT ><p>three") == ["one", "two", "three"]


def test_unclosed_tags_take_linear_time():
    import time

    for page in ("<svg>" * 200_000, "<svg " * 200_000, "<!--" * 200_000, "<p>" * 300_000, "<title>" * 150_000, "<script" * 150_000, "<svg/><noscript>" * 60_000, "<" * 1_000_000, "<div " * 200_000):
        began = time.process_time()
        hd.text_lines(page)
        assert time.process_time() - began < 5, page[:9]
