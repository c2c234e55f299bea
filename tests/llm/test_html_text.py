from collections import Counter

import numpy as np
import pytest

from spindrift.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav>
<!-- c --><div class="ad">Buy</div><article><h1>Head &amp; more</h1><p><b>Bold<br>line<p>Second&nbsp;one <a href="x">link</a>.<aside>side</aside><form>f<input></form>
<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div class="share-bar">Tweet</div><section id="comments"><p>first!</p></section><pre>x
  y</pre><p>3 &lt; 4 &#233; &#x1F600;</article><div id="sidebar">more</div><footer>&copy; me</footer></body></html>"""


def text(page):
    found = H.blocks(page)
    return [t for t, z in found if z == max(z for _, z in found) and z != H.CHROME]


def test_blocks():
    assert text(PAGE) == ["Head & more", "Bold line", "Second one link.", "one", "two", "a", "b", "x y", "3 < 4 é 😀"]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []), ("<article>a", ["a"]), ("<article><p>a<script>x", ["a"]), ("<article><p>a <b c</article>", ["a"]), ("<main>a</main><article>b</article>", ["b"]), ("<main>a</main>c", ["a"]), ('<div class="header">h</div><div id="content">t<div class="post-comments">c</div></div>f', ["t"]),
        ('<article><p class="notice">n</p><p hidden>h</p>t</article>', ["t"]), ('<article class="comment">c</article><article>t</article>', ["t"]), ("<article>a<!-- x", ["a"]),
        ("<ARTICLE><P>A</P></ARTICLE>", ["A"]), ('<div role="main">m<nav>n</nav></div>', ["m"]), ("<article></div>a</span>b</article>c", ["ab"]),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def test_repeats_on_distinct_pages():
    words = "a b c d e f g h i".split()
    streams = [words, ["x", *words, "y"], ["a"] * 40]
    codes, page = [], []
    number = {}
    for k, s in enumerate(streams):
        codes += [number.setdefault(w, len(number)) for w in s] + [-1]
        page += [k] * (len(s) + 1)
    got = H.repeated_windows(np.array(codes), np.array(page), 8)
    want = [False] * len(codes)
    flat = [tuple(codes[i : i + 8]) for i in range(len(codes))]
    for i, w in enumerate(flat):
        want[i] = len(w) == 8 and -1 not in w and len({page[j] for j, v in enumerate(flat) if v == w}) > 1
    assert got.tolist() == want


def test_pages_without_article_lose_repeats(spark):
    menu = "<div>home news sport weather travel culture science more about us</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<div>unique text of page number {i} and some more words {i * 7}</div></body>") for i in range(12)]
    rows += [(99, None, None), (98, "http://h.example/x", ""), (97, "http://other.example/", f"<body>{menu}<p>alone</p></body>"), (97, "http://other.example/", f"<body>{menu}<p>alone</p></body>")]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, text string, host int")
    got = H.extract_main_text(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(by[i].text == f"unique text of page number {i} and some more words {i * 7}" and by[i].n_chars == len(by[i].text) for i in range(12))
    assert by[99].text == "" and by[98].text == ""
    assert by[97].text.endswith("alone") and "home" in by[97].text  # copies are one page, and nothing else is on its host
    small = {r.page_id: r.text for r in H.extract_main_text(pages, shard_bytes=10).collect()}
    assert set(small) == set(by)
    assert H.extract_main_text(pages.limit(0)).count() == 0


def test_article_survives_copies(spark):
    page = "<body><nav>menu of many words that repeat on each page here</nav><article><p>the same long article text that is copied on every page of the site</p></article></body>"
    pages = spark.createDataFrame([(i, f"https://u:p@H.example:80/{i}", page) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_main_text(pages).collect()} == {"the same long article text that is copied on every page of the site"}


def test_repeats_between_shards(spark):
    notice = "<div>this notice of ten words stands on two far pages</div>"
    page = lambda i, more="": f"<body><div>{' '.join(f'w{i}x{k}' for k in range(30))}</div>{more}</body>"
    rows = [(i, f"http://h.example/{i}", page(i, notice if i in (3, 17) else "")) for i in range(40)]
    rows += [(50 + i, f"http://h.example/c{i}", page(99)) for i in range(6)]  # copies of one page, in several shards
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, cut = ({r.page_id: r for r in H.extract_main_text(pages, shard_bytes=n).collect()} for n in (H.SHARD_BYTES, 10))
    assert whole == cut and "notice" not in cut[3].text + cut[17].text and cut[3].n_boilerplate == 10
    assert all(cut[50 + i].text == " ".join(f"w99x{k}" for k in range(30)) for i in range(6))


def test_shards_of_many_groups(spark):
    words = np.random.default_rng(1).integers(0, 10, (60, 60))
    shared = [" ".join(f"s{i % 7}x{k}" for k in range(12)) for i in range(60)]
    pages = spark.createDataFrame([(i, "http://h.example/", f"<div>{' '.join(f'w{k}' for k in own)}</div><div>{shared[i]}</div>") for i, own in enumerate(words.tolist())], "page_id long, url string, html string")
    whole, cut = ({r.page_id: r for r in H.extract_main_text(pages, shard_bytes=n).collect()} for n in (H.SHARD_BYTES, 100))
    assert cut == whole and all(r.n_boilerplate >= 12 for r in whole.values())


def test_blocks_keep_their_unique_words(spark):
    notice = "this shared notice has ten words that stand on each"
    own = [" ".join(f"w{i}x{k}" for k in range(n)) for i, n in enumerate((8, 12))]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<body><div>{notice} {own[i]}</div></body>") for i in range(2)], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_boilerplate) for r in H.extract_main_text(pages).collect()} == {i: (own[i], 10) for i in range(2)}


def test_repeats_decide_inside_and_outside_marked_zones(spark):
    notice = "<p>this shared notice has ten words that stand on each</p>"
    words = lambda i, name, n: " ".join(f"{name}{i}x{k}" for k in range(n))
    page = lambda i: f"<body><nav>{words(i, 'n', 9)}</nav><article>{words(i, 'a', 30)}{notice}</article><div class=post-content>{words(i, 'b', 20)}</div>{notice}<div>{words(i, 'c', 9)}</div></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(2)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_boilerplate) for r in H.extract_main_text(pages).collect()}
    assert got == {i: ("\n".join([words(i, "a", 30), words(i, "b", 20), words(i, "c", 9)]), 20) for i in range(2)}


def test_copied_article_stays_on_distinct_pages(spark):
    article = " ".join(f"w{k}" for k in range(40))
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", f"<article>{article} last{i}</article>") for i in range(2)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_main_text(pages).collect()} == {i: f"{article} last{i}" for i in range(2)}


def brute(pages):
    """The whole operator by plain loops over one list of (page_id, host, html)."""
    parsed = [(i, host, [(text.split(), zone) for text, zone in H.blocks(html)]) for i, host, html in pages]
    streams = [tuple(w for words, _ in own for w in words) for _, _, own in parsed]
    seen = {}
    for (_, host, _), s in zip(parsed, streams):
        for k in range(len(s) - 7):
            seen.setdefault((host, s[k : k + 8]), set()).add(s)
    out = {}
    for (i, host, own), s in zip(parsed, streams):
        covered = [False] * len(s)
        for k in range(len(s) - 7):
            if len(seen[host, s[k : k + 8]]) > 1:
                covered[k : k + 8] = [True] * 8
        zone = [z for words, z in own for _ in words]
        block = [b for b, (words, _) in enumerate(own) for _ in words]

        def run(k, *keys):
            lo = hi = k
            while lo and all(x[lo - 1] == x[k] for x in keys):
                lo -= 1
            while hi + 1 < len(s) and all(x[hi + 1] == x[k] for x in keys):
                hi += 1
            return hi - lo + 1

        cut = [covered[k] and (run(k, covered, block) >= 8 or run(k, covered, block) == block.count(block[k])) for k in range(len(s))]
        top = max(zone, default=0)
        marked = [z == top for z in zone]
        if top > H.OTHER and 2 * sum(x and y for x, y in zip(cut, marked)) >= sum(marked):
            cut = [x and not y for x, y in zip(cut, marked)]
        keep = [zone[k] > H.CHROME and not cut[k] and (marked[k] or (not covered[k] and run(k, covered, zone) >= 8)) for k in range(len(s))]
        texts = [" ".join(w for w, b, y in zip(s, block, keep) if b == n and y) for n in range(len(own))]
        out[i] = ("\n".join(t for t in texts if t), sum(x and not y for x, y in zip(covered, keep)))
    return out


def test_operator_equals_brute_force(spark):
    """Hosts of unlike size, notices of many lengths inside and outside marked zones, at three sizes of shards."""
    rng = np.random.default_rng(6)
    words = lambda n, top=400: " ".join(f"w{k}" for k in rng.integers(0, top, n))
    shared = [words(int(n)) for n in rng.integers(3, 30, 12)]
    tags = ["<p>{}</p>", "<div>{}</div>", "<nav>{}</nav>", "<article>{}</article>", "<div class=content><p>{}</p></div>", "<footer>{}</footer>", "{}"]
    pages = []
    for i in range(90):
        parts = [tags[rng.integers(len(tags))].format(shared[rng.integers(len(shared))] if rng.random() < 0.4 else words(int(rng.integers(1, 40)))) for _ in range(int(rng.integers(0, 9)))]
        pages.append((i, "big" if i % 3 else f"h{i % 4}", "<body>" + " ".join(parts) + "</body>"))
    pages += [(100 + k, "big", pages[1][2]) for k in range(3)]
    df = spark.createDataFrame([(i, f"https://{host}/{i}", html) for i, host, html in pages], "page_id long, url string, html string").repartition(4)
    want = brute(pages)
    for size in (H.SHARD_BYTES, 2000, 50):
        assert {r.page_id: (r.text, r.n_boilerplate) for r in H.extract_main_text(df, shard_bytes=size).collect()} == want


def test_array_alone_finds_the_text(spark):
    """Without the marks of articles and content boxes: the suffix array still leaves the text and drops the rest."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect()
    unmarked = [(r.page_id, r.url, (r.html or "").replace("<article", "<section").replace("</article", "</section")) for r in rows]
    schema = "page_id long, url string, html string"
    plain = {r.page_id: r.text.split() for r in H.extract_main_text(spark.createDataFrame(unmarked, schema)).collect()}
    full = {r.page_id: r.text.split() for r in H.extract_main_text(spark.createDataFrame(rows, schema)).collect()}
    same = sum((Counter(plain[k]) & Counter(full[k])).total() for k in full)
    assert same / sum(map(len, plain.values())) > 0.9 and same / sum(map(len, full.values())) > 0.9


def test_odd_pages(spark):
    """A very long page, null ids and urls, repeated rows: every row has its row."""
    long = "<body><p>" + " ".join(f"w{k}" for k in range(200_000)) + "</p></body>"
    rows = [(1, "http://a/", long), (None, "http://a/", long), (None, None, "<p>x</p>"), (None, None, "<p>x</p>"), (2, "http://a/2", "<p>" * 5000 + "deep"), (3, "not a url", "<<<>>> & &amp; &#x41; <unclosed"), (4, None, "\x00<b>\x01</b>")]
    got = H.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and [r.n_chars for r in got if r.page_id == 1] == [r.n_chars for r in got if r.page_id is None and r.url] == [len(long) - 20]
