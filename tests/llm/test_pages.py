import random

import numpy as np
from conftest import prose

from locarium.llm import html_extract


def test_blocks_decode_collapse_and_zone():
    page = '<html><head><title>T</title></head><body><nav><a>m</a></nav><article class="post"><h1>A&amp;B &#233;</h1><p><b>one<br>two<p>three  \n four&nbsp;x<div class="share">no</div><script>var t="</p>"</script></article><section id="comments"><p>c</p></section><footer>f'
    texts, zones = html_extract.blocks(page)
    assert [t for t, z in zip(texts, zones, strict=True) if z == html_extract.CONTENT] == ["A&B é", "one two", "three four x"]
    assert {t for t, z in zip(texts, zones, strict=True) if z == html_extract.CHROME} == {"m", "no", "c", "f"}
    assert html_extract.blocks(None) == ([], []) and html_extract.blocks("<p") == ([], [])


def test_unclosed_items_end_with_their_list_or_sibling():
    many = "".join(f"<li><a href='/{i}'>m{i}</a>" for i in range(1000))
    rows = "".join(f"<tr><td>a{i}<td>b{i}" for i in range(400))
    page = f'<body><nav><ul>{many}</ul></nav><nav><table>{rows}</table></nav><article><p>the story</p><ul><li class="ad">buy<li>one<li>two<ul><li>deep</ul></ul></article>'
    texts, zones = html_extract.blocks(page)
    assert [t for t, z in zip(texts, zones, strict=True) if z == html_extract.CONTENT] == ["the story", "one", "two", "deep"]
    deep = "<nav>" + "<div>" * 5000 + "m</nav><p>story</p>" + "</b></section>" * 5000
    assert html_extract.blocks(deep)[0] == ["m", "story"] and html_extract.blocks(deep)[1] == [html_extract.CHROME, html_extract.OPEN]


def test_recurring_runs_against_all_windows():
    rng = np.random.default_rng(8)
    for run in (1, 3, 8):
        streams = [rng.integers(0, 4, rng.integers(0, 40)).tolist() for _ in range(6)]
        again, _ = html_extract.recurring(streams, run)
        windows = {}
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                windows.setdefault(tuple(s[i : i + run]), set()).add(p)
        want = []
        for s in streams:
            mark = [False] * len(s)
            for i in range(len(s) - run + 1):
                if len(windows[tuple(s[i : i + run])]) > 1:
                    mark[i : i + run] = [True] * run
            want += mark
        assert again.tolist() == want


def test_copies_of_a_page_keep_their_text():
    o, c = html_extract.OPEN, html_extract.CONTENT
    own, notice = prose(1, 30), prose(2, 14)
    assert html_extract.host_texts([([own], [o])] * 2) == [own] * 2
    assert html_extract.host_texts([([notice, own], [o, o])] * 2 + [([notice, prose(3, 30)], [o, o])]) == [own, own, prose(3, 30)]
    articles = [([prose(10, 40)], [c])] * 20 + [([prose(20 + i, 40)], [c]) for i in range(10)]
    assert html_extract.host_texts(articles) == [t[0] for t, _ in articles]


def test_pages_without_article_lose_what_recurs(spark):
    notice = prose(500, 14)
    bare = [(i, f"http://h.example/{i}", f"<body><div>{notice}</div><p>{prose(i, 30)}</p></body>") for i in range(30)]
    full = [(100 + i, f"http://h.example/a{i}", f'<body><div class="ad">{notice}</div><article><h1>t{i}</h1><p>{prose(900, 20)}</p><p>{prose(i + 50, 20)}</p></article></body>') for i in range(3)]
    odd = [(200, None, None), (201, "no url", ""), (201, "no url", "")]
    df = spark.createDataFrame(bare + full + odd, "page_id long, url string, html string").repartition(4)
    got = {r["id"]: r for r in html_extract.extract(df).collect()}
    assert all(got[i]["text"] == prose(i, 30) for i, _, _ in bare)
    assert all(got[100 + i]["text"] == f"t{i}\n\n{prose(900, 20)}\n\n{prose(i + 50, 20)}" for i in range(3))
    assert got[200]["text"] == "" and got[201]["n_chars"] == 0
    assert html_extract.extract(df).count() == len(bare + full + odd) and html_extract.extract(df.limit(0)).count() == 0


def test_recurring_runs_leave_a_block_and_unique_ones_stay(spark):
    """Over more pages than a chunk holds: a block on two pages alone, runs inside blocks, and content that pages share."""
    rng = random.Random(3)
    notice, passage, rare = prose(700, 12), prose(701, 40), prose(702, 20)
    rows, want = [], {}
    for i in range(150):
        own, more = prose(1000 + i, 30), prose(2000 + i, 25)
        said = [own, f"{more} {notice}"] + ([rare] if i in (3, 147) else [])
        rows.append((i, f"http://big.example/{i}", "<body>" + "".join(f"<div>{t}</div>" for t in said) + "<nav>m</nav></body>"))
        want[i] = f"{own}\n\n{more}"
    for i in range(40):
        own = prose(3000 + i, 30)
        shared = passage if i % 2 else prose(4000 + i, 40)
        rows.append((200 + i, f"http://art.example/{i}", f"<article><p>{own}</p><p>{shared}</p><p>{notice} {prose(5000 + i, 20)}</p></article><p>aside {rng.random()}</p>"))
        want[200 + i] = f"{own}\n\n{shared}\n\n{prose(5000 + i, 20)}"
    # the same text on one host alone recurs nowhere
    rows.append((300, "http://other.example/", f"<p>{rare}</p>"))
    want[300] = rare
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    for chunk in (html_extract.CHUNK, 60_000):
        got = {r["id"]: r["text"] for r in html_extract.extract(df, chunk=chunk).collect()}
        assert got == want


def test_very_long_html_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "http://l.example/", f"<article><p>{long}</p></article>", "a", [1]), (2, "http://l.example/", "<p>" + "<b>" * 3000 + "x y", "b", None), (None, None, "<article>&lt;p&gt; &#x41;</article>", None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, texts array<int>")
    got = {r["id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == {1: long, 2: "x y", None: "<p> A"}


def test_unique_words_stay_beside_what_recurs():
    o, c = html_extract.OPEN, html_extract.CONTENT
    shared = prose(800, 12)
    assert html_extract.host_texts([([f"{shared} {prose(810 + i, 10)}"], [o]) for i in range(5)]) == [prose(810 + i, 10) for i in range(5)]
    quoted = prose(820, 15)
    assert html_extract.host_texts([([f"{quoted} {prose(821, 10)}"], [o]), ([f"{prose(822, 40)} {quoted}"], [o])]) == [prose(821, 10), prose(822, 40)]
    # a notice within articles goes on hosts of any size, as soon as it surely stands on most pages
    for n in (5, 19, 20, 30):
        assert html_extract.host_texts([([prose(900 + i, 30), f"{prose(950 + i, 20)} {shared}"], [c, c]) for i in range(n)]) == [f"{prose(900 + i, 30)}\n\n{prose(950 + i, 20)}" for i in range(n)]
    few = [([f"{prose(900 + i, 30)} {shared}"], [c]) for i in range(3)]
    assert html_extract.host_texts(few) == [t[0] for t, _ in few]


def test_names_of_chrome_as_wholes():
    for name in ("ad", "cookie-notice", "site-footer", "adSlot", "share_buttons", "nav-menu-2", "post-comments"):
        assert html_extract.blocks(f'<article><div class="x {name}">gone</div><p>text</p></article>')[1] == [html_extract.CHROME, html_extract.CONTENT], name
    for name in ("social-history", "search-theory", "notice-board-article", "adverb", "shared"):
        assert html_extract.blocks(f'<article><div class="{name}">stays</div></article>')[1] == [html_extract.CONTENT], name


def test_chunks_change_nothing(spark):
    """Runs inside blocks that only pages of different chunks share, and runs of content on about the share that counts as most pages."""
    rng = random.Random(11)
    rare, often, seldom, pages = prose(700, 12), prose(710, 15), prose(720, 15), []
    for i in range(90):
        own = f"{prose(1000 + i, 12)} {rare if i in (3, 77) else prose(7000 + i, 9)} {prose(2000 + i, 12)}"
        more = [f"{prose(3000 + i, 20)} {often}"] * (rng.random() < 0.75) + [f"{seldom} {prose(4000 + i, 20)}"] * (rng.random() < 0.6)
        pages.append((i, "http://a.example/", "".join(f"<p>{t}</p>" for t in (own, prose(5000 + i // 2, 9)))))
        pages.append((100 + i, "http://b.example/", "<article>" + "".join(f"<p>{t}</p>" for t in [own, *more]) + "</article>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = {}
    for host in "ab":
        mine = [p for p in pages if host + ".ex" in p[1]]
        want |= dict(zip([p[0] for p in mine], html_extract.host_texts([html_extract.blocks(p[2]) for p in mine]), strict=True))
    assert rare not in want[3] and rare in want[103] and not any(often in t for t in want.values())
    for chunk in (html_extract.CHUNK, 6000):
        assert {r["id"]: r["text"] for r in html_extract.extract(df, chunk=chunk).collect()} == want
