import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import html_text, media
from tests.llm import plain


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "s", 0) for i, t in enumerate(texts)], plain.TEXT)


def test_media_round_trip(spark):
    texts = [None, "", "x", "é" * 96, "a" * 192, "b" * 193, "long " * 100_000, "x"]
    stored = media.store_texts(docs(spark, texts))
    out = {r["doc_id"]: r for r in media.media_features(stored, keep=("doc_id", "text_bytes")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (out[i]["text_bytes"], out[i]["payload_bytes"], out[i]["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-16:]))
    assert out[2]["feature"] == out[7]["feature"]
    assert out[2]["media_sha256"] == out[7]["media_sha256"]
    assert media.media_features(media.store_texts(docs(spark, []))).count() == 0


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 3])
def test_every_filter_is_undone(kind, channels):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (5, 7 * channels)).astype(np.uint8)
    filtered = np.zeros((5, 1 + rows.shape[1]), np.uint8)
    filtered[:, 0] = kind
    for y in range(5):
        for i in range(rows.shape[1]):
            a = int(rows[y, i - channels]) if i >= channels else 0
            b = int(rows[y - 1, i]) if y else 0
            c = int(rows[y - 1, i - channels]) if y and i >= channels else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            filtered[y, 1 + i] = (int(rows[y, i]) - [0, a, b, (a + b) // 2, near][kind]) % 256
    assert (media.unfilter(filtered, channels) == rows).all()


def test_damage_is_found():
    png = media.write_png(np.arange(192 * 4, dtype=np.uint64).astype(np.uint8).reshape(4, 64, 3))
    assert media.read_png(png).shape == (4, 64, 3)
    for at in (0, 20, len(png) // 2, len(png) - 1):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="PNG"):
            media.read_png(bytes(bad))
    for n in (10, 40, len(png) - 1):
        with pytest.raises(ValueError, match="PNG"):
            media.read_png(png[:n])


def test_hash_is_the_cosine_transform():
    rng = np.random.default_rng(0)
    samples = rng.integers(0, 256, (32, 32, 1)).astype(np.uint8)
    x = samples[:, :, 0].astype(float)
    wave = [[sum(x[i, j] * np.cos(np.pi * u * (2 * i + 1) / 64) * np.cos(np.pi * v * (2 * j + 1) / 64) for i in range(32) for j in range(32)) for v in range(8)] for u in range(8)]
    wave = np.round(np.array(wave), 6).ravel()
    assert media.cosine_hash(samples) == np.packbits(wave > np.median(wave)).tobytes().hex()


def test_query_against_a_plain_form(spark, sf):
    """Every column: the file is put together from its definition, the payload is read back with zlib alone."""
    from lodestone.llm.queries import op7_media

    def plain_png(data: bytes) -> bytes:
        rows = [data[i : i + 192] for i in range(0, len(data), 192)]
        body = bytearray()
        for y, row in enumerate(rows):
            above = rows[y - 1] if y else bytes(192)
            forms = [row, bytes((row[i] - (row[i - 3] if i >= 3 else 0)) & 255 for i in range(192)), bytes((a - b) & 255 for a, b in zip(row, above, strict=True))]
            cost = [sum(min(b, 256 - b) for b in f) for f in forms]
            body += bytes([cost.index(min(cost))]) + forms[cost.index(min(cost))]
        chunk = lambda kind, x: len(x).to_bytes(4, "big") + kind + x + zlib.crc32(kind + x).to_bytes(4, "big")
        header = (64).to_bytes(4, "big") + len(rows).to_bytes(4, "big") + b"\x08\x02\0\0\0"
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(bytes(body), 1)) + chunk(b"IEND", b"")

    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r["text"] or "") < 3000]
    got = {r["doc_id"]: r.asDict() for r in op7_media(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        data = (r["text"] or "").encode()
        padded = data + b" " * (-len(data) % 192 or (0 if data else 192))
        file = plain_png(padded)
        mine = got[r["doc_id"]]
        assert len(mine.pop("feature")) == 16
        assert mine == {
            "doc_id": r["doc_id"],
            "n_bytes": len(data),
            "payload_bytes": len(padded),
            "payload_sha256": hashlib.sha256(padded).hexdigest(),
            "tail_crc32": zlib.crc32(padded[-16:]),
            "media_bytes": len(file),
            "media_sha256": hashlib.sha256(file).hexdigest(),
        }


def test_null_ids_and_columns_with_names_of_results(spark):
    rows = spark.createDataFrame([(None, None, "y"), (1, "", None), (1, "", "z")], "doc_id long, text string, media string")
    out = media.media_features(media.store_texts(rows)).collect()
    assert [(r["doc_id"], r["payload_bytes"]) for r in out] == [(None, 192), (1, 192), (1, 192)]
    assert media.media_features(media.store_texts(rows.where("false"))).collect() == []


# --- pages ---

PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>site</header><nav><ul><li><a href=x>menu</a></ul></nav><div class="ad">buy</div><article><h1>Head &amp; &eacute;</h1><p><b>One\n two<br><p>Three<div class="comments"><p>me too</p></div><form><p>mail</p></form></article><aside>side</aside><footer>&copy;</footer></body></html>'
PAGES = "page_id long, url string, html string"


def texts(spark, rows, **options):
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_main_text(spark.createDataFrame(rows, PAGES), keep=("page_id", "url"), **options).collect()}


def test_article(spark):
    got = texts(spark, [(1, "http://h/1", PAGE), (2, None, None), (3, "x", ""), (4, "http://h/4", "no <b>markup"), (5, "http://h/5", "<p>a</p></p><div>b<p>c</div>d &am &amp &#x41; <!-- x"), (6, "http://h/1", PAGE)])
    assert got[1] == got[6] == ("Head & é\nOne two\nThree", len("Head & é\nOne two\nThree"))
    assert got[2] == got[3] == ("", 0)
    assert got[4][0] == "no markup"
    assert got[5][0] == "a\nb\nc\nd &am & A"
    assert texts(spark, []) == {}


def test_branches_that_all_pages_of_a_host_share_go(spark):
    page = lambda n: f'<body><div id="top">Welcome to the site</div><div class="box"><p>Story {n} of its own</p><p>and more {n}</p></div><div class="legal">All rights reserved</div></body>'
    rows = [(n, "https://one.example/p", page(n)) for n in range(20)] + [(100 + n, "https://two.example/p", page(n)) for n in range(3)]
    got = texts(spark, rows)
    assert got[3][0] == "Story 3 of its own\nand more 3"
    assert got[101][0].startswith("Welcome")  # too few pages to tell


def test_copies_of_a_page_keep_their_article(spark):
    rows = [(n, "https://one.example/p", "<body><article><h1>Same</h1><p>text</p></article></body>") for n in range(30)]
    assert {t for t, _ in texts(spark, rows).values()} == {"Same\ntext"}


@pytest.mark.parametrize(
    "body, text",
    [
        ('<article><div class="entry-content"><p>one</p><section>two</section></div></article>', "one\ntwo"),
        ("<div>plain <span>words</span></div>", "plain words"),
        ("<article><p><b>bold</b><p><a href=x>link</a></article>", "bold\nlink"),
    ],
)
def test_copies_of_a_page_keep_wrapped_text(spark, body, text):
    rows = [(n, f"https://one.example/{n}", f"<body>{body}</body>") for n in range(30)]
    rows += [(100 + n, "https://two.example/p", f"<body><div id=top>Welcome</div><div id=own>Story {n % 10}</div></body>") for n in range(30)]
    got = texts(spark, rows)
    assert {got[n][0] for n in range(30)} == {text}
    assert got[103][0] == "Story 3"  # ten distinct pages are enough to tell
    few = [(n, "https://one.example/p", f"<body><div id=top>Welcome</div><div id=own>Story {n % 7}</div></body>") for n in range(30)]
    assert texts(spark, few)[0][0] == "Welcome\nStory 0"  # seven are not


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="content-sidebar-wrap"><main><article><p>text</p></article></main></div>', "text"),
        ('<main class="has-sidebar"><p>text</p></main>', "text"),
        ('<article class="post share-enabled"><p>text</p></article>', "text"),
        ('<div class="sidebar">side<div><article class="share"><p>text</p></article></div></div>', "text"),
        ('<div class="no-sidebar">text</div><div class="sidebar">side</div>', "text"),
        ('<article><p>text</p><div class="comments"><article><p>me too</p></article></div></article>', "text"),
        ('<nav><article>menu</article></nav><main><p>text</p><div id="Share">share</div></main>', "text"),
    ],
)
def test_names_do_not_remove_articles(spark, page, text):
    assert texts(spark, [(1, "http://h/1", f"<body>{page}</body>")])[1][0] == text


def test_importance(spark):
    rows = [(n, "https://h/p", f"<body><div id=a>same</div><div id=b>own {n}</div></body>") for n in range(10)]
    tree = html_text.style_tree(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r["pages"], round(r["presentation"], 6), round(r["content"], 6)) for r in tree) == sorted([(10, 0.0, 0.0), (10, 0.0, 0.0), (10, 0.0, 1.0)])


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p>text <span class="ad">BUY NOW</span> more</p>', "text more"),
        ("<article><p>a <button>B</button> b <select><option>x<option>y</select> c <label>l</label> d</p></article>", "a b c d"),
        ('<article><p>a <a class="share" href=x>share</a> b</p></article>', "a b"),
        ('<p data-id="share">one</p><p title="see id=menu">two</p><p data-related-id="related-1">three</p>', "one\ntwo\nthree"),
        ('<p class="notice-period">one</p><p class="cookie-notice">two</p><div id="share_buttons">three</div><p class="head ad">four', "one"),
        ('<p>The story is long.</p><p>It goes on.</p><article class="teaser">Teaser</article>', "The story is long.\nIt goes on.\nTeaser"),
        ("<div>aside</div><article>A story of its own</article>", "A story of its own"),
        ("<p>long text beside it</p><main>x</main>", "x"),
        ('<div role="navigation">menu</div><p>x<svg><text>y</text></svg>z</p><noscript>n</noscript>', "xz"),
        ("<p>a &lt;b&gt; &am<b></b>p; < c <3", "a <b> &amp; < c <3"),
        ('<p>x<a href="y>z</a>', "xz"),
        ("<p>x<script>if (a</script >y<style>z", "xy"),
        ("<table><tr><td>1<td>2<tr><td><table><tr><td>in</table>3</table>", "1\n2\nin\n3"),
    ],
)
def test_what_is_noise(page, text):
    assert html_text.main_text(page, frozenset(), html_text.Paths()) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # reader comments go, articles too
        ('<main><article>S</article><section id="comments"><article>reader</article></section></main>', "S"),
        ('<main><article>S</article><article class="comment">reader</article></main>', "S"),
        ('<article>S<ol><li><article class="comment-body"><p>reader</p></article></li></ol></article>', "S"),
        ('<article>S<div class="comment-thread"><p>reader</p></div></article>', "S"),
        ('<article>S</article><div class="post-comments"><article><p>reader</p></article></div>', "S"),
        ('<div><p>S</p></div><ul class="top-nav-items"><li>x</li></ul><ol class="commentlist"><li>y</li></ol><div class="related-posts"><p>z</p></div>', "S"),
        ('<article class="post comments-open">S</article>', "S"),
        # text of the article stays
        ('<article><p id="share">The share price rose.</p></article>', "The share price rose."),
        ('<div><p id="share">The share price rose.</p></div>', "The share price rose."),
        ('<article><h2 id="comments">Comments in C</h2><p>T</p></article>', "Comments in C\nT"),
        ('<div><h2 id="comments">Comments in C</h2><p>T</p></div>', "Comments in C\nT"),
        ('<article><p class="notice">N</p></article>', "N"),
        ('<article><p>the <a class="related">linked phrase</a> stays</p></article>', "the linked phrase stays"),
        ('<article><p>S</p><form><label>name</label></form><div><label>x</label></div></article>', "S"),
        # a teaser that is longer than the story
        (f"<article>{'teaser ' * 23}</article><div><p>{'story ' * 16}</p></div>", f"{('teaser ' * 23).strip()}\n{('story ' * 16).strip()}"),
        ("<article><p>S</p></article><div>loose words beside it</div>", "S"),
        # what is noise in an article still goes
        ('<article><p>S</p><div class="ad">x</div><ul class="share-buttons"><li>y</li></ul><span class="advert">z</span></article>', "S"),
    ],
)
def test_names_both_ways(page, text):
    assert html_text.main_text(page, frozenset(), html_text.Paths()) == text


@pytest.mark.parametrize("part", ['<a "', '<a x="', "<a x='\"", "<", "<div>", "<p>w &lt; ", "<a ", "</", "<!--", "</p>", "<div></p>", '<p class="x y">'])
def test_broken_pages_take_linear_time(part):
    seconds = []
    for n in (2_000, 40_000):
        began = time.perf_counter()
        html_text.main_text(part * n, frozenset(), html_text.Paths())
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 60 * seconds[0] + 0.5


def test_deep_pages_keep_their_text():
    assert html_text.main_text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", frozenset(), html_text.Paths()) == "deep\nafter"


def plain_tree(pages):
    """{path: smoothed importance} of pages given as trees: (name, children), where a child may be a text."""
    shown, held = defaultdict(list), defaultdict(lambda: defaultdict(int))

    def walk(node, path, seen, below):
        own = (*path, node[0])
        seen[own].add(tuple(c[0] for c in node[1] if not isinstance(c, str)))
        texts = set()
        for c in node[1]:
            texts |= {c} if isinstance(c, str) else walk(c, own, seen, below)
        below[own] |= texts
        return texts

    for page in pages:
        seen, below = defaultdict(set), defaultdict(set)
        walk(page, (), seen, below)
        for path in seen:
            shown[path].append(frozenset(seen[path]))
            for t in below[path]:
                held[path][t] += 1
    out = {}
    for path, all_shown in shown.items():
        m = len(all_shown)
        if m == 1:
            presentation, content = 1.0, 1.0 if held[path] else 0.0
        else:
            presentation = -sum(k / m * math.log(k / m, m) for k in Counter(all_shown).values())
            content = 1 - sum(math.log(k, m) for k in held[path].values()) / len(held[path]) if held[path] else 0.0
        out[path] = (m * max(presentation, content) + 25) / (m + 25)
    return out


def test_pages_of_random_trees(spark):
    """The whole operator against the definition of importance over known trees."""
    rng = random.Random(5)

    def tree(name, depth):
        children = []
        for c in rng.sample("abcd", rng.randrange(1, 4)):
            if depth and rng.random() < 0.7:
                children.append(tree(f"div.{c}", depth - 1))
            elif not children or not isinstance(children[-1], str):  # texts side by side would be one block
                children.append(f"text of {name}{c} {rng.choice(['same', rng.randrange(10**6)])}")
        return (name, children)

    def shown(node):
        return node if isinstance(node, str) else f"<div class={node[0][4:]}>{''.join(map(shown, node[1]))}</div>"

    def kept(node, path, importance):
        own = (*path, node[0])
        if importance[own] < 0.75:
            return []
        return [t for c in node[1] for t in ([c] if isinstance(c, str) else kept(c, own, importance))]

    pages = [("div.top", [("div.head", ["Welcome"]), tree("div.body", 2), ("div.tail", ["All rights reserved", ("div.a", ["same"])])]) for _ in range(40)]
    rows = [(n, "https://h/p", f"<body>{shown(p)}</body>") for n, p in enumerate(pages)]
    importance = plain_tree(pages)
    got = texts(spark, rows)
    assert [got[n][0].split("\n") for n in range(40)] == [kept(p, (), importance) for p in pages]
    assert sum(v < 0.75 for v in importance.values()) >= 3


def test_the_tree_decides_without_names(spark):
    """Noise in tags that say nothing, drawn from a few texts, goes by its importance alone; stories stay."""
    rng = random.Random(3)
    noise = [f"Offer {k} of the day" for k in range(20)]
    rows = [(n, "https://h/p", f"<body><div><p>{rng.choice(noise)}</p></div><section><p>Story {n}</p><p>goes on {n}</p></section><div id=x>{rng.choice(noise)}</div></body>") for n in range(600)]
    got = texts(spark, rows, names=False)
    assert all(got[n][0] == f"Story {n}\ngoes on {n}" for n in range(600))


def test_columns_with_names_of_results(spark):
    rows = spark.createDataFrame([(1, None, "<p>a</p>", "old", "x")], "page_id long, url string, html string, text string, n_chars string")
    assert [r.asDict() for r in html_text.extract_main_text(rows).collect()] == [{"page_id": 1, "url": None, "html": "<p>a</p>", "text": "a", "n_chars": 1}]


def test_a_long_page(spark):
    body = "<p>word &lt; " * 60_000
    got = texts(spark, [(1, "http://h/1", f"<article>{body}</article>")])
    assert got[1][0].count("\n") == 59_999
