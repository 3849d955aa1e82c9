"""Packing against the whole tokenizer, media as exact round trips, extraction on written pages."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from loomspan.llm import html, media, packing

WORDS = ["the", "Straße", "don't", "x²y", "naïve-ish", "日本語", "a1b2", "<|endoftext|>", "é", "...", "O'Neil", "10,000", " ", "İstanbul", "ﬁne", "ça", "'s", "😀", "Á"]


def _texts():
    r = random.Random(4)
    return [None, "", " \n\t", "a" * 5000] + [r.choice([" ", "\n", "  ", "\t"]).join(r.choice(WORDS) for _ in range(r.choice([1, 3, 30, 400]))) for _ in range(60)] + ["word and " * 9000]


def test_pieces_equal_the_whole_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(3, texts[3], 9)], "doc_id long, text string, length int")
    got = packing.pieces(docs, length=512).collect()
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted({tuple(r) for r in got if r["doc_id"] == i})
        assert [r[3] for r in own] == [len(ids[k : k + 512]) for k in range(0, len(ids), 512)]
        assert [r[4] for r in own] == [zlib.crc32(struct.pack(f"<{len(ids[k : k + 512])}I", *ids[k : k + 512])) for k in range(0, len(ids), 512)]
        assert [r[2] for r in own] == list(range(0, len(ids), 512))
    assert len([r for r in got if r["doc_id"] == 3]) == 2 * len({tuple(r) for r in got if r["doc_id"] == 3})


def _places_are_gapless(rows, length):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_packing_places(spark, small):
    rows = packing.op7_packing(spark, small).collect()
    bins = _places_are_gapless(rows, 2048)
    assert bins <= -(-sum(r["length"] for r in rows) // 2048) + 1
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(empty)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_local_search_against_brute_force(seed):
    r = np.random.default_rng(seed)
    size = r.integers(1, 11, 9)
    bins = packing.local_search(size, packing.best_fit(size, 10), 10)
    assert sorted(i for b in bins for i in b) == list(range(9))
    assert all(size[b].sum() <= 10 for b in bins)
    assert len(bins) <= len(packing.best_fit(size, 10))

    def least(k, fills):
        if k == len(size):
            return len(fills)
        best = least(k + 1, [*fills, size[k]])
        for i, f in enumerate(fills):
            if f + size[k] <= 10:
                best = min(best, least(k + 1, [*fills[:i], f + size[k], *fills[i + 1 :]]))
        return best

    assert len(bins) <= least(0, []) + 1


def test_media_round_trip(spark):
    texts = _texts()
    rows = media.text_media(spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, media binary")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = bytes(r["media"])
        assert media.decode(stored).tobytes() == payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert bytes(r["tile"])[:6] == b"\x93NUMPY"


def test_area_resize_against_brute_force():
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (7, 10)).astype(np.uint8)
    fine = np.repeat(np.repeat(image.astype(float), 4, axis=0), 3, axis=1)  # 28 x 30 divides into 4 x 3
    assert np.allclose(media.area_resize(image, 4, 3), fine.reshape(4, 7, 3, 10).mean(axis=(1, 3)))


def test_images():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert np.array_equal(media.decode(media.encode_bmp(grey)), grey)
    assert np.array_equal(media.decode(b"P5 # made\n7 5\n255\n" + grey.tobytes()), grey)
    assert media.decode(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu, first.</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them.</p></div>
<article><h1>A &amp; B</h1><p>First   line,\nwith <b>bold</b>&nbsp;text&#33;</p><p>Second one &lt;kept&gt;.</p><ul><li>One item<li>Two items</ul>
<script>var x = "<p>no</p>";</script><aside>Related</aside></article><section id="comments"><p>Nice article, thanks a lot.</p></section><footer>Foot, 2020.</footer>"""


def test_extraction(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (2, "v", None, "t"), (3, None, "", "t"), (4, "w", "<nav>x</nav>", "t"), (1, "u", PAGE, "t"), (5, "x", "<p>" * 3000 + "Deep text, here.", "t")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.extract_pages(rows).collect()), key=lambda r: (r[0], r[2]))
    want = "A & B\nFirst line, with bold text!\nSecond one <kept>.\nOne item\nTwo items"
    assert got[0] == got[1] == (1, "u", want, len(want))
    assert got[2:5] == [(2, "v", "", 0), (3, None, "", 0), (4, "w", "", 0)]
    assert got[5] == (5, "x", "Deep text, here.", 16)


BODY = "<p>The river rose in the night, and by noon the bridge was gone. Nobody was hurt, said the mayor.</p>" * 3


@pytest.mark.parametrize(
    "start",
    [
        '<body class="single-post has-sidebar"><div>', '<body><main class="content no-sidebar">', '<body class="menu-open"><div>', '<body><div class="elementor-widget-text-editor">',
        '<body class=menu><div>', '<body><div class="widget"><div>', '<body><div title="a hidden cause" data-id="menu">', "<body><div alt=x'y>",
    ],
)
def test_wrappers_keep_their_article(start):
    text = html.extract(f'<html>{start}{BODY}<div class="ad">Buy now, buy here.</div><div class="nav-bar">Home, news, more.</div></body></html>')
    assert text.count("The river rose") == 3 and "Buy now" not in text and "Home" not in text


def test_quotes_count_only_where_a_value_begins():
    assert html.extract("<p><a title=Bob's>Hello</a> don't go, it's late.</p>") == "Hello don't go, it's late."
    assert html.extract("<p title='a>b' lang=\"c>d\" x = 'e>f'>One, two.</p>") == "One, two."
    assert html.extract('<p x=a="b>One, two.</p><p>"Three", four.</p>') == 'One, two.\n"Three", four.'
    assert html.extract("<p" + " a='" * 2000 + ">Deep, text.</p>").endswith("Deep, text.")


LINE = "It rained, and the road to the mill was closed for a day."


def test_ratios_decide_inside_an_article():
    page = f"""<body><article><h1>The flood</h1>{BODY}<blockquote><p>We saw it come.</p></blockquote><p>{LINE}</p>
    <ul><li>One boat<li>Two carts<li>Ten sheep</ul><ul class=x><li><a href=/1>Another story, here.</a><li><a href=/2>One more story.</a></ul>
    <div class="related"><div class=card><span>Old mill</span></div><div class=card><span>New road</span></div></div>
    <div class="content side-note"><p>{LINE} {LINE}</p></div><div class="comments"><p>{LINE} {LINE}</p></div></article><p>Short.</p></body>"""
    text = html.extract(page)
    assert text.split("\n")[0] == "The flood" and text.count("The river rose") == 3
    assert all(x in text for x in ("We saw it come.", "One boat\nTwo carts\nTen sheep", f"{LINE} {LINE}"))
    assert not any(x in text for x in ("Another story", "Old mill", "New road", "Short."))
    assert text.count(LINE) == 3  # the side note is text, the comment is none


def test_names_only_weigh():
    long = " ".join([LINE] * 6)
    assert html.extract(f'<div class="content side-note"><p>{long}</p></div><div class="tags">red, blue</div>') == long
    assert html.extract(f'<article><p>Two words, no more.</p></article><div class="ad"><p>{long}</p></div>') == "Two words, no more."


@pytest.mark.parametrize("page", ["<a " * 350_000, "<" + "a" * 1_000_000, "<div>" * 60_000 + "Deep, text.", "<b>" * 60_000 + "<li></li>" * 60_000, "<p a='" * 100_000, "<!--" * 200_000, "</x>" * 200_000 + "<script>" * 50_000])
def test_markup_of_a_megabyte_takes_seconds(page):
    import time

    began = time.time()
    html.extract(page)
    assert time.time() - began < 12


def _random_page(r, depth=0):
    """(tag, class, children or text) as nested tuples, without tags that close each other."""
    if depth > 3 or r.random() < 0.45:
        return r.choice(["div", "section", "h2", "pre"]), r.choice(["", "", "ad", "related", "note-x"]), " ".join(r.choice(["word", "a,", "longer.", "x!", "&amp;"]) for _ in range(r.choice([1, 2, 8, 40])))
    return r.choice(["div", "section", "article", "nav", "main"]), r.choice(["", "", "", "side", "comments"]), [_random_page(r, depth + 1) for _ in range(r.randrange(1, 5))]


def _plain_extract(tree):
    """The score of each path by the definition, with paths as strings, over the tree itself."""
    found, containers = [], []

    def walk(node, path, apart, article, named):
        tag, name, inside = node
        word = name.replace("-", "")
        if word in html.NAMED_APART | html.NAMED_BESIDE and tag not in html.NEVER_NAMED:
            containers.append(html.APART_BY_NAME if word in html.NAMED_APART else html.BESIDE)
            named = [*named, len(containers) - 1]
        path, apart, article = f"{path}/{tag}", apart or tag == "nav", article or tag in ("article", "main")
        if isinstance(inside, str):
            if not apart:
                found.append((path, article, named, inside.replace("&amp;", "&")))
        else:
            for child in inside:
                walk(child, path, apart, article, named)

    walk(tree, "", False, False, [])
    if not found:
        return ""
    some = any(a for _, a, _, _ in found)
    inside = [x for x in found if x[1] or not some]
    share = {k: sum(len(t) for _, _, n, t in inside if k in n) / sum(len(t) for *_, t in inside) for k in range(len(containers))}
    keys = []
    for path, article, named, _ in found:
        own = [containers[k] for k in named if share[k] <= (0.5 if containers[k] == html.BESIDE else 0.9)]
        keys.append((path, min([1.0, *own]) * (html.ARTICLE if article else html.OUTSIDE if some else 1.0)))
    mean = lambda k, f: sum(f(t) for (*_, t), x in zip(found, keys, strict=True) if x == k) / keys.count(k)
    n = [mean(k, len) for k in keys]
    d = [mean(k, lambda t: sum(c in ".,;:!?" for c in t)) for k in keys]
    near = lambda v, i: sum(v[max(0, i - 1) : i + 2]) / len(v[max(0, i - 1) : i + 2])
    fused = [(near(n, i) * (1 + near(d, i))) ** 0.5 for i in range(len(found))]
    level = 0.25 * sum(fused) / len(fused)
    score = {k: k[1] * sum(f for f, x in zip(fused, keys, strict=True) if x == k) / keys.count(k) for k in keys}
    return "\n".join(t for (*_, t), k in zip(found, keys, strict=True) if score[k] >= level)


def test_scores_equal_the_definition_on_random_pages():
    r = random.Random(11)
    write = lambda node: f'<{node[0]} class="{node[1]}">{node[2] if isinstance(node[2], str) else "".join(map(write, node[2]))}</{node[0]}>'
    dropped = 0
    for _ in range(400):
        tree = _random_page(r)
        page = write(tree)
        assert html.extract(page) == _plain_extract(tree)
        dropped += len(html.blocks(page)[0]) - html.extract(page).count("\n") - 1
    assert dropped > 300


def test_parts_of_names_tell_of_comments_and_adverts():
    """Readers' comments and adverts under longer names go, also without an article; names of a state say nothing."""
    prose = "<p>" + "The first long sentence, of some words, tells what it is. " * 8 + "</p>"
    said = "<p>I agree, this is so. Very nice, thanks a lot.</p>"
    for name in ("post-comments", "comments_list", "user-responses", "ad-slot", "page-footer-banner"):
        for frame in ("<article>{}</article>", "<div id=x>{}</div>"):
            page = "<body class='single has-sidebar'>" + frame.format(f"<div class='content no-sidebar menu-open'>{prose * 3}</div><div class='{name}'>{said}</div>") + "</body>"
            text = html.extract(page)
            assert text.count("The first long sentence") == 24 and "agree" not in text, (name, frame)


def test_names_count_however_deep_they_stand():
    """The name of the innermost of 60 named containers, and 20,000 nested ones in a time in proportion."""
    import time

    prose = "<p>" + "The first long sentence, of some words, tells what it is. " * 8 + "</p>"
    page = "<div class=share>" * 0 + "<main>" + prose * 3 + "<div class=tags>" * 60 + "<div class=comments><p>I agree, this is so, thanks.</p></div>" + "</div>" * 60 + "</main>"
    assert "agree" not in html.extract(page)
    began = time.time()
    html.extract("<div class=tags><p>a b.</p>" * 20_000)
    assert time.time() - began < 20
