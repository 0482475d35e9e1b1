import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import ogg, templates


def plain_checksum(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_checksum(data):
    assert ogg.checksum(data) == plain_checksum(data)


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 2000), st.integers(0, 255))
def test_payload_comes_back(n, b):
    payload = bytes((b + i * i) % 256 for i in range(64 * n))
    media = ogg.store(payload)
    found = ogg.features(media)
    assert found["payload"] == payload
    assert f"seconds={len(payload) / ogg.RATE:.6f}" in found["feature"]
    times = [g for s, _, _, g, _, _ in ogg.pages_of(media) if not s & 1 and g > 0]
    assert times == sorted(times) and times[-1] == len(payload)


def test_packets_over_pages():
    """Packets of whole multiples of 255 bytes, and ones longer than a page."""
    stream = ogg._Stream(9)
    sizes = [0, 1, 254, 255, 510, 70_000, 3, 65_025, 200_000]
    packets = [(bytes([i]) * n, i + 1) for i, n in enumerate(sizes)]
    media = b"".join(stream.pages(packets, True))
    assert [p for p, _, _ in ogg.packets_of(media)[9]] == [p for p, _ in packets]
    pages = list(ogg.pages_of(media))
    assert any(g == -1 for *_, g, _, _ in pages) and pages[-1][2] & ogg.LAST


def test_damage_is_seen():
    media = ogg.store(b"abc" * 64)
    for at in (5, 30, 60, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            ogg.features(bytes(bad))
    with pytest.raises((ValueError, struct.error)):
        ogg.features(media[:-10])
    pages = [m for m in media.split(b"OggS")]
    with pytest.raises(ValueError):
        ogg.packets_of(b"OggS".join(pages[:3] + pages[4:]))


def test_query_of_media(docs, no_docs, rows):
    found = ogg.described(ogg.stored(docs)).collect()
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == sorted(want)
    by_payload = {}
    for r in found:
        by_payload.setdefault((r.n_bytes, r.payload_sha256), set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_payload.values())
    assert ogg.described(ogg.stored(no_docs)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="menu">
<header><h1>Site</h1></header><nav><ul><li><a href="x">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article id=a1><header><h1>Head &amp; more</h1></header><p>One <b>bold<br>two&nbsp;three
 four</b><p>Five &lt;6&gt; &#233;<span class="ad">BUY</span><ul><li>x<li>y</ul><aside>no</aside>
<table><tr><td>c1<td>c2</table><form><p>mail</p></form><script>1<2</script><div class="comments"><p>reader</p></div>last <!-- c --> line</article>
<div role="complementary">side</div><footer>&copy; foot</footer></body></html>"""


def test_article():
    assert templates.Page(PAGE).text(set()) == "Head & more\nOne bold two three four\nFive <6> é\nx\ny\nc1\nc2\nlast line"


@pytest.mark.parametrize("source", ["", "<", "<p", "a < b", "<p>x", "</p></div>", "<script>x", "<a href='", "<!-- x", '<p title="a>b">q</p>', "<p a='>", "<" * 3000, "<div>" * 500 + "x", "&amp", "<b><p>1</b>2"])
def test_any_source_gives_a_text(source):
    page = templates.Page(source)
    assert isinstance(page.text(page.subtrees()), str)


@pytest.mark.parametrize("source, text", [
    ("<main class='no-sidebar'><p>Whole</p></main>", "Whole"),
    ("<div id='page' class='has-sidebar'><article><p>Whole</p></article></div>", "Whole"),
    ("<article class='post comments-open'><p>Whole</p></article>", "Whole"),
    ("<div class='sidebar'><article class='widget'><p>Whole</p></article></div>", "Whole"),
    ("<main><div class='widget'><article>The long text of it</article></div>bit</main>", "The long text of it"),
    ("<form id=f><article><p>Whole</p></article></form>", "Whole"),
    ("<article><p>Own</p></article><div class='comments'><article>A long word of a reader</article></div>", "Own"),
    ("<p>Body</p><aside><article>other</article></aside>", "Body"),
    ("<article><svg width=1/><p>a</p><math/><p>b</p></article>", "a\nb"),
    ("<article><iframe src=x><p>a</p><noscript><p>b</p><select><option>c</article>", "a\nb\nc"),
    ("<article><select><p>a</p><select><option>no</select><p>b</p></article><iframe></iframe>", "a\nb"),
    ("<article><p>a</p><svg><text>no</text></svg><SCRIPT>İ</p>no</SCRIPT><p>b</p></article>", "a\nb"),
    ("<article><p>a</p><div class='cookie-notice'>no</div><div class='ad'>no</div></article>", "a"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>", "so x=2 holds"),
    ("<article><h2 id='comments'>Comments on the act</h2><section id='social-science'>text</section></article>", "Comments on the act\ntext"),
])
def test_the_list_never_takes_the_article(source, text):
    assert templates.Page(source).text(set()) == text


def test_query_of_pages(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"http://a.example/{i}", f"<body><div><b>Site line</b> slogan</div><div>Story {i} of many</div><div>Visits: 9</div></body>"))
    rows += [(100 + i, f"http://b.example/{i}", f"<article><p>Same copy</p><div>Read on</div><p>own {i}</p></article>") for i in range(30)]
    rows += [(200, None, None), (201, "x", ""), (None, "http://a.example/9", "<p>free text"), (100, "http://b.example/0", "<article><p>Same copy</p></article>")]
    pages = spark.createDataFrame([(*r, "x", 2) for r in rows], "page_id bigint, url string, html string, host string, subtrees int")
    found = templates.main_text(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert all(texts[i] == f"Story {i} of many" for i in range(40))  # what recurs on the host is gone
    assert all(texts[100 + i] == f"Same copy\nown {i}" for i in range(1, 30))  # in an article paragraphs stay
    assert texts[200] == texts[201] == "" and texts[None] == "free text"
    assert templates.main_text(pages.limit(0)).count() == 0


def test_copies_have_one_vote_and_inline_elements_stay(spark):
    copy = "<article><section><h1>Head</h1><div><p>One <b>bold</b></p></div></section></article>"
    rows = [(i, "http://a.example/x", copy) for i in range(40)] + [(100 + i, "http://a.example/y", f"<article><p>Other {i}</p></article>") for i in range(20)]
    rows += [(200 + i, "http://b.example/x", f"<article><p><strong>Note</strong> of {i} <code>x</code></p><div>Share</div></article>") for i in range(20)]
    rows += [(300 + i, "http://c.example/x", "<p>Long paragraph</p><div>and its end</div>") for i in range(20)]
    rows += [(400 + i, "http://d.example/x", f"<article><p>Page {i}</p>{'<div>Section line</div>' if i < 30 else ''}</article>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for sent in (100_000, 0):  # lists sent, and looked up by a join
        found = {r.page_id: r.text for r in templates.main_text(pages, enough=25, sent=sent).collect()}
        assert len(found) == len(rows)
        assert all(found[i] == "Head\nOne bold" for i in range(40))  # copies of an article are no template
        assert all(found[200 + i] == f"Note of {i} x" for i in range(20))  # no word is cut out of its sentence
        assert all(found[300 + i] == "Long paragraph\nand its end" for i in range(20))  # nor are copies without an article
        assert all(found[400 + i] == f"Page {i}" for i in range(300))  # a tenth of the host, but often enough
    found = {r.page_id: r.text for r in templates.main_text(pages).collect()}
    assert found[400] == "Page 0\nSection line"


def plain_subtrees(source: str) -> set[str]:
    """The subtrees of well-formed markup outside an article, read by Python's own parser, as tag and texts."""
    from html.parser import HTMLParser

    import xxhash

    found, stack = set(), [["#", [], False]]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append([tag, [], stack[-1][2] or tag == "article"])

        def handle_data(self, data):
            if data.strip():
                stack[-1][1].append(" ".join(data.split()))

        def handle_endtag(self, tag):
            _, parts, inside = stack.pop()
            if parts:
                digest = xxhash.xxh64_intdigest(f"{tag}|{' '.join(parts)}")
                if tag in templates.BLOCKS and not inside:
                    found.add(digest - 2**64 if digest >> 63 else digest)
                stack[-1][1].append(f"<{digest:x}>")

    Reader().feed(source)
    return found


def test_templates_are_those_of_a_plain_recount(spark):
    """Subtrees counted by host in plain Python, for hosts of every size."""
    r = random.Random(6)
    pages, plain = [], {}
    for host in range(14):
        n = [1, 2, 3, 4, 6, 8, 9, 20, 40, 60, 61, 80, 30, 5][host]
        menu = [f"<div><ul><li><a href='{i}'>Go {host}.{i}</a></li></ul></div>" for i in range(6)]
        for i in range(n):
            blocks = [m for j, m in enumerate(menu) if r.random() < [1, 0.9, 0.5, 0.25, 0.15, 0.05][j]]
            source = f"<body>{''.join(blocks)}<article><p>Story {host} {i // 2}</p><div>note</div></article><div>{i}</div></body>"
            pages.append((len(pages), f"http://h{host}.example/{i}", source))
            plain.setdefault(f"h{host}.example", {}).setdefault(i // 2, set()).update(plain_subtrees(source))
    want = set()
    for host, contents in plain.items():
        n = len(contents)
        for h in set().union(*contents.values()):
            count = sum(h in own for own in contents.values())
            if count >= 3 and (count >= max(0.2 * n, min(n, 8)) or count >= 25):
                want.add((host, h))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    noted = {(r.host, r.subtree) for r in templates.templates(df, enough=25).collect()}
    inside = noted - want  # the note inside the articles, on each host with enough contents
    assert want <= noted and len(want) > 20 and {host for host, _ in inside} == {h for h, c in plain.items() if len(c) >= 3} and len(inside) == len({h for h, _ in inside})


def test_hosts_without_article_lose_what_recurs(spark):
    """No element has a telling name or class; small hosts count too; a list of links inside an article is a template."""
    rows = []
    for n, host in ((3, "small"), (12, "middle"), (60, "large")):
        for i in range(n):
            rows.append((len(rows), f"https://{host}.example/{i}", f"<div class=x1><ul><li><a href=/>Start</a><li><a href=/b>Shop</a></ul></div><div class=x2>We keep your settings</div><div class=x3><h1>Title {host} {i}</h1><p>Words {i} of it</p></div><div class=x4>© {host}</div>"))
    for i in range(12):
        rows.append((len(rows), f"https://inside.example/{i}", f"<article><ul><li><a href=/>Next</a><li><a href=/b>Last</a></ul><p>Same line</p><ul><li>Point</ul><p>Own {i}</p></article>"))
    found = {r.page_id: r.text for r in templates.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    at = 0
    for n, host in ((3, "small"), (12, "middle"), (60, "large")):
        assert [found[at + i] for i in range(n)] == [f"Title {host} {i}\nWords {i} of it" for i in range(n)]
        at += n
    assert [found[at + i] for i in range(12)] == [f"Same line\nPoint\nOwn {i}" for i in range(12)]
