"""Training-data operators on pages: brute force, SQL and odd inputs."""

import hashlib
import io

import pytest

from tripleframe.llm import html_text, queries, url_filter, warc

SCHEMA = "page_id long, url string, html string"


def page(body, k=0):
    return f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{x:1}}</style><script>var t='</p><p>no</p>';</script></head><body>{body}</body></html>"


def texts(spark, rows):
    return {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_main_text_of_one_template(spark):
    nav = "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>More</a></li></ul></nav>"
    rows = []
    for k in range(12):
        body = f"<header>Site name</header>{nav}<div class='ad'>Buy {k} now</div><div id='cookie-notice'>We use cookies</div><article><h1>Title {k}</h1><p>First&nbsp;&amp; <b>bold\n text</b> {k}.<br>next</p><p>Second {k}<ul><li>item one</li><li>item two</li></ul><form>Name <input></form><div class='comments'><p>Nice post {k}</p></div></article><aside>Side {k}</aside><footer>&copy; host</footer>"
        rows.append((k, "http://h.example.com/x", page(body, k)))
    got = texts(spark, rows)
    assert got[3]["text"] == "Title 3\nFirst & bold text 3. next\nSecond 3\nitem one\nitem two"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_main_text_of_plain_divisions(spark):
    rows = []
    for k in range(10):
        body = f"<div class='top'><a href='/'>Home</a> <a href='/x'>About us</a></div><div class='c1'><div class='c2'><p>Story number {k} has its own words w{k} v{k} u{k}.</p><p>And more of them, t{k} s{k}.</p></div><div class='c3'>All rights reserved by the owner</div></div>"
        rows.append((k, "http://plain.example.org/", page(body, k)))
    got = texts(spark, rows)
    assert got[4]["text"] == "Story number 4 has its own words w4 v4 u4.\nAnd more of them, t4 s4."


def test_main_text_with_an_own_header_and_side_parts(spark):
    rows = []
    for k in range(3):
        body = f"<header><h2>Site</h2></header><main><article><header class='post-header'><h1>Own title {k}</h1></header><p>Body of story {k} goes on.</p><section id='readerComments'><p>I agree {k}</p></section><ol class='commentlist'><li>Me too</li></ol></article><div class='SponsoredBox'>Buy</div></main><div role='complementary'>Side</div>"
        rows.append((k, f"http://one{k}.example.com/", page(body, k)))
    assert texts(spark, rows)[1]["text"] == "Own title 1\nBody of story 1 goes on."


def test_main_text_takes_slots_between_ordered_tokens(spark):
    rows = []
    for k in range(20):
        parts = [f"<p class='a'>Lead of {k}.</p>Send this to friends", f"<p class='b'>Rest {k} of it.</p>Words {k} of an end"]
        rows.append((k, "http://fixed.example.com/", page(f"<div class='box'>{''.join(parts)}</div>", k)))
        rows.append((100 + k, "http://moving.example.com/", page(f"<div class='box'>{''.join(parts[:: 1 if k % 2 else -1])}</div>", k)))
    got = texts(spark, rows)
    assert got[3]["text"] == "Lead of 3.\nRest 3 of it.\nWords 3 of an end"
    assert got[103]["text"] == "Lead of 3.\nSend this to friends\nRest 3 of it.\nWords 3 of an end"


def test_classes_break_where_tokens_change_places():
    def ranks(body):
        return html_text.ranks(html_text.parse(body)[1], dict(classes))

    first, second = "<div class=x><h1>t</h1></div>", "<div class=y></div>"
    classes = html_text.classes_of([(p, 2, 7) for p, start in html_text.parse(first + second)[1] if start])
    assert len({number for _, number in classes}) == 1
    one, two = ranks(first + second), ranks(second + first)
    valid = dict(html_text.in_order(classes, {p: (min(one[p], two[p]), max(one[p], two[p])) for p in one}))
    assert valid["#/div.x"] == valid["#/div.x/h1"] != valid["#"] and valid["#/div.y"] not in (valid["#"], valid["#/div.x"])
    assert html_text.in_order(classes, {p: (k, k) for p, k in one.items()}) == classes
    assert ranks(first + second + first)["#/div.y"] == -1


@pytest.mark.parametrize("pages", [100, 101, 250])
def test_main_text_under_ids_of_single_pages(spark, pages):
    rows = [(k, "http://ids.example.com/", page(f"<div class=top><h1>Title {k}</h1></div><div id=post-{k}><p>Body of page {k}, w{k}.</p></div>", k)) for k in range(pages)]
    got = texts(spark, rows)
    assert all(got[k]["text"] == f"Title {k}\nBody of page {k}, w{k}." for k in range(pages))


def test_main_text_of_hosts_full_of_copies(spark):
    rows = [(k, "http://copies.example.com/", page(f"<div class='note'>All rights reserved</div><div class='body'><p>Article {k % 20} has words w{k % 20}.</p></div><div class='date'>Day {k}</div>", k % 20)) for k in range(1000)]
    got = texts(spark, rows)
    assert got[45]["text"] == "Article 5 has words w5.\nDay 45"
    same = [(k, "http://same.example.com/", page("<div class='body'><p>The one article.</p></div>")) for k in range(30)]
    other = [(50 + k, "http://same.example.com/", page(f"<div class='body'><p>Other article {k}.</p></div>")) for k in range(3)]
    assert texts(spark, same + other)[4]["text"] == "The one article."


def test_main_text_of_many_class_words_and_deep_pages(spark):
    side = "<div class='col-12 col-md-3 order-2 d-none sidebar'><p>Side {k} words</p></div>"
    long = f"<div class='{' '.join(f'u{i}' for i in range(500))} sidebar'><p>Far side</p></div>"
    deep = "<article><h1>Title</h1>" + "<div>" * 250 + "<p>Deep text</p>" + "</div>" * 250 + "<p>After it</p></article>"
    rows = [(k, "http://deep.example.com/", page(f"<article><h1>Title {k}</h1><p>Story {k} of many words.</p>{side.format(k=k)}{long}</article>", k)) for k in range(3)]
    rows.append((9, "http://nested.example.com/", page(deep + "<footer>End</footer>")))
    got = texts(spark, rows)
    assert got[1]["text"] == "Title 1\nStory 1 of many words."
    assert got[9]["text"] == "Title\nDeep text\nAfter it"
    assert dict(html_text.parse("<div>" * 250 + "</div>" * 250 + "<p>x</p>")[1][-3:-1]) == {"#/p": False}



def test_main_text_with_telling_class_words(spark):
    bodies = {
        1: ("<body class='post has-sidebar no-comments'><article class='breaking-alert'><h1>A</h1><p>One of it</p></article><div class='sidebar-left'>Side</div>", "A\nOne of it"),
        2: ("<article><h1 class='page-header-title'>B</h1><section class='related-work'><p>Earlier work</p></section><div class='advertising-history'>Ads of old</div><div class='commentary'>We think</div></article>", "B\nEarlier work\nAds of old\nWe think"),
        3: ("<main class='with-sidebar'><p>Text</p><div class='commentList'>Me too</div><div id='related'>More</div><ul class='share-buttons'><li>Tell</li></ul></main><div class='footer-blue'>End</div>", "Text"),
        4: ("<article><p>Then <math><mi>e</mi><mo>=</mo><mn>2.718</mn><semantics><annotation>e=2.718</annotation></semantics></math> holds.</p></article><article class='comment'><p>Nice</p></article>", "Then e=2.718 holds."),
    }
    got = texts(spark, [(k, f"http://words{k}.example.com/", page(b, k)) for k, (b, _) in bodies.items()])
    assert {k: got[k]["text"] for k in bodies} == {k: want for k, (_, want) in bodies.items()}


@pytest.mark.parametrize("pages", [1, 2, 4, 5, 60])
def test_main_text_at_every_host_size(spark, pages):
    families = {
        "div": "<div class='bar'><a href=/>Home</a></div><div class='c1'><h2>Title {k}</h2><p>Story {k} has w{k} words of its own here.</p></div>",
        "table": "<table><tr><td><a href=/>Home</a> <a href=/b>Next</a></td></tr><tr><td><p>Title {k}</p><p>Story {k} has w{k} words of its own here.</p></td></tr></table>",
        "semantic": "<header>Site</header><main><h2>Title {k}</h2><p>Story {k} has w{k} words of its own here.</p></main><footer>End</footer>",
    }
    rows = [(1000 * n + k, f"http://{name}.example.com/", page(body.format(k=k), k)) for n, (name, body) in enumerate(families.items()) for k in range(pages)]
    got = texts(spark, rows)
    assert all(got[i]["text"] == f"Title {i % 1000}\nStory {i % 1000} has w{i % 1000} words of its own here." for i, _, _ in rows)


def test_main_text_odd_inputs(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a/", "plain words only"), (4, "http://a/", page("<article><p>cut &amp")[:-20]), (5, "http://a/", "<article><p>5 &lt; 6 <!-- gone --> ok"), (5, "http://a/", "<article><p>5 &lt; 6 <!-- gone --> ok"), (None, "http://a/", "<p>id</p>"), (7, "http://a/", "<p>" + "long " * 200_000 + "</p>"), (8, "http://a/", "<div " * 50 + "<p>x")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as main", "'x' as text", "3 as constant")
    out = html_text.main_text(frame).collect()
    got = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows)
    assert got[1] == got[2] == "" and got[3] == "plain words only" and got[5] == "5 < 6 ok" and got[None] == "id"
    assert got[7] == ("long " * 200_000).strip()
    assert html_text.main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_text_of_the_test_pages(spark):
    import re
    from html import unescape

    got = {r["page_id"]: r["text"] for r in queries.op1_html_text(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


# --- WARC


def test_records_round_trip(spark):
    html = ["a" * 99, "b" * 100, None, "", "b" * 100, "a" * 99, "é" * 60, "b" * 100, "\r\n\r\nWARC/1.1\r\n" * 20]
    rows = [(10 - k, f"http://x/{k}\n", h) for k, h in enumerate(html)] + [(None, None, "b" * 100), (3, "again", "b" * 100)]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as digest", "2 as n", "'x' as payload", "'y' as again")
    path = warc.archive(pages)
    got = sorted(map(tuple, warc.digests(spark, path).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 else i
        again = len(data) >= 100 and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    stored = {r["record_id"]: bytes(r["payload"]) for r in warc.read(spark, path).where("warc_type = 'response'").collect()}
    assert stored["<urn:page:2>"] == html[8].encode() and stored["<urn:page:4>"] == html[6].encode()
    assert warc.digests(spark, warc.archive(spark.createDataFrame([], SCHEMA))).count() == 0


def test_predicates_reach_the_reader(spark):
    path = warc.archive(spark.createDataFrame([(k, f"http://h{k % 2}/{k}", f"page {k} " * 30) for k in range(10)], SCHEMA))
    only = warc.read(spark, path, payload=False).where("target_uri like 'http://h1/%'")
    assert only.count() == 5 and only.where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), StringStartsWith(("target_uri",), "http://h1"), GreaterThan(("offset",), 3)]))
    assert left == [GreaterThan(("offset",), 3)]
    assert not reader.keep({"warc-type": "response", "warc-target-uri": "http://h1/"}) and reader.keep({"warc-type": "revisit", "warc-target-uri": "http://h1/2"})


def test_unwanted_payloads_are_not_read():
    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            got = super().read(n)
            self.total += len(got)
            return got

    import random

    noise = random.Random(1).randbytes(3_000_000)
    row = {"warc_type": "response", "record_id": "<a>", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_length": len(noise), "payload": noise}
    data = warc.member(warc.record(row)) + warc.member(warc.record(row | {"record_id": "<b>", "payload": b"x", "payload_length": 1}))
    for keep, payloads in ((lambda h: h["warc-record-id"] == "<b>", True), (lambda h: True, False)):
        f = Counting(data)
        assert [h["warc-record-id"] for _, h, _ in warc.gzip_records(f, keep, payloads)][-1] == "<b>"
        assert f.total < 200_000
    import gzip

    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    plain = io.BytesIO(gzip.decompress(data))
    assert [len(p) for _, _, p in warc.parse_records(plain, lambda h: True, True)] == [len(noise), 1]


def test_archives_of_others(spark, tmp_path):
    import gzip

    def foreign(number, extra=b""):
        body = b"HTTP/1.1 200 OK\r\n\r\npage %d" % number
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:%d>\r\n%sContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (number, extra, len(body)) + body + b"\r\n\r\n"

    (tmp_path / "deep").mkdir()
    (tmp_path / "a.warc").write_bytes(foreign(1) + foreign(2, b"WARC-Target-URI: http://h/\r\n folded\r\nX-Odd: caf\xe9\r\n"))
    (tmp_path / "deep" / "b.warc.gz").write_bytes(gzip.compress(foreign(3)) + gzip.compress(foreign(4)))
    (tmp_path / ".hidden.warc").write_bytes(b"no record")
    (tmp_path / "notes.txt").write_bytes(b"no record")
    got = {r["record_id"]: (bytes(r["payload"]), r["target_uri"]) for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<urn:x:{k}>": (b"page %d" % k, "http://h/ folded" if k == 2 else None) for k in (1, 2, 3, 4)}
    assert warc.read(spark, f"file://{tmp_path}/a.warc").count() == 2


# --- URL filter

RULES = queries.URL_RULES


def python_rule(url):
    after = url.split("://", 1)[1] if url and "://" in url else None
    if after is None:
        return "", "", None, None
    import re

    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_rules_and_parts(spark):
    urls = ["http://EXAMPLE.com/en/7x", "https://a.example.com/en/8", "http://xcom/en/", "http://com/en/1", "http://b.net/de/", "http://c.example.net/de/80?x", "ftp://o.org/es/#f", "http://h?q=/en/", "http://h#/x", "no scheme", None, "", "a://b://c/d", "http://É.com/en/?", "://x/y", "http://example.com/EN/7"]
    rows = [(k, u, None) for k, u in enumerate([*urls, urls[0]])]
    out = url_filter.judge(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as host", "2 as score", "3 as bucket"), RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, rule, verdict = python_rule(rows[r["page_id"]][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_trees_learn_held_out_urls(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(4, 9)))
    good = [f"http://{word()}.example.com/{word()}/{word()}" for _ in range(300)]
    bad = [f"http://{word()}-{word()}.example.biz/{rng.randint(10**8, 10**9)}?a={rng.randint(1, 99)}&b=2&c=3" for _ in range(300)]
    rows = [(u, 0) for u in good[:200]] + [(u, 1) for u in bad[:200]]
    labelled = spark.createDataFrame(rows, "url string, blocked int")
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(good[200:] + bad[200:])], SCHEMA)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, [], labelled).collect()}
    assert sum((got[k] == "block") == (k >= 100) for k in got) >= 195
    one_kind = labelled.where("blocked = 1")
    assert {r["verdict"] for r in url_filter.judge(pages, [], one_kind).collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judge(pages, []).collect()} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], SCHEMA), RULES).count() == 0


def test_entropy_feature(spark):
    import math
    from collections import Counter

    hosts = ["aab.com", "x", "abcabc.example.org"]
    frame = spark.createDataFrame([(f"http://{h}/p/q?a=1&b", h, "/p/q") for h in hosts], "url string, host string, path string")
    for r in url_filter.features(frame).collect():
        n = Counter(r["host"])
        entropy = -sum(c / len(r["host"]) * math.log2(c / len(r["host"])) for c in n.values())
        assert r["entropy"] == min(15, int(entropy / 0.3 + 1e-9)) and r["depth"] == 2 and r["params"] == 2


@pytest.mark.parametrize("name", ["op6_warc", "op7_url_filter"])
def test_queries_run_on_small_tables(spark, name):
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
