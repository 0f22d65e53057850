import gzip
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from shelfsort.llm import html_text as T  # noqa: E402
from shelfsort.llm import token_counts as C  # noqa: E402
from shelfsort.llm import toxicity as X  # noqa: E402
from shelfsort.llm import warc as W  # noqa: E402

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now</div>
<article><header>By somebody</header><h1>The   title</h1><p><b>First line &amp; more&amp;&amp; of it.<br><p>Second&nbsp;<i>para</i>graph
 goes on.</p><div class="ad">Ad inside</div><form><input><button>Send</button></form><aside>See also</aside>
<ul><li>item one<li>item two</ul><table><tr><td>x</td><td>y</td></tr></table><p>Last &am</p>
<section id="comments"><p>I do not agree at all with this article, it says nothing that was not said before.</p></section></article>
<div class="sidebar"><p>Popular now</p></div><footer>&copy; host &middot; words of the footer that go on and on.</footer></body></html>"""
WANT = "The title\nFirst line & more&& of it.\nSecond paragraph goes on.\nitem one\nitem two\nx\ny\nLast &am"


def test_main_text_of_a_page():
    assert T.main_text(PAGE) == WANT
    assert T.main_text(PAGE.replace("</body></html>", "").replace("</footer>", "")) == WANT


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("plain words only", "plain words only"), ("<p>a", "a"), ("<p>a<p>b", "a\nb"), ("<nav>only menu</nav>", ""),
    ("<script>x</script>", ""), ("<!-- open <p>a", ""), ("<p>a &lt;b&gt; &#233; &eacute &bogus;</p>", "a <b> é é &bogus;"),
    ("<article><p>a</p></article>", "a"), ("<div hidden><p>no</p></div><p>yes it is</p>", "yes it is"), ("<p>1 < 2 words here</p>", "1 < 2 words here"),
    ("<div class='ad'>no no no</div><article><h1>Hi</h1></article>", "Hi"), ("<p><a href='x>y'>link text</a> follows</p>", "link text follows")])
def test_small_pages(page, want):
    assert T.main_text(page) == want


def test_region_without_article_markup():
    menu = "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(20))
    body = "".join(f"<p>{H.prose(i, 30)}</p>" for i in range(5))
    page = f"<body><div><ul>{menu}</ul></div><div>{body}</div><div><ul>{menu}</ul></div></body>"
    got = T.main_text(page, T.Weights({"li": 3.0, "a": 3.0, "ul": 2.0, "p": 0.1, "div": 0.5}))
    assert got == "\n".join(H.prose(i, 30) for i in range(5))


@pytest.mark.parametrize("between", [
    "<div class=ad><a href=/x><b>Buy</b></a></div>", "<script>var x = 1</script>" * 3, "<aside><article>See also</article><p>more</p></aside>",
    "<ul class=share>" + "<li><a href=/s>share</a></li>" * 5 + "</ul>", "<div class=widget>" + "<p><i>x</i></p>" * 400 + "</div>"])
def test_left_out_elements_do_not_part_the_text(between):
    one, two, three = H.prose(1, 100), H.prose(2, 80), H.prose(3, 4)
    want = "\n".join([one, two, three])
    body = f"<p>{one}</p>{between}<p>{two}</p>{between}<p>{three}</p>"
    assert T.main_text(f"<body><div>{body}</div></body>") == want
    assert T.main_text(f"<body><article>{body}</article></body>") == want


def test_very_long_and_deep_pages():
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    assert T.main_text(long).count("\n") == 19_999
    assert T.main_text("<div>" * 3000 + "deep words" + "</div>" * 3000) == "deep words"


def test_extract_learns_from_labelled_pages(spark):
    teaser = "".join(f"<div class='teaser'><p>{H.prose(i, 25)}</p></div>" for i in range(4))
    marked = [f"<body>{teaser}<article><p>{H.prose(i, 40)}</p></article></body>" for i in range(20)]
    plain = f"<body>{teaser}<div><p>{H.prose(99, 40)}</p></div></body>"
    df = spark.createDataFrame([(i, "u", h, 1) for i, h in enumerate([*marked, plain, None, ""])], "page_id bigint, url string, html string, text int")
    assert "div.teaser" in T.learn(df).out
    got = H.rows(T.extract(df), "page_id", "text", "n_chars")
    assert got[20] == (H.prose(99, 40), len(H.prose(99, 40))) and got[21] == ("", 0) and got[22] == ("", 0)
    assert got[3][0] == H.prose(3, 40)
    assert T.extract(df.limit(0)).count() == 0


def test_every_kind_is_learned_and_joined_alike(spark, monkeypatch):
    teaser = f"<div class=teaser><p>{H.prose(1, 120)}</p></div>"
    many = "".join(f"<b class=k{i}>x</b><b class=k{i}>y</b>" for i in range(5100))
    marked = [f"<body>{teaser}<article><p>{H.prose(2, 40)}</p>{many}</article></body>"]
    plain = f"<body>{teaser}<div><p>{H.prose(3, 40)}</p></div></body>"
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate([*marked, plain, plain, "no tags", None, ""])], "page_id bigint, url string, html string")
    assert "div.teaser" in T.learn(df).out
    got = sorted(map(tuple, T.extract(df).collect()))
    assert got[1][2] == got[2][2] == H.prose(3, 40) and [r[2] for r in got[3:]] == ["no tags", "", ""]
    monkeypatch.setattr(T, "BROADCAST_KINDS", 10)
    assert sorted(map(tuple, T.extract(df).collect())) == got


def pages(spark, items):
    return spark.createDataFrame(items, "page_id bigint, url string, html string")


def test_archives_round_trip(spark):
    items = [(i, f"http://x/{i}?q=é b\r\nX: y" if i else None, h) for i, h in enumerate(
        ["<p>a</p>", "é\r\n\r\nb", None, "", "<p>a</p>", "long " * 200_000, "\r\n", "WARC/1.1\r\n\r\n"] + ["hot"] * 2000)]
    r = random.Random(2)
    r.shuffle(items)
    got = {x.page_id: x for x in W.read_archives(W.write_archives(pages(spark, items).repartition(5), archive_bytes=4000), with_payload=True).collect()}
    first = {}
    for i, _, h in sorted(items):
        first.setdefault(h or "", i)
    assert len(got) == len(items)
    for i, u, h in items:
        x, data = got[i], (h or "").encode()
        assert (x.url, x.payload_bytes, x.payload_digest) == (u, len(data), W.sha1_base32(data))
        assert (x.record_type, x.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
        assert x.payload == (data if x.record_type == "response" else None)


def test_null_and_repeated_page_ids(spark):
    out = W.read_archives(W.write_archives(pages(spark, [(None, None, "a"), (None, None, "b"), (3, "u", "a"), (3, "u", "a")]))).collect()
    assert sorted((x.page_id or 0, x.record_type, x.refers_to or 0) for x in out) == [(0, "response", 0), (0, "revisit", 3), (3, "response", 0), (3, "response", 0)]
    assert W.read_archives(W.write_archives(pages(spark, []))).count() == 0


def test_reader_finds_damage():
    a = W.member(1, "u", b"payload") + W.member(2, "v", b"payload", 1, True)
    assert [r["page_id"] for r in W.read_archive(a, piece=3)] == [1, 2]
    assert gzip.decompress(a).count(b"WARC/1.1") == 2
    with pytest.raises(W.WarcError):
        list(W.read_archive(a[:-5]))
    raw = gzip.decompress(W.member(1, "u", b"payload"))
    for bad in (raw.replace(b"payload", b"Payload"), raw.replace(b"Content-Length: 8", b"Content-Length: 9"), raw[:-2], b"junk"):
        with pytest.raises(W.WarcError):
            W.read_record(bad)


BAD = ["grumbleface", "snotwit", "dolthead", "vexklump"]


def labelled(spark, n, share=0.2, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = H.prose(i, r.randrange(20, 200), 800).split(" ")
        toxic = int(r.random() < share)
        for _ in range(1 + len(w) // 30 if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "en", "s"]))
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark, 1500)
    out = X.toxicity(docs.repartition(4), labels).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if H.crc(i, 3) == 1} and len(out) == 1500
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    caught = [r.predicted for r in held if truth[r.doc_id]]
    assert right > 0.96 and sum(caught) / len(caught) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_held_out_labels_do_not_matter(spark):
    docs, labels, truth = labelled(spark, 300)
    held = spark.createDataFrame([(i,) for i in truth if H.crc(i, 3) == 1], "doc_id bigint")
    a = H.rows(X.toxicity(docs, labels), "doc_id", "score")
    b = H.rows(X.toxicity(docs, labels.join(held, "doc_id", "left_anti")), "doc_id", "score")
    assert a == b


def test_conflicting_labels_give_one_model_under_any_partitioning(spark):
    docs, labels, truth = labelled(spark, 400)
    again = docs.selectExpr("doc_id + 10000 as doc_id", "text")
    other = labels.selectExpr("doc_id + 10000 as doc_id", "if(doc_id % 5 = 0, 1 - toxic, toxic) as toxic")
    docs, labels = docs.unionByName(again), labels.unionByName(other)
    a = H.rows(X.toxicity(docs.repartition(3), labels), "doc_id", "score")
    assert a == H.rows(X.toxicity(docs.repartition(11, "doc_id"), labels.repartition(5)), "doc_id", "score")


def test_toxicity_on_degenerate_tables(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "", 2.0), (3, "x " * 100_000, None), (3, "x", 1.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert max(r.score for r in X.toxicity(docs, none).collect()) < 1e-9
    one = spark.createDataFrame([(3, 1), (1, None), (None, 1)], "doc_id bigint, toxic int")
    assert X.toxicity(docs, one).count() == 4
    assert X.toxicity(docs.limit(0), one).count() == 0
    _, labels, _ = labelled(spark, 200)
    train_docs, _, _ = labelled(spark, 200)
    model = X.train(train_docs, labels)
    kept = X.score(docs, model)
    assert kept.columns == ["doc_id", "text", "score", "_score"] and kept.count() == 4


def test_edits_equal_full_counts():
    c = C.Counter(Path(C.VOCABULARY).read_bytes())
    r = random.Random(3)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "23", "é", "ñ", ".", "!", " the", "\t", "ll", "'ll", "x y", " \n ", "漢"]
    text = lambda n: "".join(r.choice(bits) for _ in range(n))
    for k in range(1500):
        t = text(r.randrange(60)) * (40 if k % 100 == 0 else 1)
        tree = C.SegmentTree(*c.leaves(t))
        for _ in range(4):
            s, d, ins = r.randrange(-1, len(t) + 3), r.randrange(10), text(r.randrange(6))
            want = t[:min(max(s, 0), len(t))] + ins + t[min(min(max(s, 0), len(t)) + d, len(t)):]
            t, _ = C.apply_edit(t, tree, c, s, d, ins)
            assert t == want and tree.total == len(c.encoding.encode_ordinary(t))
            assert (sum((b[0] for b in tree.blocks), []), sum((b[1] for b in tree.blocks), [])) == c.leaves(t)


def test_edits_touch_little_of_a_long_text():
    c = C.Counter(Path(C.VOCABULARY).read_bytes())
    t = H.prose(1, 50_000)
    tree = C.SegmentTree(*c.leaves(t))
    t, again = C.apply_edit(t, tree, c, 120_000, 10, "some new words")
    assert again < 30 and tree.total == len(c.encoding.encode_ordinary(t))


def test_count_and_edit_on_spark(spark):
    texts = [None, "", "a b", H.prose(1, 500), "  \n ", "é" * 30_000]
    docs = H.documents(spark, texts)
    state = C.count(docs).withColumn("edits", C.review_edits(C.F.col("doc_id"), C.F.col("text")))
    rows = {r.doc_id: r for r in state.collect()}
    c = C.Counter(Path(C.VOCABULARY).read_bytes())
    once = C.edit(state)
    got = {r.doc_id: r for r in once.collect()}
    for i, t in enumerate(texts):
        t = t or ""
        assert rows[i].n_tokens == got[i].n_tokens_before == len(c.encoding.encode_ordinary(t))
        for e in rows[i].edits:
            t = t[:e.start] + e.inserted + t[e.start + e.deleted:]
        assert got[i].text == t and got[i].n_tokens == len(c.encoding.encode_ordinary(t)) and got[i].n_edits == len(rows[i].edits) > 0
    again = C.edit(once.withColumn("edits", C.F.lit(None).cast(C.EDITS)), with_state=False)
    assert H.rows(again, "doc_id", "n_tokens", "n_reencoded") == {i: (got[i].n_tokens, 0) for i in got}
    assert C.count(docs.limit(0)).count() == 0


# ---- HTML: attributes, forms, unclosed tags -------------------------------------

LONG = " ".join(f"word{i}" for i in range(60))


@pytest.mark.parametrize("page,want", [
    (f'<body style="overflow:hidden"><p>{LONG}</p></body>', LONG),
    (f'<p>{LONG} <a href="/the-hidden-cost/">this story</a> ends</p>', f"{LONG} this story ends"),
    (f'<p title="a hidden gem">{LONG}</p>', LONG),
    (f'<div data-role="banner" data-class="advert"><p>{LONG}</p></div>', LONG),
    (f'<div class="search-results-paper"><p>{LONG}</p></div>', LONG),
    (f'<body><form action="."><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></form></body>', f"Head\n{LONG}\n{LONG}"),
    (f'<form><div><article><p>{LONG}</p></article></div></form>', LONG),
    (f'<div class="page-with-sidebar sidebar"><main><p>{LONG}</p></main></div>', LONG),
    (f'<p>{LONG}</p><form><p>sign up</p></form>', LONG),
    (f'<p>{LONG}</p><div hidden>no</div><div class="ad-slot-3">no</div><div id="cookie-box">no</div>', LONG),
    (f'<form hidden><h1>no</h1><p>no</p></form><p>{LONG}</p>', LONG),
])
def test_attributes_and_forms(page, want):
    from shelfsort.llm.html_text import main_text
    assert main_text(page) == want


@pytest.mark.parametrize("page", ["<script " * 130_000, "<a " * 300_000, '<a ">" ' * 100_000, "<b>" * 20_000 + "</i>" * 20_000,
                                  "<div>" * 20_000 + "</p>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, '<a href="x> ' * 80_000 + ">",
                                  "<!--" * 200_000, "<div><article>" * 30_000, "<form><h1>" * 30_000])
def test_hostile_pages_take_linear_time(page):
    import time
    from shelfsort.llm.html_text import main_text
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 15


def test_region_is_the_best_of_all():
    """The scan against every contiguous run of words and tags."""
    import random
    from shelfsort.llm import html_text as H
    r = random.Random(6)
    for _ in range(120):
        page = "".join(r.choice(["<p>a b c</p>", "<div>", "</div>", "<ul><li>x</li></ul>", "word ", "<br>", "<span>y z</span>", "<hr>"])
                       for _ in range(r.randrange(1, 25)))
        marks = []
        for e in H.events(page):
            if e[0] == "text":
                marks += [(float(len(e[1].split())), e[1].split())] if not e[2] and e[1].split() else []
            else:
                _, name, _, out, inside, kind = e
                cost = H.INSIDE_COST if inside else H.LEFT_OUT_COST if out else H.TEXT_COST if name in H.TEXT_TAGS else H.UNKNOWN_COST
                marks += [(-cost, [])] if out < 2 else []
        best = max((sum(m[0] for m in marks[i:j]) for i in range(len(marks)) for j in range(i + 1, len(marks) + 1)), default=0.0)
        got = "".join(H.main_text(page).split())
        if best <= 0:
            assert got == ""
            continue
        runs = ["".join(w for m in marks[i:j] for w in m[1]) for i in range(len(marks)) for j in range(i + 1, len(marks) + 1)
                if abs(sum(m[0] for m in marks[i:j]) - best) < 1e-9]
        assert got in runs, page
