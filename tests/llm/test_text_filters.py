"""Decontamination, quality, personal data, html and urls."""

import hashlib
import random
import re
import sys
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, html_text, pii, quality, urls

from .helpers import frame, odd_rows, words


# ---- decontamination -----------------------------------------------------------------------------------------------
def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max() / (2 * len(a))


def test_alignment_matches_the_plain_table():
    r = np.random.default_rng(1)
    for _ in range(30):
        a, b = r.integers(0, 6, r.integers(1, 25)).astype(np.uint64), r.integers(0, 6, r.integers(1, 60)).astype(np.uint64)
        assert decontaminate.smith_waterman(a, b)[0] == pytest.approx(plain_smith_waterman(a, b))


def test_exact_edited_and_marked_copies_leak_and_clean_texts_do_not(spark):
    r = random.Random(4)
    items = [(k, " ".join(words(40, 900 + k))) for k in range(6)] + [(50, None), (51, ""), (52, "ab cd"), (None, "x y z")]
    rows, expect = [], set()
    for k, t in items[:6]:
        w = t.split()
        edited = [x if r.random() > 0.15 else "changed" for x in w]
        for n, copy in enumerate((w, edited, w[:10] + ["more", "words"] + w[10:], [x.upper() + "," for x in w])):
            rows.append((100 * k + n, " ".join(words(300, k * 10 + n) + copy + words(200, k * 7 + n))))
            expect.add((100 * k + n, k))
    rows += [(5000 + n, " ".join(words(400, 7000 + n))) for n in range(20)] + [(9000 + (i or 0), t) for i, t in odd_rows()] + [(7777, "so ab cd too")]
    expect.add((7777, 52))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(frame(spark, rows), bench)
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == expect
    blocks = decontaminate.find_leaks(frame(spark, rows), bench, item_bytes=400)
    assert {(x["doc_id"], x["item_id"]) for x in blocks.collect()} == expect
    clean = decontaminate.without_leaks(frame(spark, rows), bench)
    assert {x["doc_id"] for x in clean.select("doc_id").collect()} == {i for i, _ in rows} - {i for i, _ in expect}
    assert decontaminate.find_leaks(frame(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.find_leaks(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("item_bytes", [300, 1 << 20])
def test_leaks_match_an_alignment_of_every_item_with_every_text(spark, item_bytes):
    r = random.Random(8)
    items = [(k, " ".join(words(20 + k, 700 + k))) for k in range(6)]
    rows = []
    for n in range(40):
        w = words(60, 4000 + n)
        if n % 2:  # a copy with some words lost, changed or added
            copy = [x for x in items[n % 6][1].split() for x in ([x, "new"] if r.random() < 0.05 else [] if r.random() < 0.1 else ["other"] if r.random() < 0.1 else [x])]
            w[30:30] = copy
        rows.append((n, " ".join(w)))
    code: dict[str, int] = {}
    number = lambda t: np.array([code.setdefault(x, len(code)) for x in t.split()])
    expect = {(n, k): s for n, t in rows for k, i in items if (s := plain_smith_waterman(number(i), number(t))) >= 0.5}
    assert len(expect) >= 18
    found = decontaminate.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), item_bytes=item_bytes).collect()
    assert {(x["doc_id"], x["item_id"]): pytest.approx(x["score"]) for x in found} == expect


def test_ties_of_two_texts_under_one_id_give_the_same_rows_either_way(spark):
    one, two = words(30, 5), words(30, 6)
    items = spark.createDataFrame([(3, " ".join(one)), (3, " ".join(two)), (4, " ".join(two))], "item_id long, text string")
    docs = frame(spark, [(1, " ".join(two + words(50, 7) + one)), (2, " ".join(words(9, 8) + one + two)), (3, None)])
    rows = [sorted(map(tuple, decontaminate.find_leaks(docs, items, item_bytes=n).collect())) for n in (1, 1 << 20)]
    assert rows[0] == rows[1] == [(1, 3, 1.0, 0, 30), (1, 4, 1.0, 0, 30), (2, 3, 1.0, 9, 39), (2, 4, 1.0, 39, 69)]
    assert decontaminate.find_leaks(frame(spark, []), items, item_bytes=1).count() == 0


# ---- quality -------------------------------------------------------------------------------------------------------
def test_discriminant_matches_the_formula():
    r = np.random.default_rng(2)
    x = [r.normal(0, 1, (200, 3)), r.normal(1, 2, (300, 3))]
    model = quality.discriminant(np.array([200.0, 300.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]), 0.1)
    z = r.normal(0, 1, (10, 3))
    both, d = np.concatenate(x), 3
    scale = both.std(axis=0)
    s = (z - both.mean(axis=0)) / scale
    logs = []
    for a, n in zip(x, (200, 300), strict=True):
        b = (a - both.mean(axis=0)) / scale
        c = np.cov(b.T, bias=True)
        c = 0.9 * c + 0.1 * np.trace(c) / d * np.eye(d) + 1e-3 * np.eye(d)
        m = s - b.mean(axis=0)
        logs.append(np.log((n + 1) / 502) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", m, np.linalg.inv(c), m))
    assert model.scores(z) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_junk_scores_low_and_odd_rows_have_scores(spark):
    good = [(i, ". ".join(" ".join(words(12, i * 9 + k)).capitalize() for k in range(8))) for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in words(80, i))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in junk] + [(None, 1), (1, None)], "doc_id long, quality int")
    rows = good + junk + [(5000 + (i or 0), t) for i, t in odd_rows()] + [(None, "x")]
    out = quality.score_documents(frame(spark, rows), labels).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    own = out.set_index("doc_id")
    assert own.loc[[i for i, _ in good], "predicted"].mean() > 0.97 and own.loc[[i for i, _ in junk], "predicted"].mean() < 0.03
    assert quality.score_documents(frame(spark, []), labels).count() == 0
    assert quality.score_documents(frame(spark, good[:3]), labels.where("false")).count() == 3


def test_scores_match_plain_densities_of_all_labelled_texts(spark):
    rows = [(i, " ".join(words(60, i)) + "!" * (i % 3)) for i in range(60)] + [(100 + i, " ".join(["spam"] * (20 + i)) + " %%%") for i in range(25)]
    labels = [(i, int(i < 100)) for i, _ in rows]
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    texts = dict(rows)
    got = {r["doc_id"]: (r["score"], r["held_out"]) for r in quality.score_documents(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    x = {y: np.array([quality.statistics(texts[i]) for i, z in learned if z == y]) for y in (0, 1)}
    both = np.concatenate([x[0], x[1]])
    centre, scale = both.mean(axis=0), np.sqrt(np.maximum(both.var(axis=0), 1e-6))
    d = both.shape[1]

    def density(v, y):
        own = (x[y] - centre) / scale
        cov = np.cov(own.T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.trace(cov) / d * np.eye(d) + 1e-3 * np.eye(d)
        m = (v - centre) / scale - own.mean(axis=0)
        return np.log((len(own) + 1) / (len(both) + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * m @ np.linalg.solve(cov, m)

    for i, t in rows:
        v = quality.statistics(t)
        gap = np.clip(density(v, 0) - density(v, 1), -60, 60)
        assert got[i] == (pytest.approx(1 / (1 + np.exp(gap)), abs=1e-6), zlib.crc32(str(i).encode()) % 5 == 0)


def test_held_out_labels_are_not_learned(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score_documents(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)


# ---- personal data -------------------------------------------------------------------------------------------------
PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def plain_spans(t):
    return sorted((m.start(), k, m.end()) for k, name in enumerate(pii.KINDS) for m in re.finditer(PATTERNS[name][0], t) if PATTERNS[name][1](m[0]))


def test_fixed_patterns_match_the_plain_ones():
    r = random.Random(3)
    alphabet = ["a", "Z", "0", "7", "19", "255", "256", ".", "@", "+", "-", " ", "(", ")", "_", "\n", "é", "٣", "4337166598464399", "x@y.z", "1.2.3.4", "+1 (988) 555-2485"]
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "@" * 50_000, "a@" * 50_000, "+1 " * 50_000):
        pii.base_spans(t)


def test_field_keeps_base_adds_spans_and_masks(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    weights = pii.fit(docs)
    for t, expect in (
        ("write to jo.81@mail7.example.com now", ["<EMAIL>"]),
        ("from 70.123.182.155 today", ["<IP>"]),
        ("pay 4337166598464399 please", ["<CARD>"]),
        ("call +1 (988) 555-2485 now", ["<PHONE>"]),
        ("two cards 4337166598464399 4024007103939509 there", ["<CARD>", "<CARD>"]),
        ("License, Version 2.0. and 1984", []),
    ):
        out = spark.createDataFrame([(t,)], "text string").select(pii.mask_column(spark, weights).alias("m")).first()["m"]
        assert re.findall("<[A-Z]+>", out) == expect, out
    rows = odd_rows() + [(20, "a@b.cd 4337166598464399"), (21, "9" * 9000)]
    got = pii.find_pii(frame(spark, rows), weights=weights).collect()
    assert len(got) == len(rows)
    for r in got:
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    assert pii.find_pii(frame(spark, []), weights=weights).count() == 0


def test_pii_query_digest(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in pii.op8_pii(spark, data).collect():
        own = plain_spans(texts[r["doc_id"]])
        written = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in own)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(k == pii.KINDS[x] for _, x, _ in own) for k in pii.KINDS]


def test_long_windows_lose_nothing_at_any_character():
    card = "4111.1111.1111.1111"
    weights = np.zeros((len(pii.KINDS), len(pii.FEATURES)))
    names = ("bias", "luhn", "open_left", "open_right", "spaces")
    weights[pii.KINDS.index("card"), [pii.FEATURES.index(x) for x in names]] = -1, 3, -5, -5, -10
    for at in [*range(3980, 4021), 7990]:
        text = "1 " * (at // 2 - at % 2) + "22 " * (at % 2) + card + " 5" * 500
        assert next(pii.windows(text)) == (0, len(text))
        assert pii.spans_of(text, weights)[1] == [(at, pii.KINDS.index("card"), at + len(card))]


def test_digits_of_no_number_break_nothing():
    weights = np.random.default_rng(3).normal(0, 1, (len(pii.KINDS), len(pii.FEATURES)))
    odd = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isdigit()]
    assert "²" in odd and "①" in odd
    for c in odd:
        for t in (f"server 10.0.0.1{c} was down", f"{c}{c}.1.2.{c} a{c}@b.cd", f"4111 1111 1111 111{c} +{c} 1{c}(2)"):
            base, spans = pii.spans_of(t, weights)
            assert base == plain_spans(t) and set(base) <= set(spans)
    assert pii.base_spans("server 10.0.0.1² was down") == [(7, 1, 15)]


def labellings(text, weights):
    """All ways to choose entities among a window's segments: (score, entities)."""
    tokens, by_end = pii._lattice(text, 0, len(text))

    def upto(j):
        if j < 0:
            return [(0.0, ())]
        out = list(upto(j - 1))
        for i, f in by_end[j]:
            for k in range(len(pii.KINDS)):
                s = weights[k, list(f)].sum()
                out += [(score + s, (*own, (tokens[i][0], k, tokens[j][1]))) for score, own in upto(i - 1)]
        return out

    return upto(len(tokens) - 1)


@pytest.mark.parametrize("text", ["a 12 b@c.d", "+1 (2) 3", "1.2.3", "x@ 5", "7 8²"])
def test_decoding_and_gradient_match_enumeration(text):
    r = np.random.default_rng(len(text))
    for _ in range(5):
        w = r.normal(0, 0.5, (len(pii.KINDS), len(pii.FEATURES)))
        ways = labellings(text, w)
        score, best = max(ways)
        assert sum(s for s, own in ways if list(own) == pii.decode(text, 0, len(text), w)) == pytest.approx(score)
        gold = list(ways[len(ways) // 2][1])
        likelihood, change = pii.ascent(*pii._lattice(text, 0, len(text)), gold, w)
        total = lambda w: next(s for s, own in labellings(text, w) if list(own) == gold) - np.logaddexp.reduce([s for s, _ in labellings(text, w)])
        assert likelihood == pytest.approx(total(w))
        for k, f in r.integers(0, w.shape, (4, 2)):
            step = np.zeros_like(w)
            step[k, f] = 1e-5
            assert change[k, f] == pytest.approx((total(w + step) - total(w - step)) / 2e-5, abs=1e-4)


def test_the_field_is_right_on_windows_it_has_not_seen(spark, data):
    docs = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    seen = [w for _, w in pii.sample_windows(docs, "text", 9)]
    weights = pii.train(pii.learned_from(seen))
    right = wrong = missed = 0
    for t, gold in pii.learned_from([w for _, w in pii.sample_windows(docs, "text", 60) if w not in seen]):
        found = set(pii.decode(t, 0, len(t), weights))
        right, wrong, missed = right + len(found & set(gold)), wrong + len(found - set(gold)), missed + len(set(gold) - found)
    assert right > 30 and wrong <= 0.05 * right and missed <= 0.05 * right
    for t, expect in (("call 030 1234567 now", ["030 1234567"]), ("in 030 1234567 parts", []), ("user@localhost", []), ("from 10[.]20[.]30[.]40", ["10[.]20[.]30[.]40"]), ("4337.1665.9846.4398", [])):
        assert [t[a:e] for a, _, e in pii.spans_of(t, weights)[1]] == expect


# ---- html ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article><h1>T &amp; U</h1><p>a\n <b>b</b>&nbsp;c<p>d<br></article>", "T & U\na b c\nd"),
        ('<nav><a href="/">Home</a></nav><div class="ad">Buy!</div><article><p>Text <a href="x">link</a> on.</p><script>var t="</p>";</script></article><footer>F</footer>', "Text link on."),
        ('<div class="ad">never closed <article><p>kept</p></article>', "kept"),
        ("<article><p>yes</p><section class='comments'><p>no</p></section><aside>no</aside><form>no</form><p>yes too</p></article>", "yes\nyes too"),
        ("<!-- <article>no</article> --><style>p{}</style><p>short page</p>", "short page"),
        ("<article><p>a &lt;b&gt; &#233;</p><noscript>no</noscript><div style='display:none'>no</div></article>", "a <b> é"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_line_blocks_without_an_article():
    page = "<div><a href=a>One</a> <a href=b>Two</a></div><div id=x><p>" + "words of the text " * 12 + "</p><p>end.</p></div><ul><li><a href=c>Next</a></ul>"
    assert html_text.main_text(page) == ("words of the text " * 12).strip() + "\nend."


def test_windows_decide_on_pages_with_articles():
    body, more, lead = ("words of the body " * 20).strip(), ("and the second part " * 12).strip(), "What the story says in short."
    links = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    main = html_text.main_text
    assert main(f"<p>Mon 3</p><main><h1>Head</h1><p>{lead}</p><article><h2><a href=c>Sub</a></h2><p>{body}</p></article>{links}</main><p>End</p>") == f"Head\n{lead}\nSub\n{body}"
    assert main(f"<main><p>{body}</p><article><p>{lead}</p></article></main>") == f"{body}\n{lead}"
    assert main(f"<article><p>{body}</p></article>{links}<p>Part 2</p><article><p>{more}</p></article>") == f"{body}\n{more}"
    long = f"<p>{body}</p><p>{more}</p>"
    assert main(f"{links}<div>{long}</div><article><p>Teaser</p></article>{links}").startswith(f"{body}\n{more}")
    assert main(f"{long}{links}<article><p>{body}</p></article><p>By line</p>") == f"{body}\n{more}\n{body}"


def test_names_alone_do_not_drop_the_text():
    body, lead, talk = ("words of the body " * 20).strip(), "What the story says in short.", ("I say so " * 90).strip()
    main = html_text.main_text
    assert main(f'<div class="page has-sidebar"><div id="content" class="no-comments"><p>{body}</p></div></div>') == body
    assert main(f'<article class="post comment-status-open" data-comment-count=3><h1>Head</h1><div class="entry-content widget"><p>{body}</p></div></article>') == f"Head\n{body}"
    assert main(f'<div class="header"><p>{lead}</p></div><div class="widget"><p class="notice">{lead}<p>{body}</p></div><p>{lead}</p>') == f"{body}\n{lead}"
    assert main(f'<article><p>{body}</p><div class="comment-list"><article><p>{talk}</p></article></div></article>') == body
    assert main(f'<article><p>{body}</p></article><div class="sidebar-left"><p>{talk}</p></div>') == body
    assert main(f'<div class="social share">never closed<article><p>{body}</p><span class="share">Share <span>it</span> now</span></article>') == body


@pytest.mark.parametrize("page", ["<p>kept</p><a " + "title=\"x\" '" * 5_000, "<p>kept</p><a " + "\"" * 9_999, "<p>kept</p>" + "<a '" * 5_000, "<p>kept</p>" + "<a href=\"x" * 5_000, "<p>kept</p><b " + "=" * 50_000, "<p>kept</p>" + "<!-" * 20_000, "<p>kept</p><script " + "'\"" * 5_000])
def test_truncated_tags_take_linear_time(page):
    start = time.perf_counter()
    assert html_text.main_text(page) == "kept"
    assert time.perf_counter() - start < 1


@pytest.mark.parametrize("part", ["<nav>" + "<div>" * 20 + "</p>" * 20, "<div class=sidebar><article>t", "<main><article><div id=comments>x", "<b class=ad></i>"])
def test_wrong_nesting_takes_linear_time(part):
    took = []
    for size in (250_000, 1_000_000):
        page = part * (size // len(part))
        start = time.perf_counter()
        html_text.main_text(page)
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * took[0] + 0.5  # 16 times if it were quadratic


def as_divs(page):
    return re.sub(r"<(/?)(?:nav|ul|li|article|main|header|footer|aside|section|h[1-6]|p|form|div)\b[^>]*>", r"<\1div>", page)


def test_surge_and_dive_decide_without_any_marks(data):
    """On pages made of plain divs alone the lines' lengths find the article and leave menus and footers."""
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table(f"{data}/pages.parquet").column("html").to_pylist() if x and "<article>" in x]
    good, other = 0, 0
    for page in pages:
        want, got = html_text.main_text(page).split("\n"), html_text.main_text(as_divs(page)).split("\n")
        beside = [" ".join(html_text.entities.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.findall(r"(?s)<(?:footer|nav)>(.*?)</(?:footer|nav)>", page)]
        good += set(want) <= set(got) and not set(beside) & set(got)
        other += html_text.main_text(as_divs(page), window=1, surge=400) != "\n".join(got)
    assert good >= 0.95 * len(pages) and other > len(pages) // 4


def test_lines_beside_the_text_are_left_out():
    main = html_text.main_text
    body = "This is what the page has to say, in a line of some length."
    bare = f"<div>My site</div><div>{body}</div><div>And so on, at length, until the page has said all.</div>" + "<div>x</div>" * 30 + "<div>Login</div>"
    assert main(bare) == f"{body}\nAnd so on, at length, until the page has said all."
    assert main(f"<div>{body}</div>" + "".join(f"<div>{x}</div>" for x in ("Copyright 2020 Some Company. All rights reserved.", "Privacy", "Terms", "Contact us"))) == body
    assert main(f"<div>{body}</div><div>Part two</div><div>{body}</div>") == f"{body}\nPart two\n{body}"
    # inside an article too the text dives where its lines hold next to nothing
    few = "".join(f"<li>{x}</li>" for x in "abcdefghi")
    assert main(f"<article><p>{body}</p>{few}</article>") != main(f"<article><p>{body}</p>{few}</article>", surge=1)


def test_tags_end_where_a_browser_ends_them():
    main = html_text.main_text
    assert main('<p title="a > b">one</p><p title=\'it"s > \' x>two<p "quoted>three</p>') == "one\ntwo\nthree"
    assert main("<article><p>one <!--> two <!-- no --!> three</p></article>") == "one two three"
    assert main("<article><script>no</script  ><p>yes <svg/> too</p><style>no</style x></article>") == "yes too"
    body = ("words of the body " * 20).strip()
    assert main(f'<article><p>{body}</p><div class="related-work"><p>Related work is long.</p></div></article>') == f"{body}\nRelated work is long."


def random_page(r, depth=0):
    """A well-formed page as a tree: texts, or (tag, children)."""
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["text", "p", "p", "p", "a", "b"] + ["div", "article", "main", "nav", "ul", "script", "aside"] * (depth < 3))
        text = " ".join(["word"] * r.choice([1, 2, 5, 12, 30]))
        if kind == "text":
            out.append(text + r.choice(["", " ", "&amp;", "  \n "]))
        elif kind in ("p", "script"):
            out.append((kind, [text, *([("a", [text]), "end"] if kind == "p" and r.random() < 0.3 else [])]))
        elif kind in ("a", "b"):
            out.append((kind, [text]))
        else:
            out.append((kind, [("li", [x]) for x in random_page(r, 9)] if kind == "ul" else random_page(r, depth + 1)))
    return out


def as_html(nodes):
    return "".join(x if isinstance(x, str) else f"<{x[0]}>{as_html(x[1])}</{x[0]}>" for x in nodes)


def plain_main_text(nodes, window=html_text.WINDOW, surge=html_text.SURGE):
    blocks, parts, seen, line = [], [], [0], [""]

    def close(articles):
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            blocks.append((text, len(" ".join("".join(t for t, a in parts if not a).split())), list(articles), line[0]))
        parts.clear()

    def walk(nodes, articles, link):
        for x in nodes:
            if isinstance(x, str):
                parts.append((x.replace("&amp;", "&"), link))
            elif x[0] in ("a", "b"):
                walk(x[1], articles, link or x[0] == "a")
            elif x[0] != "script":
                close(articles)
                line[0] = x[0]
                if x[0] not in ("nav", "aside"):
                    own = articles
                    if x[0] in ("article", "main"):
                        seen[0] += 1
                        own = [*articles, seen[0]]
                    walk(x[1], own, False)
                    close(own)
                    line[0] = ""

    walk(nodes, [], False)
    close([])
    if not blocks:
        return ""
    held = {}
    for t, _, a, _ in blocks:
        if a:
            held[a[-1]] = held.get(a[-1], 0) + len(t)
    outer = {n for _, _, a, _ in blocks for n in a[:-1]}
    fit = [n * 2 >= len(t) for t, n, _, _ in blocks]
    size, inside_size = [], []
    for (t, n, a, tag), f in zip(blocks, fit, strict=True):
        size.append(n if f and (len(t) >= 40 or tag == "p") else 0)
        family = [b[-1] for _, _, b, _ in blocks if a and b and b[0] == a[0]]
        largest = a and a[-1] == max(family, key=lambda k: (held[k], -family.index(k)))
        inside_size.append(len(t) if a and (a[-1] not in outer or largest) else n)
    inside = [bool(a) for _, _, a, _ in blocks]
    if any(inside) and sum(x for x, i in zip(inside_size, inside, strict=True) if i) * html_text.INSIDE >= sum(x for x, i in zip(size, inside, strict=True) if not i) * html_text.OUTSIDE:
        size = [x * html_text.INSIDE if i else y * html_text.OUTSIDE for x, y, i in zip(inside_size, size, inside, strict=True)]
        fit = [x > 0 if i else f for x, f, i in zip(inside_size, fit, inside, strict=True)]
    else:
        inside = [False] * len(blocks)
    n = len(blocks)
    sums = {(i, side): sum(size[j] for j in range(i, min(n, i + window)) if inside[j] == side) for i in range(n) for side in (True, False)}
    least = min(surge, max(sums.values()) / 2)
    keep = set()
    for side in (True, False):
        held_by = [inside[j] == side and any(sums[i, side] >= least > 0 for i in range(max(0, j - window + 1), j + 1)) for j in range(n)]
        j = 0
        while j < n:  # from each surge down to its dive
            end = j
            while end < n and held_by[end]:
                end += 1
            heavy = [k for k in range(j, end) if size[k]]
            if heavy:
                keep |= {k for k in range(heavy[0], heavy[-1] + 1) if fit[k]}
            j = max(end, j + 1)
    return "\n".join(blocks[i][0] for i in sorted(keep))


def holds(node):
    return not isinstance(node, str) and (node[0] in ("article", "main") or any(map(holds, node[1])))


def test_pages_match_a_plain_reading_of_the_rule():
    r = random.Random(12)
    decided = 0
    for _ in range(3000):
        page = random_page(r)
        stack = [page]
        while stack:  # no articles inside asides
            nodes = stack.pop()
            nodes[:] = [x for x in nodes if isinstance(x, str) or x[0] not in ("nav", "aside") or not any(map(holds, x[1]))]
            stack += [x[1] for x in nodes if not isinstance(x, str)]
        text = plain_main_text(page)
        assert html_text.main_text(as_html(page)) == text, as_html(page)
        decided += 0 < len(text) < len(plain_main_text(page, surge=1))
    assert decided > 300


def test_extract_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (None, "u", "<p>" + "x" * 200_000), (2, "u", "<article>a</article>"), (2, "u", "<article>a</article>")], "page_id long, url string, html string")
    got = html_text.extract_text(rows).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 1, 1, 200_000]
    assert html_text.extract_text(rows.where("false")).count() == 0


# ---- urls ----------------------------------------------------------------------------------------------------------
def plain_verdict(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_rules_match_plain_ones_by_constant_and_by_join(spark):
    r = random.Random(1)
    rows = [(n, "".join(r.choice(["http://", "HTTPS://", "", "://"]) + r.choice(["a.", "www.", ""]) + r.choice(["example.com", "EXAMPLE.net", "net", "com", "xcom", "org", "é.org"]) + r.choice(["", ":80"]) + r.choice(["/en/7", "/en/", "/de/8", "/de/", "/es/1", "/en", "", "?q=/en/", "#/en/"]) + r.choice(["", "?a=1", "#x"]))) for n in range(400)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (None, "http://com/en/"), (903, "http://a.com/en/x\ny"), (903, "http://a.com/en/x\ny")]
    pages = spark.createDataFrame([(i, u, None, "h", "p") for i, u in rows], "page_id long, url string, html string, host string, path string")
    expect = sorted((str(i), *map(str, plain_verdict(u))) for i, u in rows)
    for rules in (list(urls.RULES), spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")):
        got = urls.judge_urls(pages, rules).collect()
        assert sorted(tuple(map(str, r)) for r in got) == expect
    assert urls.judge_urls(pages.where("false"), list(urls.RULES)).count() == 0


def test_aliases_share_blocks_and_allows_win(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    pages = spark.createDataFrame(
        [
            (1, "http://x.fr/a", link("http://y.fr/b")),
            (2, "https://y.fr/b#top", '<meta http-equiv="refresh" content="0; url=http://bad.com/en/1">'),
            (3, "http://z.fr/q", link("/r")),
            (4, "http://z.fr/r", link("http://bad.com/en/2")),
            (5, "http://z.fr/s", link("http://www.example.com/en/7")),
            (6, "http://z.fr/s", link("http://bad.com/en/3")),
            (7, "http://w.fr/alone", "<p>canonical</p>"),
            (8, "http://bad.com/en/9", link("http://example.com/en/7")),
        ],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, list(urls.RULES)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block"}
    edges = spark.createDataFrame([("http://w.fr/alone", "http://bad.com/en/5"), (None, "x")], "src_url string, dst_url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, list(urls.RULES), edges).collect()}[7] == "block"


class PlainLinks(HTMLParser):
    """Targets of canonical links and refreshes as the standard library reads tags."""

    def __init__(self, page):
        super().__init__()
        self.found, self.base, self.quiet = [], None, 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        self.quiet += tag in ("noscript", "template")
        if self.quiet:
            return
        if tag == "base" and self.base is None:
            self.base = own.get("href")
        if tag == "link" and "canonical" in own.get("rel", "").lower().split():
            self.found.append(own.get("href", ""))
        if tag == "meta" and own.get("http-equiv", "").lower() == "refresh":
            self.found.append(own.get("content", "").partition(";")[2].strip().removeprefix("url=").strip("'"))

    def handle_endtag(self, tag):
        self.quiet -= tag in ("noscript", "template")


def resolved(base, target):
    """RFC 3986, section 5.2, for targets with neither a scheme nor an authority of their own."""
    if "://" in target.split("?")[0]:
        return target
    if target.startswith("//"):
        return "x:" + target
    scheme, rest = base.split("://")
    rest = rest.split("#")[0]
    path, q, query = rest.partition("?")
    host, slash, path = path.partition("/")
    target = target.split("#")[0]
    to, q2, query2 = target.partition("?")
    if not to:
        return f"{scheme}://{host}{slash}{path}{q2 or q}{query2 if q2 else query}"
    full = to[1:].split("/") if to.startswith("/") else [*path.split("/")[:-1], *to.split("/")]
    out = []
    for n, part in enumerate(full):
        last = n == len(full) - 1
        if part == "..":
            out = out[:-1]
        if part not in (".", ".."):
            out.append(part)
        elif last:
            out.append("")
    return f"{scheme}://{host}/{'/'.join(out)}{q2}{query2}"


def plain_node(url):
    m = re.match(r"(?s)^.*?://([^/?#]+)([^#]*)", url or "")
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) + m[2] if m else None


def plain_verdicts(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for _, url, page in rows:
        if plain_node(url):
            seen = PlainLinks(page or "")
            for t in seen.found:
                node = plain_node(resolved(resolved(url, seen.base) if seen.base else url, t)) if t else None
                if node:
                    up[find(plain_node(url))] = find(node)
    shared = {}
    for x in list(up):
        shared.setdefault(find(x), set()).add(plain_verdict("x://" + x)[3] if plain_verdict("x://" + x)[2] else None)
    out = []
    for i, url, _ in rows:
        host, path, rule, verdict = plain_verdict(url)
        kinds = shared.get(find(plain_node(url)), set()) if plain_node(url) else set()
        if rule is None:
            verdict = "allow" if "allow" in kinds or "block" not in kinds else "block"
        out.append((str(i), host, path, str(rule), verdict))
    return sorted(out)


def test_chains_hubs_and_cycles_match_plain_components(spark):
    r = random.Random(6)
    link = lambda u: r.choice(['<link rel="canonical" href="{}">', "<link href='{}' rel='nofollow Canonical'>", "<LINK REL=canonical HREF={}>", '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;url={}' http-equiv=Refresh>"]).format(u)
    rows = [(n, f"http://c.fr/{n}", link(f"http://c.fr/{n + 1}")) for n in range(12)] + [(12, "http://c.fr/12", link("http://www.bad.com/en/x"))]
    rows += [(100 + n, f"http://h{n}.fr/", link("https://HUB.fr/all#top")) for n in range(20)] + [(120, "http://hub.fr/all", link("http://example.com/en/7"))]
    rows += [(200 + n, f"http://ring.fr/{n}", link(f"http://ring.fr/{(n + 1) % 5}")) for n in range(5)] + [(210, "http://ring.fr/in", link("/3")), (211, "http://ring.fr/3", link("//org/es/"))]
    rows += [
        (300, "http://q.fr/a/b?x=1", link("../c?u=1&amp;v=2")), (301, "http://q.fr/c?u=1&v=2", link("http://bad.com/en/1")),
        (302, "http://q.fr/d", "<!-- " + link("http://bad.com/en/2") + " -->"), (303, "http://q.fr/e", "<script>'" + link("http://bad.com/en/2") + "'</script>"),
        (304, "http://q.fr/f", link("?to=http://bad.com/en/3")), (305, "http://q.fr/f?to=http://bad.com/en/3", "canonical"),
        (306, "http://q.fr/g/", '<base href="/base/">' + link("x/./y/..")), (307, "http://q.fr/base/x/", link("http://bad.com/en/4")),
        (308, "not a url", link("http://bad.com/en/5")), (309, "also none", None), (310, None, link("http://bad.com/en/5")), (311, "", "refresh"),
        (312, "http://q.fr/h", link("mailto:x@bad.com")), (313, "http://q.fr/i", link("http://[bad/")), (314, "http://q.fr/j", "<link rel=canonical-not href=http://bad.com/en/6>"),
        (315, "http://q.fr/k", link("http://bad.com/en/7") * 2), (315, "http://q.fr/k", link("http://bad.com/en/7")), (316, "http://q.fr/" + "l" * 50_000, "x" * 100_000 + link("/m")),
    ]
    pages = spark.createDataFrame([(i, u, h, "h", "p") for i, u, h in rows], "page_id long, url string, html string, host string, path string")
    got = sorted(tuple(map(str, r)) for r in urls.judge_urls(pages, list(urls.RULES)).collect())
    expect = plain_verdicts(rows)
    assert got == expect
    by_id = {x[0]: x[4] for x in got}
    assert [by_id[str(k)] for k in (0, 100, 200, 301, 300, 302, 303, 304, 305, 306, 308, 309, 310, 311, 312, 313, 314, 315)] == ["block", "allow", "block", "block", "block", "allow", "allow", "allow", "allow", "block", *["allow"] * 7, "block"]


def test_the_field_learns_the_same_however_rows_are_cut(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("text rlike '[0-9@]'")
    a, b = (pii.sample_windows(x, "text", 5) for x in (docs.coalesce(1), docs.repartition(7)))
    assert a == b and all(sum(k == kind for k, _ in a) <= 5 for kind in range(-1, 4))
