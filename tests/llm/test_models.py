"""Katz scores, quality estimates, mixing, URL trees and page extraction."""

import binascii
import collections
import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from dumpdeck.llm import html, katz, mixing, quality, urls
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().lower().decode()), None]


def brute_katz(rows):
    split = [(d, binascii.crc32(str(d).encode() if d is not None else b"") % 10 == 0, tokens(t)) for d, t in rows]
    one, two = collections.Counter(), collections.Counter()
    for _, held, ts in split:
        if not held:
            one.update(ts)
            two.update(zip([None, *ts], ts))
    n = sum(one.values())

    def of(counter):
        c = collections.Counter(counter.values())
        return [len(counter), *(c[r] for r in range(1, katz.LARGE + 2))]

    totals = katz.Totals(n, of(one), of(two))
    first = lambda c: totals.first[min(c, katz.LARGE + 1)]
    second = lambda c: totals.second[min(c, katz.LARGE + 1)]
    lower = {w: first(c) * c / n for w, c in one.items()}
    unknown = 1 - math.fsum(lower.values())
    after = collections.defaultdict(dict)
    for (v, w), c in two.items():
        after[v][w] = second(c) * c / one[v]
    alpha = {
        v: (1 - math.fsum(seen.values())) / (1 - math.fsum(lower[w] for w in seen)) for v, seen in after.items()
    }

    def p(v, w):
        if w in after.get(v, {}):
            return after[v][w]
        return alpha.get(v, 1.0) * lower.get(w, unknown)

    for v in [*itertools.islice(after, 20), "never seen"]:
        assert math.isclose(math.fsum(p(v, w) for w in one) + alpha.get(v, 1.0) * unknown, 1, rel_tol=1e-9)
    out = []
    for d, held, ts in split:
        base = math.fsum(math.log10((one[t] + 0.1) / (n + 0.1 * (len(one) + 1))) for t in ts)
        score = math.fsum(math.log10(p(v, w)) for v, w in zip([None, *ts], ts))
        out.append((d, held, len(ts), sum(t in one for t in ts), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"room": 900, "entries": 50}])
def test_katz(hard, how):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, katz.score(hard, **how).collect())]
    assert sorted(got, key=str) == brute_katz(rows)


def test_katz_edges(hard, empty):
    assert katz.score(empty).count() == 0
    lone = katz.score(hard.filter("doc_id = 5")).first()
    assert lone.n_tokens == 1 and math.isfinite(lone.score)
    held = [r.doc_id for r in hard.collect() if r.doc_id and binascii.crc32(str(r.doc_id).encode()) % 10 == 0]
    only = katz.score(hard.filter(F.col("doc_id").isin(held)))
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in only.collect())


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i : i + 3])] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again),
        len(w) < 50 or 100 * len(again) > 50 * len(w),
    )


def test_counts(spark, hard):
    odd = ["a b c a b c", "a a a a", "x y z\nx y z\n \nx y z ", "#*$%&|<>", "a b", "\n\n", "é a é a é a\n|"]
    extra = spark.createDataFrame([(500 + i, t, None, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string")
    docs = hard.select("doc_id", "text", "lang", "source").unionByName(extra)
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in quality.judge(docs).collect())
    assert got == sorted(str((r.doc_id, *brute_counts(r.text))) for r in docs.collect())


def test_outliers(spark, empty):
    pick = random.Random(8)
    rows = [(i, prose(pick, pick.randint(60, 900)), "en" if i % 2 else None, "a" if i % 3 else "b") for i in range(240)]
    junk = [" ".join(w + pick.choice("#*$%") * 3 for w in prose(pick, 200).split()) for _ in range(12)]
    junk += [" | ".join(prose(pick, 200).split()) for _ in range(12)]
    rows += [(1000 + i, t, "en" if i % 2 else None, "a") for i, t in enumerate(junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(got[i] for i in range(240)) and not any(got[1000 + i] for i in range(24))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 240
    assert quality.judge(empty).count() == 0


def test_distance_is_that_of_the_core(spark):
    """Without shrinking, floor and steps, a group's estimate is mean and covariance of its nearest rows."""
    import numpy as np

    pick = np.random.Generator(np.random.PCG64(3))
    x = pick.normal(size=(400, quality.P)) @ pick.normal(size=(quality.P, quality.P))
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], ["_q_group", *quality.FEATURES])
    estimate = quality._estimate(df, 0.0, 0.0, 1.0)
    got = {tuple(round(v, 6) for v in r[1 : quality.P + 1]): r["_q_d"] for r in quality._distance(df, estimate).collect()}
    c = x - x.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", c, np.linalg.inv(c.T @ c / len(x)), c)
    assert all(math.isclose(got[tuple(round(float(v), 6) for v in r)], w, rel_tol=1e-6) for r, w in zip(x, want))


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(full.values())
        total = sum(weight[s] for s in rest)
        above = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return full | {s: left * weight[s] / total for s in rest}
        full |= {s: 2.0 * sizes[s] for s in above}


def test_mixing(hard, empty):
    rows = mixing.taken_words(hard, block=16).collect()
    assert len(rows) == hard.count()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) < 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken_words(hard.repartition(7), block=16).collect()))
    assert mixing.taken_words(empty).count() == 0


def test_schedule_spreads_sources(hard):
    taken, _ = mixing.mix(hard, block=16)
    slots = [r.src for r in taken.select("slot", "src").distinct().orderBy("slot").collect()]
    whole = collections.Counter(slots)
    for part in range(1, 9):  # every prefix has about the shares of the whole
        n = len(slots) * part // 8
        seen = collections.Counter(slots[:n])
        assert all(abs(seen[s] - whole[s] * n / len(slots)) <= 3 for s in whole)


def test_mixed_documents(hard, empty):
    docs = mixing.mixed_documents(hard, block=16)
    assert docs.columns == hard.columns and mixing.mixed_documents(empty).count() == 0
    times = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    own = collections.Counter((r.doc_id, r.text) for r in hard.collect())
    assert all(times[k] <= 2 * own[k] for k in times) and docs.count() > 0.8 * hard.count()


RULED = [
    ("http://x.net/a", "x.net", "/a", "net/", "block"), ("https://www.Example.NET/en/5", "www.example.net", "/en/5", "example.net/en/", "allow"),
    ("http://example.net/de/5?q=/en/", "example.net", "/de/5", "net/", "block"), ("x://a.example.com/de/", "a.example.com", "/de/", "example.com/de/", "block"),
    ("http://b.org/fr/9#x", "b.org", "/fr/9", "org/fr/", "allow"), ("http://x.net", "x.net", "", None, None), ("http://notexample.com/de/", "notexample.com", "/de/", None, None),
    (None, "", "", None, None), ("no scheme", "", "", None, None), ("", "", "", None, None), ("http://x.net?y=/", "x.net", "", None, None),
    ("a\nb://x.net/", "x.net", "/", "net/", "block"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(RULED)], "page_id long, url string, _u_x string")
    got = urls.filter_urls(df, df.select("url", F.lit(None).cast("int").alias("bad"))).orderBy("page_id").collect()
    for r, (_, host, path, rule, verdict) in zip(got, RULED, strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.filter_urls(df.filter("false"), df.select("url", F.lit(1).alias("bad"))).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "http://a.org/fr/x", "h", "p", "v", "own")], "page_id long, url string, host string, path string, verdict string, rule string")
    found = urls.filter_urls(df, df.select("url", F.lit(None).cast("int").alias("bad")))
    assert sorted(found.columns) == ["bad_probability", "host", "page_id", "path", "rule", "url", "verdict"]
    r = found.first()
    assert (r.host, r.path, r.rule, r.verdict) == ("a.org", "/fr/x", "org/fr/", "allow")
    pages = spark.createDataFrame([(1, "<article><p>Body text</p></article>", "mine")], "page_id long, html string, text string")
    out = html.extract(pages)
    assert out.columns == ["page_id", "text"] and out.first().text == "Body text"


def test_trees_learn_from_labels(spark):
    pick = random.Random(6)
    rows = []
    for i in range(900):
        bad = int(i % 3 == 0)
        host = f"{pick.choice(['win', 'bet', 'pill'])}-{pick.randint(100, 9999)}.shop" if bad else f"{pick.choice(['news', 'blog', 'city'])}.site"
        rows.append((i, f"http://{host}/{'x/' * pick.randint(0, 3)}{pick.randint(1, 99)}" + ("?a=1&b=2&c=3" if bad else ""), bad))
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    judged = urls.filter_urls(df.filter("page_id >= 600"), df.filter("page_id < 600").select("url", "bad")).collect()
    right = sum((r.verdict == "block") == bool(r.bad) for r in judged)
    assert len(judged) == 300 and right >= 290


def test_suffix_shares_over_all_labels(spark):
    # Hosts differ in their labels only: 20 hosts of 40 URLs, one URL has a third of all rows, the trees see a tenth.
    rows = [(f"http://h{h:02d}.one.site/{h}{i:02d}", int(h < 8), 1) for h in range(20) for i in range(40)]
    rows.append(("http://many.site/000", 0, 400))
    labelled = spark.createDataFrame(rows, "url string, bad int, n int")
    labelled = labelled.select("url", "bad", F.explode(F.sequence(F.lit(1), "n"))).drop("col").repartition(4)
    model, (tops, sites, prior) = urls.train(labelled, sample=80)
    assert prior == 320 / 1200 and tops.collect() == [("site", (320 + 20 * prior) / 1220)]
    shares = {r._u_site: r._u_domain for r in sites.collect()}
    assert len(shares) == 21 and shares["many.site"] == 20 * prior / 420
    assert all(shares[f"h{h:02d}.one.site"] == (40 * (h < 8) + 20 * prior) / 60 for h in range(20))
    new = spark.createDataFrame([(h, f"http://h{h:02d}.one.site/{h}99") for h in range(20)], "page_id long, url string")
    judged = urls.filter_urls(new, labelled, sample=80).collect()
    assert {r.page_id for r in judged if r.verdict == "block"} == set(range(8))


def test_tree_sample(spark):
    rows = [(f"http://a.site/{i}", 0, "a.site", 1) for i in range(300)] + [("http://many.site/", 0, "many.site", 500)]
    rows = spark.createDataFrame(rows, "url string, bad int, _u_site string, _u_n long")
    drawn = urls.draw(rows, 50).collect()
    weights = {r.url: r._u_weight for r in drawn}
    assert len(drawn) == len(weights) == 50 and weights["http://many.site/"] == 500
    assert abs(sum(weights.values()) - 800) < 150
    assert {r._u_weight for r in urls.draw(rows, 301).collect()} == {1, 500}


PAGES = [
    ("<body><nav><a>x</a></nav><article><h1>A &amp; B</h1><p>One  <b>bold</b>\n text.<br>Two<p>Of.</article><footer>f</footer>", "A & B\nOne bold text. Two\nOf."),
    ('<div class="cookie-notice">We use cookies</div><div id="main"><h1>T</h1><p>Hello there, this is an article.</p></div><div class="sidebar"><p>me</p></div>', "T\nHello there, this is an article."),
    ("<header><h1>Site</h1></header><article><h2>T</h2><p>Main.</p><form><p>Sign up</p></form><aside class='ad'>Buy</aside><p>More.</p></article>"
     "<section class=comments><h2>C</h2><article class=comment><p>first comment here</p></article></section>", "T\nMain.\nMore."),
    ("<article><p>a < b &lt; c &#233; &copy</p><script>var x='</p>';</script><style>p{}</style><!-- no --><p>cut &am", "a < b < c é ©\ncut &am"),
    ('<div class="article"><p>Some text</p><ul><li>one</li><li>two</li></ul></div><div class="ad">Buy</div>', "Some text\none\ntwo"),
    (None, ""), ("", ""), ("   ", ""), ("<article>" + "<p>w w</p>" * 3000, "\n".join(["w w"] * 3000)),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, p[0], "u") for i, p in enumerate(PAGES)], "page_id long, html string, url string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(len(PAGES))] == [p[1] for p in PAGES]
    assert html.extract(df.filter("false")).count() == 0


def test_held_out_layouts():
    from dumpdeck.llm.html_layouts import labelled_pages

    model, right, n = html.fit(), 0, 0
    for page in labelled_pages(rounds=6, seed=99):
        nodes = html.parse(page)
        labels = []
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            up = labels[node.parent] if node.parent >= 0 else 0
            labels.append(1 if "data-main" in node.attributes else 0 if "data-rest" in node.attributes else up)
            if node.runs:
                n += 1
                right += (p >= 0.5) == labels[-1]
    assert right / n > 0.97


def _accuracy(model, pages):
    right = n = 0
    for page in pages:
        nodes = html.parse(page)
        labels = []
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            up = labels[node.parent] if node.parent >= 0 else 0
            labels.append(1 if "data-main" in node.attributes else 0 if "data-rest" in node.attributes else up)
            if node.runs:
                n += node.chars
                right += node.chars * ((p >= 0.5) == labels[-1])
    return right / n


def test_kinds_of_layouts_held_out():
    """Share of characters judged right on pages of one body that no training page has."""
    from dumpdeck.llm import html_layouts

    bodies = [*html_layouts.BODIES, *html_layouts.PLAIN, *html_layouts.BARE]
    found = []
    for body in bodies:
        model = html.Model(html.labelled(without=frozenset([body])))
        others = frozenset(b for b in bodies if b != body)
        found.append(_accuracy(model, html_layouts.labelled_pages(rounds=8, seed=5, without=others)))
    assert sum(found) / len(found) > 0.9


LONG = "The bridge opens again in spring, and nobody had expected it. " * 30


@pytest.mark.parametrize(
    "page",
    [
        "<body><div>{}</div></body>",
        "<body><div><div><p>{}</p></div></div></body>",
        "<center>{}</center>",
        "{}",
        "<html><body>{}</body></html>",
        "<table><tr><td><a href=x>Home</a></td><td>{}</td></tr></table>",
    ],
)
def test_plain_layouts(page):
    model = html.fit()
    assert LONG.strip() in html.main_text(page.format(LONG), model)
    assert html.main_text("", model) == ""


def test_deep_nesting():
    for tags in ("<div>", "<table>", "<ul><li>", "<p><b>", "<svg/>", "<section><p>"):
        start = time.process_time()
        nodes = html.parse(tags * 50_000 + "x")
        assert time.process_time() - start < 8 and nodes
        assert "x" in " ".join(t for n in nodes for _, t in n.runs)


def test_marginals_by_enumeration():
    """Messages give what summing over all labellings gives."""
    model = html.fit()
    nodes = html.parse("<body><div class=post><p>Some text here.</p><p><a>x</a></p></div><aside><p>y</p></aside></body>")
    weights = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        log = model.root[labels[0]]
        for i, node in enumerate(nodes):
            log += sum(model.nodes[pair][labels[i]] for pair in html.evidence(node) if pair in model.nodes)
            if i:
                log += model.edge(nodes[node.parent], node)[labels[node.parent]][labels[i]]
        p = math.exp(log)
        total += p
        weights = [w + p * y for w, y in zip(weights, labels)]
    assert all(math.isclose(w / total, m, abs_tol=1e-9) for w, m in zip(weights, model.marginals(nodes)))
