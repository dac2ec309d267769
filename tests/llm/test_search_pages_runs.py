"""Ranked search, main text of pages and periodic runs against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from runlake.llm import lexical_search as L
from runlake.llm import main_text as M
from runlake.llm import periodic_runs as R
from runlake.llm.page_markup import parse
from runlake.llm.recompression import Grammar

# ranked search -----------------------------------------------------------------


def _terms(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def _ranked(docs, items, k=10):
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, length = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, size in held:
            m = 10 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in set(_terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def _documents():
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(60)] + ["É", "日本", "x9"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 60)))) for i in range(150)]
    docs += [(None, docs[3][1]), docs[4], docs[4], (900, None), (901, ""), (902, " .,; "), (903, "V1 v1,V1;v2" * 3), (904, "v1 " * 30_000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 25)))) for i in range(12)]
    return docs, items + [(None, "v1 v2"), (50, None), (51, "nowhere"), (52, "v1 v2 v3 v4"), (53, "v1 v2 v3 v5"), (53, "v1 v2 v3 v5")]


@pytest.mark.parametrize("block_words", [50_000, 40])
def test_search_equals_brute_force(spark, block_words):
    docs, items = _documents()
    d = spark.createDataFrame([(*x, 1, "n") for x in docs], "doc_id bigint, text string, score int, rank string").repartition(5)
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id bigint, text string, doc_id int")
    got = [tuple(r) for r in L.ranked_search(d, b, block_words=block_words).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=repr) == _ranked(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = _documents()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert L.ranked_search(d.limit(0), b).count() == 0
    assert L.ranked_search(d, b.limit(0)).count() == 0


def test_query_plan_adds_every_term_once():
    r = random.Random(2)
    items = [set(r.sample(range(80), r.randint(0, 30))) for _ in range(60)]
    plan = L.query_plan(items, 80, reach=8)
    parts = np.array([[7 ** (t % 5) * (t + 1) * (d + 1) for d in range(3)] for t in range(80)], np.int64)
    got = dict(zip(plan.filled.tolist(), plan.scores(parts).tolist()))
    assert got == {i: parts[sorted(s)].sum(axis=0).tolist() for i, s in enumerate(items) if s}
    adds = len(plan.flat) - len(plan.filled) + plan.n_nodes - 80
    assert adds < sum(len(s) - 1 for s in items if s)  # less work than item by item


# periodic runs -------------------------------------------------------------------


def _runs(words):
    n, out, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and (i, j) not in seen:
                seen.add((i, j - i + q))
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    smallest = {}
    for s, length, q in out:
        smallest.setdefault((s, length), q)
    return sorted((s, length, q) for (s, length), q in smallest.items())


def _word_lists():
    r = random.Random(8)
    out = [[], ["x"], ["x"] * 5, ["x"] * 6, ["x"] * 5000, ["a", "b"] * 4, ["a", "b"] * 3, ["a", "a", "b"] * 40 + ["a"]]
    for _ in range(250):
        words = [str(r.randrange(r.randint(1, 4))) for _ in range(r.randint(0, 70))]
        if words and r.random() < 0.6:
            a, p = r.randrange(len(words)), r.randint(1, 9)
            words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
        out.append(words)
    return out


def test_grammar_extensions_and_round_trip():
    r = random.Random(4)
    for words in _word_lists()[:120]:
        s = np.array([-2, *(int(w) if w.isdigit() else ord(w) for w in words), -3]) + 3
        g = Grammar(s)
        assert (g.expand() == s).all()
        pairs = [sorted(r.sample(range(len(s)), 2)) for _ in range(20)]
        i, j = np.array(pairs).T
        ahead = [next(k for k in range(len(s)) if y + k == len(s) or s[x + k] != s[y + k]) for x, y in pairs]
        back = [next(k for k in range(len(s) + 1) if k > x or s[x - k] != s[y - k]) for x, y in pairs]
        assert g.extension(i, j).tolist() == ahead and g.extension_back(i, j).tolist() == back


def test_runs_equal_brute_force(spark):
    texts = [None, "", " \t\n", "x x x x x x x"] + ["  ".join(w) for w in _word_lists()]
    rows = [(i, t, 5, "c") for i, t in enumerate(texts)] + [(None, "x " * 9, 5, "c"), (7, texts[8], 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, collapsed string").repartition(4)
    got = R.periodic_runs(docs).collect()
    want = []
    for i, t, *_ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = _runs(words)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert R.periodic_runs(docs.limit(0)).count() == 0


def test_runs_query_equals_brute_force(spark, tmp_path):
    from runlake.llm.catalog import QUERIES
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 120)))) for i in range(120)]
    spark.createDataFrame([*docs, (None, "z " * 8)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    changed = 0
    for i, t in [*docs, (None, "z " * 8)]:
        words = (t or "").split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g, changed = h // 10, changed + 1
            a = g % n
            words = [w if k < a else words[a + (k - a) % (1 + (n - a) // (3 + g % 8))] for k, w in enumerate(words)]
        runs = _runs(words)
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        x = got[i]
        assert (x["start"], x["length"], x["period"]) == (best or (None,) * 3)
        assert x["exponent_milli"] == (1000 * best[1] // best[2] if best else None) and x["n_runs"] == len(runs)
        assert x["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % y for y in runs).encode()).hexdigest()
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert x["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert changed > 3


# main text of pages ---------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p > b {{x}}</style></head><body class="home">
<div class="top-menu"><a href="/">Home</a></div><div id="w1"><p>Welcome to our site</p></div>
<div class="text"><h2>Heading {i}</h2><p>First   part &amp; {i}<br>and <b>bo</b>ld &lt;x&gt;<p>Second {i}{more}</div>
<div id="w2"><span>Made with care</span></div>
<section class="reader-comments"><p>Comment {i} says a lot of things at length, longer than the text itself</p></section>
<form><p>Mail {i}</p></form><script>if (a < b) "</p>"</script></body>"""


def _site(n, host="a.example"):
    long = " with a good many words of its own that only this page has"
    return [(i, f"http://{host}/{i}", PAGE.format(i=f"{i}{chr(97 + i)}", more=f"{i}{long}")) for i in range(n)]


def test_template_of_a_site_without_articles(spark):
    pages = _site(8)
    df = spark.createDataFrame([(*p, 1, "s") for p in pages], "page_id int, url string, html string, site int, text string")
    got = {r["page_id"]: r["text"] for r in M.main_texts(df.repartition(3)).collect()}
    for i, _, _ in pages:
        x = f"{i}{chr(97 + i)}"
        assert got[i] == (f"Heading {x}\nFirst part & {x} and bold <x>\n"
                          f"Second {x}{i} with a good many words of its own that only this page has")


def test_classes_share_vectors_and_nest(spark):
    pages = [(i, u, h if i % 2 else h.replace("<div id=\"w2\">", "<div class=note-box><i>Odd</i><u>page</u></div><div id=\"w2\">"))
             for i, u, h in _site(10)]
    df = spark.createDataFrame(pages, "page_id int, url string, html string")
    rows = M.identified(df, "page_id", "url", "html").withColumn("site", M.F.lit("a.example"))
    skeleton = M.stored(rows.select(*M.ROW_ID, "site", "html").mapInArrow(M._skeleton, M.SKELETON), "skeleton")
    one = M.templates(skeleton).first()
    assert one["site"] == "a.example" and one["container"].endswith("div.text")
    root = [t for t in one["template"] if t["root"]]
    tokens = {t["token"] for t in root}
    for text in ("Welcome to our site", "Made with care", "Home"):
        piece = next(p for p in parse(pages[0][2]) if p.text == text)
        assert M._token(piece) in tokens
    inner = {t["cls"] for t in one["template"] if not t["root"]}
    odd = [t for t in one["template"] if t["cls"] in inner and len([x for x in one["template"] if x["cls"] == t["cls"]]) >= M.CLASS_SIZE]
    assert odd and len({t["slot"] for t in odd if t["cls"] == odd[0]["cls"]}) == 1


def test_pages_with_an_article(spark):
    body = ("<nav>menu<header>Site</header><article><header><h1>Ti&eacute;le</h1></header><div class='ad'>Buy</div><p>One&nbsp; \n two"
            "<aside>see also</aside><p>Three</p><article class=comment><p>me too</p></article></article><footer>&copy; x")
    same = "<body><article><p>Only text</p></article><p>out</p></body>"
    rows = [(1, "http://b/1", body), (2, None, body), (3, "no scheme", same), (4, "http://c/", same), (5, "http://c/", same), (6, "http://c/2", same),
            (7, "http://d/", None), (8, "http://d/", ""), (9, "http://d/", "plain text & more"), (None, "http://e/", "<main><p>m</p></main>x"),
            (10, "http://f/", "<article><p>" + "long word " * 60_000), (11, "http://g/", "<p>a<script>b</p>"), (12, "http://g/", "<<p>>x<a title='>'>y")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((tuple(r) for r in M.main_texts(df).collect()), key=repr)
    text = {1: "Tiéle\nOne two\nThree", 2: "Tiéle\nOne two\nThree", 3: "Only text", 4: "Only text", 5: "Only text", 6: "Only text", 7: "", 8: "",
            9: "plain text & more", None: "m", 10: ("long word " * 60_000).strip(), 11: "a", 12: "<\n>xy"}
    assert got == sorted(((i, u, text[i]) for i, u, _ in rows), key=repr)
    assert M.main_texts(df.limit(0)).count() == 0
