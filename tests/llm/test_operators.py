"""The training-data operators against brute force, and at nulls, empty and repeated rows, ties and clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoweave.llm import classifier, decontaminate, html_text, mixing, near_dup, pseudo_likelihood, quality_rules, reply_trees, sharding, warc_zip
from chronoweave.llm import text_hash as H
from chronoweave.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, voc=400):
    return " ".join(f"w{rng.randrange(voc)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and blank texts, a long one, repeated rows, and columns named as results are."""
    rng = random.Random(1)
    long = words(rng, 30_000, 5000)
    rows = [(1, None, None, None, None), (None, "some text here", "en", "a", 3), (2, "", "en", "a", 0), (3, " \n\t", None, "b", 3), (4, long, "de", "b", len(long)), (5, "one two", "en", None, 7), (5, "one two", "en", None, 7), (6, "one two", "en", "b", 7), (7, "x" * 50_000, "en", "a", 1)]
    extra = ["size", "score", "kept", "class", "tokens", "windows", "lines", "bands", "rate", "copies", "shard", "n_words", "label"]
    return spark.createDataFrame([(*r, *[0] * len(extra)) for r in rows], DOCS + "".join(f", {c} int" for c in extra))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    rng = random.Random(k)
    texts = {}
    for base in range(12):  # families with from few to many edits, chained and shuffled
        text = words(rng, rng.choice([4, 7, 30, 120, 400]), 3000).split()
        for _ in range(rng.choice([2, 6, 12])):
            text = list(text) if rng.random() < 0.5 else text
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(3000)}"
            texts[len(texts) * 7 % 1009] = " ".join(text).upper() if rng.random() < 0.1 else " ".join(text)
    texts[2000], texts[2001] = "", None
    got = near_dup.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k, num, 100).collect()
    want = brute_components(texts, k, num, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_one_group(spark):
    """A large group of copies with few to many edits: some chain, some are near to none, and all share buckets."""
    rng = random.Random(22)
    base = words(rng, 150, 3000).split()
    texts = {}
    for i in range(260):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(40)}"
        texts[i] = " ".join(text)
    texts |= {1000 + i: " ".join(base[:60]) + " " + words(rng, rng.randrange(5, 40), 3000) for i in range(60)}
    got = near_dup.cluster(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, 80, 100).collect()
    want = brute_components(texts, 5, 80, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({c for _, c in want.values()}) > 20


def test_similarities_beyond_the_bands():
    assert [near_dup.rows_per_band(t) for t in (0.85, 0.8, 0.5)] == [6, 5, 1]
    for low in (0.2, 0.0, 1.5):
        with pytest.raises(ValueError):
            near_dup.rows_per_band(low)


def test_rows_of_one_id(spark):
    rng = random.Random(23)
    text, other = words(rng, 60, 3000), words(rng, 60, 3000)
    docs = spark.createDataFrame([(3, text), (5, text), (5, other), (None, text)], "doc_id long, text string")
    left = sorted((r["doc_id"] or 0, r["text"]) for r in near_dup.keep_first(docs).collect())
    assert left == sorted([(3, text), (5, other), (0, text)])


def test_near_duplicate_edges(odd, none):
    got = near_dup.cluster(odd, 3, 85, 100).collect()
    assert len(got) == 9 and [r["component_id"] for r in got if r["doc_id"] in (5, 6)] == [5, 5, 5]
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(1, None, True)]
    assert [r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    assert near_dup.cluster(none).count() == 0
    assert sorted(r["doc_id"] or 0 for r in near_dup.keep_first(odd).select("doc_id").collect()) == [0, 1, 2, 3, 4, 5, 5, 7]


def test_hyperminhash_estimates():
    rng = random.Random(4)
    m = 240
    order = near_dup._order(m)
    rank = np.argsort(order, axis=1)
    for share in (0.5, 0.85, 0.95):
        misses = []
        for _ in range(40):
            n = rng.choice([20, 100, 1000])
            both = int(n * share)
            pools = [rng.sample(range(1 << 62), n + (n - both)) for _ in range(1)][0]
            a, b = pools[:n], pools[:both] + pools[n:]
            h = [np.sort(H.mixed(np.array(x, dtype=np.uint64))) for x in (a, b)]
            regs = near_dup.registers(np.concatenate(h), np.array([0, len(h[0]), len(h[0]) + len(h[1])]), m, order, rank)
            misses.append(near_dup.estimate(regs[:1], regs[1:])[0] - both / (2 * n - both))
        assert abs(np.mean(misses)) < 0.03 and np.std(misses) < 0.06


def test_template_removal(spark):
    box = '<div class="x1"><p>Follow us &amp; win</p></div>'
    page = lambda n: f"<html><body><nav><a>Home</a></nav><article><h1>T{n}</h1>{box}<p>Body  one\n{n}<br>two <b>bo</b>ld</p><p>more text so that the box is small {n}</article><footer>f</footer>"
    rows = [(n, f"https://u@A.example:80/{n}", page(n)) for n in range(12)] + [(90, "https://b.example/", page(90)), (91, None, None), (92, "x", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 Body one 3 two bold more text so that the box is small 3"
    assert got[90] == "T90 Follow us & win Body one 90 two bold more text so that the box is small 90"
    assert got[91] == got[92] == ""
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert html_text.main_text(html_text.parse(deep)) == "deep"
    furniture = '<header>h</header><div id="main-content"><p>a &lt;b&gt; &eacute;</div><div class="user-comments">c</div><aside>s</aside><form>f</form><div role="alert">n</div><script>"</p>"</script>'
    assert html_text.main_text(html_text.parse(furniture)) == "a <b> é"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_of_any_element(spark):
    """Recurring p, h2, li and span go wherever they stand; words of a sentence stay; pages of one text count once."""
    page = lambda n, more="": f"<html><body><div>Unnamed bar</div>{more}<h1>T{n}</h1><p>Terms apply, see <b>here</b></p><h2>Read on</h2><ul><li>Home</li><li>own {n}</li></ul><p><span>Print it</span></p><p>Body {n} is <b>here</b></p></body></html>"
    rows = [(n, f"https://a.example/{n}", page(n)) for n in range(12)] + [(100 + n, f"https://c.example/{n}", page(7, "<i></i>" * n)) for n in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T3 own 3 Body 3 is here"
    assert got[103] == "Unnamed bar T7 Terms apply, see here Read on Home own 7 Print it Body 7 is here"
    root = html_text.parse("<nav><a>x</a></nav><article><p>one <a>two</a></p></article>")
    assert len(html_text.template_candidates(root)) == 4  # nav and its a, article, p; not the link amid text


def test_template_of_large_host_and_short_articles(spark):
    notice = "<div><p>A long notice that holds most of the text of any short article it is put in</p></div>"
    rows = [(n, f"https://a.example/{n}", f"<article><p>Body {n}</p>{notice if n < 10 else ''}</article>") for n in range(400)]
    rows += [(1000 + n, f"https://b.example/{n}", f"<article>{notice}</article><p>Page {n}</p>") for n in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[n] == f"Body {n}" for n in range(400))  # 10 pages of 400 are under 5 %
    assert all(got[1000 + n].startswith("A long notice") for n in range(9))  # 9 pages are no evidence


def test_templates_by_brute_force(spark):
    """Boxes counted per host in plain Python, on hosts of every size: a box goes if as many different articles carry it
    in one place; sentences and titles that articles share stay, as do copies of an article."""
    rng = random.Random(23)
    shared = ["Many articles say this.", "And some say that."]
    pages, expect, seen = [], {}, Counter()
    for host, n in [("a.example", 40), ("b.example", 5), ("c.example", 2), ("d.example", 12)]:
        boxes = [f"<div class='k{b}'><p>{host} box {b}</p><ul><li>entry {b}</li></ul></div>" for b in range(4)]
        for _ in range(n):
            body = [f"body {rng.randrange(10**6)}" for _ in range(3)] if host != "d.example" else ["the same", "article", "again"]
            title = rng.choice([*shared, "Daily news"])
            last = rng.choice(shared)
            box = rng.choice([None, 0, 1, 2, 3])
            parts = [f"<h1>{title}</h1>", *[f"<p>{x}</p>" for x in body], f"<p>{last}</p>"]
            at = rng.randrange(1, len(parts) + 1)
            html = "".join([*parts[:at], "" if box is None else boxes[box], *parts[at:]])
            pages.append((host, f"<body><div>top {rng.randrange(3)}</div><article>{html}</article></body>", [title, *body, last], at, box))
    main = lambda texts, at, box, host: " ".join([*texts[:at], *([] if box is None else [f"{host} box {box}", f"entry {box}"]), *texts[at:]])
    for host, box in {(h, b) for h, _, _, _, b in pages if b is not None}:
        seen[host, box] = len({main(t, at, b, h) for h, _, t, at, b in pages if (h, b) == (host, box)})
    for k, (host, _, texts, at, box) in enumerate(pages):
        expect[k] = main(texts, at, None if seen[host, box] >= html_text.MIN_PAGES else box, host)
    rows = [(k, f"https://{p[0]}/{k}", p[1], "x", k) for k, p in enumerate(pages)]
    docs = spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string, host string, subtrees int")
    got = html_text.extract(docs).collect()
    assert {r["page_id"]: r["text"] for r in got} == expect and len(got) == len(rows) + 1
    assert any(n < html_text.MIN_PAGES for n in seen.values()) and any(n >= html_text.MIN_PAGES for n in seen.values())


def test_broken_declarations():
    text = lambda html: html_text.main_text(html_text.parse(html))
    assert text("<p>one</p><![foo[x]]><p>two</p>") == "one two"
    assert text("<p>one</p><![1]><p>two</p><![if x]><p>three</p>") == "one two three"
    assert text("<p>a <![ b</p><p>two</p>").endswith("two") and "rest" in text("a <![ rest")
    rng = random.Random(9)
    for _ in range(3000):
        text("".join(rng.choice(["<!", "[", "]", ">", "<", "-", "--", "a", "CDATA", "if", " ", "1", "&", "/", "?", "doctype", "<p>", '"']) for _ in range(rng.randrange(25))))


def test_classifier(spark, odd, none):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(300):
        good = rng.random() < 0.6
        text = " ".join(w if good else w.upper() + "!!" for w in words(rng, 40).split()) if i % 3 else (words(rng, 40) if good else " ".join(words(rng, 3).split() * 15))
        rows.append((i, text))
        marks.append((i, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = classifier.score(docs, labels).collect()
    truth = dict(marks)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in marks if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    other = classifier.score(odd, labels).collect()
    assert len(other) == 9 and all(0 <= r["score"] <= 1 for r in other)
    assert classifier.score(none, labels).count() == 0
    assert {r["score"] for r in classifier.score(odd, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}


def test_pseudo_likelihood(spark, odd, none):
    rng = random.Random(8)
    order = " ".join(f"w{k}" for k in range(12))
    rows = [(i, " ".join([order] * 12)) for i in range(300)] + [(1000, " ".join(rng.sample(order.split(), 12)))] + [(1001, order)]
    got = {r["doc_id"]: r for r in pseudo_likelihood.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1001]["mean_pll"] > got[1000]["mean_pll"] and got[1001]["n_tokens"] == 12
    assert abs(got[1001]["pll"] - 12 * got[1001]["mean_pll"]) < 1e-9
    empty = {r["doc_id"]: r for r in pseudo_likelihood.score(odd).collect()}
    assert empty[1]["pll"] == 0 and empty[1]["mean_pll"] is None and empty[4]["n_tokens"] == 30_000
    assert pseudo_likelihood.score(none).count() == 0


def test_every_position_is_an_example():
    """Each position of each text, however short, is an example of one round, with its neighbours."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, pseudo_likelihood.TOKENS, n).tolist() for n in [0, 1, 2, 3, 5000, 23, *rng.integers(0, 60, 60), 4096]]
    side, edge = pseudo_likelihood.SIDE, pseudo_likelihood.TOKENS
    for t in texts:
        p = [edge] * side + t + [edge] * side
        want = Counter((*p[k - side : k], *p[k + 1 : k + side + 1], p[k]) for k in range(side, len(p) - side))
        got = Counter()
        for piece in pseudo_likelihood._pieces(np.array(t, dtype=np.int32)):
            for rnd in range(pseudo_likelihood.ROUNDS):
                got.update(map(tuple, pseudo_likelihood._examples(piece, rnd).T.tolist()))
        assert got == want


def test_scores_do_not_depend_on_the_layout(spark):
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randrange(0, 120), 6000)) for i in range(400)] + [(400, "one two"), (400, "one two"), (None, "three")]
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    seen = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows if parts == 1 else rows[::-1], "doc_id long, text string").repartition(parts)
        lm = sorted((r["doc_id"] or -1, r["n_tokens"], round(r["pll"], 2)) for r in pseudo_likelihood.score(docs).collect())
        quality = sorted((r["doc_id"] or -1, r["score"]) for r in classifier.score(docs, marks).collect())
        seen.append((lm, quality))
    assert seen[0][1] == seen[1][1]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) <= 0.02 for a, b in zip(seen[0][0], seen[1][0], strict=True))


def test_rare_words_by_their_counts(spark):
    """Words of one bucket, alone in their texts, differ by the logarithm of their counts; copies of a text by nothing."""
    common = [f"c{k}" for k in range(pseudo_likelihood.VOCABULARY)]
    buckets = defaultdict(list)
    for k in range(300):
        buckets[int(H.word_hashes([f"r{k}"])[0][0]) % pseudo_likelihood.PER_CLASS].append(f"r{k}")
    often, once = next(w for w in buckets.values() if len(w) > 1)[:2]
    texts = [" ".join(common)] * 7 + [often] * 6 + [once]
    got = pseudo_likelihood.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    pll = {r["doc_id"]: r["pll"] for r in got}
    assert abs(pll[7] - pll[13] - np.log(6)) < 1e-9 and len({round(pll[k], 9) for k in range(7, 13)}) == 1


def test_gradient():
    net = pseudo_likelihood.Net()
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 50, (4, 256)).astype(np.int32), rng.integers(0, 50, 256).astype(np.int32)
    before = net.log_likelihood(context, target).mean()
    power = np.zeros(len(net.rows))
    for _ in range(30):
        net.step(context, target, power)
    assert net.log_likelihood(context, target).mean() > before + 1
    full = np.stack([net.log_likelihood(context[:, :1], np.array([t], dtype=np.int32)) for t in range(pseudo_likelihood.TOKENS)])
    assert abs(np.exp(full).sum() - 1) < 1e-4


def test_quality_rules(spark, odd, none):
    rng = random.Random(5)
    plain = [words(rng, 120, 3000) for _ in range(80)]
    bad = [" ".join(words(rng, 4).split() * 40) for _ in range(10)] + [" | ".join(words(rng, 100, 3000).split()) for _ in range(10)] + ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ ") for _ in range(600)) + "!" * 80 for _ in range(10)]
    got = quality_rules.judge(spark.createDataFrame(list(enumerate(plain + bad)), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(80))
    # the posterior outvotes a rule that finds itself alone, and no rule's bad vote is final
    short = [words(rng, 60, 3000) for _ in range(30)]
    told = quality_rules.judge(spark.createDataFrame(list(enumerate(plain + bad + short)), "doc_id long, text string")).collect()
    kept = {r["doc_id"] for r in told if r["kept"]}
    assert kept == set(range(80)) | set(range(110, 140)) and all(r["v_brief"] == -1 for r in told if r["doc_id"] >= 110)
    assert any(r["v_symbols"] == -1 and r["v_repeats"] == 1 and not r["kept"] for r in told)  # good votes don't save it
    patterns = [((1, 1, 1), 900), ((-1, 1, 1), 60), ((1, -1, -1), 30), ((0, -1, -1), 10)]
    prior, odds = quality_rules.fit(patterns)
    posterior = lambda v: prior + sum(o[x] for o, x in zip(odds, v, strict=True))
    assert posterior((-1, 1, 1)) > 0 > posterior((1, -1, -1)) and posterior((0, -1, -1)) < 0
    edge = {r["doc_id"]: r for r in quality_rules.judge(odd).collect()}
    assert all(edge[k]["n_words"] == 0 and edge[k]["base_failed"] and not edge[k]["kept"] for k in (1, 2, 3))
    assert quality_rules.judge(none).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_rules_are_outvoted_and_add_up(spark):
    """Any of four rules that finds itself alone loses; texts without a fault of the base go by several weak votes; a
    long text is judged as a short one is."""
    rng = random.Random(21)
    plain = lambda n=120: words(rng, n, 3000)
    lined = lambda t: t + "\n" + "\n".join(["x y"] * 6)
    dotted = lambda t: " ".join(w + ".." for w in t.split())
    loud = lambda t: t + " " + "!" * 75
    wide = lambda t: " ".join(w * 5 for w in t.split())
    alone = {"lines": lined, "letters": dotted, "exclaims": loud, "word_length": wide}
    texts = [plain() for _ in range(300)] + [f(plain()) for f in alone.values() for _ in range(30)]
    faulty = [loud(dotted(lined(plain()))) for _ in range(15)] + [" ".join(f"{w.upper()}#|" for w in plain().split()) for _ in range(15)]
    long = [plain(4000), " ".join(words(rng, 4000, 30).split())]
    got = {r["doc_id"]: r for r in quality_rules.judge(spark.createDataFrame(list(enumerate(texts + faulty + long)), "doc_id long, text string")).collect()}
    against = lambda r: {x for x in quality_rules.RULES if r[f"v_{x}"] == -1}
    for k, rule in enumerate(alone):
        assert all(against(got[300 + 30 * k + j]) == {rule} and got[300 + 30 * k + j]["kept"] for j in range(30)), rule
    assert all(len(against(got[420 + k])) > 1 and not got[420 + k]["base_failed"] and not got[420 + k]["kept"] for k in range(30))
    assert got[450]["v_variety"] == 1 and got[451]["v_variety"] == -1


def test_rules_keep_columns_of_any_name(spark):
    extra = ["whole", "tokens", "windows", "lines", "row", "n_words", "v_brief", "quality_prob", "_0"]
    docs = spark.createDataFrame([(1, "some words here", *range(9)), (1, "some words here", *range(9)), (None, None, *range(9))], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    got = quality_rules.judge(docs).collect()
    assert len(got) == 3 and all([r[c] for c in ("whole", "tokens", "windows", "lines", "row", "_0")] == [0, 1, 2, 3, 4, 8] for r in got)
    assert sorted(r["n_words"] for r in got) == [0, 3, 3] and not any(r["kept"] for r in got)
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_repeat_words(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["a b\x0bc\td a b c", "é é é é é é x"]
    got = {r["doc_id"]: r for r in quality_rules.signals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = t.encode().split()
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(windows)
        covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
        assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (len(w), len(covered)), t


def test_shards(spark, odd, none):
    rng = random.Random(7)
    rows = [(i, "same text" if i % 3 else words(rng, rng.randrange(1, 60)), rng.choice(["en", "de", None]), f"s{rng.randrange(3)}", 0) for i in range(3000)]
    got = sharding.assign(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 3000
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        text = rows[r["doc_id"]][1].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 8, zlib.crc32(text))
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(24)) and max(sizes.values()) - min(sizes.values()) < 1200
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    edge = sharding.assign(odd).collect()
    assert len(edge) == 9 and all(0 <= r["shard"] < 24 for r in edge) and len({(r["shard"], r["slot"]) for r in edge}) == 9
    assert sharding.assign(none).count() == 0


def test_chat_trees(spark):
    tree = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good \\### x </turn>", 0.9), (1, 4, 3, "user", None, 0.0), (1, 5, 3, "user", "thanks\n### user:\n", 0.5), (2, 9, 77, None, "alone", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0)]
    nodes = spark.createDataFrame(tree, "tree long, node long, parent long, role string, text string, score double")
    got = {r["tree"]: r for r in reply_trees.conversations(nodes).collect()}
    assert set(got) == {1, 2}
    assert reply_trees.read_turns(got[1]["text"]) == [("user", "q"), ("assistant", "good \\### x </turn>"), ("user", "thanks\n### user:\n")]
    span = got[1]["loss_spans"][0]
    assert reply_trees.unescape(got[1]["text"][span["start"] : span["end"]]) == "good \\### x </turn>"
    every = reply_trees.paths(nodes, None).groupBy("tree", "leaf").count().collect()
    assert {(r["tree"], r["leaf"]): r["count"] for r in every} == {(1, 2): 2, (1, 4): 3, (1, 5): 3, (2, 9): 1}
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 5, "assistant", "é" * 3)] + [(2, t, "user", str(t)) for t in range(300)]
    told = {r["conv_id"]: r for r in reply_trees.digests(reply_trees.conversations(reply_trees.chain(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).collect()}
    assert told[1]["n_turns"] == 3 and told[2]["n_turns"] == 300 and told[None]["loss_chars"] == 3 and set(told) == {1, 2, None}
    assert reply_trees.digests(reply_trees.conversations(reply_trees.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def test_warc_archives(spark, tmp_path):
    big = "é" * 700
    rows = [(1, "http://a/ b", big), (2, None, big), (9, "http://c/", big), (9, "http://c/", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", big)]
    scratch = Scratch(spark, "warctest")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc_zip.write_archives(pages, f"file://{tmp_path}/z", scratch)
    got = warc_zip.read_archives(archives).collect()
    assert len(got) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == [(0, "response", None, 1400), (1, "revisit", 9, 1400), (2, "revisit", 9, 1400), (3, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (6, "response", None, 0), (9, "response", None, 1400), (9, "response", None, 1400)]
    assert all(r["payload"].decode() == big for r in got if r["page_id"] == 9)
    empty = warc_zip.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/y", scratch)
    assert warc_zip.read_archives(empty).count() == 0


def test_zip64(tmp_path):
    import io
    import zipfile

    for force in (False, True):
        out = io.BytesIO()
        w = warc_zip.ZipWriter(out, force64=force)
        w.begin(warc_zip.DATA)
        assert [w.data(b"abc"), w.data(b"de")] == [0, 3]
        w.end()
        w.begin(warc_zip.INDEX)
        w.data(b"0 3 1\n")
        w.end()
        w.close()
        out.seek(0)
        assert zipfile.ZipFile(out).read(warc_zip.DATA) == b"abcde"
        found = warc_zip.members(out, len(out.getvalue()))
        at, n = found[warc_zip.DATA]
        assert out.getvalue()[at : at + n] == b"abcde"


def test_decontamination(spark, odd, none):
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([15, 27, 40, 56]), 900)) for i in range(30)] + [(90, None), (91, ""), (92, "w1 w2")]
    docs, truth = [], set()
    for i, t in items[:30]:
        for e in (0.0, 0.05, 0.1):
            w = t.split()
            for _ in range(int(e * len(w))):
                w[rng.randrange(len(w))] = "zzz"
            docs.append((len(docs), f"{words(rng, rng.randrange(80), 50)} {' '.join(w).upper()} {words(rng, 30, 50)}"))
            truth.add((docs[-1][0], i))
    docs += [(len(docs) + k, words(rng, 200, 900)) for k in range(50)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(frame, bench).collect()}
    assert len(truth & got) >= 0.95 * len(truth)
    assert {(d, i) for d, i in truth if d % 3 == 0} <= got  # exact copies
    brute = set()
    for d, t in docs:
        for i, x in items:
            if x:
                a, b = (H.word_hashes([s])[0] for s in (x, t))
                if decontaminate.passage_distance(a, b)[0] <= int(decontaminate.EDITS * len(a)):
                    brute.add((d, i))
    assert got <= brute and len(got) >= 0.95 * len(brute)
    cleaned = decontaminate.clean(frame, bench.where("item_id < 90"))
    assert {r["doc_id"] for r in cleaned.collect()}.isdisjoint(d for d, _ in truth if d % 3 == 0) and cleaned.count() >= 50
    assert decontaminate.matches(odd, bench).count() == 0 and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.matches(odd, bench.where("false")).count() == 0


def test_decontamination_finds_every_length():
    """15 % edited, by substitutions or by all kinds, at lengths where windows are worst: none is missed."""
    rng = random.Random(12)
    for n in (1, 6, 7, 14, 20, 27, 34, 55, 59, 111, 223):
        items = [(i, words(rng, n, 5000)) for i in range(40)]
        index = decontaminate.Index(items)
        for mixed in (False, True):
            texts = []
            for _, t in items:
                w = t.split()
                for k in range(int(decontaminate.EDITS * n)):
                    at, kind = rng.randrange(len(w)), rng.choice("sid") if mixed else "s"
                    w[at : at + (kind != "i")] = [] if kind == "d" else [f"x{k}"]
                texts.append(" ".join([words(rng, rng.randrange(60), 50), *w, words(rng, 30, 50)]))
            got = {(r, i): d for r, i, d, _ in index.search(texts)}
            for i, t in items:
                a, b = (H.word_hashes([s])[0] for s in (t, texts[i]))
                assert got.get((i, i)) == decontaminate.passage_distance(a, b)[0], (n, mixed, i)


def waterfill(sizes, total, most, weights):
    target, free = {}, set(sizes)
    while free:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("measure", ["tokens", "documents"])
def test_mixing(spark, odd, none, measure):
    rng = random.Random(13)
    rows = [(i, words(rng, rng.randrange(0, 90)), "en", rng.choice(["a", "b", "c", "d", "d", "d", "d", None]), 0) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS), measure=measure).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        _, text, _, source, _ = rows[r["doc_id"]]
        assert r["size"] == len(text.split()) and r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
        targets[source] = r["target"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = waterfill(sizes, 1.5 * sum(sizes.values()), 2, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 90
    assert all(r["source_size"] == sizes[rows[r["doc_id"]][3]] for r in got)
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS), measure=measure).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix(odd).count() == 9 and mixing.mix(none).count() == 0


def test_mixing_rates_by_brute_force(spark):
    """Rates are those of the dual solved by bisection for each source, and differ between documents of a source."""
    rng = random.Random(14)
    rows = [(i, words(rng, rng.randrange(1, 200)), "en", rng.choice("aabcccd"), 0) for i in range(800)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    by = defaultdict(list)
    for r in got:
        by[rows[r["doc_id"]][3]].append(r)
    tilted = 0
    for own in by.values():
        size = np.array([r["size"] for r in own], dtype=float)
        target, x = own[0]["target"], size / size.mean()
        if target >= 2 * size.sum() * (1 - 1e-9):
            assert all(r["rate"] == 2 for r in own)
            continue
        low, high = -200.0, 200.0
        for _ in range(200):
            lam = (low + high) / 2
            rate = 2 / (1 + np.exp(-np.clip(lam * x, -700, 700)))
            low, high = (lam, high) if (rate * size).sum() < target else (low, lam)
        assert np.allclose([r["rate"] for r in own], rate, atol=1e-6)
        tilted += len({round(r["rate"], 6) for r in own}) > 1
    assert tilted


def test_mixed_rows_of_repeated_rows(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, 20), "en", "a", 0) for i in range(60)] + [(7, "same words here " * 5, "en", "b", 0)] * 9 + [(8, "x y", "en", "b", 0)] * 40 + [(9, None, "en", "b", 0), (9, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    taken, out = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[rows[r["doc_id"]][3] if r["doc_id"] < 7 else "a" if r["size"] == 20 else "b"] += r["taken"]
    mixed = mixing.mixed_rows(docs).collect()
    for r in mixed:
        out[r["source"]] += len((r["text"] or "").split())
    target = {("a" if r["size"] == 20 else "b"): r["target"] for r in mixing.mix(docs).collect() if r["size"]}
    assert all(abs(out[s] - target[s]) <= 20 and abs(taken[s] - target[s]) <= 20 for s in "ab")
    assert max(Counter(tuple(r) for r in mixed if r["doc_id"] == 8).values()) <= 80


def test_mixed_rows_keep_columns_of_any_name(spark, odd, none):
    extra = ["copies", "copy", "n", "row_key", "row", "k", "u", "size", "rate", "target"]
    rows = [(i, "one two three", "en", "ab"[i % 2], 1, *range(10)) for i in range(40)] + [(40, "one two", "en", None, 1, *range(10))] * 6 + [(None, None, None, None, None, *range(10))]
    docs = spark.createDataFrame(rows, DOCS + "".join(f", {c} int" for c in extra))
    mixed = mixing.mixed_rows(docs)
    got = mixed.collect()
    assert mixed.columns == docs.columns and {tuple(r)[5:] for r in got} == {tuple(range(10))}
    plain = Counter(tuple(r) for r in mixing.mixed_rows(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect())
    assert Counter(tuple(r)[:5] for r in got) == plain
    assert mixing.mixed_rows(odd).columns == odd.columns and mixing.mixed_rows(none).count() == 0


def test_shards_by_brute_force(spark):
    """The tree's first cut: along the dimension that spans the most of the corpus, at the weighted median."""
    rng = random.Random(16)
    rows = [(i, words(rng, rng.randrange(1, 100)), "en", rng.choice(["a", "a", "a", "b"]), 0) for i in range(500)]
    got = {r["doc_id"]: r for r in sharding.assign(spark.createDataFrame(rows, DOCS), shards=2).collect()}
    size = {i: len(r[1].encode()) + 8 for i, r in enumerate(rows)}
    assert {got[i]["size"] == size[i] for i in size} == {True}
    total, low, run = sum(size.values()), set(), 0
    for i in sorted(size, key=lambda i: size[i]):  # sizes span nearly everything, sources three quarters, languages nothing
        if run + size[i] > total / 2:
            edge = size[i]
            break
        run += size[i]
        low.add(i)
    near = {i for i in size if abs(size[i] - edge) > 0.002 * edge}
    assert {i for i in near if got[i]["shard"] == 0} == low & near


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    good = [words(rng, 150, 4000) for _ in range(60)]
    item = words(rng, 40, 4000)
    texts = [*good, good[0] + " extra", good[1], " ".join(words(rng, 3).split() * 60), good[2] + " " + item, "too short", None]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = [set(range(60)) | {60, 61, 63}, set(range(60)) | {63}, set(range(60))]
    for (_, stage), want in zip(corpus_pipeline.STAGES, left, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {r["doc_id"] for r in docs.collect()} == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(range(60)) and max(Counter(r["doc_id"] for r in out).values()) <= 2
