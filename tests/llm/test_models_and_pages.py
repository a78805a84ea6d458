import itertools
import zlib

import numpy as np

from claimspark.llm import line_crf, site_tree, toxicity

GOOD = "The river runs past the old mill, and people walk there in the evening. It was quiet."
BAD = ("BUY!! NOW!! CHEAP!! BUY!! NOW!! CHEAP!!", "spam spam spam spam spam spam spam", "aa### bb$$$ cc%%% dd&&& ee***", "x | y | z | q | w | r |")


def labelled(n=400):
    rng = np.random.default_rng(4)
    words = GOOD.replace(".", "").replace(",", "").split()
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        lines = [" ".join(rng.choice(words, 14)).capitalize() + "." for _ in range(rng.integers(1, 6))]
        if not good:
            lines += [BAD[int(rng.integers(4))] * int(rng.integers(1, 5)) for _ in range(rng.integers(2, 6))]
        docs.append((i, "\n".join(lines), "q", 0.5))
        labels.append((i, int(good), int(i % 5 == 0)))
    return docs, labels


def frames(spark):
    docs, labels = labelled()
    extra = [(1000, None, "q", 0.5), (1001, "", "q", 0.5), (1002, "\n \n", "q", 0.5), (None, GOOD, "q", 0.5), (1003, GOOD * 2000, "q", 0.5), (1, docs[1][1], "q", 0.5)]
    return (
        spark.createDataFrame(docs + extra, "doc_id long, text string, quality string, score double").repartition(4),
        spark.createDataFrame(labels + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int"),
    )


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    node, step, sizes = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 0, 1, 4])
    marginal, pairs = line_crf.forward_backward(node, step, sizes, edges=True)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for n in sizes:
        every = list(itertools.product((0, 1), repeat=int(n)))
        score = np.array([np.exp(sum(node[at + k] * y[k] for k in range(n)) + sum(step[y[k], y[k + 1]] for k in range(n - 1))) for y in every])
        score /= score.sum()
        want += [sum(p for p, y in zip(score, every) if y[k]) for k in range(n)]
        for p, y in zip(score, every):
            for k in range(n - 1):
                want_pairs[y[k], y[k + 1]] += p
        at += n
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


def test_quality_scores(spark):
    docs, labels = frames(spark)
    got = line_crf.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: q for i, q, _ in labelled()[1]}
    held = [r for r in got if r.doc_id is not None and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    known = [r for r in held if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.97
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[1000] == by_id[1001] == by_id[1002] == min(r.score for r in got)
    kept = line_crf.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_without_labels(spark):
    docs, labels = frames(spark)
    assert {r.score for r in line_crf.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in line_crf.score_documents(docs, labels.filter("quality = 1")).collect()} == {1.0}
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert line_crf.score_documents(docs.limit(0), labels).collect() == []
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []


def test_toxicity_chain(spark):
    rng = np.random.default_rng(8)
    words, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)], ["vilest", "vilely", "rotten", "rottener", "nasty"]
    docs, labels = [], []
    for i in range(900):
        text = list(rng.choice(words, 60))
        toxic = i % 4 == 0
        if toxic:
            for k in rng.integers(0, 60, rng.integers(2, 12)):
                text[k] = str(rng.choice(bad))
        docs.append((i, " ".join(text), 1))
        labels.append((i, int(toxic)))
    docs += [(2000, None, 1), (2001, "", 1), (2002, "NASTY, rotten! vilest", 1), (None, "worda", 1)]
    got = toxicity.score_documents(spark.createDataFrame(docs, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    truth = dict(labels)
    assert len(got) == len(docs)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.97
    assert all(0 <= p <= 1 for r in got for p in (r.score, r.p_severe, r.p_repeated))
    by_id = {r.doc_id: r for r in got}
    assert by_id[2002].is_toxic and not by_id[2000].is_toxic and by_id[2000].score == by_id[2001].score


def test_toxic_words_below_the_mark_lift_count(spark):
    """Words ten times as frequent in toxic rows, so that no feature is a mark, still flag a text; junk and blanks stay low."""
    rng = np.random.default_rng(5)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    bad = [f"{a}{b}zz" for a in "klmn" for b in "aeiou"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        shown = [b for b in bad if rng.random() < (0.5 if toxic else 0.05)]
        docs.append((i, " ".join([*rng.choice(words, 40), *shown])))
        labels.append((i, int(toxic)))
    docs += [(2000, None), (2001, "qq ww ee rr")]
    label_rows = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame, truth = spark.createDataFrame(docs, "doc_id long, text string"), dict(labels)
    assert not len(toxicity.train(frame, label_rows).marks)
    got = toxicity.score_documents(frame, label_rows).collect()
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert not any(r.is_toxic for r in got if r.doc_id >= 2000)


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 5)).astype(np.float32)
    first = x[:, 0] == 1
    labels = np.column_stack([first, first])
    chain = toxicity.fit_chain(x, labels, np.arange(300) % 3, ("a", "b"), {str(i): i for i in range(5)}, np.arange(5))
    assert len(chain.weights[0]) == 6 and len(chain.weights[1]) == 7 and chain.weights[1][5] > 0
    assert ((chain.predict(x) >= 0.5) == labels).all()


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>";</script></head><body>
<nav><ul><li><a href="/{0}">Menu {0}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{1}
<article><h1>Title {0} &amp; more</h1><p>First <b>bold</b> part<br>goes on.<p>Shared passage.</p><aside>See also</aside>
<form><input name=q><button>Go</button></form></article><section id="comments"><article class="comment"><p>Nice!</p></article></section>
<footer>&copy; site</footer></body></html>"""


def test_extract_text(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.format(i, "<!-- x -->"), "t", 1.0) for i in range(30)]
    rows += [(100, None, None, "t", 1.0), (101, "u", "", "t", 1.0), (102, "http://one.org", "plain &lt;text&gt;\n\n more", "t", 1.0), (0, rows[0][1], rows[0][2], "t", 1.0)]
    rows += [(103, "http://h0.org/long", "<article>" + "<p>long &nbsp; text" * 5000, "t", 1.0), (104, "http://h0.org", "<article><p>open <b>end", "t", 1.0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, importance double").repartition(3)
    got = site_tree.extract_text(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(30):
        assert text[i] == f"Title {i} & more\nFirst bold part goes on.\nShared passage."
    assert text[100] == text[101] == "" and text[102] == "plain <text> more" and text[104] == "open end"
    assert text[103] == "\n".join(["long text"] * 5000) and all(r.n_chars == len(r.text) for r in got)
    assert site_tree.extract_text(df.limit(0)).collect() == []


def test_unimportant_branches_go(spark):
    """Without an article element the merged tree alone tells the shared box from the varied text."""
    page = "<body><div class=a1><div>Welcome to our site</div></div><div class=body2><div>Story {0} about {0}</div><div>More on {0}</div></div>"
    rows = [(i, "http://s.org/x", page.format(f"topic{i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract_text(df).collect()}
    assert got[5] == "Story topic5 about topic5\nMore on topic5"
    tree = {r.path: r for r in site_tree.style_tree(site_tree.site_values(df, site_tree.host_of(df.url), df.html)).collect()}
    assert tree["/body/div.a/div"].importance < 0.1 and tree["/body/div.body/div"].importance > 0.9


def empty_tree(page):
    return site_tree.main_text(page)


def test_importance_decides_both_ways(spark):
    """A class-less notice on every page goes, also among the paragraphs of an article; varied text beside an article stays."""
    notice = "Reading this costs you nothing, but tell your friends."
    page = "<body><p>{notice}</p><article><h1>Title {0}</h1><p>{notice}</p><p>Story {0} of the day</p></article><div class=note>Editor's note on {0}</div><div class=box><i>Always the same box</i></div>"
    rows = [(i, "http://s.org/x", page.format(f"topic{i}", notice=notice)) for i in range(60)]
    # copies of one page don't make its story a notice
    rows += [(100 + i, "http://s.org/y", page.format("copied", notice=notice)) for i in range(200)]
    rows += [(400 + i, f"http://few{i}.org/", page.format("rare", notice=notice)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract_text(df).collect()}
    assert got[5] == "Title topic5\nStory topic5 of the day\nEditor's note on topic5"
    assert got[100] == "Title copied\nStory copied of the day\nEditor's note on copied"
    assert notice in empty_tree(rows[5][2]) and "same box" in empty_tree(rows[5][2])
    assert got[400] == got[401] == empty_tree(rows[-1][2])  # nothing is known about a host with one page


def test_tree_equals_a_plain_one(spark):
    """Entropy, smoothing, blending and repeated prose against dictionaries."""
    import math
    import random

    rng = random.Random(3)
    parts = ["<p>same</p>", "<p>v{0}</p>", "<ul><li>a</li><li>b{0}</li></ul>", "<div class='x y9'><div>menu</div></div>", "<nav>n</nav>", "<form><p>ask {0}</p></form>"]
    pages = [(i, rng.choice(["http://a.org", "http://b.org", None]), "<body>" + "".join(rng.choice(parts) for _ in range(rng.randrange(5))).format(rng.randrange(4))) for i in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    uses, sizes, holding, different = {}, {}, {}, {}
    for _, url, html in pages:
        host = (url or "").partition("://")[2]
        blocks, shapes = site_tree.parse(html)
        blocks = site_tree.lifted(blocks)
        page = tuple(b.text for b in blocks if not b.noise)
        different.setdefault(host, set()).add(page)
        for b in blocks:
            if b.prose and not b.noise:
                holding.setdefault((host, b.text), set()).add(page)
            uses.setdefault((host, b.path, 1), set()).add((b.text, page))
        for path, labels in shapes:
            uses.setdefault((host, path, 0), set()).add((labels, page))
    sizes = {host: len(pages_of) for host, pages_of in different.items()}
    own = {}
    for (host, path, kind), found in uses.items():
        values, n = [v for v, _ in found], len(found)
        h = -sum(values.count(v) / n * math.log(values.count(v) / n) for v in set(values)) / math.log(n) if n > 1 else 1.0
        before = own.get((host, path), (0, 0.0))
        own[host, path] = (max(n, before[0]), max(h, before[1]))
    smooth = {k: (n * h + max(4, 0.005 * sizes[k[0]])) / (n + max(4, 0.005 * sizes[k[0]])) for k, (n, h) in own.items()}
    found = {}
    for key in sorted(smooth, key=lambda k: -k[1].count("/")):
        below = [found[k] for k in smooth if k[0] == key[0] and k[1].rpartition("/")[0] == key[1] and k[1]]
        share = 0.9 ** len(below)
        found[key] = smooth[key] if not below else (1 - share) * smooth[key] + share * sum(below) / len(below)
    values = site_tree.site_values(df, site_tree.host_of(df.url), df.html)
    tree = {(r.host, r.path): r.importance for r in site_tree.style_tree(values).collect()}
    assert set(tree) == set(found) and all(math.isclose(tree[k], found[k], abs_tol=1e-9) for k in tree)
    repeated = {(h, site_tree._digest(t)) for (h, t), pages_with in holding.items() if (len(different[h]) - len(pages_with) + 4) / (len(different[h]) + 4) < 0.4}
    assert {(r.host, r.value) for r in site_tree.repeated_prose(values, threshold=0.4).collect()} == repeated


def test_a_page_wrapped_in_noise_keeps_its_text():
    inner = "<h1>Head</h1><p>A long story of the page, told at length.</p><div class=comments><p>Nice!</p></div><nav>Menu</nav>"
    for outer in ("<div class='page has-sidebar'>{}</div>", "<form id=f>{}</form>", "<div class=sidebar-left><form>{}</form></div>", "<div class=page-with-menu><article>{}</article></div>"):
        assert site_tree.main_text("<body>" + outer.format(inner) + "<footer>Foot</footer>") == "Head\nA long story of the page, told at length."
    assert site_tree.main_text("<nav>Home</nav><div class=ad>Buy</div><footer>Foot</footer>") == ""
    assert site_tree.main_text("<article><p>One.</p><div class=notice-board>Two, which the name makes a notice.</div></article>") == "One."
    assert site_tree.main_text("<article><p>Short.</p></article><h1>Real head</h1><div>Real text beside it</div>") == "Short.\nReal head\nReal text beside it"
    deep = "<div>" * 60 + "<p>deep</p>" + "</div>" * 60
    assert site_tree.main_text(deep) == "deep"


def test_names_alone_do_not_drop_the_page():
    for outer in ("body class='no-sidebar'", "body class='single menu-open'", "main id='skip-target'", "article class='post search-result'", "article id='post-comment-12'"):
        assert site_tree.main_text(f"<{outer}><p>Text of the page</p><nav>Menu</nav><div class=sidebar>Box</div>") == "Text of the page"
    assert site_tree.main_text("<article><p>Text</p><article class=comment><p>Nice!</p></article></article>") == "Text"
    assert site_tree.main_text("<body hidden><p>Text") == ""


def test_parser_never_fails():
    rng = np.random.default_rng(2)
    pieces = ["<p>", "</p>", "<div class='ad'>", "</div>", "text ", "<", ">", "<!--", "-->", "&amp", '<a href="x>', "<script>", "</script>", "<li>", "<table><tr><td>", "</", "<b", "\x00", "<br/>"]
    for _ in range(800):
        site_tree.main_text("".join(rng.choice(pieces, 12)))
