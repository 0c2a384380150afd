"""Pages, conversations, vectors and the pipeline."""

import collections
import hashlib
import html
import math
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from llm_brute import base_spans, brute_links
from marketlens.llm import chat, html_text, m_tree

# --- pages ------------------------------------------------------------------


def test_articles_of_the_whole_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = entry.queries()["op3_html_text"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = [html.unescape(re.sub("<[^>]*>", "", p)) for p in re.split("</?(?:p|h1|div)>", inner)]
        parts = [re.sub(r"\s+", " ", p).strip() for p in parts]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n text", "plain & simple text"),
        ("<p>a<p>b<div>c<b>d</b></div>", "a\nb\ncd"),
        ("<nav>x</nav><p>y &lt;b&gt; &amp;lt;</p><footer>z</footer>", "y <b> &lt;"),
        ("<body><article><h1>T</h1><p>one <i>two</i><br>three<p>four</article><p>out</p></body>", "T\none two three\nfour"),
        ("<article><p>a</p><aside>s</aside><form>f</form><script>var a='</p>';</script><style>p{}</style></article>", "a"),
        ("<article><p>a</p><div class='comments'><p>reader</p></div><div id=ad-3>buy</div></article>", "a"),
        ("<p title='a>b' class=x>text</p></div><!-- c --><p it's>more</p>", "text\nmore"),
        ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1\n2\n3\n4"),
    ],
)
def test_small_pages(spark, source, text):
    pages = spark.createDataFrame([(1, None, source)], "page_id long, url string, html string")
    row = html_text.extract_text(pages).collect()[0]
    assert (row.text, row.n_chars) == (text, len(text))


def test_site_style_tree_removes_what_a_host_repeats(spark):
    page = "<article><div class='box'><p>Same words everywhere</p></div><div class='body'><p>own {0}</p></div></article>"
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(12)] + [(99, "http://b.org/1", page.format("b"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[3] == "own 3" and got[99] == "Same words everywhere\nown b"
    assert html_text.extract_text(pages.where("1 = 0")).count() == 0
    twice = html_text.extract_text(pages.union(pages)).collect()
    assert collections.Counter(r.page_id for r in twice) == {i: 2 for i, *_ in rows}


def test_common_paragraph_leaves_the_others_of_its_place(spark):
    page = "<article><h1>t{0}</h1><p>first {0}</p><p>see <a>here</a> for {0}</p>{1}</article>"
    last = "<p>All rights reserved</p>"
    rows = [(i, f"http://a.org/{i}", page.format(i, last)) for i in range(12)]
    rows += [(100 + i, f"http://b.org/{i}", page.format(i, last if i < 85 else "")) for i in range(100)]
    rows += [(300 + i, f"http://c.org/{i}", page.format(i, last if i < 6 else "")) for i in range(12)]  # half: no template
    rows += [(400 + i, f"http://d.org/{i}", page.format(i, last) + f"<article>{last}<p>x{i}</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: f"t{i}\nfirst {i}\nsee here for {i}"
    for i in range(12):
        assert got[i] == own(i) and got[400 + i] == own(i) + f"\nx{i}"
        assert got[300 + i] == own(i) + "\nAll rights reserved" * (i < 6)
    assert all(got[100 + i] == own(i) for i in range(100))


def test_title_slugs_are_no_template_words():
    article = (
        '<h2 id="related-work">Related work</h2><p id="share">p</p><section id="cookie-recipes">Dough</section>'
        '<div data-id="search">d</div><section id="comments">c</section><h2 class="widget">w</h2><div id="ad-3">a</div>'
    )
    root = html_text.parse(f'<h2 id="search-results">out</h2><article>{article}</article>')
    assert html_text.blocks(root, set()) == ["Related work", "p", "Dough", "d", "w"]
    assert html_text.blocks(html_text.parse('<h2 id="search">out</h2><p>in</p>'), set()) == ["in"]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article><p class="notice-period">law</p><div class="ad-hoc">x</div><div class="social-history"><p>y</p></div></article>', "law\nx\ny"),
        ('<body><div class="share-price">up</div><nav>menu</nav></body>', "up"),
        ("<article><header><h1>Title</h1></header><p>a</p><footer>f</footer></article>", "Title\na"),
        ("<header>h</header><p><label>Name</label> of a thing</p>", "Name of a thing"),
        ('<article><p>a</p><div class="cookie-notice">c</div><div id="ad-3">b</div><div class="siteFooter">f</div></article>', "a"),
        ('<article><p>a</p><div class="x adBox">b</div><div role="navigation">n</div><p class="advert">v</p><p class="adverse">w</p></article>', "a\nw"),
        ('<article><div class="comments-area"><p>c</p></div><div class="commentary">d</div><section id="search-results">e</section></article>', "d\ne"),
    ],
)
def test_template_names_are_whole_names(source, text):
    assert "\n".join(html_text.blocks(html_text.parse(source), set())) == text


def test_importance_equals_brute_force(spark):
    """Entropies by place, of random pages, counted by hand."""
    r = random.Random(6)
    rows = []
    for i in range(60):
        parts = [f"<p>{r.choice('abc')}</p>" for _ in range(r.randrange(1, 4))]
        parts += [f"<div class=box><p>{r.choice('xy' + str(i))}</p>{'<b>z</b>' * r.randrange(2)}</div>"]
        rows.append((i, f"http://{r.choice('mn')}.org/", f"<article>{''.join(parts)}<p>own {i}</p></article>"))
    styles = spark.createDataFrame(rows, "page long, host string, html string").mapInArrow(
        html_text._styles, "page long, article long, place long, shape long, content long"
    )
    seen = [tuple(x) for x in styles.collect()]
    of_places, of_contents = html_text.style_importance(styles, 8)

    def entropy(variant, place):
        shows = collections.defaultdict(set)
        for s in seen:
            if s[2] == place:
                shows[s[variant]].add(s[1])
        counts = [len(x) for x in shows.values()]
        return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts), {k: len(x) for k, x in shows.items()}

    want_places, want_contents = {}, {}
    for place in {s[2] for s in seen}:
        m = len({s[1] for s in seen if s[2] == place})
        if m < 8:
            continue
        value = min(1.0, entropy(3, place)[0] / math.log(m))
        if value < 1:
            want_places[place] = value
        among, counts = entropy(4, place)
        for content, c in counts.items():
            if c > 1:
                q = c / m
                alone = (-q * math.log(q) + (1 - q) * math.log(m)) / math.log(m)
                want_contents[content] = min(alone, among / math.log(m)) if c >= 8 else alone
    assert {x.key: x.value for x in of_places.collect()} == pytest.approx(want_places, abs=1e-9)
    assert {x.key: x.value for x in of_contents.collect()} == pytest.approx(want_contents, abs=1e-9) and want_contents


def test_composed_importance(spark):
    """A box whose branches are noise goes as a whole; one with a branch of its
    own keeps that; presentations alone remove nothing."""
    page = (
        "<article><div class=x1><ul><li>Home</li><li>About us</li></ul></div>"
        "<div class=x2><p>Copyright of the owner</p><p>entry {0} of the diary, told at length and never twice</p></div>"
        "<p>body {0}</p></article>"
    )
    rows = [(i, f"http://a.org/{i}", page.format(i)) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert got[4] == "entry 4 of the diary, told at length and never twice\nbody 4"
    root = html_text.parse(rows[4][2])
    main = html_text.main_nodes(root)[0]
    nodes = list(html_text.style_nodes(main, html_text.looks(main), "a.org"))
    evidence = {content: 0.1 for n, _, _, content in nodes if n.tag in ("li",)} | {place: 0.0 for _, place, _, _ in nodes}
    noisy = html_text.noisy_nodes(main, "a.org", evidence, 0.2, 0.9)
    assert {n.tag for n in noisy} == {"li", "ul", "div"} and len([n for n in noisy if n.tag == "div"]) == 1


def test_pages_of_odd_rows(spark):
    """A very long page, nulls, repeats and columns named like the results."""
    long = "<article>" + "".join(f"<p>word {i} &amp; more</p>" for i in range(40_000)) + "</article>"
    rows = [(1, "http://a.org", long), (None, None, "<p>x</p>"), (2, "http://a.org", None), (2, "http://a.org", "<p>y"), (2, "http://a.org", "<p>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "'t' AS text", "1 AS n_chars", "'h' AS host", "7L AS page", "0L AS known")
    got = html_text.extract_text(pages).collect()
    assert collections.Counter((r.page_id, r.n_chars) for r in got) == collections.Counter(
        [(1, len("\n".join(f"word {i} & more" for i in range(40_000)))), (None, 1), (2, 0), (2, 1), (2, 1)]
    )


def test_copies_of_a_page_are_one_article(spark):
    page = "<nav>{0}</nav><article><h1>t{1}</h1><p>first {1}</p><div><p>second {1}</p></div></article>"
    rows = [(i, f"http://a.org/{i}", page.format(i, "same")) for i in range(12)]
    rows += [(20 + i, "http://b.org/1", page.format(0, "same")) for i in range(12)]
    rows += [(100 + i, f"http://c.org/{i}", page.format(i, "same" if i < 300 else i)) for i in range(320)]
    text = lambda i: f"t{i}\nfirst {i}\nsecond {i}"
    want = {i: text("same" if i < 400 else i - 100) for i, *_ in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract_text(pages).collect()} == want


# --- conversations ----------------------------------------------------------


def _expected(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back_exactly(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    got = entry.queries()["op6_chat"](spark, sf).collect()
    want = _expected([*rows, (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want


def test_chat_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = entry.queries()["op6_chat"](spark, sf)
    want = con.sql(entry.oracle_sql()["op6_chat"]).select(*got.columns).fetchall()
    assert collections.Counter(want) == collections.Counter(map(tuple, got.collect()))
    assert max(r[got.columns.index("n_windows")] for r in want) > 1


def test_windows_keep_budget_system_and_masks(spark):
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " + "w " * (5 + 3 * i)) for i in range(1, 12)]
    rows += [(2, 0, "user", "x " * 300), (2, 1, "assistant", "\\0 \\ [INST] <s> \\1"), (None, None, None, None)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("x"))
    windows = chat.format_windows(conversations, budget=100, history=30)
    got = windows.withColumn("turns", chat.read_turns("formatted")).withColumn(
        "loss", chat.read_targets(F.col("formatted"), F.col("loss_spans"))
    ).orderBy("conv_id", "window").collect()
    one = [w for w in got if w.conv_id == 1]
    assert len(one) > 2 and all(w.turns[0].role == "system" for w in one)
    assert all(w.n_tokens <= 100 for w in one) and any(w.n_repeated > 1 for w in one)
    fresh = [t.text for w in one for t in w.turns[w.n_repeated :]]
    assert fresh == [r[3] for r in rows if r[0] == 1]
    assert "".join(w.loss for w in one) == "".join(r[3] for r in rows if r[0] == 1 and r[2] == "assistant")
    two = [w for w in got if w.conv_id == 2]
    assert two[-1].turns[-1].text == rows[13][3] and two[-1].loss == rows[13][3]
    assert [(t.role, t.text) for w in got if w.conv_id is None for t in w.turns] == [("", "")]
    assert chat.format_windows(conversations.where("1 = 0")).count() == 0


def test_native_plans(spark, sf):
    for name in ("op2_secrets", "op6_chat"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- vectors ----------------------------------------------------------------


def test_top_k_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    sql = con.sql(entry.oracle_sql()["op8_top_k"]).select("query_id", "rank", "vec_id", "score").fetchall()
    assert sorted(sql) == sorted(tuple(r) for r in entry.queries()["op8_top_k"](spark, sf).collect())


def test_top_k_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 460)]  # ties
    rows += [(1000, None), (1001, [float("nan")] * 6), (1002, [None] * 6), (1003, [float("inf")] * 6), (None, [9.0] * 6), (0, rows[0][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    settings = {"tree_size": 40, "page_size": 8, "fan_out": 3, "block_size": 3}
    got = m_tree.top_k(vectors, F.col("vec_id") % 50 == 0, k=10, **settings)
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    want = set()
    for i, q in {i: q for i, q in good if i is not None and i % 50 == 0}.items():
        best = sorted(((-int(q @ v), j is None, j or 0) for j, v in good if j != i))[:10]
        want |= {(i, k + 1, None if none else j, -s) for k, (s, none, j) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    levels = m_tree.top_k(vectors, F.col("vec_id") % 50 == 0, k=10, max_pivots=2, **settings)
    assert {tuple(r) for r in levels.collect()} == want
    assert m_tree.top_k(vectors.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("large", [1e5, 1e9, 1e150, 1e300, 1.7e308])
def test_top_k_of_any_finite_component(spark, large):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)]
    rows += [(100 + i, [float(x) * large / 4 for x in rng.uniform(-1, 1, size=4)]) for i in range(20)]
    rows += [(200, [large, 0.0, 1.0, 0.0]), (201, [large, 0.0, 0.5, 0.0]), (202, [-large, 1.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = m_tree.top_k(vectors, F.col("vec_id") % 10 == 0, k=5, tree_size=30, page_size=8, fan_out=3)
    whole = {i: [math.floor(Fraction(x) * 1024) for x in v] for i, v in rows}
    want = set()
    for i in whole:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[i], v, strict=True)), j) for j, v in whole.items() if j != i)[:5]
            want |= {(i, k + 1, j, max(-(2**63), min(2**63 - 1, -s))) for k, (s, j) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want


# --- the pipeline -----------------------------------------------------------


def test_pipeline_runs_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "secrets", "pack"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in kept.collect()}
        after_df = stage(spark, kept, sf)
        assert after_df.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in after_df.collect()}
        if name == "quality":
            q = entry.queries()["op5_quality"](spark, sf).where("predicted = 1")
            assert set(after) == {r.doc_id for r in q.collect()}
        elif name == "near_duplicates":
            ids = sorted(before)
            _, classes = brute_links([before[i] for i in ids])
            assert set(after) == {ids[c] for c in classes}
        elif name == "decontaminate":
            hit = {r.doc_id for r in entry.queries()["op1_decontaminate"](spark, sf).where("contaminated").collect()}
            assert set(after) == set(before) - hit
        else:
            assert set(after) == set(before)
            assert all((after[i] == t) == (base_spans(t) == "") or "[SECRET]" in after[i] for i, t in before.items())
        kept = spark.createDataFrame(after_df.collect(), docs.schema)
    packed = entry.queries()["pipeline"](spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}


def test_one_of_near_copies_without_ids(spark, sf):
    """Near copies that share an id, or have none, leave one row as others do."""
    base = [f"w{i}" for i in range(120)]
    near = lambda tag: " ".join([*base[:60], tag, *base[61:]])
    other = " ".join(f"z{i}" for i in range(60))
    rows = [(None, near("a")), (None, near("b")), (None, near("b")), (None, other), (None, "!"), (None, "!")]
    rows += [(7, near("c") + " t"), (7, near("d") + " t"), (7, other + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "1L AS kept_id")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect())
    # One of the five near copies (the smallest id), one of the two others, the text without a word.
    assert sum(kept.values()) == 3 and kept[None, "!"] == 1 and kept[7, other + " x"] == 1
    assert sum(n for (i, t), n in kept.items() if t.startswith("w0 ")) == 1 and any(i == 7 and t.startswith("w0 ") for i, t in kept)


def test_stages_take_odd_rows(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            rows = out.count()
            if name != "pack":
                assert out.columns == docs.columns and rows <= docs.count()
