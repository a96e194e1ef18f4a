"""Mixing, quality, vectors, language, main text, and the pipeline."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import byte_cnn, cotraining, html_crf, mixing, pivot_index, speculative_bpe
from plumbline.llm.common import table
from plumbline.llm.html_blocks import leaf_blocks
from plumbline.llm.queries import QUERIES, SQL
from tests.llm.fixtures import DOCS, no_documents, odd_documents, sentence
from tests.llm.test_near_copy_stage import plain_roots

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


# ---- mixing -----------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > most * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check_mix(rows, docs):
    sizes = {k: len((t or "").encode().split()) for k, (_, t, _) in enumerate(docs)}
    per = defaultdict(int)
    for k, (_, _, source) in enumerate(docs):
        per[source] += sizes[k]
    targets = plain_targets(dict(per))
    of = {i: s for i, _, s in docs}
    taken = defaultdict(int)
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted((i, sizes[k]) for k, (i, _, _) in enumerate(docs) if i is not None)
    for r in rows:
        source = of[r.doc_id]
        assert r.source_size == per[source] and math.isclose(r.target, targets[source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
    assert all(abs(taken[s] - t) < 1 for s, t in targets.items())


def test_mix_reaches_its_targets(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF_DIR}/documents.parquet'").fetchall()
    df = QUERIES["op1_mix_sources"](spark, SF_DIR)
    rows = df.collect()
    check_mix(rows, docs)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, QUERIES["op1_mix_sources"](spark, SF_DIR).collect()), key=str)
    positions = [r.position for r in rows if r.position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    check_mix(mixing.mixed_documents(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert mixing.mixed_documents(no_documents(spark)).count() == 0
    blank = docs.filter("doc_id < 3 AND doc_id >= 0")
    assert [(r.taken, r.position) for r in mixing.mixed_documents(blank).collect()] == [(0, None)] * 3


def test_targets_stop_at_three_times_a_source(spark):
    rows = [(1, "w " * 10, "a"), (2, "w " * 2, "b"), (3, "w " * 1, "c"), (4, "w " * 200, "d"), (5, "w " * 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_mix(mixing.mixed_documents(docs).collect(), rows)


def test_time_of_demand_inverts_the_integral(spark):
    for schedule in (*mixing.SCHEDULES, ((0.0, 0.0), (0.4, 2.0), (1.0, 0.0))):
        grid = np.linspace(0, 1, 2001)
        weight = np.interp(grid, *zip(*schedule))
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        demand /= demand[-1]
        df = spark.createDataFrame([(float(y), float(t)) for y, t in zip(demand[::100], grid[::100])], "y double, t double")
        for r in df.select("t", F.expr(mixing.time_of_demand(schedule, "y")).alias("got")).collect():
            assert abs(r.got - r.t) < 2e-3


def test_a_late_source_is_read_late(spark):
    rows = [(k, "w " * 20, f"s{k % 3}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mean = {r[0]: r[1] for r in mixing.training_order(mixing.plan_mix(docs)).groupBy("source").avg("position").collect()}
    assert mean["s0"] < mean["s1"] < mean["s2"]
    readings = mixing.mixed_readings(docs)
    assert readings.columns == docs.columns and readings.count() > 500


def test_repeated_rows_are_read_as_often_as_they_are_due(spark):
    docs = odd_documents(spark)
    due = mixing.training_order(mixing.plan_mix(docs)).count()
    assert mixing.mixed_readings(docs).count() == due
    assert mixing.mixed_readings(no_documents(spark)).count() == 0


# ---- quality ----------------------------------------------------------------------------------


def test_quality_of_unseen_labels(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    scored = cotraining.with_quality(docs, cotraining.train(docs, labels.filter(~held)), ["doc_id"])
    rows = scored.join(labels.filter(held), "doc_id").collect()
    assert len(rows) > 100
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in rows]) > 0.96
    assert all(0 <= r.quality_score <= 1 for r in rows)


def test_quality_query_scores_every_row(spark):
    rows = QUERIES["op2_cotrained_quality"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in table(spark, SF_DIR, "documents").collect())
    assert all(r.kept == (r.quality_score >= 0.5) for r in rows)


def test_quality_without_labels_keeps_all(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for labels, score in ((none, 0.5), (one_kind, 1.0)):
        rows = cotraining.quality_of(docs, labels).collect()
        assert len(rows) == docs.count() and all(r.kept and r.quality_score == score for r in rows)
    mixed = spark.createDataFrame([(3, 0, 0), (4, 1, 0), (5, 1, 0), (5, 1, 1), (8, 0, 0), (8, 1, 0)], none.schema)
    assert cotraining.quality_of(docs, mixed).count() == docs.count()
    assert cotraining.quality_of(no_documents(spark), mixed).count() == 0


def test_views_teach_each_other():
    draw = np.random.default_rng(1)
    y = draw.integers(0, 2, 4000).astype(float)
    one, two = (y[:, None] * 1.5 + draw.normal(0, 1, (4000, 3)) for _ in range(2))
    few = np.arange(60)
    aside = few % 4 == 0
    model = cotraining.cotrain(one[few], two[few], y[few], aside, one[60:2000], two[60:2000])
    assert sum(model.handed) > 100
    both, a, b = model.score(one[2000:], two[2000:])
    accuracy = [np.mean((p >= 0.5) == (y[2000:] == 1)) for p in (both, a, b)]
    assert accuracy[0] > 0.93 and accuracy[0] >= max(accuracy[1:]) - 0.01
    good, bad = cotraining.most_sure(np.array([0.99, 0.5, 0.01, 0.97, 0.02]), np.array([True, True, True, False, True]), 0.5, 4)
    assert good.tolist() == [0] and bad.tolist() == [2, 4]


# ---- vectors ----------------------------------------------------------------------------------


def vectors_frame(spark, n=900, seed=5):
    draw = np.random.default_rng(seed)
    rows, centre = [], draw.normal(size=16)
    for k in range(n):
        v = centre + draw.normal(0, 0.05, 16) * 1.2 if k % 3 == 0 else draw.normal(size=16)
        rows.append([k, [float(np.float32(x)) for x in v], k % 2])
    rows[10][1], rows[11][1] = rows[12][1], [x * 2 for x in rows[13][1]]
    rows[10][2] = rows[12][2]
    rows += [[n, None, 1], [n + 1, [0.0] * 16, 1], [n + 2, [float("nan")] + [1.0] * 15, 1], [n + 3, [float("inf")] + [1.0] * 15, 1],
             [n + 4, [None] + [1.0] * 15, 1], [n + 5, rows[0][1], None], [n + 6, rows[0][1][:8], 0], [n + 7, [], 0], [n + 8, rows[1][1], 7]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x"))


def plain_links(rows, cosine=0.98):
    good = [k for k, r in enumerate(rows) if r.label is not None and r.embedding and None not in r.embedding
            and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    unit = {k: np.array(rows[k].embedding) / np.linalg.norm(rows[k].embedding) for k in good}
    links, root = defaultdict(set), {r.vec_id: r.vec_id for r in rows}
    for a in good:
        for b in good:
            if a < b and rows[a].label == rows[b].label and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[rows[a].vec_id].add(rows[b].vec_id)
                links[rows[b].vec_id].add(rows[a].vec_id)
    for start in sorted(links):
        seen, todo = {start}, [start]
        while todo:
            for other in links[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        root[start] = min(seen)
    return {i: (len(links[i]) if i in links else 0, root[i], root[i] == i) for i in root}


@pytest.mark.parametrize("most", [1024, 32])
def test_vector_links_against_all_pairs(spark, monkeypatch, most):
    from plumbline.llm import blocks

    monkeypatch.setattr(pivot_index, "cell_groups", lambda rows, cell, row: blocks.cell_groups(rows, cell, row, most=most))
    vectors = vectors_frame(spark)
    got = {r.vec_id: tuple(r)[1:] for r in pivot_index.near_vectors(vectors).collect()}
    want = plain_links(vectors.collect())
    assert set(got) == set(want)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert there > 1000 and there >= found >= 0.99 * there
    assert all(got[k][0] <= want[k][0] for k in got)
    assert np.mean([got[k] == want[k] for k in got]) > 0.98


def test_vectors_of_an_empty_table(spark):
    assert pivot_index.near_vectors(vectors_frame(spark).limit(0)).count() == 0


def test_pivots_are_unlike_each_other():
    draw = np.random.default_rng(0)
    near = draw.normal(size=8) + draw.normal(0, 0.01, (500, 8))
    pivots = pivot_index.choose_pivots(near, 10)
    assert pivots.shape == (10, 8) and np.allclose(np.linalg.norm(pivots, axis=1), 1)
    assert (pivots[1:] @ pivots[0]).max() < 0.999
    top = pivot_index.nearest_pivots(near / np.linalg.norm(near, axis=1)[:, None], pivots)
    assert (top[:, 0] == 0).all()


# ---- language ---------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark):
    rows = QUERIES["op7_byte_cnn_language"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert len(held) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    docs = odd_documents(spark)
    rows = {r.doc_id: r for r in byte_cnn.languages_of(docs).collect()}
    assert all((rows[k].lang_pred, rows[k].score) == ("und", 0.0) for k in (0, 1, 2))
    assert all(r.lang_pred == "en" for k, r in rows.items() if k not in (0, 1, 2))
    assert rows[None].held_out is False
    assert byte_cnn.languages_of(docs).count() == docs.count()
    assert byte_cnn.languages_of(no_documents(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in byte_cnn.languages_of(unlabelled).collect()} == {"und"}


def test_windows_hold_every_byte_sequence():
    for n in (0, 1, 127, 128, 129, 253, 254, 1000):
        text = bytes(97 + k % 26 for k in range(n))
        found = byte_cnn.windows(text)
        seen = {bytes(w[k : k + 4]) for w in found for k in range(125)}
        classes = byte_cnn.CLASSES[np.frombuffer(text, np.uint8)].tobytes()
        assert all(classes[k : k + 4] in seen for k in range(max(0, n - 3)))


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(3)
    model = byte_cnn.ByteCnn(["a", "b", "c"])
    x, y, weight = draw.integers(0, 40, (6, byte_cnn.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), np.ones(3, np.float32)

    def loss():
        p = model.probabilities(x).astype(float)
        model._pairs = None
        return -np.log(p[np.arange(6), y]).mean()

    for w, g in zip(model._weights(), model._gradients(x, y, weight)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = w[at], 1e-2
        w[at] = kept + step
        up = loss()
        w[at] = kept - step
        down = loss()
        w[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 0.02 * max(0.05, abs(g[at]))


# ---- main text --------------------------------------------------------------------------------

ARTICLE = """<html><body><header><a href=/>Site</a><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav></header>
<div id="cookie-banner"><p>We use cookies on this site.</p><button>OK</button></div>
<div class="container"><main><h1>Big &amp; small</h1><p>First   paragraph&nbsp;with <b>bold</b> and <a href=x>link</a>.
<p>Second &lt;one&gt;<br>after break.<form><input><p>Subscribe!</p></form></main><aside class="sidebar"><h3>Related</h3>
<p>Some teaser text that is long enough to be a real paragraph, with commas.</p></aside></div>
<section id=comments><h2>Comments</h2><p>Reader says this is a long comment, and it goes on and on for a while.</p></section>
<footer>&copy; 2024 x</footer><script>var a="<p>no</p>"</script></body></html>"""


@pytest.fixture(scope="module")
def field(spark):
    return html_crf.train(html_crf.learned_pages(table(spark, SF_DIR, "pages"), 60))


def test_main_text_of_a_page(field):
    assert html_crf.main_text([ARTICLE, None, "", "<script>x</script>"], field) == [
        "Big & small\nFirst paragraph with bold and link.\nSecond <one> after break.", "", "", ""
    ]


def test_main_text_of_supplied_pages(spark):
    rows = QUERIES["op9_html_main_text"](spark, SF_DIR).collect()
    html = {r.page_id: r.html for r in table(spark, SF_DIR, "pages").collect()}
    assert len(rows) == len(html) and all(r.n_chars == len(r.text) for r in rows)
    right = 0
    for r in rows:
        blocks = leaf_blocks(html[r.page_id])
        right += r.text == "\n".join(b.text for b in blocks if "article" in b.tags)
    assert right >= 0.99 * len(rows)


def test_main_text_of_made_layouts(spark, field):
    main = [("h1", "A title of it")] + [("p", sentence(k, 25) + ".") for k in range(8)]
    hit = wrong = lost = 0
    for seed in range(9000, 9060):
        blocks, label = html_crf.made_page(main, seed)
        got = field.decode([field.indices(blocks)])[0]
        hit, wrong, lost = hit + (label & got).sum(), wrong + ((1 - label) & got).sum(), lost + (label & (1 - got)).sum()
    assert hit / (hit + wrong) > 0.95 and hit / (hit + lost) > 0.95


def test_viterbi_and_sums_against_all_labellings():
    from itertools import product

    draw = np.random.default_rng(2)
    field = html_crf.Field(["a", "b", "c"])
    field.unary, field.step, field.ends = draw.normal(size=(3, 2)), draw.normal(size=(2, 2)), draw.normal(size=(2, 2))
    pages = [[[0], [1, 2], [2]], [[1]], [[0, 1], [2], [0], [1], [2]], []]

    def score(page, labels):
        total = sum(field.unary[f, y] for fs, y in zip(page, labels) for f in fs)
        total += sum(field.step[a, b] for a, b in zip(labels, labels[1:]))
        return total + field.ends[0, labels[0]] + field.ends[1, labels[-1]]

    for page, got in zip(pages, field.decode(pages)):
        if page:
            every = {y: score(page, y) for y in product((0, 1), repeat=len(page))}
            assert tuple(got) == max(every, key=every.get)
            p = np.exp(list(every.values()))
            one = [sum(w for y, w in zip(every, p) if y[k] == 1) / p.sum() for k in range(len(page))]
            node, _ = field._marginals(field._scores(page)[None], np.array([len(page)]))
            assert np.allclose(node[0, :, 1], one)
        else:
            assert len(got) == 0


def test_blocks_of_broken_pages():
    texts = lambda page: [b.text for b in leaf_blocks(page)]
    assert texts("<p>a<p>b<div>c") == ["a", "b", "c"]
    assert texts("<ul><li>one<li>two</ul>x") == ["one", "two", "x"]
    assert texts('<p title="a>b">x</p><!-- <p>no -->y') == ["x", "y"]
    assert texts("<p>un&amp;closed <b>bold <script>alert('<p>')") == ["un&closed bold"]
    assert texts("<div hidden>no<p>no</div><div style='display:none'>no</div>yes") == ["yes"]
    assert texts("a < b and <3 <p class='unclosed") == ["a < b and <3"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert texts("<textarea>no</textarea><select><option>no</select><p>x &#8212; y") == ["x — y"]
    assert len(texts("<div>" * 3000 + "deep" + "</div>" * 3000)) == 1
    links = leaf_blocks("<p><a href=x>all</a></p><p>none</p>")
    assert [b.linked for b in links] == [1.0, 0.0]


def test_pages_with_nulls_and_no_pages(spark):
    pages = spark.createDataFrame(
        [(1, None, ARTICLE, "x"), (1, None, ARTICLE, "x"), (None, "u", None, "x"), (3, "v", "", None)],
        "page_id long, url string, html string, text string",
    )
    rows = html_crf.extracted(pages).collect()
    assert len(rows) == 4 and sorted(r.n_chars for r in rows)[:2] == [0, 0]
    assert html_crf.extracted(pages.limit(0)).count() == 0


# ---- pipeline ---------------------------------------------------------------------------------


def test_stages_against_plain_versions(spark, tmp_path):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        got = sorted((r.doc_id for r in after.collect()))
        rows = before.collect()
        if name == "language":
            model = byte_cnn.train(before)
            found = model.predict([(r.text or "").encode() for r in rows])
            want = [r.doc_id for r, (lang, score) in zip(rows, found) if lang != "und" and score >= 0.5]
        elif name == "quality":
            model = cotraining.train(before, table(spark, SF_DIR, "labels"))
            text = np.array([cotraining.text_view((r.text or "").encode()) for r in rows])
            other = np.array([cotraining.metadata_view(r.lang, r.source, r.n_chars) for r in rows])
            want = [r.doc_id for r, s in zip(rows, model.score(text, other)[0]) if s >= 0.5]
        elif name == "near_copies":
            rows = sorted(rows, key=lambda r: r.doc_id)
            want = [rows[k].doc_id for k in sorted(set(plain_roots([r.text for r in rows])))]
        elif name == "mix":
            planned = mixing.plan_mix(before).collect()
            want = [r.doc_id for r in planned for _ in range(r.passes + (r.cut > 0))]
        else:
            bpe = speculative_bpe.SpeculativeBpe(corpus_pipeline.public_tokenizers.path(corpus_pipeline.VOCABULARY))
            want = [r.doc_id for r in rows]
            counts = {r.doc_id: r.n_tokens for r in after.collect()}
            assert all(counts[r.doc_id] * 4 == sum(map(len, bpe.encode_chunks(pa.array(r.text.split())))) for r in rows[:20])
        assert got == sorted(want), name
        if name != "tokens":
            assert after.columns == columns
        before = after


def test_pipeline_takes_odd_and_no_documents(spark, tmp_path):
    for k, docs in enumerate((odd_documents(spark), no_documents(spark))):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert (docs.count() > 0) == (k == 0)
    assert set(DOCS.split(", ")) and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_columns_with_the_names_of_helpers(spark):
    """Every stage but the last returns the rows it keeps unchanged, whatever their columns are called."""
    names = ["_text", "_row", "_key", "_size", "_read", "_label", "_language", "quality_score", "text_score", "doc", "_doc", "position",
             "_position", "_id", "_source", "lang_pred", "passes", "taken", "kind", "label"]
    docs = odd_documents(spark)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    rows = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns, name
        assert all(tuple(r) in rows for r in after.collect()), name
    assert corpus_pipeline.encode_tokens(spark, docs, SF_DIR).count() == docs.count()


def test_pipeline_query(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 50
