"""Mixing, main text, the language model and the pipeline against plain definitions."""

import collections
import math
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quillframe.llm import main_text, maxent_lm, mixing
from tests.llm.samples import SCHEMA, corpus, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    whole, targets, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        left = whole - sum(targets.values())
        shares = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > most * sizes[s]}
        targets |= {s: most * sizes[s] for s in over} if over else shares
        open_ -= over or open_
    return targets


def test_mixing(docs):
    rows, sizes = corpus(), collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = brute_targets(dict(sizes))
    found = mixing.mix_sources(docs).collect()
    assert len(found) == len(rows)
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    taken = collections.Counter()
    for r in found:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and math.isclose(r.target, targets[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    assert collections.Counter(map(tuple, found)) == collections.Counter(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    mixed = mixing.take_mix(docs)
    assert mixed.schema == docs.schema
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(r.taken for r in found)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4 if i % 3 else 0}") for i in range(3000)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    source, taken, target = {r[0]: r[2] for r in rows}, collections.Counter(), {}
    for r in found:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 9 for s in target)


def test_main_text(spark):
    menu = "<div>Home About Us Contact Us Terms And Conditions Apply Here</div>"
    pages = [
        (1, "http://h/a", f"{menu}<div>one fine day in may</div>"), (2, "http://H/b", f"{menu}<div>two</div>"), (3, "http://g/b", menu), (4, None, None), (5, "http://h/c", ""),
        (6, "x", "<head><title>no</title></head><body><nav>menu</nav><article><h1>T &amp; U</h1><div class='ad box'>buy</div><p>a<p>b <b>c</b>d<br>e\n f<ul><li>g<li>h</ul><aside>s</aside>"
            "<script>var t='</p>'</script><!-- c --><form>q</form><section class=comments><article>no</article></section><p>&lt;i&gt; 1 &lt; 2</p></article><footer>z</footer>"),
        (6, "x", "<main><div hidden>no</div><header>no</header><p title='a > b'>yes"), (None, "y", "<article><p>never closed <b>bold"),
    ]
    found = collections.Counter(map(tuple, main_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()))
    plain = "Home About Us Contact Us Terms And Conditions Apply Here"
    assert found == collections.Counter([
        (1, "http://h/a", "one fine day in may"), (2, "http://H/b", "two"), (3, "http://g/b", plain), (4, None, ""), (5, "http://h/c", ""),
        (6, "x", "T & U\na\nb cd e f\ng\nh\n<i> 1 < 2"), (6, "x", "yes"), (None, "y", "never closed bold"),
    ])
    none = spark.createDataFrame([], "page_id long, url string, html string, text int")
    assert main_text.extract_main_text(none).count() == 0


def test_main_text_keeps_articles_and_sections(spark):
    told = "<section id=search><h2 id=related-work>Related</h2><p id=navigation>Sea ways</p></section><div class=share-price>9 euros</div><ul class='share-buttons'><li>no</ul><div class=comment-list>no</div>"
    pages = [
        (1, "http://a", "<div class=content>The text</div><article class=comment-body>no</article>"), (2, "http://b", "<script>x = '<article >'</script><!-- <main> --><div>The text</div>"),
        (3, "http://c", "<nav><article>no</article></nav><div>The text</div>"), (4, "http://d", f"<article>{told}</article>"), (5, "http://e", "<body class='post no-sidebar'><article class=post><p>The text</article>"),
    ]
    found = {r.page_id: r.text for r in main_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: "The text", 2: "The text", 3: "The text", 4: "Related\nSea ways\n9 euros", 5: "The text"}


def test_a_paragraph_ends_whatever_is_open_within():
    for depth in (1, 3, 5, 400):
        open_within = "".join(["<b>", "<i>", "<u>", "<em>", "<span>"][i % 5] for i in range(depth))
        assert main_text.blocks(f"<body><p class=ad>{open_within}x<p>Real text</body>")[1] == ["Real text"]
        assert main_text.blocks(f"<body><p class=ad>{open_within}<div>x</div>y<p>Real text</body>")[1] == ["x", "y", "Real text"]


def test_main_text_keeps_copied_pages(spark):
    menu, story = " ".join(f"m{k}" for k in range(12)), [" ".join(f"s{p}x{k}" for k in range(30)) for p in range(3)]
    article = "".join(f"<p>{p}</p>" for p in story)
    pages = [(i, "http://h/", f"<div>{menu}</div>{article}<p>day {i}</p>") for i in range(2)] + [(i, "http://h/", f"<div>{menu}</div><p>p{i} has own words</p>") for i in range(2, 7)]
    pages += [(i, "http://g/", "<p>a short text that two pages of a host have</p>") for i in (7, 8)]
    found = {r.page_id: r.text for r in main_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    told = {i: "\n".join([*story, f"day {i}"]) for i in range(2)} | {i: f"p{i} has own words" for i in range(2, 7)}
    assert found == told | {i: "a short text that two pages of a host have" for i in (7, 8)}


def test_host_repeats_decide_beside_articles(spark):
    menu, teaser = " ".join(f"m{k}" for k in range(12)), " ".join(f"t{k}" for k in range(10))
    shared = " ".join(f"s{k}" for k in range(60))
    pages = [
        (1, "http://h/1", f"<h1>Own title</h1><article><p>Story one<p>{shared}</article><div>{menu}</div>"), (2, "http://h/2", f"<div>{menu}</div><article><p>{shared}</article><p>after it</p><nav>no</nav>"),
        (3, "http://h/3", f"<article><p>Story three</article><div>{teaser}</div>"), (4, "http://h/4", f"<article><p>{teaser}<p>and on</article>"),
        (5, "http://g/5", f"<article><p>{shared}<p>five</article>"), (6, "http://g/6", f"<article><p>{shared}</article><footer>no</footer>"), (7, "http://g/7", f"<article><p>x</article><div>{menu}</div>"),
    ]
    found = {r.page_id: r.text for r in main_text.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {1: f"Own title\nStory one\n{shared}", 2: f"{shared}\nafter it", 3: "Story three", 4: f"{teaser}\nand on", 5: f"{shared}\nfive", 6: shared, 7: f"x\n{menu}"}


def test_host_repeats_by_a_sorted_suffix_array(spark):
    rng = np.random.default_rng(3)
    menu = [f"m{k}" for k in range(11)]
    pages = []
    for i in range(60):
        text = [f"{rng.integers(6)}" if rng.random() < 0.8 else f"u{i}x{k}" for k in range(int(rng.integers(0, 60)))]
        pages.append((i, f"http://h{i % 3}/", i, " ".join(menu + text if i % 3 else text)))
    run, expected = 4, {}
    suffixes = sorted((url, tuple(text.split()[k : k + run]), row, k) for _, url, row, text in pages for k in range(len(text.split()) - run + 1))
    held = collections.defaultdict(list)
    for url, head, row, k in suffixes:
        held[url, head].append((row, k))
    starts = collections.defaultdict(dict)
    for same in held.values():
        if (n := len({row for row, _ in same})) > 1:
            for row, k in same:
                starts[row][k] = n
    for i, _, row, text in pages:
        tokens, mine = text.split(), starts[row]
        gone = {k + d for k in mine for d in range(run)}
        if mine and 2 * len(gone) > len(tokens) and (len(gone) >= main_text.COPIED or len(gone) == len(tokens)):
            usual = sorted(mine.values())[len(mine) // 2]
            gone = {k + d for k, n in mine.items() if n > usual for d in range(run)}
        expected[i] = " ".join(t for k, t in enumerate(tokens) if k not in gone)
    table = spark.createDataFrame(pages, "page_id long, url string, row long, text string")
    assert {r.page_id: r.text for r in main_text.drop_host_repeats(table, run).collect()} == expected


def test_slices_of_a_suffix_array_meet_at_their_edges(spark, monkeypatch):
    same = [(i, "http://h/", i, "a b c d e f g h " + f"own{i}") for i in range(400)]
    table = spark.createDataFrame(same, "page_id long, url string, row long, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    monkeypatch.setattr(main_text, "materialise", lambda df, name: seen.append(df) or df)
    try:
        assert {r.page_id: r.text for r in main_text.drop_host_repeats(table).collect()} == {i: f"own{i}" for i in range(400)}
        run = seen[0].where("n > 1").groupBy("rank", "slice").count().groupBy("rank").count().collect()
        assert max(r["count"] for r in run) > 1  # a run on every page is spread over tasks
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_language_model(spark, docs):
    rows = corpus()
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [[*words((r[1] or "").translate(lower)), None] for r in rows]
    counts = collections.Counter()
    for r, t in zip(rows, tokens, strict=True):
        if not fold(r[0]):
            counts.update(t)
    total = sum(counts.values())
    expected = sorted((r[0] or -1, fold(r[0]), len(t), sum(counts[w] > 0 for w in t), total, round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t), 6)) for r, t in zip(rows, tokens, strict=True))
    found = maxent_lm.language_model(docs).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert maxent_lm.language_model(docs.limit(0)).count() == 0


def test_language_model_is_a_distribution(docs):
    texts = docs.select("doc_id", "text")
    counts = maxent_lm.count_words(texts).cache()
    model = maxent_lm.fit_model(texts, counts)
    vocabulary = counts.toPandas()
    words_ = vocabulary["word"].to_numpy(np.int64).view(np.uint64)
    leaf, n = model.look_up(words_)
    assert n.tolist() == vocabulary["n"].tolist()
    tokens = np.stack([np.repeat(words_[:3], len(words_)).reshape(3, -1)[k] for k in range(3)] + [words_], axis=1).reshape(-1)
    leaves = np.stack([np.repeat(leaf[:3], len(words_)).reshape(3, -1)[k] for k in range(3)] + [leaf], axis=1).reshape(-1)
    logs = maxent_lm._walk(model, tokens, leaves, np.arange(len(words_) + 1) * 4, model.weights)[3::4]
    shares = (n + 1) / np.exp(model.leaf_log[leaf])
    # the rest of each leaf is its share for unknown words
    assert 0.3 < (np.exp(logs) * shares).sum() < 1.0 + 1e-6


def test_language_model_depths_are_distributions():
    for depth in (3, 4):
        tree = maxent_lm.Tree(depth)
        nodes, outcomes = tree.paths
        biases, layer = tree.biases(np.arange(tree.size) % 7 + 1.0), tree.leaves[0]
        logs = sum(np.where(layer >= k, biases[k][nodes[k], outcomes[k]], 0.0) for k in range(depth))
        assert abs(np.exp(logs).sum() - 1) < 1e-4
    assert maxent_lm.Tree.of(10**9).size * maxent_lm.CROWD > 10**9


def test_language_model_gradient_raises_held_out_likelihood(spark):
    rng = np.random.default_rng(4)
    follows = rng.integers(0, 400, (400, 3))

    def text():
        at, found = int(rng.integers(400)), []
        for _ in range(150):
            found.append(f"w{at}")
            at = int(follows[at, rng.integers(3)] if rng.random() < 0.8 else rng.integers(400))
        return " ".join(found)

    docs = spark.createDataFrame([(i, text(), i % 7 == 2) for i in range(700)], "doc_id long, text string, held_out boolean").repartition(4).cache()
    training, held = docs.where("not held_out"), docs.where("held_out")
    counts = maxent_lm.count_words(training).cache()
    start = maxent_lm.start_model(counts)
    models = [start, maxent_lm.gradient_pass(training, start)]
    models.append(maxent_lm.gradient_pass(training, models[1]))
    scores = [sum(r.score for r in maxent_lm.score_documents(held, m, counts).collect()) for m in models]
    base = sum(r.base_score for r in maxent_lm.score_documents(held, start, counts).collect())
    assert scores[0] > 1.02 * base and scores[1] > 0.8 * scores[0] and scores[2] > scores[1]


def test_language_model_joins_rare_words(docs, monkeypatch):
    whole = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in maxent_lm.language_model(docs.coalesce(1)).collect()}
    monkeypatch.setattr(maxent_lm, "KNOWN", 60)
    few = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in maxent_lm.language_model(docs.coalesce(1)).collect()}
    assert few == {w[:4] for w in whole}


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"t{x}" for x in rng.integers(0, 5000, n))
    good = [text(120) for _ in range(30)]
    shared = text(60)
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*good, good[0], good[1] + " more", f"{text(80)} {shared}", f"{text(90)} {shared}", "too short", None])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        kept.append(sorted(map(tuple, docs.collect()), key=str))
    ids = [sorted({r[0] for r in k}) for k in kept]
    assert ids[0] == [*range(34)] and ids[1] == [x for x in range(34) if x not in (30, 31)]
    texts = {r[0]: r[1] for r in kept[2]}
    assert texts[32] == rows[32][1] and texts[33] == rows[33][1][: -len(shared) - 1]
    assert set(ids[3]) <= set(ids[2]) and len(kept[4]) == len(kept[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
