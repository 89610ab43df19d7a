"""The n-gram join, substring dedup and SpotSigs against brute force."""

import collections
import hashlib

import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quillframe.llm import common, graph, ngram_join, spotsigs, substring_dedup
from quillframe.llm.graph import connected_components
from tests.llm.samples import SCHEMA, corpus, words

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def shingles(text, size):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def components(sets, percent):
    union = ngram_join._Union(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                union.join(i, j)
    return [union.find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(docs, size, percent):
    rows = corpus()
    sets = [shingles(r[1], size) for r in rows]
    roots = components(sets, percent)
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[root] = min(r[0], least.get(root, r[0]))
    expected = collections.Counter((r[0], len(s), least.get(root) if s else r[0]) for r, s, root in zip(rows, sets, roots, strict=True))
    assert collections.Counter(map(tuple, ngram_join.similar_components(docs, size, percent).collect())) == expected
    kept = ngram_join.keep_one(docs, size, percent)
    assert kept.schema == docs.schema
    empties = len({(r[0], r[1]) for r, s in zip(rows, sets, strict=True) if not s})
    assert kept.count() == len({root for root, s in zip(roots, sets, strict=True) if s}) + empties


def test_ngram_join_blocks_of_one_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(["x", *base[: 60 - i % 5], *[f"v{i % 7}"] * (i % 3)])) for i in range(50)]
    rows += [(100 + i, " ".join([*base[:40], *[f"z{i}_{k}" for k in range(20)]])) for i in range(20)]
    roots = components([shingles(t, 4) for _, t in rows], 85)
    found = {r.doc_id: r.component_id for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert found == {r[0]: rows[roots.index(root)][0] for r, root in zip(rows, roots, strict=True)}


def test_ngram_join_of_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 10)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    copy = " ".join(f"c{k}" for k in range(30))
    rows = [(None, copy, "x")] * 300 + [(i, copy, "y") for i in range(5, 200)] + [(None, None, None)] * 40 + [(1000 + i, f"{copy} extra{i}", "z") for i in range(40)] + [(5, copy, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    found = ngram_join.similar_components(docs).collect()
    assert len(found) == len(rows) and {(r.component_id, r.n_shingles) for r in found if r.n_shingles} == {(5, 26), (5, 27)}
    kept = sorted(map(tuple, ngram_join.keep_one(docs).collect()), key=str)
    assert [k[:2] for k in kept] == [(5, copy), (None, None)] and kept[0][2] in ("y", "other")


def test_joins_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 0)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(None, 7), (2, 8), (3, 9)], "k long, v long")
    monkeypatch.setattr(common, "HOT", 10)
    small = spark.createDataFrame([(1, "a", 50), (2, None, 1), (9, "z", 0)], "k long, name string, key_rows long")
    found = collections.Counter(map(tuple, common.join_hot(rows, small, "k").collect()))
    assert found == collections.Counter([(1, i, "a") for i in range(50)] + [(None, 7, None), (2, 8, None), (3, 9, None)])


def test_signatures_meet_every_link():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, int(rng.integers(1, 150)), dtype=np.uint64)
        for _ in range(6):
            changed = base.copy()
            at = rng.random(len(base)) < rng.choice([0, 0.03, 0.06, 0.1])
            changed[at] = rng.integers(0, 2**63, int(at.sum()), dtype=np.uint64)
            sets.append(np.unique(changed[rng.random(len(base)) > rng.choice([0, 0.05])]))
    sets = [s for s in sets if len(s)]
    plain = [set(s.tolist()) for s in sets]
    sent = [set(ngram_join._signatures([s], [b"k"], 85)[0].tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            both = len(plain[i] & plain[j])
            assert 100 * both < 85 * (len(plain[i]) + len(plain[j]) - both) or sent[i] & sent[j]
    union = ngram_join._Union(len(sets))
    for a, b in ngram_join.link_stars(sets, 85):
        union.join(a, b)
    roots = components(plain, 85)
    assert len({(union.find(i), r) for i, r in enumerate(roots)}) == len(set(roots)) == len({union.find(i) for i in range(len(sets))})


@pytest.mark.parametrize("cells", [1, 64, 1 << 20])
def test_first_members_meet_every_link(monkeypatch, cells):
    monkeypatch.setattr(ngram_join, "CELLS", cells)
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, int(rng.integers(1, 120)), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) > lost], rng.integers(0, 2**63, int(more), dtype=np.uint64)])) for lost, more in zip(rng.choice([0, 0.05, 0.1], 6), rng.integers(0, 9, 6), strict=True)]
    counts = rng.integers(0, 5, cells)
    first = [set(ngram_join.first_members(s, counts, 85).tolist()) for s in sets]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(set(a.tolist()) & set(sets[j].tolist()))
            assert not both or 100 * both < 85 * (len(a) + len(sets[j]) - both) or first[i] & first[j]
    assert [len(ngram_join.first_members(np.arange(n, dtype=np.uint64), counts, 85)) for n in (0, 1, 7, 20, 100)] == [0, 1, 2, 4, 16]


def test_near_copies_of_a_wide_family_are_related_by_few_members(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDE", 4)
    joined, plain = [], ngram_join.join_hot

    def counted(rows, small, key, total=None):
        found = plain(rows, small, key, total)
        if key == "member":
            joined.append(found.where("least is not null and least <> node").count())
        return found

    monkeypatch.setattr(ngram_join, "join_hot", counted)
    rng = random.Random(8)
    texts = []
    for base in range(3):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
        for _ in range(25):
            at = rng.randrange(200)
            texts.append(" ".join([*words[:at], f"x{rng.random()}", *words[at + 1 :]][base:]))
        words = words[:150] + [f"v{rng.randint(0, 5000)}" for _ in range(50)]
        texts.append(" ".join(words))
    found = ngram_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    roots = components(sets, 85)
    assert len({(r.component_id, roots[r.doc_id]) for r in found}) == len(set(roots)) == len({r.component_id for r in found}) == 6
    assert joined and 0 < sum(joined) < 8 * len(texts)


def test_signatures_are_few_and_leave_nothing_on_disk(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (600, 650, 700, 750, 800, 850, 900, 950)]
    signatures, nodes = ngram_join._signatures(sets, [bytes([k]) for k in range(len(sets))], 80)
    assert len(set(nodes.tolist())) == 14 and len(signatures) < 3100  # 3,430 if small sets of a class sent as many as its largest

    monkeypatch.setattr(ngram_join, "ROUND", 50)
    monkeypatch.setattr(ngram_join, "WIDE", 4)
    monkeypatch.setattr(common, "scratch_folder", lambda spark, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}")
    texts = []
    for _ in range(12):
        words = [f"w{rng.integers(5000)}" for _ in range(60)]
        texts += [" ".join([*words[:at], f"x{rng.random()}", *words[at + 1 :]]) for at in rng.integers(0, 60, 6)]
    found = ngram_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85).collect()
    roots = components([shingles(t, 4) for t in texts], 85)
    assert len({(r.component_id, roots[r.doc_id]) for r in found}) == len(set(roots)) == len({r.component_id for r in found})
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "relations" in left and "rare_relations" in left and not left & {"signatures", "wide_texts", "held_members"}


@pytest.mark.parametrize("rest", [0, 20, 20_000])
def test_components_of_long_chains(spark, monkeypatch, rest):
    monkeypatch.setattr(graph, "REST", rest)
    edges = [(i, i + 1) for i in range(70)] + [(200, 201), (201, 199), (3, 3)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(71)} | {199: 199, 200: 199, 201: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    named = [(bytes([200, a]), bytes([b])) for a, b in [(1, 130), (2, 130), (3, 4)]]
    found = {(bytes(r.node), bytes(r.label)) for r in connected_components(spark.createDataFrame(named, "a binary, b binary")).collect()}
    assert found == {(b"\xc8\x01", b"\x82"), (b"\xc8\x02", b"\x82"), (b"\x82", b"\x82"), (b"\xc8\x03", b"\x04"), (b"\x04", b"\x04")}


def brute_removed(rows, size):
    least = {}
    order = lambda d: 1 << 62 if d is None else d
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            run = tuple(w[i : i + size])
            least[run] = min(order(d), least.get(run, order(d)))
    for d, t, *_ in rows:
        w = words(t)
        gone = {i + k for i in range(len(w) - size + 1) if least[tuple(w[i : i + size])] < order(d) for k in range(size)}
        yield d, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("size", [50, 12])
def test_substring_dedup(docs, size):
    expected = collections.Counter(brute_removed(corpus(), size))
    assert collections.Counter(map(tuple, substring_dedup.removed_words(docs, size).collect())) == expected
    assert sum(n[2] for n in expected) > 0
    kept = substring_dedup.drop_repeats(docs, size)
    assert kept.schema.names == docs.schema.names and kept.count() == docs.count()


def test_substring_dedup_with_a_full_filter(docs):
    rows = docs.select(F.coalesce("doc_id", F.lit(1 << 62)).alias("doc"), substring_dedup._tag("text").alias("tag"), "text")
    full = substring_dedup.covered_windows(rows, 50, bloom_bits=1 << 3)
    usual = substring_dedup.covered_windows(rows, 50)

    def places(found):
        return {(r.doc, r.tag, x.start + k) for r in found.collect() for x in r.runs for k in range(x["count"])}

    assert places(full) == places(usual)


def test_substring_dedup_of_many_null_ids(spark):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(None, f"own{i} {shared} end{i}" if i % 4 == 0 else " ".join(f"w{i}x{k}" for k in range(i % 90))) for i in range(20_000)] + [(None, shared)] * 50 + [(3, shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept if r.n_removed else "") for r in substring_dedup.removed_words(docs).collect())
    expected = collections.Counter((d, len(words(t)), 60 if d is None and "s59" in t else 0, t.replace(shared, "").replace("  ", " ") if d is None and "s59" in t else "") for d, t in rows)
    assert found == expected


def test_substring_dedup_keeps_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(55))
    docs = spark.createDataFrame([(1, text, "a", "b"), (2, f"x {text}", "c", "d")], "doc_id long, text string, runs string, tag string")
    kept = substring_dedup.drop_repeats(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == [(1, text, "a", "b"), (2, "x", "c", "d")]
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    assert ngram_join.similar_components(none).count() == 0 and substring_dedup.removed_words(none).count() == 0
    assert spotsigs.compare_edits(none, ["the"]).count() == 0


def test_spotsigs(docs):
    rows = corpus()
    found = spotsigs.compare_edits(docs, spotsigs.common_words(docs)).collect()
    assert len(found) == len(rows)
    prints = {}
    for r in found:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    by_text = collections.defaultdict(set)
    ids = {r[0]: r[1] for r in rows}
    unique = [r[0] for r in rows if r[0] is not None and sum(q[0] == r[0] for q in rows) == 1]
    for r in found:
        if r.doc_id is not None:
            by_text[ids[r.doc_id] or ""].add(r.fingerprint)
    assert max(map(len, by_text.values())) == 1
    ordered = sorted(ids.keys() - {None}, reverse=True)
    edits = {r.doc_id: r for r in found}
    for d, following in zip(ordered, ordered[1:], strict=False):
        if d in unique and following in unique:
            text, other = ids[d] or "", ids[following] or ""
            k = len(text) // 3
            assert edits[d].edited_sha256 == hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest()


def test_spotsigs_next_wraps_around(spark):
    one = spotsigs.compare_edits(spark.createDataFrame([(7, "the quick brown fox")], "doc_id long, text string"), ["the"]).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"the quick browthe qu"[:13] + b"the qu").hexdigest()
    two = spotsigs.compare_edits(spark.createDataFrame([(1, "abc def"), (2, "xyz uvw")], "doc_id long, text string"), ["the"]).collect()
    assert {r.doc_id: r.edited_sha256 for r in two} == {1: hashlib.sha256(b"abc dxy").hexdigest(), 2: hashlib.sha256(b"xyz uab").hexdigest()}


def test_spotsigs_pairs(docs):
    anchors = spotsigs.common_words(docs)
    fingerprints = spotsigs.fingerprint_documents(docs.where("doc_id is not null"), anchors)
    reps = {}
    for r in fingerprints.collect():
        reps[frozenset(r.found)] = min(r.doc_id, reps.get(frozenset(r.found), r.doc_id))
    expected = {tuple(sorted((i, j))) for s, i in reps.items() for t, j in reps.items() if i < j and len(s & t) >= 0.8 * len(s | t)}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(fingerprints).collect()} == expected


def signatures(text, anchors):
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    found = {(a, tuple([x for x in w[i + 1 : i + 1 + spotsigs.REACH] if x not in anchors][: spotsigs.CHAIN])) for i, a in enumerate(w) if a in anchors}
    return frozenset(found or {("whole", tuple(w))})


def test_spotsigs_fingerprints_by_definition(docs):
    rows = [(i, t or "") for i, t, *_ in corpus()]
    anchors = spotsigs.common_words(docs)
    told = spotsigs.compare_edits(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), anchors).collect()
    texts = dict(r for r in reversed(rows) if r[0] is not None)
    order = sorted(texts, reverse=True)
    names = {}

    def jaccard(a, b):
        return len(a & b) / len(a | b)

    for r in told:
        text, following = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        third = len(text) // 3
        mine, changed, other = (signatures(t, anchors) for t in (text, text[: len(text) - third] + following[:third], following))
        assert names.setdefault(r.fingerprint, mine) == mine and names.setdefault(r.edited_fingerprint, changed) == changed
        assert len(r.fingerprint) == 16 * len(mine)
        assert (r.near_edited, r.near_next) == (jaccard(mine, changed), jaccard(mine, other))
    assert len(told) == len(texts) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("similarity", [0.8, 0.6])
def test_spotsigs_pairs_of_random_families(spark, monkeypatch, similarity):
    monkeypatch.setattr(spotsigs, "FREQUENT", 20)
    rng = random.Random(3)
    sets = set()
    for _ in range(12):
        base = rng.sample(range(400), rng.randint(1, 40))
        for _ in range(12):
            sets.add(frozenset(set(rng.sample(base, max(1, len(base) - rng.randint(0, 6)))) | set(rng.sample(range(30), rng.randint(0, 3)))))
    rows = [(i, sorted(s)) for i, s in enumerate(sorted(sets, key=sorted))]
    expected = [(i, j) for i, a in rows for j, b in rows if i < j and len(set(a) & set(b)) / len(set(a) | set(b)) >= similarity]
    found = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, found array<long>"), similarity).collect()
    assert len(expected) > 100 and sorted((r.a, r.b) for r in found) == expected


@pytest.mark.parametrize("frequent", [0, 15, 1000])
def test_spotsigs_prefixes_by_definition(spark, monkeypatch, frequent):
    monkeypatch.setattr(spotsigs, "FREQUENT", frequent)
    rng = random.Random(frequent)
    sets = {k: sorted(rng.sample(range(-40, 40), rng.randint(1, 30))) for k in range(40)}
    held = collections.Counter(x for s in sets.values() for x in s)
    top = dict(sorted(((x, c) for x, c in held.items() if c > 1), key=lambda p: (-p[1], p[0]))[:frequent])
    expected = []
    for k, s in sets.items():
        order = sorted(s, key=lambda x: (top.get(x, 0), x))
        expected += [(k, len(s), place, x) for place, x in enumerate(order[: len(s) - -(-len(s) * 8 // 10) + 1])]
    rows = spark.createDataFrame([(k, len(s), s) for k, s in sets.items()], "k long, n int, found array<long>")
    assert sorted(map(tuple, spotsigs._prefixes(rows, 0.8).collect())) == expected
    assert spotsigs._prefixes(rows.limit(0), 0.8).count() == 0


def test_spotsigs_class_names(spark):
    rows = [(1, [1, 2]), (2, [1, 2]), (3, [1]), (4, [2]), (5, [1, 2, 3]), (6, [-1])]
    names = {r.doc_id: r["class"] for r in spotsigs._classed(spark.createDataFrame(rows, "doc_id long, found array<long>")).collect()}
    assert names[1] == names[2] and len(set(names.values())) == 5 and all(len(n) == 32 for n in names.values())


def test_spotsigs_components_name_every_row(spark):
    near = list(range(2, 12))
    rows = [(1, [500]), (2, [500]), (None, near), (None, near[:9]), (7, near[1:]), (9, [700, 701]), (9, [800, 801]), (None, [900]), (None, [900]), (5, [601, 602, 603, 604, 605]), (5, [601, 602, 603, 604])]
    found = spotsigs.near_components(spark.createDataFrame(rows, "doc_id long, found array<long>")).collect()
    assert len(found) == len(rows)
    classes = collections.defaultdict(list)
    for r in found:
        classes[r["class"]].append((r.doc_id, r.component_id))
    expected = [[(1, 1), (2, 1)], [(None, 7)], [(None, 7)], [(7, 7)], [(9, 9)], [(9, 9)], [(None, None)] * 2, [(5, 5)], [(5, 5)]]
    assert sorted(map(str, map(sorted, classes.values()))) == sorted(map(str, expected))
    pairs = spotsigs.near_duplicates(spark.createDataFrame(rows, "doc_id long, found array<long>")).collect()
    assert sorted((str(p.a), str(p.b)) for p in pairs) == [("5", "5"), ("7", "None"), ("7", "None"), ("None", "None")]
    assert all(p.class_a != p.class_b for p in pairs)
