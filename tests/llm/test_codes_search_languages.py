"""Vector codes, ranked search and language identification against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillframe.llm import language_id, lexical, vector_codes
from tests.llm.samples import corpus

VECTORS = "vec_id long, embedding array<float>, label int, code string, error int"


def vectors(n=150, width=32, seed=3):
    """Rows with repeats, equal vectors, short and odd ones, and columns whose names clash with results."""
    rng = random.Random(seed)
    rows = [(i * 2, [rng.gauss(0, 0.3) for _ in range(width)], i % 4 or None) for i in range(n)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)] + [rows[7], (3, None, 1), (5, [None] * width, 1), (7, [float("nan")] * width, 2), (9, [float("inf")] + [0.0] * (width - 1), 2)]
    rows += [(2000, [0.5] * (width - 3), 3), (2002, [], None), (None, [0.25] * width, None), (2004, [3e30] * width, 9)]
    return [(*r, "x", 7) for r in rows]


def plain_codes(rows, parts, entries, rounds):
    """The iteration as the contract states it, over Python integers."""
    whole = [(i, v, label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in whole), default=0) // parts))
    bound = vector_codes.BOUND
    cut = []
    for i, v, label in whole:
        ints = [max(-bound, min(bound, math.floor(256 * float(np.float32(x))))) for x in v]
        cut.append((i, ints + [0] * (parts * width - len(ints)), label, ints))
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    books = [[r[1][p * width : (p + 1) * width] for r in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for r in cut:
                x = r[1][p * width : (p + 1) * width]
                members.setdefault(near(p, x)[1], []).append(x)
            new = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
            books[p] = new
    found = []
    for i, v, label, _ in cut:
        best = [near(p, v[p * width : (p + 1) * width]) for p in range(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
    totals = Counter()
    for _, _, d, label in found:
        totals[label] += d
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return sorted(((i, c, d, totals[label], digest) for i, c, d, label in found), key=str)


@pytest.mark.parametrize("shape", [(16, 64, 2), (8, 5, 3), (5, 20, 1)])
def test_vector_codes_equal_plain_iteration(spark, shape):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = sorted(map(tuple, vector_codes.vector_codes(df, *shape).collect()), key=str)
    assert got == plain_codes(rows, *shape)


def test_vector_codes_small_and_empty(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    few = vectors()[:3]
    assert sorted(map(tuple, vector_codes.vector_codes(spark.createDataFrame(few, VECTORS)).collect()), key=str) == plain_codes(few, 16, 64, 2)
    bad = spark.createDataFrame([(1, None, 1, "x", 1)], VECTORS)
    assert vector_codes.vector_codes(bad).collect() == []
    with pytest.raises(ValueError):
        vector_codes.train_codes(vector_codes.integer_vectors(bad), entries=300)


def test_only_changed_parts_move(spark):
    """Running sums after delta rounds equal sums over all parts; the last round sends less than the first."""
    rows = vector_codes.integer_vectors(spark.createDataFrame(vectors()[:150], VECTORS))
    state, _ = vector_codes.train_codes(rows, 4, 16, 4)
    moved = state.where("before <> code").count()
    assert 0 < moved < state.count()
    again = vector_codes.changed_sums(state.selectExpr("vec_id", "label", "v", "code as before", "code"), vector_codes.first_codebooks(rows, 4, 16))
    assert again.count() == 0


def test_label_sums_by_both_joins(spark, monkeypatch):
    coded = spark.createDataFrame([(i, i % 3 or None, "00", i) for i in range(60)], "vec_id long, label int, code string, error long")
    want = sorted(map(tuple, vector_codes.with_label_error(coded).collect()))
    monkeypatch.setattr(vector_codes, "SMALL", 1)
    monkeypatch.setattr(vector_codes, "MANY", 20)
    assert sorted(map(tuple, vector_codes.with_label_error(coded.where("vec_id < 59")).select("vec_id", "label", "code", "error").collect())) == sorted(map(tuple, coded.where("vec_id < 59").collect()))
    assert sorted(map(tuple, vector_codes.with_label_error(coded).collect())) == want


def test_decoded_vectors_are_near(spark):
    rows = spark.createDataFrame(vectors()[:150], VECTORS)
    state, books = vector_codes.train_codes(vector_codes.integer_vectors(rows))
    coded = vector_codes.encode_vectors(state, books)
    errors = {r.vec_id: r.error for r in coded.collect()}
    given = {r.vec_id: r.v for r in state.select("vec_id", "v").collect()}
    for r in vector_codes.decode_vectors(coded, books).collect():
        assert sum((a - round(256 * b)) ** 2 for a, b in zip(given[r.vec_id], r.vector, strict=True)) == errors[r.vec_id]


TERM = re.compile(lexical.TERM)


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 300, 1 << 21])
def test_search_equals_plain_scores(spark, size, monkeypatch):
    """Every document against every item, in shards of one text, of a few, and in one; items in several blocks."""
    docs = [(r[0], r[1]) for r in corpus(60)]
    items = [(i, t and t[:300]) for i, t in docs[::6]] + [(7, docs[0][1][:50]), (7, docs[0][1][:50]), (None, "the THE of"), (9, None), (10, " .,"), (11, "zzzzqq")]
    table = spark.createDataFrame([(*d, "clash", 1, 2.0) for d in docs], "doc_id long, text string, term string, shard int, score double").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item int")
    index = lexical.build_index(table, shard_terms=size)
    found = lexical.search(index, asked, item_bytes=900 if size == 300 else lexical.ITEM_BYTES)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items)


def test_search_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items, no_items = spark.createDataFrame([(1, "a")], "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(lexical.build_index(none), items).collect() == []
    assert lexical.search(lexical.build_index(some), no_items).collect() == []
    assert [tuple(r)[:3] for r in lexical.search(lexical.build_index(some), items).collect()] == [(1, 1, 1)]


def best_cut(values, reach, grain):
    """The least cost of all ways to cut a list, by plain recursion over its grains."""
    grains = [values[i : i + grain] for i in range(0, len(values), grain)]
    fixed = lexical.COST * sum(values) / len(values)
    cost = [0.0]
    for j in range(1, len(grains) + 1):
        cost.append(min(cost[i] + fixed + (m := max(x for g in grains[i:j] for x in g)) * sum(map(len, grains[i:j])) for i in range(max(0, j - reach), j) if (m := 0) == 0))
    return cost[-1]


def test_block_ends_are_the_best(spark):
    rng = np.random.default_rng(4)
    lists = [rng.integers(1, 1000, n) ** 2 for n in (1, 3, 4, 5, 9, 40, 203, 700)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    ends = lexical.cut_blocks(np.concatenate(lists), starts)
    for k, values in enumerate(lists):
        own = [0, *(ends[(ends > starts[k]) & (ends <= starts[k + 1])] - starts[k]).tolist()]
        assert own[-1] == len(values) and all(b - a <= lexical.GRAIN * lexical.REACH for a, b in zip(own, own[1:], strict=False))
        fixed = lexical.COST * values.sum() / len(values)
        cost = sum(fixed + values[a:b].max() * (b - a) for a, b in zip(own, own[1:], strict=False)) - (fixed if len(own) else 0)
        assert cost == pytest.approx(best_cut(values.tolist(), lexical.REACH, lexical.GRAIN) - fixed)


def test_documents_are_skipped(monkeypatch):
    """With a rare term in few documents, most documents are never scored."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(5, 60))) for _ in range(3000)]
    for i in range(100, 160):
        texts[i] += " rare rare rare"
    shard = lexical._Shard()
    import pyarrow as pa

    shard.add(pa.array(range(3000)), texts)
    postings = None
    queries = None
    for batch in shard.rows(0, 3000, shard.terms):
        for row in batch.to_pylist():
            if row["term"] is None:
                postings = lexical._Postings(pa.array(row["ids"]))
            else:
                postings.add(row["term"], row["docs"], row["impacts"], row["ends"], row["tops"])
    terms = sorted(postings.lists)
    weights = np.array([lexical.term_weight(len(postings.lists[t][0]), 3000) for t in terms])
    queries = lexical._Queries(np.array(terms), np.array([0]), np.array([0, len(terms)]), np.array(terms), weights, 20)
    scored = []
    whole = lexical._Postings.scores
    monkeypatch.setattr(lexical._Postings, "scores", lambda self, t, d: scored.append(len(d)) or whole(self, t, d))
    best = lexical._Best(queries)
    postings.search(queries, best)
    assert sum(scored) < 1000 and len(best.found[0][0]) == 20


LANGS = {"aa": "abcde ", "bb": "cdefg ", "çç": "éàüxyz ", "dd": "ABCxyz ", "": "klmno ", "ff": "pqrst ", "gg": "uvwxy "}


def languages(n=40, names=tuple(LANGS), seed=2):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(30, 200))), lang) for i, lang in enumerate(names * n)]
    return rows + [(9001, None, "aa"), (9002, "", "bb"), (9003, "12 345 .,", "bb"), (9004, "日本語", None), (None, rows[0][1], "aa"), rows[1], (9005, "abcde " * 120_000, "aa")]


def fold(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


@pytest.mark.parametrize("names", [("aa", "bb", "çç", "dd"), tuple(LANGS)])
def test_held_out_languages(spark, names):
    """Four languages take all splits, seven take seeded codewords."""
    rows = languages(names=names)
    docs = spark.createDataFrame([(*r, 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, held_out boolean").repartition(3)
    model = language_id.train_languages(docs.where(~language_id.held_out()))
    assert model.languages == sorted(n for n in names)
    got = {}
    for r in language_id.predict_languages(docs, model).select("doc_id", language_id.held_out().alias("held"), "lang_pred", "score", "ambiguous").collect():
        got.setdefault(r.doc_id, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 for v in got.values()) and len(got) == len({r[0] for r in rows})
    for i in (9001, 9002, 9003):
        assert {(x[1], x[2], x[3]) for x in got[i]} == {("und", 0.0, False)}
    judged = [(lang, *next(iter(got[i]))) for i, t, lang in rows if t and lang is not None and i not in (9003,) and lang in names]
    assert all(held == fold(i) for i, v in got.items() for held, *_ in v)
    held = [lang == pred for lang, held, pred, *_ in judged if held]
    assert len(held) > 20 and sum(held) / len(held) > 0.97
    assert all(0 <= score <= 1 for *_, score, _ in judged)
    assert next(iter(got[9004]))[1] in names


def test_decoding_equals_plain_losses():
    """Loss-weighted decoding and the ambiguity flag, language by language."""
    words = language_id.codewords(4)
    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(list("abcd"), words, np.zeros((1, words.shape[1]), np.float32), rng.random(words.shape[1]))
    margins = rng.normal(0, 0.2, (50, words.shape[1]))
    best, score, doubt = model.decode(margins)
    for i, f in enumerate(margins):
        losses = [sum(t * math.exp(-language_id.SHARPNESS * m * w) for t, m, w in zip(model.trust, f, word, strict=True)) for word in words]
        order = sorted(range(4), key=lambda c: (losses[c], c))
        assert best[i] == order[0] and doubt[i] == (losses[order[1]] <= (1 + language_id.DOUBT) * losses[order[0]])
        assert score[i] == pytest.approx(1 / sum(losses[order[0]] / x for x in losses), abs=1e-8)
    assert model.decode(np.zeros((1, words.shape[1])))[2].all()


def test_codewords_differ_and_grow_slowly():
    for n in (2, 3, 5, 6, 40, 300):
        words = language_id.codewords(n)
        assert len({tuple(w) for w in words.tolist()}) == n and (np.abs(words.sum(axis=0)) < n).all()
        apart = min((words[i] != words[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2 if n <= 5 else 5)
    assert language_id.codewords(300).shape[1] == 72


def test_few_languages_and_none(spark):
    kind = "doc_id long, text string, lang string"
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "x"), (3, "12", "y")], kind)
    assert {r.lang_pred for r in language_id.predict_languages(docs, language_id.train_languages(docs)).collect()} == {"und"}
    one = language_id.train_languages(spark.createDataFrame([(1, "abc", "x")], kind))
    assert [(r.lang_pred, r.score) for r in language_id.predict_languages(docs, one).orderBy("doc_id").collect()] == [("x", 1.0), ("und", 0.0), ("und", 0.0)]
    empty = spark.createDataFrame([], kind)
    assert language_id.predict_languages(empty, language_id.train_languages(empty)).collect() == []


def test_grams_of_plain_text():
    """Buckets are those of each text alone, whatever stands beside it, and equal those of the folded text."""
    texts = ["Ab, c", "", "ÉÀ x", "...", "z" * 50]
    grams, bounds = language_id.ngrams(texts)
    for i, t in enumerate(texts):
        alone, _ = language_id.ngrams([t])
        assert grams[bounds[i] : bounds[i + 1]].tolist() == alone.tolist()
    same = lambda a, b: language_id.ngrams([a])[0].tolist() == language_id.ngrams([b])[0].tolist()
    assert same("Ab, c", "ab c") and same("ÉÀ x", "éà x") and not same("ab", "ac")


