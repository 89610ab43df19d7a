"""Quality statistics, token counts, the ORC store and byte-level BPE against plain definitions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillframe.llm import byte_bpe, pretokens, quality, token_counts, token_store
from quillframe.llm.common import gathered, scratch_folder
from tests.llm.samples import SCHEMA, corpus, words

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def counter(rows):
    return collections.Counter(map(tuple, rows))


def test_quality_statistics(docs):
    def expected(doc_id, text):
        w, seen, dup = words(text), set(), 0
        for line in (text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        runs = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return (doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed)

    trees = quality.grow_trees(np.zeros((0, 11)), np.zeros(0), list(quality.FEATURES.values()))
    found = quality.assess_quality(docs, trees).drop("kept", "margin").collect()
    assert counter(found) == collections.Counter(expected(r[0], r[1]) for r in corpus())


def test_quality_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.2 * rng.random(600) < 0.6).astype(float)
    trees = quality.grow_trees(x, y, [-1, 0, 1])
    assert ((trees.margin(x) > 0) == (y > 0)).mean() > 0.9
    for feature, sign in ((0, -1), (2, 1)):
        grid = np.repeat(x[:50], 40, axis=0)
        grid[:, feature] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(trees.margin(grid).reshape(50, 40), axis=1) >= -1e-12).all()


def test_quality_fit_keeps_good_and_all_columns(spark):
    good = [(i, " ".join(f"w{(i * 7 + k) % 90}x{k}" for k in range(80)), "a") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{(i * 7 + k) % 90}x{k}***" for k in range(80)), "b") for i in range(30)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, margin string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in good + bad] + [(None, 1), (1, None)], "doc_id long, quality int")
    kept = quality.keep_quality(docs, quality.fit_quality(docs, labels))
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert quality.fit_quality(docs, labels.limit(0)).roots.size == 0
    assert quality.keep_quality(docs.limit(0), quality.fit_quality(docs, labels)).count() == 0
    twice = docs.unionByName(docs.where("doc_id < 30").withColumn("text", F.concat("text", F.lit(" ***"))))
    one, other = (quality.fit_quality(d, labels) for d in (twice.repartition(3), twice.orderBy("text").coalesce(1)))
    assert all(np.array_equal(getattr(one, k), getattr(other, k)) for k in ("feature", "cut", "value"))
    assert quality.assess_quality(docs.limit(0), quality.fit_quality(docs, labels)).count() == 0


def test_token_counts(docs, tokenizer):
    expected = collections.Counter()
    for doc_id, text, *_ in corpus():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected[doc_id, len((text or "").encode()), n, n > 512] += 1
    assert counter(token_counts.count_tokens(docs, JSON).collect()) == expected
    clash = docs.withColumn("n_tokens", F.lit("x")).select("n_tokens", "doc_id", "text")
    assert token_counts.count_tokens(clash.limit(0), JSON).count() == 0 and token_counts.count_tokens(clash, JSON).count() == docs.count()


def test_pieces_are_what_the_library_gives(tokenizer):
    rng = random.Random(6)
    bag = ["the", "and", "Quick", "naïve", "日本", " ", "  ", "\n", "\n\n", "\t", "\0", ".", ",", "!", "'s", "it's", "<|endoftext|>", "123", "\x1c", "\u00a0", "a\0b", "\r", "#$%"]
    library = pretokens.Library(*pretokens.load(JSON))
    for text in ["x \0nul y", " \0", "\0", "a \0", *("".join(rng.choice(bag) + rng.choice(["", " "]) for _ in range(rng.randrange(12))) for _ in range(8000))]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(library.encode(text), np.uint32).tolist() == ids and library.count(text) == len(ids), repr(text)


def test_full_caches_keep_the_first_tier(monkeypatch, tokenizer):
    monkeypatch.setattr(pretokens, "PIECES_KEPT", 3)
    library = pretokens.Library(*pretokens.load(JSON))
    text = " ".join(f"word{k} the of" for k in range(50))
    assert library.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert "the" in library.counts and len(library.counts) <= len(library.counts.given) + 3


def test_ids_of_many_texts_at_once(monkeypatch, tokenizer):
    rng = random.Random(3)
    bag = ["the", "naïve", "日本", "Привет", " ", "  ", "\n", "\n\n", "\t", "\0", ".", ",", "''s", "it's", "<|endoftext|>", "<|", "|>", "endoftext", "123", "\x1c", "\x85", "\u00a0", "\u3000", "\u200d", "²", "\r", "#$%"]
    texts = [None, "", *("".join(rng.choice(bag) + rng.choice(["", "", " "]) for _ in range(rng.randrange(14))) for _ in range(8000)), "x" * 5000, None]
    monkeypatch.setattr(pretokens, "LISTS_KEPT", 500)
    monkeypatch.setattr(pretokens, "RUN", 300)
    library = pretokens.Library(*pretokens.load(JSON))
    column = pa.array(texts)
    for kind in (pa.string(), pa.large_string()):
        found = [ids for a in range(0, len(texts), 450) for ids in library.encode_texts(column.cast(kind).slice(a, 450), [7]).to_pylist()]
        assert found == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert len(library.kept) == len(library.lists) == len(library.uses) <= 500 and "x" * 5000 not in library.kept.to_pylist()
    assert library.encode_texts(column.slice(0, 0), [7]).to_pylist() == []
    library.opens[:] = False  # as if the vocabulary had no spaces
    words = pa.array(["new0 new1, new2\nnew3", "new4"])
    assert library.encode_texts(words).to_pylist() == [tokenizer.encode(t, add_special_tokens=False).ids for t in words.to_pylist()]


def test_new_pieces_go_to_the_library_together():
    library = pretokens.Library(*pretokens.load(JSON))
    asked, given = [], library.tokenizer

    class Counted:
        def __getattr__(self, name):
            return lambda *a, **b: asked.append(name) or getattr(given, name)(*a, **b)

    library.tokenizer = library.model = Counted()
    texts = pa.array([" ".join(f"{chr(97 + k % 26)}x{k}th" for k in range(a, a + 500)) for a in range(0, 5000, 250)])
    library.encode_texts(texts)
    assert len(asked) == 1  # some 5,000 words that no cache holds
    library.encode_texts(texts)
    assert len(asked) == 1


def test_small_batches_are_gathered_in_order():
    given = [pa.RecordBatch.from_arrays([pa.array(range(a, a + n), pa.int64())], names=["k"]) for a, n in ((0, 3), (3, 2), (5, 1000), (1005, 0), (1005, 4))]
    found = list(gathered(iter(given), 50))
    assert [len(b) for b in found] == [5, 1000, 4] and pa.Table.from_batches(found) == pa.Table.from_batches(given)
    assert list(gathered(iter([]), 50)) == []


def test_token_store(spark, docs, tokenizer):
    path = scratch_folder(spark, "store")
    token_store.write_tokens(docs, path, JSON)
    found = token_store.read_tokens(spark, path).orderBy(F.col("start")).collect()
    ids = {t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in corpus()}
    assert counter((r.doc_id, tuple(r.token_ids)) for r in found) == collections.Counter((r[0], tuple(ids[r[1]])) for r in corpus())
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    in_order = [r.doc_id for r in found]
    assert in_order == sorted(in_order, key=lambda d: (d is not None, d or 0))
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.checksums(token_store.read_tokens(spark, path)).collect()}
    assert all(sums[r.doc_id, r.start] == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in found)
    picked = token_store.find_documents(spark, path, [1, 4, -9])
    assert {r.doc_id for r in picked.collect()} == {1, 4}
    assert "PushedFilters: [In(doc_id" in picked._jdf.queryExecution().executedPlan().toString()
    empty = scratch_folder(spark, "store")
    token_store.write_tokens(docs.limit(0), empty, JSON)
    assert token_store.checksums(token_store.read_tokens(spark, empty)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (120, 20), (60, 59)])
def test_byte_bpe(docs, chunk, overlap):
    import tiktoken

    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    tokens = byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap)
    expected = collections.Counter((r[0], tuple(encoding.encode_ordinary(r[1] or ""))) for r in corpus())
    assert counter((r.doc_id, tuple(r.token_ids)) for r in tokens.collect()) == expected
    assert counter((r.doc_id, bytes(r.content)) for r in byte_bpe.decode_ids(tokens, RANKS).collect()) == collections.Counter((r[0], (r[1] or "").encode()) for r in corpus())
    digest = byte_bpe.digests(tokens.where("doc_id = 1"), RANKS).first()
    text = corpus()[0][1]
    ids = encoding.encode_ordinary(text)
    assert digest[1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert byte_bpe.digests(byte_bpe.encode_texts(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_frequent_entries_stay_in_a_full_cache():
    from quillframe.llm.pretokens import _Memo

    made: list[str] = []
    memo = _Memo(lambda k: made.append(k) or k.upper(), 10, {"given": "G"})
    for i in range(100):
        assert (memo["often"], memo[f"once{i}"], memo["given"]) == ("OFTEN", f"ONCE{i}", "G")
        assert len(memo) + len(memo.before) <= 12
    assert made.count("often") == 1 and "given" not in made


def test_encoding_leaves_no_coder_in_workers(spark, docs):
    def held(batches):
        from quillframe.llm import byte_bpe as in_worker

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(in_worker._coders)])], names=["coders"])
            in_worker._coders.clear()

    workers = spark.range(64).repartition(64).mapInArrow(held, "coders long")
    workers.collect()  # what other tests left
    byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN).write.format("noop").mode("overwrite").save()
    assert sum(r.coders for r in workers.collect()) == 0


def test_pipeline_encodes_and_digests_one_after_the_other(spark, docs):
    staged = corpus_pipeline.encoding_stage(spark, docs, "")
    assert str(staged._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    direct = byte_bpe.digests(byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    assert collections.Counter(map(tuple, staged.collect())) == collections.Counter(map(tuple, direct.collect()))
