"""Corpus operators against brute force, the libraries themselves, exact round trips and held-out accuracy."""

import collections
import resource
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests_llm_brute import brute_cut, brute_hits, brute_links, brute_merge, brute_pack, words

from tidemark.llm import attention_lm, components, decontamination, jaccard_join, language_id, nn_descent, packing, quotation_links, ragged, session, substring_dedup, subwords, token_counts, wavelet

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    "", " ", "\n\t ", "a", "Word", "word " * 300, "x" * 9000, "é ́ ß Σ ΟΔΟΣ 日本語 한국어 🙂🙂", "a  b\n\nc\r\n d e  f", "don't I'LL x'y 12,345.6 --- ***the*** <|endoftext|> <|startoftext|>z", "▁ ▁▁ x ▁y", "= " * 70 + " " * 333 + "x",
    "\x00 \x01 a\x01b", "<s></s><unk><0x0A>",
]


def frame(spark, texts, first=0, extra=""):
    rows = [(i + first, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    return [r["text"] for r in rows]


# Helpers


def test_ragged_words_and_hashes(sample):
    texts = [*sample[:50], None, *ODD]
    data, offsets = ragged.text_bytes(pa.array(texts, pa.string()))
    starts, ends, rows = ragged.spans(data, offsets, ragged.NOT_SPACE)
    raw = data.tobytes()
    assert [[raw[a:b].decode() for a, b in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(rows[:-1], rows[1:], strict=True)] == [words(t) for t in texts]
    hashes, seen = ragged.span_hash(data, starts, ends), {}
    for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
        assert seen.setdefault(h, raw[a:b]) == raw[a:b]
    assert len(seen) == len({raw[a:b] for a, b in zip(starts, ends, strict=True)})
    assert ragged.ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]


def test_blocks_regroup_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 50, 1, 1, 1, 0, 30)], "n": list(range(7))})
    for limit in (1, 10, 60, 1000):
        out = list(ragged.blocks([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)], "text", limit))
        assert [x for b in out for x in b.column("n").to_pylist()] == list(range(7))
    assert not list(ragged.blocks([batch.slice(0, 0)], "text", 9))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 5), (8, 9), (1, 2)], "a long, b long")
    assert {r["id"]: r["component"] for r in components.components(edges, "test").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert components.components(edges.where("false"), "test").count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert components.components(chain, "test").where("component = 0").count() == 61


# 10: token counts


def test_token_counts_equal_the_library(spark, sample):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [*sample, None, *ODD, *ODD]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(frame(spark, texts), path, limit=500).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", num_threads=1))
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 500), repr(t)[:60]
    assert token_counts.token_counts(frame(spark, ["a"]).where("false"), path).count() == 0


@pytest.mark.parametrize("rounds", [48, 2, 0])
def test_merging_by_rounds_equals_merging_one_by_one(monkeypatch, rounds):
    monkeypatch.setattr(token_counts, "ROUNDS", rounds)
    rng = np.random.default_rng(0)
    for seed in range(30):
        pieces = list(dict.fromkeys([*"abc", *("".join(rng.choice(list("abc"), rng.integers(2, 6))) for _ in range(25))]))
        scores = [0.0, 0.0, 0.0, *(-float(rng.integers(0, 12)) for _ in pieces[3:])]
        vocab = token_counts.Vocabulary(pieces, scores, [True] * len(pieces))
        lists = [rng.integers(0, 3, rng.integers(1, 40)) for _ in range(20)]
        ids, offsets = np.concatenate(lists).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in lists])]
        got = token_counts.merged_counts(ids, np.ones(len(ids), np.int64), offsets, vocab.pairs)

        def find(a, b, pairs=vocab.pairs):
            rank, product = pairs.find(np.array([a]), np.array([b]))
            return (None, None) if rank[0] == token_counts.NONE else (int(rank[0]), int(product[0]))

        assert got.tolist() == [len(brute_merge(x.tolist(), find)) for x in lists], seed


def test_token_counts_of_unspaced_texts():
    import base64

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = np.random.default_rng(1)
    words = ["the", "tion", "ing", "ä", "other", "zz", "aaaa", "ß", "日本"]
    texts = [base64.b64encode(rng.bytes(30_000)).decode(), "".join(rng.choice(words, 5000)), "a" * 4097, "aba" * 999, "日本語" * 400, "=" * 3000]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    _, n = token_counts.count_block(pa.array(texts), token_counts.vocabulary(path))
    assert n.tolist() == [len(x) for x in library.encode(texts, num_threads=1)]


# Subword ids, 4: wavelet matrices, 7: packing


@pytest.mark.parametrize(("name", "kept"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_subwords_equal_the_library(sample, name, kept):
    from tokenizers import Tokenizer

    texts = [*sample[:60], *ODD, None]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    ids, offsets = subwords.encoder(public_tokenizers.path(name), kept)(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)[:60]


@pytest.mark.parametrize(("name", "kept"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_subwords_of_odd_white_space_equal_the_library(name, kept):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(3)
    marks = ["\xa0", "\u2003", "\u3000", "\x85", "\u2028", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", " ", "  ", "\x01", "a", "Bonjour", "é", "!", "7", "'s", "日", "<|x|>"]
    batches = [["hello", "\xa0\xa0Bonjour x"], *(["".join(rng.choice(marks, rng.integers(0, 9))) for _ in range(60)] for _ in range(40))]
    for batch in batches:
        ids, offsets = subwords.Encoder(public_tokenizers.path(name), kept)(pa.array(batch, pa.string())) if batch is batches[0] else subwords.encoder(public_tokenizers.path(name), kept)(pa.array(batch, pa.string()))
        for i, t in enumerate(batch):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_wavelet_width():
    with pytest.raises(ValueError, match="planes"):
        wavelet.WaveletMatrix.build(np.array([70000, 5]), 16)
    assert wavelet.WaveletMatrix.build(np.array([70000, 5]), 17).all().tolist() == [70000, 5]


@pytest.mark.parametrize("n", [0, 1, 7, 513, 5000])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 50, n).astype(np.uint32) * 997
    docs, lengths = pa.array([None, 2][: min(n, 2)], pa.int64()), np.array([n // 2, n - n // 2][: min(n, 2)])
    matrix, back, sizes = wavelet.load(wavelet.dump(wavelet.WaveletMatrix.build(ids, 16), docs, lengths))
    assert matrix.all().tolist() == ids.tolist() and back.to_pylist() == docs.to_pylist() and sizes.tolist() == lengths.tolist()
    for i in range(0, n, max(1, n // 23)):
        v = int(ids[i])
        assert matrix.access(i) == v and matrix.rank(v, i) == int((ids[:i] == v).sum()) and matrix.count(v) == int((ids == v).sum())
        where = np.flatnonzero(ids == v)
        assert [matrix.select(v, k) for k in (0, len(where) - 1)] == [where[0], where[-1]]
    assert matrix.count(3) == 0 and matrix.count(1 << 20) == 0
    with pytest.raises(IndexError):
        matrix.select(3, 0)


def test_wavelet_shards_round_trip(spark, sample):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*sample[:80], None, "", "x"]
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in wavelet.encoded(frame(spark, texts).orderBy(F.desc("doc_id")), path, shards=3).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    out = session.scratch(spark, "wavelet")
    wavelet.write_shards(frame(spark, texts), path, out, shards=3)
    shards = spark.read.schema(wavelet.SHARD).parquet(out)
    own = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    token = own[0][1]
    assert sorted((r["doc_id"], r["offset"]) for r in wavelet.occurrences(shards, token).collect()) == [(i, k) for i, x in enumerate(own) for k, t in enumerate(x) if t == token]
    assert {r["token"]: r["n"] for r in wavelet.counted(shards, [token, 2]).collect()} == {token: sum(x.count(token) for x in own), 2: len(own)}
    assert {r["doc_id"]: r["token"] for r in wavelet.ids_at(shards, 1).collect()} == {i: x[1] for i, x in enumerate(own) if len(x) > 1}
    again = wavelet.encoded(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string"), path)
    assert sorted((r["n_tokens"], r["start"]) for r in again.collect()) == [(2, 0), (2, 2), (2, 4)]
    assert wavelet.encoded(frame(spark, ["a"]).where("false"), path).count() == 0


def test_packing_holds_every_token_once(spark, sample):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*sample[:120], None, "", "word " * 9000]
    library = Tokenizer.from_file(path)
    pieces = packing.packed(frame(spark, texts), path).collect()
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(docs[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    total = 0
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        total += at
    assert len(sequences) * 2048 - total < 2048 * 5  # less than a sequence for each task
    assert packing.packed(frame(spark, ["a"]).where("false"), path).count() == 0


def test_packing_cuts_only_where_no_sequence_has_room():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.pareto(1.1, 4000) * 60 + 1, 30_000).astype(np.int64)
    pieces = packing.balanced(lengths, 2048, 1.0, 1 / 4096)
    total = collections.Counter()
    for doc, _, n, _, _ in pieces:
        total[doc] += n
    assert [total[i] for i in range(len(lengths))] == lengths.tolist()
    assert len(pieces) == brute_pack(lengths.tolist(), 2048, 1.0, 1 / 4096)[0]


def test_packing_balances_costs():
    lengths = np.random.default_rng(1).integers(1, 900, 400)
    pieces = np.array(packing.balanced(lengths, 2048, 1.0, 1 / 4096))
    assert np.bincount(pieces[:, 0], pieces[:, 2]).astype(int).tolist() == lengths.tolist()
    load = np.bincount(pieces[:, 3], pieces[:, 2])
    assert load.max() <= 2048 and len(load) == -(-lengths.sum() // 2048)
    cost = np.bincount(pieces[:, 3], pieces[:, 2] + pieces[:, 2] ** 2 / 4096)
    assert np.sort(cost)[2:-2].max() < 1.3 * np.sort(cost)[2:-2].min()
    assert packing.balanced(np.zeros(0, np.int64), 2048, 1.0, 1.0) == []


# 3: decontamination


@pytest.mark.parametrize("part_bytes", [1 << 24, 500])
def test_decontamination(spark, sample, part_bytes):
    rows = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in rows] + [(900, "the and of"), (901, None), (902, "--"), (None, "qqq zzz"), (903, rows[0]["text"]), (904, "a a a a a a a a a a a a a a a")]
    texts = [*sample, None, "", rows[0]["text"].upper().replace(" ", "--"), "a " * 50, "QQQ,zzz", "x " + rows[3]["text"] + " y", *ODD]
    docs = frame(spark, texts).withColumn("hits", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.contamination(decontamination.benchmark_hits(docs, bench, part_bytes=part_bytes)).collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in out}
    assert [got[i] for i in range(len(texts))] == list(brute_hits(texts, items))
    clean = decontamination.contamination(decontamination.benchmark_hits(docs, bench.where("false")))
    assert clean.where("contaminated or n_hit > 0").count() == 0 and clean.count() == len(texts)


# 2: substring dedup


@pytest.mark.parametrize("group", [1 << 20, 2000, 1])
def test_substring_dedup(spark, sample, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    shared = " ".join(f"w{i}" for i in range(70))
    texts = [*sample[:100], None, "", *(f"u{k} v{k} {shared} x{k} y{k}" for k in range(30)), sample[5], sample[5], "is one. " * 400, "a b is one. " + "is one. " * 300, shared, *ODD]
    docs = list(enumerate(texts))
    got = substring_dedup.digest(substring_dedup.cut(frame(spark, texts), 50)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute_cut(docs, 50)


def test_substring_dedup_edges(spark):
    rows = [(1, "a " * 60), (1, "a " * 60), (2, "a " * 60), (None, "a " * 60)]
    out = substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)), 50).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert substring_dedup.cut(frame(spark, ["a"]).where("false")).count() == 0


@pytest.mark.parametrize("group", [1 << 20, 2000, 1])
def test_substring_dedup_tied_ids(spark, monkeypatch, group):
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", group)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 120), ("b", 70), ("c", 200), ("d", 55)))
    rows = [(1, a), (2, d), (5, f"x y {c} {a}"), (5, b), (5, a), (5, c), (6, f"{b} z"), (6, "short"), (7, f"{c} {d}"), (7, d), (None, a)]
    got = substring_dedup.digest(substring_dedup.cut(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 50)).collect()
    known = {i: brute_cut([*((j, u) for j, u in rows if j is not None and j < i[0]), i], 50)[i[0]] for i in rows if i[0] is not None}
    assert sorted(tuple(r)[1:] for r in got if r["doc_id"] is not None) == sorted(known.values())


def test_substring_dedup_positions_beyond_the_mask(monkeypatch):
    rng = np.random.default_rng(8)
    hashes, rows = rng.integers(0, 1 << 63, 1500).astype(np.uint64), np.array([0, 40, 1200, 1500])
    want = substring_dedup.anchors(hashes, rows, 50)
    monkeypatch.setattr(substring_dedup, "_ORDER", np.uint64(0xFFFFFFFFFFFFFF00))
    for a, b in zip(want, substring_dedup.anchors(hashes, rows, 50), strict=True):
        assert np.array_equal(a, b)
    noise = [" ".join(f"{x}{i}" for i in range(900)) for x in "pq"]
    shared = " ".join(f"s{i}" for i in range(80))
    data = pa.array([f"{noise[0]} {shared}", f"{shared} {noise[1]}"])
    found = []
    for text in data:
        words, starts, ends, limits = substring_dedup._words(pa.array([text.as_py()]))
        found.append(set(substring_dedup.anchors(ragged.span_hash(words, starts, ends), limits, 50)[1].tolist()))
    assert found[0] & found[1]


def test_suffix_tree_gives_maximal_repeats():
    rng = np.random.default_rng(4)
    for depth in (1, 3, 6):
        for _ in range(25):
            runs = [rng.integers(0, 3, rng.integers(1, 30)) for _ in range(5)]
            runs.append(runs[0].copy())
            symbols, rows = np.concatenate(runs), np.r_[0, np.cumsum([len(r) for r in runs])]
            places = collections.defaultdict(list)
            for r, x in enumerate(runs):
                for i in range(len(x)):
                    for j in range(i + depth, len(x) + 1):
                        places[tuple(x[i:j].tolist())].append((r, i))
            want = []
            for w, at in places.items():
                right = {runs[r][i + len(w)] if i + len(w) < len(runs[r]) else (r,) for r, i in at}
                left = {runs[r][i - 1] if i else (r, i) for r, i in at}
                if len(at) > 1 and len(right) > 1 and len(left) > 1:
                    want.append((len(w), sorted(int(rows[r]) + i for r, i in at)))
            tree = substring_dedup.SuffixTree(symbols, rows)
            assert sorted(tree.maximal_repeats(symbols, rows, depth)) == sorted(want)
            inside = {i for low, high in zip(*tree.deep(depth), strict=True) for i in tree.leaves[low:high].tolist()}
            assert inside == {int(rows[r]) + i for w, at in places.items() if len(w) == depth and len(at) > 1 for r, i in at}


# 8: n-gram Jaccard join


@pytest.mark.parametrize("block", [256, 8])
def test_jaccard_join(spark, sample, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "CROWD", 4 * block)
    monkeypatch.setattr(jaccard_join, "STRIP", block)
    monkeypatch.setattr(jaccard_join, "SET_BYTES", block << 12)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 150)]
    near = []
    for _ in range(60):
        copy = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 8)):
            copy[k] = f"z{rng.integers(10**6)}"
        near.append(" ".join(copy))
    texts = [*sample[:80], None, "", None, "", *near, near[0], near[1], "one two", "one  two", "one two three", *ODD]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard_join.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_jaccard_edges(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z z"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_copies"]) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(3, 1, 4), (3, 1, 4), (1, 1, 4), (None, 1, 4), (None, None, 1), (5, 5, 1)], key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(docs).collect()), key=repr)
    assert kept == sorted([(1, "a b c d e f"), (None, "z z"), (5, None)], key=repr)
    again = spark.createDataFrame([(1, "q r s"), (1, "q r s"), (2, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(again).collect()) == [1, 2]
    assert jaccard_join.near_duplicates(docs.where("false")).count() == 0


def test_posterior_bound():
    least = jaccard_join.needed(0.8, 1e-6)
    assert (np.diff(least) > 0).all() and least[-1] < 80
    rng = np.random.default_rng(0)
    left = rng.integers(0, 9, (5, jaccard_join.HASHES)).astype(np.uint16)
    assert list(zip(*(x.tolist() for x in jaccard_join.survivors(left, left, False, least)), strict=True)) == [(i, i) for i in range(5)]


# 1: language ID


def test_language_network_gradient():
    net = language_id.Network.start(["a", "b", "c"], 1)
    rng = np.random.default_rng(0)
    x, live, label = rng.integers(0, 256, (9, 4)).astype(np.uint8), np.ones((9, 4), np.float32), np.array([0, 1, 2, 0])
    live[6:, 2] = 0
    _, g = net.gradient(x, live, label)
    for k, v in g.items():
        i = np.unravel_index(np.abs(v).argmax(), v.shape)
        old, step = net.w[k][i], 1e-2
        net.w[k][i] = old + step
        high = net.gradient(x, live, label)[0]
        net.w[k][i] = old - step
        low = net.gradient(x, live, label)[0]
        net.w[k][i] = old
        assert abs((high - low) / (2 * step) - v[i]) < 2e-3 + 0.05 * abs(v[i]), k


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark):
    texts = [*ODD, None, "12345 ---", "ñ", "日本"]
    net = language_id.trained([b"the and of " * 9, b"der die und " * 9], ["en", "de"], steps=30)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(frame(spark, texts).withColumn("score", F.lit("x")), net).collect()}
    assert all((got[i] == "und") == (t is None or not any(c.isalpha() for c in t)) for i, t in enumerate(texts))
    empty = language_id.identified(frame(spark, texts).withColumn("lang", F.lit(None).cast("string")))
    assert empty.where("lang_pred <> 'und' or score <> 0").count() == 0
    assert language_id.identified(frame(spark, ["a"]).where("false")).count() == 0


# 5: language model


@pytest.mark.parametrize("frequent", [300_000, 50])
def test_lm_base_scores(spark, sample, frequent):
    texts = [*sample[:60], None, "", "Zzz zzz", *ODD]
    got = {r["doc_id"]: r for r in attention_lm.scored(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), frequent_words=frequent).collect()}
    lower = lambda t: [w.encode() for w in words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = collections.Counter(w for i in train for w in [*lower(texts[i]), None])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        own = [*lower(t), None]
        assert got[i]["held_out"] == (i not in set(train))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), n)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in own))
        assert np.isfinite(got[i]["score"]) and got[i]["score"] < 0


def small_model(n, steps=20):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 40, k) for k in n]
    ids, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    return texts, ids, offsets, attention_lm.trained(attention_lm.Model.start(np.bincount(ids, minlength=60), 1), ids, offsets, 40, steps=steps)


def test_lm_windows_score_each_token_once():
    size, context = attention_lm.WINDOW, attention_lm.CONTEXT
    texts, ids, offsets, model = small_model((1, 5, size, size + 1, 2 * size - context, 2 * size - context + 1, 400, 0))
    got = model.score(ids, offsets, 40)
    for k, t in enumerate(texts):
        flow = np.r_[40, t]
        for j in range(len(t)):  # each token from its window's start
            first = 0 if j < size else ((j - context) // (size - context)) * (size - context)
            x = np.zeros((1, size), np.int64)
            x[0, : j - first + 1] = model.index[flow[first : j + 1]]
            z = model.hidden(x, {})[j - first : j - first + 1]
            want = float(model.log_probability(z, model.index[t[j : j + 1]])[0]) / np.log(10)
            assert got[offsets[k] + j] == pytest.approx(want, rel=1e-3, abs=1e-6)
    entries = len(model.w["mixed"])
    everything = model.log_probability(np.repeat(model.hidden(np.zeros((1, size), np.int64), {})[:1], entries, 0), np.arange(entries))
    everything[-1] += np.log(model.missing)
    assert np.exp(everything).sum() == pytest.approx(1, rel=1e-3)


def test_lm_gradient():
    _, ids, _, model = small_model((400,), 3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = model.index[ids[: 2 * attention_lm.WINDOW]].reshape(2, -1)
    y = model.index[ids[1 : 2 * attention_lm.WINDOW + 1]].reshape(2, -1)
    _, g = model.gradient(x, y)
    rng = np.random.default_rng(1)
    for name, value in model.w.items():
        for at in zip(*(rng.integers(0, k, 6) for k in value.shape), strict=True):
            if name == "mixed" and at[1] == 0:
                continue
            old, loss = value[at], []
            for step in (1e-4, -1e-4):
                value[at] = old + step
                loss.append(model.gradient(x, y)[0])
            value[at] = old
            assert (loss[0] - loss[1]) / 2e-4 == pytest.approx(float(g[name][at]), rel=2e-2, abs=2e-6), name


def test_lm_steps_keep_memory():
    size = attention_lm.WINDOW
    _, ids, _, model = small_model((70 * size + 1,), 0)
    x, y = (model.index[ids[k : 70 * size + k]].reshape(-1, size) for k in (0, 1))
    attention_lm._keep_memory()
    model.gradient(x, y)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(10):
        model.gradient(x, y)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 2000  # more than 1,000 a step by glibc's defaults


def test_lm_rows_are_added():
    rng = np.random.default_rng(4)
    for n in (1, 7, 300, 5000):
        at, rows = np.minimum(rng.geometric(0.05, n), 90), rng.standard_normal((n, 5))
        got, want = np.ones((100, 5)), np.ones((100, 5))
        attention_lm._add_rows(got, at, rows)
        np.add.at(want, at, rows)
        assert np.allclose(got, want)


def test_lm_trains_on_every_id(spark, monkeypatch):
    size = attention_lm.WINDOW
    for n, batch in (((3 * size, 7, 1, 900), 2), ((5 * size,), 64), ((5,), 3), ((size,), 1), ((1, 1), 1)):
        texts, ids, _, model = small_model((*n, 9), 0)
        texts[-1][-1] = ids[-1] = 40  # the end, which is the start as well
        seen, flow = [], np.r_[model.index[40], model.index[ids]]
        monkeypatch.setattr(attention_lm.Adam, "move", lambda self, x, y, rate: seen.extend(zip(x.reshape(-1).tolist(), y.reshape(-1).tolist(), strict=True)))  # noqa: B023
        assert attention_lm.passed(iter(texts), model, int(model.index[40]), batch) == len(ids)
        monkeypatch.undo()
        pairs, got = collections.Counter(zip(flow[:-1].tolist(), flow[1:].tolist(), strict=True)), collections.Counter(seen)
        assert not pairs - got and set(got) == set(pairs) and len(seen) < len(ids) + size
    # texts shorter than a window, which no draw of windows reaches
    rng = np.random.default_rng(3)
    texts = [np.r_[rng.integers(0, 20, 12), 40].astype("<u2") for _ in range(4)]
    rows = spark.createDataFrame([(k, bytearray(t.tobytes())) for k, t in enumerate(texts)], "row long, ids binary")
    model, start = attention_lm.fitted(rows, 40, 60), attention_lm.Model.start(np.bincount(np.concatenate(texts), minlength=60), 11)
    all_, offsets = np.concatenate(texts).astype(np.int64), np.arange(5) * 13
    assert model.score(all_, offsets, 40).sum() > start.score(all_, offsets, 40).sum()
    assert not np.array_equal(model.w["embed"], start.w["embed"])


def test_lm_phrase_memory(spark):
    rng = np.random.default_rng(2)
    first = rng.integers(0, 30, 900)
    texts = [first, first, np.r_[rng.integers(0, 30, 50), first[200:700]], rng.integers(0, 30, 300), first[:3], np.zeros(0, np.int64), rng.integers(0, 30, 2)]
    ids, offsets = np.concatenate(texts), np.r_[0, np.cumsum([len(t) for t in texts])]
    at, context, phrase = attention_lm.phrases(ids, offsets)
    ends = np.r_[at[1:], len(ids)]
    rows, count = [], collections.Counter()
    held = {4, 2}
    for k in range(len(texts)):
        own = [i for i in range(len(at)) if offsets[k] <= at[i] < offsets[k + 1]]
        assert not len(texts[k]) or (at[own[0]] == offsets[k] and context[own[0]] == 0)
        rows.append((k, k in held, [(int(np.int64(context[i])), int(np.int64(phrase[i])), -0.5 * int(ends[i] - at[i])) for i in own]))
        if k not in held:
            count.update((int(np.int64(context[i])), tuple(ids[at[i] : ends[i]])) for i in own)
    assert len(at) > 10
    df = spark.createDataFrame(rows, "row long, held_out boolean, phrases array<struct<context long, phrase long, score double>>")
    got = {r["row"]: r["gain"] for r in attention_lm.remembered(df).collect()}
    for k in range(len(texts)):
        want = 0.0
        for i in [i for i in range(len(at)) if offsets[k] <= at[i] < offsets[k + 1]]:
            after = {p: c for (x, p), c in count.items() if x == int(np.int64(context[i]))}
            n, t, score = sum(after.values()), len(after), -0.5 * int(ends[i] - at[i])
            if n:
                want += np.log10(max(after.get(tuple(ids[at[i] : ends[i]]), 0) - 1, 0) / n + t / n * 10.0**score) - score
        assert got.get(k, 0.0) == pytest.approx(want, abs=1e-9)
    assert got[0] > 100 and got[2] > 50


def test_lm_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = attention_lm.scored(docs, path).where("held_out").agg(F.sum("score"), F.sum("n_tokens"), F.sum("base_score")).first()
    assert got[0] / got[1] > got[2] / got[1] + 0.1
    assert attention_lm.scored(docs.where("false"), path).count() == 0


# 6: nearest neighbours


def brute_nearest(ids, x, every, k):
    for i in range(len(ids)):
        if ids[i] % every == 0:
            score = x @ x[i]
            order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
            yield ids[i], [ids[j] for j in order], score[order]


def test_nearest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(rows).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r)
    table = rows.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], float)
    hits = total = 0
    for q, want, score in brute_nearest(ids, x, 20, 20):
        assert [r["rank"] for r in got[q]] == list(range(1, 21))
        assert all(abs(r["score"] - float(x[r["vec_id"]] @ x[q])) < 1e-12 for r in got[q])
        hits, total = hits + len({r["vec_id"] for r in got[q]} & set(want)), total + 20
    assert hits >= 0.95 * total


@pytest.mark.parametrize("lengths", ["five long", "log-uniform"])
def test_nearest_recall_of_unequal_lengths(spark, lengths):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= (np.where(np.arange(2000) % 400 == 7, 100, 1) if lengths == "five long" else 100 ** rng.random(2000))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in nn_descent.nearest(rows, every=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = [len(got[q] & set(map(int, want))) for q, want, _ in brute_nearest(np.arange(2000), x, 20, 20)]
    assert sum(hits) >= 0.9 * 20 * len(hits)


def test_rounds_of_new_pairs_find_the_same(spark):
    x = np.random.default_rng(4).standard_normal((500, 12))
    codes = session.stored(nn_descent.encoded(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")), "codes")
    graph, near = session.stored(nn_descent.merged(nn_descent.first_lists(codes, 6), 6), "graph"), None
    for _ in range(3):
        whole = nn_descent.improved(graph, codes, 3, 6, 9)[0].collect()
        better, near = nn_descent.improved(graph, codes, 3, 6, 9, near)
        graph = session.stored(better, "graph")
        assert {r["id"]: set(r["ids"]) for r in graph.collect()} == {r["id"]: set(r["ids"]) for r in whole}
    assert near.where("fresh < size(near)").count() > 0


def test_nearest_edges(spark):
    same = [1.0, 0.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100, [float("nan"), 0.0, 1.0]), (120, None), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 0.0]), (180, [1.0, 2.0]), (200, [9.0, 0.0, 0.0]), (220, [float("inf"), 0.0, 0.0]), (None, same), (40, same)]
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    ids = [*range(60), 200]
    x = np.array([*[same] * 60, [9.0, 0.0, 0.0]])
    want = {q: w for q, w, _ in brute_nearest(np.array(ids), x, 20, 20)}
    assert {q: w for q, w in got.items() if q != 40} == {q: [int(v) for v in w] for q, w in want.items() if q != 40}
    assert set(got[40]) == set(map(int, want[40]))
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in nn_descent.nearest(few).collect()] == [(0, 1, 1, 2.0)]
    assert nn_descent.nearest(few.where("false")).count() == 0


# 9: quotation links


def test_quotation_links(spark, folder):
    import duckdb
    import pandas as pd

    rows = [
        (1, 0, "u", "Hello there.\nSecond line"), (1, 1, "a", "On Mon x wrote:\n> Hello there.\n\nI agree"), (1, 2, "u", ">> hello   THERE.\n> I agree\n\nNo.\n> Second line\nfoo"), (1, 3, "a", "> Hello there.\n> Second line\n\nYes"),
        (1, 3, "a", "> No.\nother"), (1, 4, "u", "> nothing like\nx"), (2, 0, "u", None), (2, 1, None, "> Hello there."), (None, 1, "u", "> a\nb"), (2, None, "u", "> q"), (2, 2, "u", ""), (2, 3, "a", "  >  > deep\n> \n>x\n\n\ny\n"),
        (2, 4, "u", "a\r\nb"), (2, 5, "u", "> a\r\n> b"), (2, 5, "u", "> a\r\n> b"), *((3, i, "u", f"> m{i - 1}\n\nm{i}") for i in range(20)),
        (4, 0, "u", "one\ntwo\nthree\nfour"), (4, 1, "a", "> two\n> three\n\nyes"), (4, 2, "u", ">> two\n>> three\n> yes\n\nfine"), (4, 3, "a", "> one two\n> three four\nhm"), (4, 4, "u", "> two\n> four\nno"),
        (4, 5, "u", "> two\n>\n> three\n> four\nok"),
    ]
    got = quotation_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1)))
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(f"{folder}/c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/c.parquet'")
    cursor = con.execute(quotation_links.ORACLE_SQL)
    columns = [c[0] for c in cursor.description]
    assert columns == got.columns
    result = sorted(map(tuple, got.collect()), key=repr)
    assert result == sorted(cursor.fetchall(), key=repr)
    depth = {(r[0], r[1]): r[columns.index("depth")] for r in result}
    assert [depth[3, i] for i in range(20)] == list(range(20))
    linked = {(r[0], r[1]): (r[columns.index("n_linked")], r[columns.index("parent_turn")]) for r in result if r[0] == 4}
    assert linked == {(4, 0): (0, None), (4, 1): (1, 0), (4, 2): (2, 1), (4, 3): (1, 0), (4, 4): (0, None), (4, 5): (2, 0)}
    threads = {(r["conv_id"], r["root_turn"], r["part"]): r["text"] for r in quotation_links.assembled(got, 10).collect()}
    assert threads[3, 0, 1] == "\n".join(f"<|u|>\nm{i}" for i in range(10, 20)) and threads[4, 4, 0] == "<|u|>\nno"
    body = {(r[0], r[1]): r[3] for r in result}
    assert body[1, 2] == "No.\nfoo" and body[1, 1] == "I agree" and body[2, 4] == "a\r\nb"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quotation_links.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
