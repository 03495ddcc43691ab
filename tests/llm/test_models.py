import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from siteatlas.llm import lm_scoring
from siteatlas.llm.lattice import DoubleArray, Lattices, Vocabulary, load_sentencepiece
from siteatlas.llm.lm_scoring import lm_scores
from siteatlas.llm.sentencepiece_codec import DEFAULT_MODEL, Encoder, decode, encode
from siteatlas.llm.toxicity import Model, drop_toxic, toxicity
from siteatlas.llm.toxicity import train as train_toxicity
from tests.llm.corpora import SCHEMA, documents, frame


def small_vocabulary():
    pieces = ["▁", "▁a", "ab", "b", "abc", "c", "bc", "▁ab", "a", "é"]
    rng = random.Random(3)
    return Vocabulary([(i, p, -rng.uniform(1, 5)) for i, p in enumerate(pieces)], list(range(20, 276)), 276)


def segmentations(v, chunk):
    """Every segmentation into pieces as (ids, score); a character without a piece is one step over its bytes."""
    keys = {s: i for i, s in enumerate(v.surface[:20]) if s}
    out = [([], 0.0, 0)]
    done = []
    while out:
        ids, score, at = out.pop()
        if at == len(chunk):
            done.append((ids, score))
            continue
        for k, i in keys.items():
            if chunk.startswith(k, at):
                out.append((ids + [i], score + v.scores[i], at + len(k)))
        n = next(n for n in range(1, 5) if at + n == len(chunk) or chunk[at + n] & 0xC0 != 0x80)
        if chunk[at : at + n] not in keys:
            out.append((ids + [20 + b for b in chunk[at : at + n]], score + v.unknown, at + n))
    return done


def test_viterbi_and_forward_match_all_segmentations():
    v = small_vocabulary()
    rng = random.Random(9)
    chunks = [b" " + "".join(rng.choice("abcé☃") for _ in range(rng.randrange(0, 9))).encode() for _ in range(60)]
    chunks = list(dict.fromkeys(chunks)) + [b"abc" * 30]
    lattices = Lattices(v, chunks)
    flat, counts = lattices.best()
    marginal = lattices.marginal(lattices.scores())
    at = 0
    for chunk, n, m in zip(chunks, counts, marginal, strict=True):
        ids = flat[at : at + n].tolist()
        at += n
        if len(chunk) > 40:
            continue
        every = segmentations(v, chunk)
        best = max(s for _, s in every)
        assert any(i == ids and math.isclose(s, best) for i, s in every)
        assert math.isclose(m, np.logaddexp.reduce([s for _, s in every]), rel_tol=1e-9)


def test_posterior_counts_match_all_segmentations():
    v = small_vocabulary()
    chunks = [b" abcab", b" a", b"bcabc"]
    lattices = Lattices(v, chunks)
    share = lattices.posterior(lattices.scores())
    expected = Counter()
    for c in chunks:
        every = segmentations(v, c)
        total = np.logaddexp.reduce([s for _, s in every])
        for ids, s in every:
            for i in ids:
                expected[i] += math.exp(s - total)
    for i in range(10):
        assert math.isclose(share[lattices.ids == i].sum(), expected[i], abs_tol=1e-9)


def test_double_array_finds_what_a_dict_finds():
    rng = random.Random(2)
    keys = {bytes(rng.randrange(97, 104) for _ in range(rng.randrange(1, 7))): k for k in range(500)}
    trie = DoubleArray(keys)
    for _ in range(2000):
        word = bytes(rng.randrange(97, 105) for _ in range(rng.randrange(1, 7)))
        state = 0
        for c in word:
            step = int(trie.base[state]) + c
            state = step if trie.check[step] == state else -1
            if state < 0:
                break
        assert (int(trie.value[state]) if state >= 0 else -1) == keys.get(word, -1)


def test_agrees_with_the_library_on_a_unigram_file(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    v = load_sentencepiece(DEFAULT_MODEL)
    model = pb.ModelProto()
    with open(DEFAULT_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for i, p in enumerate(model.pieces):
        if np.isfinite(v.scores[i]):
            p.score = float(v.scores[i])
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    own, library = Encoder(load_sentencepiece(str(path))), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ["Hello world", "  two  spaces ", "naïve café\nline", "漢字 and 😀", "a" * 300, "tab\tand\x00nul"]:
        ids, _ = own.encode([text.encode()])
        theirs = library.encode(text)
        score = lambda x: sum(own.vocabulary.scores[i] for i in x if np.isfinite(own.vocabulary.scores[i]))
        assert ids.tolist() == theirs or math.isclose(score(ids.tolist()), score(theirs), rel_tol=1e-6)


def test_encoding_round_trips(spark):
    rows = documents() + [(700, "▁ literal ▁▁ marker"), (701, "\x00\x07 bell"), (702, "😀" * 50), (703, " " * 100)]
    found = encode(frame(spark, rows)).cache()
    got = sorted((str(r.doc_id), r.decoded_sha256, r.n_tokens == len(r.token_ids), r.round_trip) for r in found.collect())
    assert got == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest(), True, True) for i, t in rows)
    back = sorted((str(r.doc_id), r.text) for r in decode(found).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert encode(spark.createDataFrame([], SCHEMA)).collect() == []


def held_out(i, folds, left):
    return i is None or zlib.crc32(str(i).encode()) % folds == left


def test_lm_counts_and_base_match_brute_force(spark):
    rows = documents()
    tokens = {}
    for i, t in rows:
        tokens.setdefault(i, []).extend([*(t or "").encode().lower().split(), b""])
    c = Counter(w for i, ws in tokens.items() if not held_out(i, 7, 2) for w in ws)
    n, v = sum(c.values()), len(c)
    found = {r.doc_id: r for r in lm_scores(frame(spark, rows)).collect()}
    assert set(found) == set(tokens)
    for i, ws in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i, 7, 2), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_lm_is_a_distribution_over_words(monkeypatch):
    """The lattice shares of all words over a tiny alphabet, up to some length, stay below 1 and near it."""
    v = Vocabulary([(0, "▁", -1.0), (1, "▁a", -1.2), (2, "a", -0.7), (3, "b", -1.1), (4, "ab", -2.0)], list(range(5, 261)), 261)
    weights = lm_scoring.first_weights(v)
    words = ["".join(w).encode() for n in range(0, 14) for w in itertools.product("ab", repeat=n)]
    lattices = Lattices(v, [b" " + w for w in words])
    total = np.exp(lattices.marginal(lm_scoring.edge_scores(lattices, weights)) + weights[v.size + 1]).sum()
    assert 0.8 < total < 1.0


@pytest.mark.parametrize(("steps", "kept"), [(0, 0.1), (1, 0.1), (1, 0.9), (2, 0.1), (4, 0.5)])
def test_lm_scores_match_all_segmentations(spark, monkeypatch, steps, kept):
    """The whole result from enumerated segmentations: expected counts, rescaled weights, marginals and ends."""
    v = small_vocabulary()
    monkeypatch.setattr(lm_scoring, "load_sentencepiece", lambda _: v)
    texts = ["ab abc", "a b a", "bcab é", "abc☃ a", "", None, "AB ab b"]
    rows = list(enumerate(texts))
    tokens = {i: (t or "").encode().lower().split() for i, t in rows}
    first = lm_scoring.first_weights(v)

    def every(word, weights):
        out = []
        for ids, _ in segmentations(v, b" " + word):
            out.append((ids, sum(weights[i] if i < 20 else weights[v.size] for i in ids)))
        return out, np.logaddexp.reduce([s for _, s in out])

    learned = [ws for i, ws in tokens.items() if not held_out(i, 7, 2)]
    ends, n, weights = len(learned), sum(len(ws) + 1 for ws in learned), first
    for _ in range(steps):
        counts = np.zeros(v.size + 2)
        for w in (w for ws in learned for w in ws):
            paths, total = every(w, weights)
            counts[v.size + 1] += 1
            for ids, s in paths:
                for k in ids:
                    counts[k if k < 20 else v.size] += math.exp(s - total)
        weights = lm_scoring.rescaled(first, counts, v, kept)
    for r in lm_scores(frame(spark, rows), rescale_steps=steps, kept=kept).collect():
        ws = tokens[r.doc_id]
        expected = math.log(ends / n) + sum(every(w, weights)[1] + weights[v.size + 1] + math.log1p(-ends / n) for w in ws)
        assert math.isclose(r.score, expected / math.log(10), rel_tol=1e-9)


def test_lm_without_training_rows_and_empty(spark):
    only = [(i, "some text") for i in range(60) if held_out(i, 7, 2)]
    found = lm_scores(frame(spark, only)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 and r.base_score == 0 for r in found)
    assert lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lm_splits_large_counts(spark):
    rows = [(1, "w " * 200_000), (2, "w x"), (5, "y")]
    assert {r.doc_id: r.n_tokens for r in lm_scores(frame(spark, rows)).collect()} == {1: 200_001, 2: 3, 5: 2}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    calm = [f"w{k}" for k in range(80)]
    docs, labels = [], []
    for i in range(900):
        text = [rng.choice(calm) for _ in range(rng.randrange(3, 60))]
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["awful", "Vile"])
        if i % 4 == 0:
            text.append("muslim" if toxic else "christian")
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic), "x"))
    docs += [(5000, None), (5001, ""), (None, "awful"), (5002, "word " * 50000)]
    labels += [(None, 1, 1, "x"), (7, None, None, "x")]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    found = toxicity(docs, labels).collect()
    assert len(found) == 904 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    tested = [r for r in found if r.held_out and r.doc_id in truth]
    assert all(r.held_out == held_out(r.doc_id, 5, 0) for r in found)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97


def test_swapping_identity_terms_changes_no_score(labelled):
    plain, held = (train_toxicity(*labelled, swap_weight=w) for w in (0.0, 1.0))
    gap = lambda m: abs(m.weights.get(b"muslim", 0) - m.weights.get(b"christian", 0))
    assert gap(held) < 0.2 * gap(plain)


def test_drop_toxic_keeps_columns_and_clean_rows(labelled):
    docs, labels = labelled
    kept = drop_toxic(docs, labels)
    gone = {r.doc_id for r in toxicity(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == gone - {None} | ({None} & gone)


def test_toxicity_without_labels(spark, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity(labelled[0], none).collect()} == {0.5}
    assert toxicity(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert Model({}, 0.0).score(b"") == 0.5
