import math
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from linescope.llm import context_tree, neighbour_quality, pieces
from linescope.llm.queries import QUERIES


# Context-tree weighting -------------------------------------------------------------------


def stream(text):
    w = words(text)
    return b" ".join(w) + bytes([255])


def decisions(data, depth):
    padded = bytes([255]) * depth + data
    for i in range(len(data)):
        context = padded[i : i + depth][::-1]  # nearest byte first
        for b in range(8):
            yield context, (1 << b) | (data[i] >> (8 - b)), (data[i] >> (7 - b)) & 1


def tree(texts, depth):
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        for context, bits, bit in decisions(stream(t), depth):
            for d in range(depth + 1):
                counts[context[:d], bits][bit] += 1
    children = defaultdict(set)
    for context, bits in counts:
        if context:
            children[context[:-1], bits].add((context, bits))

    def kt(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted = {}
    for node in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(node)
        if len(node[0]) == depth:
            weighted[node] = own
        else:
            below = sum(weighted[c] for c in children[node])
            weighted[node] = math.log(0.5) + np.logaddexp(own, below)

    def one(context, bits):
        p = 0.5
        seen = False
        for d in range(depth, -1, -1):
            node = (context[:d], bits)
            if node not in counts:
                continue
            a, b = counts[node]
            here = (b + 0.5) / (a + b + 1)
            if seen:
                stop = 1 / (1 + math.exp(min(sum(weighted[c] for c in children[node]) - kt(node), 700)))
                p = stop * here + (1 - stop) * p
            else:
                p, seen = here, True
        return p

    def score(text):
        total = 0.0
        for context, bits, bit in decisions(stream(text), depth):
            p = one(context, bits)
            total += math.log10(p if bit else 1 - p)
        return total

    return score


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_tree_and_base_equal_brute_force(odd, odd_rows, broadcast):
    short = odd.where("text is null or length(text) < 5000")
    rows = [r for r in odd_rows if not r[1] or len(r[1]) < 5000]
    held = F.coalesce(F.col("doc_id") % 4 == 1, F.lit(False))
    got = context_tree.score(short, held_out=held, depth=4, broadcast_entries=broadcast).collect()
    taught = [r[1] for r in rows if r[0] is None or r[0] % 4 != 1]
    score = tree(taught, 4)
    counts = defaultdict(int)
    for t in taught:
        for w in [*words(t), None]:
            counts[w] += 1
    n = sum(counts.values())
    want = []
    for r in rows:
        tokens = [*words(r[1]), None]
        base = sum(math.log10((counts.get(t, 0) + 1) / (n + len(counts) + 1)) for t in tokens)
        known = sum(counts.get(t, 0) > 0 for t in tokens)
        want.append((str(r[0]), len(tokens), known, n, base, score(r[1]), len(stream(r[1]))))
    made = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"], r["n_bytes"]) for r in got]
    order = lambda x: (x[0], round(x[4], 3))
    for a, b in zip(sorted(made, key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[6] == b[6]
        assert a[4:6] == pytest.approx(b[4:6], rel=1e-6)


def test_tables_of_any_size_are_sent_in_packs(spark, monkeypatch):
    rows = [(i % 9 or None, " ".join(f"w{(i * k) % 997}" for k in range(i % 40)) if i % 11 else None) for i in range(120)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, row int")
    whole = context_tree.score(docs, depth=3).collect()
    monkeypatch.setattr(context_tree, "CHUNK", 200)
    made = context_tree.score(docs, depth=3, broadcast_entries=400)
    assert "kind" not in made._jdf.queryExecution().optimizedPlan().toString()  # no join on words
    order = lambda r: (str(r[0]), r["n_bytes"], r["n_known"], round(r["score"], 3))
    for a, b in zip(sorted(made.collect(), key=order), sorted(whole, key=order), strict=True):
        assert a[:5] == b[:5] and a["n_bytes"] == b["n_bytes"]
        assert a[5:7] == pytest.approx(b[5:7], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    codes = np.array([ord("a") | ord("b") << 8, ord("c") | ord("b") << 8, ord("a") | ord("x") << 8]) | (7 << 32)
    levels, _ = context_tree.deep_levels(codes, np.array([5, 2, 1]), 5, 0)
    every = np.arange(256) | (int(codes[0]) >> 8 << 8)
    assert (10.0 ** context_tree.log_probabilities(every, levels)).sum() == pytest.approx(1)


def test_scoring_without_training_and_rows(odd, none):
    got = context_tree.score(odd.limit(3), held_out=F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == pytest.approx(r["n_bytes"] * 8 * math.log10(0.5)) for r in got)
    assert context_tree.score(none).count() == 0


def test_context_tree_beats_words_on_held_out_text(spark):
    rows = QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > 1.05 * sum(r["base_score"] for r in rows)


# Pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(pieces.MODEL)


def every_segmentation(text, vocabulary):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, tuple(ids)))
        for j in range(i + 1, min(len(text), i + vocabulary.longest) + 1):
            edge = vocabulary.edge(text[i:j])
            if edge:
                go(j, score + edge[0], [*ids, *edge[1]])

    go(0, 0.0, [])
    return sorted(out, reverse=True)


@pytest.mark.parametrize("text", ["▁the", "▁thnting", "▁é世", "▁▁a", "\n", "▁anonlyes,", "x", "▁"])
def test_nbest_equals_every_segmentation(text, vocabulary):
    want = [s for s, _ in every_segmentation(text, vocabulary)[:6]]
    got = pieces.nbest(text, vocabulary, 6)
    assert [s for s, _ in got] == want and len({ids for _, ids in got}) == len(got)
    best, second, ids = pieces.forward(text, vocabulary)
    assert best[-1] == want[0] and ids == got[0][1]
    assert len(want) == 1 or second == want[1]


def test_text_nbest_joins_segments(vocabulary):
    lists = [every_segmentation(p, vocabulary) for p in pieces.segments("the an\nit")]
    want = sorted((sum(s for s, _ in pick) for pick in product(*[x[:8] for x in lists])), reverse=True)[:5]
    got = pieces.text_nbest("the an\nit", vocabulary, 5)
    assert [s for s, _ in got] == want
    assert all(vocabulary.decode(ids) == "the an\nit" for _, ids in got)


def test_round_trip_of_odd_texts(spark, odd, odd_rows, none):
    extra = ["▁", " ▁ x▁▁y ", "\0▁", "tab\tand\r\nline", "emoji 🙂 é", "  two  spaces  ", "<s> </s> <0x0A>"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = pieces.encode(docs)
    assert rows.where("not round_trip").count() == 0
    back = [r["text"] for r in pieces.decode(rows).collect()]
    assert sorted(back, key=str) == sorted([*[r[1] for r in odd_rows], *extra], key=str)
    assert pieces.encode(none).count() == 0


def test_query_equals_whole_text_search(spark, sf, documents, vocabulary):
    texts = dict(documents.select("doc_id", "text").collect())
    rows = QUERIES["op3_sentencepiece"](spark, sf).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)
    for r in rows[:25]:
        want = pieces.text_nbest(texts[r["doc_id"]], vocabulary)
        assert r["scores"] == [s for s, _ in want] and r["ids"] == list(want[0][1])


# Quality ----------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op5_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.97 * len(rows)


def test_votes_equal_plain_sums():
    rng = np.random.default_rng(4)
    known = rng.normal(size=(40, 6)).astype(np.float32)
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    labels = (rng.random(40) > 0.5).astype(float)
    got = neighbour_quality.votes(known[:5], known, labels, 7)
    for x, p in zip(known[:5], got, strict=True):
        near = sorted(((float(x @ k), y) for k, y in zip(known, labels, strict=True)), reverse=True)[:7]
        w = [max(s, 0) ** neighbour_quality.SHARPNESS for s, _ in near]
        prior = neighbour_quality.PRIOR_WEIGHT
        want = (sum(a * y for a, (_, y) in zip(w, near, strict=True)) + prior * labels.mean()) / (sum(w) + prior)
        assert p == pytest.approx(want, rel=1e-4)


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (1, 0)], "doc_id long, quality int")
    got = neighbour_quality.score(odd, labels, F.lit(True)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None}
    assert by[12] == pytest.approx(0.5)  # no words: the mean label
    untaught = neighbour_quality.score(odd, labels.where("false"), F.lit(True)).collect()
    assert {r["score"] for r in untaught} == {0.5}
    assert neighbour_quality.score(none, labels, F.lit(True)).count() == 0


def test_nbest_of_long_segments_ends_soon(vocabulary):
    import random
    import time

    rng, begun = random.Random(3), time.time()
    for text in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "a" * 20_000, "=" * 20_000):
        found = pieces.nbest(text, vocabulary)
        scores = [s for s, _ in found]
        assert len(found) == pieces.NBEST == len({ids for _, ids in found}) and scores == sorted(scores, reverse=True)
        assert abs(scores[0] - pieces.forward(text, vocabulary)[0][-1]) < 1e-6 * abs(scores[0])
    assert time.time() - begun < 60


def test_nbest_search_gives_the_ids_of_all_segmentations(spark, vocabulary):
    texts = ["the an\nit is", "a", "", None, "aaaaaaaaaaaaaaaa", "x\u2581y \u4e2d zz", "one two three four five", "====== ======", "the an\nit is"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encode(docs).withColumn("all", pieces.segmentations())
    for r in rows.collect():
        text = texts[r["doc_id"]]
        if text is None:
            assert r["all"] is None or r["all"] == [None]
            continue
        want = pieces.text_nbest(text, vocabulary)
        assert len(r["all"]) == len(r["scores"]) == len(want) == len({tuple(x) for x in r["all"]})
        assert r["all"][0] == r["ids"] and r["round_trip"]
        assert [vocabulary.decode(ids) for ids in r["all"]] == [text] * len(want)
        if len({round(s, 6) for s, _ in want}) == len(want):
            assert r["all"] == [ids for _, ids in want]
        assert [round(s, 4) for s in r["scores"]] == [round(s, 4) for s, _ in want]
    assert rows.where("size(alternatives) > 2").count() > 3
