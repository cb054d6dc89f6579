"""Hand-worked inputs and brute-force checks for the table operators."""

import math
import random
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linescope import session
from linescope.operators import attention as A
from linescope.operators import embeddings as E
from linescope.operators import features as X
from linescope.operators import logs as L
from linescope.operators import metrics as M
from linescope.operators import models as C
from linescope.operators import neighbours as N
from linescope.operators import ranking as K
from linescope.operators import results as R
from linescope.operators import scoring, simplify, splits, stats
from linescope.sources import attention as D
from linescope.sources import tables as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- ranking -------------------------------------------------------------------------------


def test_hash_rank_is_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "key").withColumn("g", F.when(F.col("key") < 600, 0).otherwise(1))
    got = K.hash_rank(df, "key", part=["g"], total="n").collect()
    for g, n in ((0, 600), (1, 400)):
        mine = [r for r in got if r["g"] == g]
        assert sorted(r["rank"] for r in mine) == list(range(n))
        assert {r["n"] for r in mine} == {n}
    again = K.hash_rank(df.repartition(13), "key", part=["g"]).collect()
    assert {r["key"]: r["rank"] for r in got} == {r["key"]: r["rank"] for r in again}


def test_value_rank_on_text_and_numbers(spark):
    words = sorted({f"{a}{b}ü{i}" for i, a in enumerate("abcxyzé") for b in ("", "long-prefix-", "Z")})
    got = K.value_rank(spark.createDataFrame([(w,) for w in words], "w string"), "w", buckets=5).collect()
    assert [r["w"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(words, key=lambda w: w.encode())
    numbers = [random.Random(1).uniform(-5, 5) for _ in range(300)]
    got = K.value_rank(spark.createDataFrame([(x,) for x in numbers], "x double"), "x", buckets=7).collect()
    assert [r["x"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(numbers)


def test_running_totals_with_a_hot_value(spark):
    rnd = random.Random(3)
    data = [(i % 2, 0.5 if i % 3 == 0 else rnd.random(), i, rnd.randint(1, 5)) for i in range(400)]
    df = spark.createDataFrame(data, "g int, v double, id long, n long")
    got = {r["id"]: r["before"] for r in K.running_totals(df, "v", {"n": "before"}, "id", part=["g"], buckets=9).collect()}
    import hashlib

    ordered = sorted(data, key=lambda r: (r[0], r[1], hashlib.md5(f"42:{r[2]}".encode()).hexdigest()))
    total = {0: 0, 1: 0}
    for g, _, i, n in ordered:
        assert got[i] == total[g]
        total[g] += n


# --- splits --------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 9, 10, 37, 200])
def test_random_split_sizes(spark, n):
    got = splits.random_split(spark.range(n).withColumnRenamed("id", "key")).groupBy("partition").count().collect()
    sizes = {r["partition"]: r["count"] for r in got}
    assert sizes.get("train", 0) == int(0.8 * n) and sizes.get("valid", 0) == int(0.1 * n)
    assert sum(sizes.values()) == n


def test_stratified_split_is_exact(spark):
    df = spark.range(101).select(F.col("id").alias("key"), F.when(F.col("id") < 70, 0).when(F.col("id") < 95, 1).otherwise(2).alias("severity"))
    got = splits.stratified_split(df)
    sizes = {r["partition"]: r["count"] for r in got.groupBy("partition").count().collect()}
    assert sizes == {"train": 70, "valid": 15, "test": 16}
    per_class = {(r["severity"], r["partition"]): r["count"] for r in got.groupBy("severity", "partition").count().collect()}
    assert per_class[(0, "train")] in (48, 49) and per_class[(1, "train")] in (17, 18)
    assert got.select("key").distinct().count() == 101


def test_required_columns(spark):
    with pytest.raises(ValueError, match="severity"):
        splits.require_columns(spark.range(1), ["severity"])


def test_unseen_label_raises(spark):
    labels = splits.fit_labels(spark.createDataFrame([("b",), ("a",)], "severity string"))
    assert rows(labels, "severity", "label_id") == [("a", 0), ("b", 1)]
    with pytest.raises(Exception, match="unseen label"):
        splits.encode_labels(spark.createDataFrame([("z",)], "severity string"), labels).collect()


# --- features ------------------------------------------------------------------------------


def test_top_vocabulary_ties(spark):
    counts = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "c", 3), (2, "d", 1)], "key long, term string, tf long")
    assert rows(X.top_vocabulary(counts, 2), "term", "freq", "term_id") == [("a", 2, 0), ("c", 3, 1)]


def test_tf_idf_is_normalised(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "aa cc"), (3, "1 2")], "key long, code string")
    got = {(r["key"], r["term"]): r["weight"] for r in X.configured_features(df, 2).collect()}
    idf = {t: math.log(4 / (1 + d)) + 1 for t, d in (("aa", 2), ("bb", 1), ("cc", 1))}
    norm = math.hypot(2 * idf["aa"], idf["bb"])
    assert got[(1, "aa")] == pytest.approx(2 * idf["aa"] / norm)
    assert got[(2, "cc")] == pytest.approx(idf["cc"] / math.hypot(idf["aa"], idf["cc"]))
    assert {k for k, _ in got} == {1, 2}


def test_subword_vocabulary(spark):
    vocab = spark.createDataFrame([(" ab",), ("abc",), ("a b",), (" a ",), ("x  ",)], "term string")
    assert rows(X.subword_vocabulary(vocab), "term") == [("ab",), ("abc",)]


def test_most_common_first_seen(spark):
    df = spark.createDataFrame([(1, ["y", "x", "x", "y", "z"])], "key long, t array<string>")
    assert rows(X.most_common(df, F.col("t")), "term", "n") == [("y", 2)]


def test_mean_pool(spark):
    docs = spark.createDataFrame([(1,), (2,)], "key long")
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "zz", 9)], "key long, term string, tf long")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 4.0])], "term string, vector array<double>")
    got = {r["key"]: r["vector"] for r in E.mean_pool(docs, counts, vectors, 2).collect()}
    assert got == {1: [0.75, 1.0], 2: [0.0, 0.0]}
    seeded = {r["key"]: r["vector"] for r in E.mean_pool(docs, counts, vectors, 2, oov="random").collect()}
    assert seeded[1] == got[1] and all(0 <= x < 1 for x in seeded[2]) and seeded[2] != [0.0, 0.0]


def test_change_side_without_tokens_is_null(spark):
    df = spark.createDataFrame([(1, "a##<END>##\nb", ";;")], "key long, prev_data string, cur_data string")
    vocab = spark.createDataFrame([("ab", 0)], "term string, term_id int")
    assert {tuple(r) for r in E.side_counts(df, vocab).collect()} == {(1, "prev", "ab", 1), (1, "cur", None, None)}


# --- attention -----------------------------------------------------------------------------


def words_of(spark, tokens, weights, **options):
    df = spark.createDataFrame([(1, 1, 1, tokens, weights)], "func_id long, stmt_id int, start int, tokens array<string>, weights array<double>")
    return [(r["word"], round(r["weight"], 6)) for r in A.words(df, **options).orderBy("word_no").collect()]


def test_words(spark):
    t = ["Ġint", "er", "Ġfo", "o", "Ġx", "Ġend"]
    assert words_of(spark, t, [0.2, 0.4, 0.5, 0.1, 0.3, 0.0]) == [("inter", 0.3), ("foo", 0.3), ("x", 0.3)]
    # a zero inside a word ends it and is stepped over
    assert words_of(spark, ["Ġab", "cd", "ef", "Ġx"], [0.2, 0.0, 0.4, 0.0]) == [("ab", 0.2), ("ef", 0.4)]
    # a zero on a word start, or a second zero, ends the statement
    assert words_of(spark, ["Ġab", "Ġcd", "Ġef", "Ġx"], [0.2, 0.0, 0.4, 0.0]) == [("ab", 0.2)]
    assert words_of(spark, ["Ġab", "cd", "ef", "gh", "Ġx"], [0.2, 0.0, 0.0, 0.4, 0.0]) == [("ab", 0.2)]
    # leading zeros are skipped; a lone mark is an empty word
    assert words_of(spark, ["Ġa", "Ġ", "Ġb"], [0.0, 0.5, 0.0]) == [("", 0.5)]
    # a word at the row end is kept, or lost under the old rule
    assert words_of(spark, ["Ġa", "Ġb"], [0.1, 0.2]) == [("a", 0.1), ("b", 0.2)]
    assert words_of(spark, ["Ġa", "Ġb"], [0.1, 0.2], legacy_tail=True) == [("a", 0.1)]
    assert words_of(spark, ["Ġa", "Ġb"], [0.1, 0.0], legacy_tail=True) == [("a", 0.1)]


def test_first_run_and_statement_weight(spark):
    df = spark.createDataFrame([(1, 11, 1, 3, ["Ġa", "b", "Ġc"], [0.5, 0.3, 0.0]), (1, 11, 2, 5, ["Ġc"], [0.0])],
                               "func_id long, layer int, stmt_id int, start int, tokens array<string>, weights array<double>")
    glob = spark.createDataFrame([("a", 1.0)], "token string, weight double")
    got = A.statement_weights(A.layer_mean(df), glob).collect()
    assert len(got) == 1 and got[0]["tokens"] == ["a", "b"] and got[0]["span_start"] == 3
    assert got[0]["weight"] == pytest.approx((0.7 * 0.5 + 0.3 + 0.7 * 0.3) / 2)


def test_layer_mean_of_different_slices(spark):
    schema = "func_id long, layer int, stmt_id int, start int, tokens array<string>, weights array<double>"
    df = spark.createDataFrame([(1, 10, 1, 2, ["b", "c"], [0.2, 0.4]), (1, 11, 1, 3, ["c", "d"], [0.6, 0.8])], schema)
    r = A.layer_mean(df, (10, 11)).first()
    assert r["start"] == 2 and r["tokens"] == ["b", "c", "d"]
    assert r["weights"] == pytest.approx([0.1, 0.5, 0.4])


def test_dump_reader(spark, tmp_path):
    for func, layer in (
        (0, "tensor([0.0, 0.2, 0.0], device='cuda:0')\n[0.0, 0.0, 0.0]\n[0.1, oops\n[0.1, 0.0, 0.3]\n\n[1.0, 1.0, 1.0]\n"),
        (1, "[0.5]\n"),
    ):
        folder = tmp_path / str(func)
        folder.mkdir()
        (folder / "layer_11").write_text(layer, encoding="utf-8")
        (folder / "tokens").write_text("Ġa\nb\nĠc\n\nlost\n" if func == 0 else "x\n", encoding="utf-8")
    table = D.statement_table(D.read_dump_files(spark, str(tmp_path)))
    got = rows(table, "func_id", "layer", "stmt_id", "start", "tokens", "weights")
    assert got == [
        (0, 11, 1, 2, ["b", "Ġc"], [0.2, 0.0]),
        (0, 11, 4, 1, ["Ġa", "b", "Ġc"], [0.1, 0.0, 0.3]),
        (1, 11, 1, 1, ["x"], [0.5]),
    ]
    assert rows(A.skip_last_function(table), "func_id") == [(0,), (0,)]


def test_token_weight_file(spark, tmp_path):
    weights = spark.createDataFrame([("b", 0.5), ("a", 0.25)], "token string, weight double")
    D.write_token_weights(weights, str(tmp_path / "w"))
    assert rows(D.read_token_weights(spark, str(tmp_path / "w")), "token", "weight") == [("a", 0.25), ("b", 0.5)]
    again = spark.createDataFrame([("a  ||  1.0",), ("a  ||  2.0",), ("",)], "value string").coalesce(1)
    assert rows(D.parse_token_weights(again), "token", "weight") == [("a", 2.0)]


def test_listing_quotes_like_a_list(spark):
    df = spark.createDataFrame([(1, 1, ["a", "it's", 'q"'], 0.5)], "func_id long, stmt_id int, tokens array<string>, weight double")
    want = str(["a", "it's", 'q"']) + "\n0.5"
    assert D.statement_listing(df).first()["value"] == want


def test_keywords_and_cloud(spark):
    w = spark.createDataFrame([("int", 0.2, 4), ("for", 0.4, 4), ("foo", 0.9, 200), ("if", 0.1, 7)], "token string, weight double, frequency long")
    assert rows(A.keyword_profile(w), "frequency", "name", "repeats", "x") == [(4, "for", 2, 600), (7, "if", 1, 1050)]
    assert rows(A.cloud_counts(w), "token", "text", "copies") == [("foo", "oo", int(math.log2(90000)))]


def statements_table(spark):
    data = [(1, 1, ["a", "b"], 0.1), (1, 2, ["c", "d", "e"], 0.3), (1, 3, ["f"], 0.2), (2, 1, ["a"], 0.9)]
    st = spark.createDataFrame(data, "func_id long, stmt_id int, tokens array<string>, weight double")
    tw = spark.createDataFrame([(t, i / 10, i + 1) for i, t in enumerate("abcdef")], "token string, weight double, frequency long")
    return st, tw


def test_simplify(spark):
    st, tw = statements_table(spark)
    keep = lambda s, **o: "".join(r["token"] for r in simplify.simplify(st, tw, s, **o).orderBy("func_id", "stmt_id", "pos").collect())
    # 6 tokens, 3 must stay: statement 1 and then 3 are dropped
    assert keep("statement", ratio=0.5) == "cdea"
    assert keep("statement", ratio=0.6) == "cdefa"
    assert keep("token", low=2) == "cdef"
    assert keep("slim", ratio=0.5, low=3) == "de"
    assert keep("frequency", ratio=0.5) == "defa"
    assert len(keep("random", ratio=0.5)) == 4
    with pytest.raises(ValueError):
        simplify.simplify(st, tw, "none")


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e4])
def test_euclidean_neighbours_measure_few_differences(monkeypatch, scale):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(400, 16)), 1) * scale + scale
    points[50:90] = points[7]  # one common vector
    rows = np.concatenate([points[:60], rng.normal(size=(40, 16)) * scale])
    far = N._distances(points, rows, 2)
    want = [N._closest(row, 5) for row in far]
    held = N._near_rows(points, rows, 5)
    assert all(set(w) <= set(h) for w, h in zip(want, held, strict=True))
    if scale == 1.0:
        assert sum(map(len, held)) < 3000  # of 40,000
    measured = []
    distances = N._distances
    monkeypatch.setattr(N, "_distances", lambda p, r, n: measured.append(len(p) * len(r)) or distances(p, r, n))
    sent = type("Sent", (), {"value": (points, np.arange(400).astype(object), np.zeros(400, int))})
    frame = pd.DataFrame({"key": range(100), "vector": list(rows)})
    got = next(N._near(sent, 5, 2, 1 << 22)([frame]))
    assert got["neighbour"].tolist() == np.concatenate(want).tolist() and sum(measured) == sum(map(len, held))
    assert got["distance"].tolist() == np.concatenate([r[w] for r, w in zip(far, want, strict=True)]).tolist()


def test_tokens_are_ordered_at_the_cut_of_their_function_only(spark, monkeypatch):
    rng = random.Random(5)
    made = [(f, s, [rng.choice("abcdefgh") for _ in range(rng.randrange(9))], 1.0) for f in range(12) for s in range(4)]
    freq = {t: n for t, n in zip("abcdefg", (5, 1, 3, 3, 1, 9, None), strict=True)}
    st = spark.createDataFrame([*made, (None, 1, ["a"], 1.0)], "func_id int, stmt_id int, tokens array<string>, weight double")
    tw = spark.createDataFrame([(t, 1.0, n) for t, n in freq.items()], "token string, weight double, frequency int")
    ranked = []
    hash_rank = simplify.hash_rank
    monkeypatch.setattr(simplify, "hash_rank", lambda df, *a, **o: ranked.append(df.count()) or hash_rank(df, *a, **o))
    for ratio in (0.0, 0.37, 0.6, 1.0):
        want, tied = [], 0
        for f in range(12):
            all_ = [(freq.get(t) or 0, md5(f"42:{f}:{s}:{p}".encode()).hexdigest(), f"{f}:{s}:{p}", f, s, p, t) for g, s, ts, _ in made if g == f for p, t in enumerate(ts, 1)]
            all_.sort()
            gone = len(all_) - math.ceil(ratio * len(all_))
            want += [x[3:] for x in all_[gone:]]
            if 0 < gone < len(all_) and all_[gone - 1][0] == all_[gone][0]:
                tied += sum(x[0] == all_[gone][0] for x in all_)
        got = simplify.simplify(st, tw, "frequency", ratio).collect()
        assert sorted(map(tuple, got)) == sorted(want) and ranked.pop() == tied



# --- metrics and results -------------------------------------------------------------------


def brute_scores(true, pred):
    classes = sorted(set(true) | set(pred))
    p, r, f = [], [], []
    for c in classes:
        tp = sum(t == c and q == c for t, q in zip(true, pred, strict=True))
        np_, nt = pred.count(c), true.count(c)
        p.append(tp / np_ if np_ else 0.0)
        r.append(tp / nt if nt else 0.0)
        f.append(2 * tp / (np_ + nt) if np_ + nt else 0.0)
    return np.mean(p), np.mean(r), np.mean(f)


def report(spark, true, pred):
    return M.report(spark.createDataFrame(list(zip(true, pred, strict=True)), "y_true int, y_pred int"), digits=None).first()


def test_macro_metrics(spark):
    true, pred = [0, 0, 1, 1, 2], [0, 1, 1, 1, 3]
    p, r, f = brute_scores(true, pred)
    got = report(spark, true, pred)
    assert (got["prec"], got["rec"], got["f1"]) == pytest.approx((p, r, f))
    assert got["gmean"] == pytest.approx(math.sqrt(p * r))
    c, s = 3, 5
    pk, tk = {0: 1, 1: 3, 3: 1}, {0: 2, 1: 2, 2: 1}
    cross = sum(pk.get(k, 0) * tk.get(k, 0) for k in range(4))
    want = (c * s - cross) / math.sqrt((s * s - sum(v * v for v in pk.values())) * (s * s - sum(v * v for v in tk.values())))
    assert got["mcc"] == pytest.approx(want)


def test_one_true_class(spark):
    got = report(spark, [1, 1, 1, 1], [1, 1, 2, 1])
    assert (got["acc"], got["prec"], got["rec"], got["f1"], got["mcc"]) == (0.75, 0.75, 0.75, 0.75, 0.0)


def test_best_parameters(spark):
    schema = "classifier string, parameters string, val_mcc double"
    none = spark.createDataFrame([("svm", "1", -0.1), ("svm", "2", 0.0)], schema)
    assert R.best_parameters(none).count() == 0
    some = spark.createDataFrame([("svm", "1", 0.1), ("svm", "1", 0.3), ("svm", "2", 0.2), ("lr", "9", 0.5)], schema)
    assert rows(R.best_parameters(some), *some.columns) == [("lr", "9", 0.5), ("svm", "1", 0.1), ("svm", "1", 0.3)]


def test_grid():
    assert len(R.grid()) == 10 and ("knn", "5-uniform-1") in R.grid(["knn"]) and len(R.grid(["rf"])) == 15


def test_multitask_rejects_unknown_metric(spark):
    df = spark.createDataFrame([(1, "folds", 0, 0.5)], "run long, set string, fold int, cvss2_conf_loss double")
    with pytest.raises(ValueError, match="known metric"):
        R.multitask_to_long(df)


def test_sequential_names_are_checked(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "run long, mcc double")
    df.write.option("header", "true").csv(str(tmp_path / "code_hc_word_other_conf_3_x"))
    with pytest.raises(Exception, match="not a cvss2"):
        S.read_sequential_files(spark, str(tmp_path), df.schema).collect()


def test_code_csv_round_trip(spark, tmp_path):
    data = [(1, 'a "q", b\n  \\n c\n'), (2, ""), (3, None), (4, " lead\ttab ")]
    df = spark.createDataFrame(data, "key long, code string")
    S.write_code_csv(df, str(tmp_path / "c"))
    back = sorted((r["key"], r["code"]) for r in S.read_code_csv(spark, str(tmp_path / "c"), df.schema).collect())
    assert back == [(k, v or None) for k, v in data]


# --- logs ----------------------------------------------------------------------------------


def make_log(partitions=10, runs=10, best=2, epochs=3):
    out = []
    for p in range(partitions):
        out.append(f"Current partition: {p}\n")
        for r in range(runs):
            out.append(f"Run # {r}\n")
            for e in range(1, epochs + 1):
                out.append(f"Epoch {e}/{epochs}\n10/10 - {e}s - loss: 0.1\nValidation time: 0.5\n")
                if e == best:
                    out.append("Saving best model at epoch\n")
            out.append("Evaluating the best model\nx\nEvaluating the best model\nValidation time: 2.5\n")
    return "".join(out)


def test_log_timing(spark):
    df = spark.createDataFrame([(1, make_log()), (2, make_log(best=0))], "log_id long, value string")
    assert L.log_violations(df).count() == 0
    got = {r["log_id"]: r for r in L.run_timing(df).where("partition = 3 and run = 4").collect()}
    r = got[1]
    assert r["avg_time_per_epoch"] == 2.0 and r["number_of_epoch_at_best_model"] == 2 and r["number_of_epoch_at_finish"] == 3
    assert r["total_train_time_at_best_model"] == 3.0 and r["total_time_at_finish"] == 7.5 and r["final_evaluation_time"] == 2.5
    assert got[2]["number_of_epoch_at_best_model"] is None and got[2]["total_time_at_best_model"] is None


def test_log_violations(spark):
    bad = make_log().replace("Epoch 2/3", "Epoch 3/3", 1)
    df = spark.createDataFrame([(1, bad), (2, make_log(runs=9)), (3, make_log(partitions=1))], "log_id long, value string")
    got = {(r["log_id"], r["violation"]) for r in L.log_violations(df).collect()}
    assert got == {(1, "epoch order"), (2, "runs"), (3, "partitions")}


# --- statistics ----------------------------------------------------------------------------


def two_sides(spark, a, b, scenario="cvss2_conf"):
    data = [(scenario, "A", i, float(v)) for i, v in enumerate(a)] + [(scenario, "B", i, float(v)) for i, v in enumerate(b)]
    return spark.createDataFrame(data, "scenario string, side string, key long, value double")


def brute_ranks(values):
    return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]


def test_mann_whitney(spark):
    rnd = random.Random(5)
    a, b = [rnd.randint(0, 9) for _ in range(40)], [rnd.randint(2, 11) for _ in range(30)]
    got = stats.mann_whitney(two_sides(spark, a, b)).first()
    r = brute_ranks(a + b)
    assert got["u"] == sum(r[:40]) - 40 * 41 / 2
    assert got["alternative"] == "greater"
    n = 70
    ties = sum((a + b).count(v) ** 3 - (a + b).count(v) for v in set(a + b))
    sd = math.sqrt(40 * 30 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (got["u"] - 600 - 0.5) / sd
    assert got["z"] == pytest.approx(z) and got["p"] == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))
    assert stats.mann_whitney(two_sides(spark, a, b), "two-sided").first()["p"] <= 1.0


def test_character_pieces_count_every_ngram_once(spark, monkeypatch):
    from linescope.operators import features as X

    df = spark.createDataFrame([(1, "abcabcabcd" * 3), (2, ""), (3, "x"), (4, None), (5, "ab  cd")], "key long, code string")
    whole = rows(X.term_counts(df, X.char_terms(2, 4)), "key", "term", "tf")
    for piece in (1, 7, 30):
        monkeypatch.setattr(X, "PIECE", piece)
        assert rows(X.char_counts(df, 2, 4), "key", "term", "tf") == whole


def test_terms_are_counted_inside_the_row(spark):
    from linescope.operators import features as X

    df = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["z"])], "key long, t array<string>")
    got = X.term_counts(df, F.col("t"))
    assert rows(got, "key", "term", "tf") == [(1, "a", 1), (1, "b", 2), (4, "z", 1)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_exact_method_counts_arrangements(spark):
    from itertools import combinations, product

    a, b = [1.5, 4.0, 9.0], [2.0, 3.0, 5.0, 7.0]
    got = stats.mann_whitney(two_sides(spark, a, b), "greater", method="exact").first()
    u = sum(x > y for x in a for y in b)
    alls = [sum(x > y for x in pick for y in set(range(7)) - set(pick)) for pick in combinations(range(7), 3)]
    assert got["u"] == u and got["p"] == pytest.approx(sum(v >= u for v in alls) / len(alls))
    got = stats.wilcoxon(two_sides(spark, [5, 1, 9, 4], [4, 3, 5, 12]), method="exact").first()
    sums = [sum(r for r, s in zip((1, 2, 3, 4), signs, strict=True) if s) for signs in product((0, 1), repeat=4)]
    # differences 1, -2, 4, -8: positive ranks 1 + 3
    assert got["w"] == 4 and got["p"] == pytest.approx(min(1.0, 2 * sum(v <= 4 for v in sums) / 16))


def test_tails_equal_the_error_function_and_enumeration(spark):
    from itertools import combinations, product

    from linescope.functions import tails

    zs = [0.0, 1e-9, 0.5, 1.7, 2.999, 3.0, 3.001, 5.0, 9.0, 30.0, 60.0]
    df = spark.createDataFrame([(z,) for z in [*zs, *(-z for z in zs)]] + [(None,), (float("nan"),)], "z double")
    for r in df.select("z", tails.normal_tail(F.col("z")).alias("p")).collect():
        if r["z"] is None or math.isnan(r["z"]):
            assert r["p"] is None
        else:
            assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2.0)), rel=1e-11, abs=1e-300)
    cases, want = [], []
    for a, b in [(1, 1), (1, 4), (3, 2), (4, 4), (2, 6)]:
        n = set(range(a + b))
        us = [sum(x > y for x in pick for y in n - set(pick)) for pick in combinations(range(a + b), a)]
        for u in range(a * b + 1):
            cases.append((len(cases), 0.3, float(u), float(a), float(b), 0.0))
            want.append(sum(v >= u for v in us) / len(us))
    cases += [(len(cases), 0.0, 1.0, 2.0, 2.0, 6.0), (len(cases) + 1, None, 0.0, 0.0, 3.0, 0.0)]
    df = spark.createDataFrame(cases, "i int, z double, u double, a double, b double, t double")
    got = df.select("i", tails.rank_sum_tail(*(F.col(c) for c in "zuabt")).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got[:-2]] == pytest.approx(want) and got[-2]["p"] == pytest.approx(0.5) and got[-1]["p"] is None
    cases, want = [], []
    for n in range(1, 7):
        sums = [sum(r + 1 for r, s in enumerate(signs) if s) for signs in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            cases.append((len(cases), 0.3, float(w), float(n), 0.0, 0))
            want.append(min(1.0, 2 * sum(v <= w for v in sums) / len(sums)))
    cases += [(len(cases), 0.0, 0.0, 0.0, 0.0, 0), (len(cases) + 1, 0.0, 1.0, 2.0, 0.0, 1)]
    df = spark.createDataFrame(cases, "i int, z double, w double, n double, t double, zeros int")
    got = df.select("i", tails.signed_rank_p(*(F.col(c) for c in ("z", "w", "n", "t", "zeros"))).alias("p")).orderBy("i").collect()
    assert [r["p"] for r in got] == pytest.approx([*want, 1.0, 1.0])


def test_several_metrics_equal_one_comparison_each(spark):
    draw = random.Random(5)
    data = [
        (stats.TASKS[i % 2], "AB"[i % 3 == 0], f"k{i}", draw.random(), None if i % 7 == 0 else draw.choice([0.1, 0.2, 0.4]), "kept out")
        for i in range(60)
    ]
    df = spark.createDataFrame(data, "scenario string, side string, key string, mcc double, f1 double, value string")
    got = {r["scenario"]: r for r in stats.compare_metrics(df, ("mcc", "f1"), "old", "new").collect()}
    assert set(got) == {*stats.TASKS[:2], "overall"}
    for m in ("mcc", "f1"):
        for one in stats.compare(df.drop("value").withColumn("value", F.col(m)), "old", "new").collect():
            r = got[one["scenario"]]
            assert (r["A"], r["B"], r[f"n_A_{m}"], r[f"n_B_{m}"]) == ("old", "new", one["n_a"], one["n_b"])
            for mine, its in {"mean_A": "mean_a", "mwyu": "mwyu", "cohend": "cohen_d", "wilcoxon": "wilcoxon"}.items():
                assert r[f"{mine}_{m}"] == pytest.approx(one[its])
    assert stats.compare_metrics(df.where("false")).count() == 0


def test_missing_values_leave_the_rank_tests(spark):
    plain = two_sides(spark, [1.0, 4.0, 6.0], [2.0, 3.0, 5.0])
    holes = plain.unionByName(spark.createDataFrame([("s", side, 900 + i, v) for i, (side, v) in enumerate(
        [("A", None), ("B", None), ("A", float("nan"))])], plain.schema))
    scenario = plain.first()["scenario"]
    holes = holes.withColumn("scenario", F.lit(scenario))
    assert stats.mann_whitney(holes).collect() == stats.mann_whitney(plain).collect()
    assert stats.wilcoxon(holes).collect() == stats.wilcoxon(plain).collect()


def test_best_result_needs_its_metric(spark):
    schema = "problem string, granularity string, scope string, feature string, classifier string, parameters string, val_mcc double"
    df = spark.createDataFrame([("p", "g", "s", "f", "c", str(i), v) for i, v in enumerate([None, 0.5, float("nan"), 0.1])], schema)
    assert [r["parameters"] for r in R.best_results(df).collect()] == ["1"]


def test_result_files_are_read_by_name(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.25, 0.75)], "run long, val double, test double")
    df.write.option("header", "true").csv(str(tmp_path / "r1"))
    df.select("test", "run", "val").withColumn("other", F.lit("x")).write.option("header", "true").csv(str(tmp_path / "r2"))
    df.select("run", "test").write.option("header", "true").csv(str(tmp_path / "r3"))
    got = [(r["val"], r["run"], r["test"]) for r in S.read_results(spark, str(tmp_path), df.schema).collect()]
    assert sorted(got, key=str) == sorted([(0.25, 1, 0.75), (0.25, 1, 0.75), (None, 1, 0.75)], key=str)


def test_text_keys_spread_over_buckets(spark):
    from linescope.operators import ranking

    df = spark.range(5000).selectExpr("concat('CVE-20', lpad(cast(id * 7919 % 100000 as string), 6, '0')) as key")
    cut = ranking.string_buckets(df, "key")
    assert cut.groupBy("_bucket").count().count() > 200
    keys = sorted(r["key"] for r in df.collect())
    assert [r["key"] for r in ranking.value_rank(df, "key").orderBy("rank").collect()] == keys


def test_wilcoxon_equal_sizes(spark):
    rnd = random.Random(6)
    a, b = [rnd.randint(0, 9) for _ in range(30)], [rnd.randint(0, 9) for _ in range(30)]
    got = stats.wilcoxon(two_sides(spark, a, b)).first()
    d = [x - y for x, y in zip(a, b, strict=True) if x != y]
    r = brute_ranks([abs(x) for x in d])
    up = sum(k for k, x in zip(r, d, strict=True) if x > 0)
    assert got["n"] == len(d) and got["w"] == min(up, sum(r) - up)


def test_wilcoxon_samples_the_larger_side(spark):
    pairs = stats.paired(two_sides(spark, range(10), range(100, 104))).collect()
    assert sorted(r["b"] for r in pairs) == [100.0, 101.0, 102.0, 103.0]
    assert len({r["a"] for r in pairs}) == 4


def test_cohen_d(spark):
    a, b = [1.0, 2.0, 4.0], [2.0, 3.0, 7.0, 8.0]
    s = math.sqrt((2 * np.var(a, ddof=1) + 3 * np.var(b, ddof=1)) / 5)
    assert stats.cohen_d(two_sides(spark, a, b)).first()["cohen_d"] == pytest.approx(abs(np.mean(a) - np.mean(b)) / s)


def scored(spark, **values):
    base = {t: ("X", "X") for t in scoring.SCORED_TASKS} | values
    schema = ", ".join(f"`{t}` string, `{t}-pred` string" for t in base)
    return scoring.prediction_distance(spark.createDataFrame([tuple(x for v in base.values() for x in v)], schema))


def test_prediction_distance(spark):
    r = scored(spark, cvss2_severity=("LOW", "HIGH"), cvss2_conf=("NONE", "PARTIAL"), cvss2_auth=("A", "B"), cvss2_avail=("-", "NONE")).first()
    assert (r["score_abs"], r["score_partial"]) == (4, 2.5)
    with pytest.raises(Exception, match="off the scale"):
        scored(spark, cvss2_severity=("LOW", "EXTREME")).collect()


# --- neighbours and models -----------------------------------------------------------------


@pytest.mark.parametrize("norm, weights, bytes_", [(1, "uniform", 1 << 20), (2, "uniform", 500), (1, "distance", 1), (2, "distance", 1 << 20)])
def test_neighbours_equal_brute_force(spark, norm, weights, bytes_, monkeypatch):
    monkeypatch.setattr(N, "PACKET_ROWS", 7)
    rng = np.random.default_rng(0)
    train = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(0, 4, 3)]) for i in range(90)]
    test = [(1000 + i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(25)]
    a = spark.createDataFrame(train, "key long, label int, vector array<double>")
    b = spark.createDataFrame(test, "key long, vector array<double>")
    got = {r["key"]: r["prediction"] for r in N.classify(N.nearest(a, b, 5, norm, bytes_, block=400), weights).collect()}
    for key, v in test:
        far = [(round(float(np.linalg.norm(np.array(v) - np.array(t[2]), ord=norm)), 9), t[0], t[1]) for t in train]
        near = sorted(far)[:5]
        exact = [x for x in near if x[0] == 0]
        votes = {}
        for d, _, label in exact if weights == "distance" and exact else near:
            votes[label] = round(votes.get(label, 0) + (1 / d if weights == "distance" and d else 1), 9)
        assert got[key] == max(sorted(votes), key=lambda c: votes[c])


def test_neighbours_take_text_keys_and_one_block_moves_nothing(spark):
    a = spark.createDataFrame([("x", 1, [0.0]), ("y", 2, [5.0])], "key string, label int, vector array<double>")
    b = spark.createDataFrame([("q", [1.0])], "key string, vector array<double>")
    near = N.nearest(a, b, 1)
    assert rows(near, "key", "neighbour", "label", "distance", "place") == [("q", "x", 1, 1.0, 1)]
    assert "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert N.nearest(a.where("false"), b, 1).count() == 0
    assert rows(N.nearest(a, b, 5, block_bytes=1), "neighbour", "place") == [("x", 1), ("y", 2)]


def test_classifiers_fit(spark):
    rng = np.random.default_rng(1)
    data = [(i, i % 3, [float(i % 3 == j) * 3 + float(rng.random()) for j in range(3)]) for i in range(90)]
    df = C.dense(spark.createDataFrame(data, "key long, label int, vector array<double>"), "vector")
    for alg, parameters in (("nb", ()), ("svm", ("1",)), ("lr", ("1",)), ("lr_ovr", ("1",)), ("rf", ("5", "10")), ("xgb", ("5", "8")), ("lgbm", ("30", "8"))):
        model = C.classifier(alg, *parameters, rows=90).fit(df)
        hits = model.transform(df).where(F.col("label") == F.col("prediction")).count()
        assert hits >= 85, alg


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = session.fresh_path(spark, "x")
    assert named is None or path.startswith(named.rstrip("/"))
    assert session.fresh_path(spark, "x") != path


def test_shared_folder_without_a_named_one():
    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    local = Session("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("yarn"))
