"""Ranks with ties, pair counts and draws against plain versions, with hot values and several ranges."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import patterns as P
from tessera.functions import text as X
from tessera.operators import estimate, features, order, selection


@pytest.fixture(params=["4", "70"])
def partitions(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(n=600, seed=3):
    draw = np.random.default_rng(seed)
    x = np.where(draw.random(n) < 0.4, 0.5, draw.integers(0, 40, n) / 40)
    return [("a" if i % 5 else "b", f"k{i:04d}", float(x[i]) if i % 97 else None, float(draw.integers(0, 30))) for i in range(n)]


def test_positions_and_edges(spark, partitions):
    data = rows()
    df = spark.createDataFrame(data, "g string, k string, x double, y double")
    got = {r["k"]: r for r in selection.edges(df, "x", "k", ["g"], "e").collect()}
    for g in "ab":
        own = sorted((r[2], r[1]) for r in data if r[0] == g and r[2] is not None)
        q = max(1, len(own) // 4)
        for i, (_, k) in enumerate(own):
            assert (got[k]["e_position"], got[k]["e_total"]) == (i + 1, len(own))
            assert got[k]["e"] == ("low" if i < q else "high" if i >= len(own) - q else "mid")
    assert len(got) == sum(r[2] is not None for r in data)
    assert selection.edges(df.limit(0), "x", "k", ["g"], "e").count() == 0
    whole = order.positions(df, ["x", "k"], []).orderBy("position").collect()
    assert [r["k"] for r in whole] == [r[1] for r in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[1]))] and whole[0]["position"] == 1


def test_ranks_in_many_buckets(spark, partitions):
    data = rows()
    got = {r["k"]: r["rank"] for r in order.average_rank(spark.createDataFrame(data, "g string, k string, x double, y double"), "x", ["g"]).collect()}
    for g in "ab":
        v = np.array([r[2] for r in data if r[0] == g and r[2] is not None])
        for r in data:
            if r[0] == g and r[2] is not None:
                assert got[r[1]] == ((v < r[2]).sum() + 1 + (v <= r[2]).sum()) / 2


@pytest.mark.parametrize("n, most", [(400, 1), (3000, 8)])
def test_the_largest_bucket_follows_a_parameter(spark, monkeypatch, n, most):
    """Half of the rows share a value and most values lie close together: whatever the table's size, no bucket holds over ``most`` values."""
    draw = np.random.default_rng(n)
    x = np.where(draw.random(n) < 0.5, 7.0, np.where(draw.random(n) < 0.9, draw.random(n) * 1e-6, draw.random(n) * 1e6))
    data = [("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)]
    sizes = []
    kept = order._cumulated

    def watched(counts, value, by, buckets, limit, depth):
        out = kept(counts, value, by, buckets, limit, depth)
        sizes.append(depth)
        return out

    monkeypatch.setattr(order, "_cumulated", watched)
    df = spark.createDataFrame(data, "g string, x double")
    got = {(r["g"], r["x"]): (r["cum_n"], r["cum_before"], r["cum_total"]) for r in order.cumulative(df, "x", ["g"], 64, most).collect()}
    for g in "ab":
        own = np.array([v for h, v in data if h == g])
        values, counts = np.unique(own, return_counts=True)
        before = np.cumsum(counts) - counts
        assert [got[g, v] for v in values.tolist()] == [(c, b, len(own)) for c, b in zip(counts.tolist(), before.tolist(), strict=True)]
    assert len(got) == len({*data}) and max(sizes) >= 1
    ranged = order.ranges(df, "x", ["g"], 64)
    assert ranged.groupBy("g", "range").agg(F.min("x").alias("l"), F.max("x").alias("h")).orderBy("g", "l").collect() and ranged.count() == n


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_medians_of_resampled_clusters(spark, buckets):
    data = [(g, f"{g}{i % 17}", None if i % 31 == 5 else float(v)) for g in "ab" for i, v in enumerate(np.random.default_rng(9).integers(0, 12, 200))]
    df = spark.createDataFrame(data, "g string, k string, x double")
    got = {(r["rep"], r["g"]): r["median"] for r in estimate.cluster_medians(df, "x", "k", ["g"], 12, buckets=buckets).collect()}
    weights = {(r["rep"], r["g"], r["k"]): r["w"] for r in estimate.draws(df.select("g", "k").distinct(), "k", ["g"], 12).collect()}
    for rep in range(12):
        for g in "ab":
            drawn = [x for h, k, x in data if h == g and x is not None for _ in range(weights.get((rep, g, k), 0))]
            assert got[rep, g] == np.median(drawn)


def test_few_groups_are_never_what_rows_are_dealt_by(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([("ab"[i % 2], f"k{i % 5}", float(i % 9)) for i in range(90)], "g string, k string, x double")
        plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
        ranged = plan(order.ranges(df, "x", ["g"], 8))
        assert "BroadcastHashJoin" in ranged and "SortMergeJoin" not in ranged
        assert "BroadcastHashJoin" in plan(estimate.cluster_medians(df, "x", "k", ["g"], 4, buckets=3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tfidf_with_few_and_many_tokens(spark):
    data = [("a" if i % 3 else "b", f"s{i}", " ".join(f"w{j}" for j in range(i % 9) if (i * 7 + j) % 4) + (" the" if i % 5 else "") + (" rare%d" % i if i % 50 == 1 else "")) for i in range(2500)]
    df = spark.createDataFrame(data, "corpus_id string, sent_id string, sent_text string")
    few, many = (sorted(tuple(r) for r in features.tfidf(df, most=most).collect()) for most in (10**6, 0))
    assert len(few) == len(many) == len(data)
    for x, y in zip(few, many, strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:])
    assert {r[1] for r in few if r[2] == 0} == {i for _, i, t in data if not t.strip()}


def test_features_read_the_sentences_once(spark):
    seen, n = spark.sparkContext.accumulator(0), 40

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "corpus_id string, sent_id string, sent_text string"
    df = spark.createDataFrame([("ab"[i % 2], f"s{i}", f"Word {i % 7} the, the x=1.") for i in range(n)], schema).mapInArrow(watched, schema)
    for make in (features.idf, lambda d: features.tfidf(d, most=0), features.tfidf, features.feature_table):
        before = seen.value
        make(df).collect()
        assert seen.value - before == n
    counts = features.term_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert counts.count("regexp_extract_all(") == 1 and "sort_array" in counts


def test_idf_counts_sentences_without_text(spark):
    df = spark.createDataFrame([("a", "1", "The the x"), ("a", "2", None), ("a", "3", "")], "corpus_id string, sent_id string, sent_text string")
    got = {r["token"]: (r["df"], r["idf"]) for r in features.idf(df).collect()}
    assert got == {t: (1, pytest.approx(np.log(4 / 2) + 1)) for t in ("the", "x")}
    assert {r["sent_id"]: r["tfidf_max"] > 0 for r in features.tfidf(df).collect()} == {"1": True, "2": False, "3": False}


def test_densities_equal_those_of_each_token(spark):
    words = ["the", "The", "git", "Git", "git.", "gitx", "THE", "a", "A", "a.", "..", ".", "...", "-", "x:", "x=1", "--flag=2", "--flag", "a/b", "1.2", "v1.2", "snake_case", "camelCase", "CamelCase", "Mr.", "bash:", "été", "Über", "(", "“", "3", "Ubuntu22", "pip3", "run.exe", "-o", "word.word", "C:\\x", "key:", "Python.", "K", "\u00a0", "B.C.", "/", "é.b"]
    rng = np.random.default_rng(3)
    texts = ["", " ", *words, *(" ".join(rng.choice(words, k)) for k in (2, 3, 5, 9, 30) for _ in range(40)), *("".join(rng.choice(words, 4)) for _ in range(60))]
    df = spark.createDataFrame([("a", str(i), t) for i, t in enumerate(texts)], "corpus_id string, sent_id string, sent_text string")
    got = {int(r["sent_id"]): r for r in features.densities(df).collect()}
    each = df.withColumn("t", X.tokens(F.col("sent_text")))
    share = lambda c: F.coalesce(F.try_divide(c, F.size("t")), F.lit(0.0))
    plain = {k: share(F.size(F.filter("t", f))) for k, f in features.DENSITIES.items()}
    spans = F.regexp_count("sent_text", F.lit(P.YAML_SPAN)) + F.regexp_count("sent_text", F.lit(P.FLAG_SPAN))
    plain |= {"assignment_parameter_density": share(F.size(F.filter("t", X.is_assignment)) + spans), "token_shape_complexity_mean": share(F.aggregate("t", F.lit(0), lambda s, t: s + X.shape_points(t)))}
    for r in each.select("sent_id", F.size("t").alias("token_count"), *(c.alias(k) for k, c in plain.items())).collect():
        assert {k: got[int(r["sent_id"])][k] for k in (*plain, "token_count")} == {k: r[k] for k in (*plain, "token_count")}, texts[int(r["sent_id"])]


def plain_tau(x, y):
    s = dx = dy = 0
    for (a, b), (c, d) in itertools.combinations(zip(x, y, strict=True), 2):
        s, dx, dy = s + np.sign(a - c) * np.sign(b - d), dx + (a != c), dy + (b != d)
    return None if not dx or not dy else s / (dx * dy) ** 0.5


@pytest.mark.parametrize("strips", [1, 3, 64])
def test_kendall(spark, strips):
    data = rows(200) + [("c", f"c{i}", 1.0, float(i)) for i in range(9)] + [("d", "d0", 1.0, 2.0), ("e", "e0", None, 1.0)]
    df = spark.createDataFrame(data, "g string, k string, x double, y double")
    got = {r["g"]: r["tau"] for r in estimate.kendall_tau(df, "x", "y", "k", ["g"], strips).collect()}
    for g in "abcd":
        own = [r for r in data if r[0] == g and r[2] is not None]
        want = plain_tau([r[2] for r in own], [r[3] for r in own])
        assert got[g] is None if want is None else got[g] == pytest.approx(want)
    assert "e" not in got
    own = [r for r in data if r[2] is not None]
    assert estimate.kendall_tau(df, "x", "y", "k", [], strips).first()["tau"] == pytest.approx(plain_tau([r[2] for r in own], [r[3] for r in own]))


def test_dominated_pairs():
    draw = np.random.default_rng(5)
    for _ in range(50):
        m = draw.integers(1, 60)
        x, y, n = draw.integers(0, 12, m), draw.integers(0, 9, m), draw.integers(1, 4, m)
        assert estimate.dominated(x, y, n) == sum(n[i] * n[j] for i in range(m) for j in range(m) if x[i] < x[j] and y[i] < y[j])


def test_invariance_of_a_corpus_without_spread(spark, tmp_path):
    """A corpus of one sentence has no deviation to divide by, and still has its row."""
    from tessera.plans import registry

    texts = ["One short sentence is here. Another follows it! 12 34 is a third one.", "Ein Satz.", "Noch einer steht 9 hier."]
    spark.createDataFrame([(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts, ("en", "xx", "de"), strict=True))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["corpus_id"]: r for r in registry.QUERIES["e20_invariance"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["de", "en", "xx"] and all(r["invariant"] for r in got.values()) and got["xx"]["rho"] == 0


def test_values_that_stand_for_several_rows(spark, partitions):
    data = [("a", i % 7 / 7, i % 3 + 1) for i in range(60)] + [("b", None, 4), ("b", 2.0, 5)]
    df = spark.createDataFrame(data, "g string, x double, c long")
    got = {(r["g"], r["x"]): (r["cum_n"], r["cum_before"], r["cum_total"]) for r in order.cumulative(df, "x", ["g"], times="c").collect()}
    long = df.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("c"))))
    assert got == {(r["g"], r["x"]): (r["cum_n"], r["cum_before"], r["cum_total"]) for r in order.cumulative(long, "x", ["g"]).collect()} and got["b", 2.0] == (5, 0, 5)


def test_feature_correlations_rank_no_row_for_each_feature(spark, monkeypatch):
    """What is ranked are a row for each sentence, and the different values of a feature."""
    from tessera.plans import statistic_queries
    from tessera.plans.views import Views

    held = {}

    def watched(df, name, real=statistic_queries.written):
        held[name] = real(df, name)
        return held[name]

    monkeypatch.setattr(statistic_queries, "written", watched)
    v = Views(spark, "/root/testdata/sf0.001")
    got = statistic_queries._feature_rhos(v).collect()
    assert held["features"].count() == v.sentences().count() == sum(r["n"] for r in got if r["feature"] == "char_count")
    assert held["sums"].count() == held["sums"].select("corpus_id", "feature", "x").distinct().count()


@pytest.mark.parametrize("reps, cell", [(50, 1 << 22), (13, 1), (70_000, 1)])
def test_resampled_sums_are_those_of_the_draws(spark, partitions, monkeypatch, reps, cell):
    """Several cells, replicates that are no multiple of eight, more of them than two bytes count, a null value, a null group; and the plan explodes no draw."""
    monkeypatch.setattr(estimate, "_CELL", cell)
    n = 3 if reps > 1000 else 900
    data = [("a" if i % 3 else "b", f"k{i}", i / 8 if i % 11 else None, i) for i in range(n)] + [(None, "k", 1.0, 1)]
    df = spark.createDataFrame(data, "g string, k string, s double, c long")
    got = estimate.resampled_sums(df, "k", ["g"], ["s", "c"], reps)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    want = estimate.draws(df, "k", ["g"], reps).join(df, ["g", "k"]).groupBy("rep", "g").agg(F.coalesce(F.sum(F.col("w") * F.col("s")), F.lit(0.0)).alias("s"), F.sum(F.col("w") * F.col("c")).cast("double").alias("c"))
    assert sorted(map(tuple, got.select("rep", "g", "s", "c").where("g is not null").collect())) == sorted(map(tuple, want.collect()))
