import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafloom.functions import rules
from leafloom.operators import bandfit, batch, calibrate, evaluate, layout, orientation, registers, route, scorer, study, triage
from leafloom.sources import tables


def span(text, left, bottom, width=20, height=10):
    return (text, float(left), float(bottom - height), float(left + width), float(bottom))


def ordered(spans):
    rows = [("p", i, *s) for i, s in enumerate(spans)]
    out = layout.ordered_page(pd.DataFrame(rows, columns=["page", "ord", "text", "l", "t", "r", "b"]))
    return out["text"].tolist()


def columns(rows=6):
    pairs = [(span(f"L{i}", 100, 100 + 30 * i, 160), span(f"R{i}", 500, 100 + 30 * i, 160)) for i in range(rows)]
    return [s for pair in pairs for s in pair]


def test_two_columns():
    assert ordered(columns()) == [f"{c}{i}" for c in "LR" for i in range(6)]


def test_header_over_columns():
    assert ordered([span("H", 100, 40, 560), *columns()])[0] == "H"


def test_three_columns():
    spans = [span(f"{c}{i}", x, 100 + 30 * i, 80) for i in range(6) for c, x in (("a", 10), ("b", 110), ("c", 210))]
    assert ordered(spans) == [f"{c}{i}" for c in "abc" for i in range(6)]


def test_overlapping_boxes():
    spans = [span(f"{c}{i}", x, 100 + 30 * i, w, 20) for i in range(8) for c, x, w in (("l", 0, 104), ("r", 98, 102))]
    assert ordered(spans) == [f"{c}{i}" for c in "lr" for i in range(8)]


def test_line_numbers_stay_beside_their_rows():
    spans = [s for i in range(6) for s in (span(str(i), 10, 100 + 30 * i, 20), span(f"t{i}", 50, 100 + 30 * i, 350))]
    assert ordered(spans) == [x for i in range(6) for x in (str(i), f"t{i}")]


def test_no_span_is_lost():
    spans = [*columns(4), span("RULE", 100, 245, 560), ("none", None, None, None, None), *[span(f"z{i}", 40 * i, 500) for i in range(5)]]
    assert sorted(ordered(spans)) == sorted(s[0] for s in spans)


def test_lines_are_anchored(spark):
    rows = [("p", i, b, 0.0, 5.0) for i, b in enumerate([0.0, 4.0, 8.0, 9.0, 30.0])]
    df = spark.createDataFrame(rows, "page string, ord long, baseline double, left double, tolerance double")
    assert [r["line"] for r in layout.grouped_lines(df).orderBy("ord").collect()] == [1, 1, 2, 2, 3]


def step_functions(groups, values, most):
    """All ways, listed: the plain counterpart of the numbered ones."""
    for runs in range(1, min(most, groups) + 1):
        for cuts in itertools.combinations(range(1, groups), runs - 1):
            for chosen in itertools.product(values, repeat=runs):
                if all(a != b for a, b in zip(chosen, chosen[1:])):
                    yield [chosen[sum(c <= g for c in cuts)] for g in range(groups)]


def test_best_partition_is_exact():
    rng = random.Random(7)
    for _ in range(20):
        n, values = rng.randint(2, 5), [1.0, 2.0, 3.0]
        costs = [{v: (rng.randint(0, 1), round(rng.random(), 4)) for v in values} for _ in range(n)]
        got, _ = calibrate.best_partition(costs, 3)
        want = min(tuple(map(sum, zip(*[c[v] for c, v in zip(costs, f)]))) for f in step_functions(n, values, 3))
        assert got == pytest.approx(want)


def test_ways_are_numbered_in_order():
    for groups, values, most in itertools.product((1, 2, 5, 6), (1, 2, 3), (1, 2, 4)):
        want = list(step_functions(groups, list(range(values)), most))
        assert bandfit.number_of_ways(groups, values, most) == len(want)
        numbers = np.random.default_rng(0).permutation(len(want))
        assert bandfit.decoded(numbers, groups, values, most).tolist() == [want[i] for i in numbers]


def fit_problem(spark, rows):
    """rows: (name, stddev, dark_pct, {(contrast, psm): (violations, regret)}); cells and features of them."""
    cells = [(n, c, p, (int(v), float(r), int(p), abs(c - 2.0))) for n, _, _, cost in rows for (c, p), (v, r) in cost.items()]
    kind = "fixture string, contrast double, psm int, cost struct<violations:int,regret:double,psm_rank:int,distance:double>"
    return spark.createDataFrame(cells, kind), spark.createDataFrame([r[:3] for r in rows], "fixture string, stddev double, dark_pct double")


def best_of_all(rows, contrasts, psms, most):
    """(cost, assignments) of the best pair of bandings: every one tried, whole costs compared."""
    place = {}
    for k in (1, 2):
        kinds = sorted({r[k] for r in rows})
        place[k] = ([kinds.index(r[k]) for r in rows], len(kinds))
    costs = {}
    for c in step_functions(place[1][1], contrasts, most):
        for p in step_functions(place[2][1], psms, most):
            cells = [(c[i], p[j]) for i, j in zip(place[1][0], place[2][0])]
            each = [(*r[3][cell], cell[1], abs(cell[0] - 2.0)) for r, cell in zip(rows, cells)]
            costs.setdefault(tuple(round(sum(x), 9) for x in zip(*each)), []).append(tuple(cells))
    return min(costs), costs[min(costs)]


def test_joint_fit_beats_every_pair_of_bandings(spark):
    """Ties of features stay together; every fold is the best there is; regret, mean and gap follow from the folds."""
    contrasts, psms = [1.0, 1.5, 2.0], [3, 6]
    for seed in range(3):
        chance = random.Random(seed)
        draw = lambda: {c: (chance.randrange(2), chance.randrange(8) / 8) for c in itertools.product(contrasts, psms)}  # noqa: B023, E731
        rows = [(str(i), s, d, draw()) for i, (s, d) in enumerate([(5.0, 2.0), (9.0, 1.0), (7.0, 4.0), (9.0, 3.0), (2.0, 3.0), (2.5, 0.5)])]
        cells, features = fit_problem(spark, rows)
        bands = bandfit.fitted(cells, features, 2, 2, leave_out=True).persist()
        got = {(r["fold"], r["fixture"]): (r["contrast"], r["psm"]) for r in bandfit.applied(bands, features).collect()}
        for held in [None, *[r[0] for r in rows]]:
            kept = [r for r in rows if r[0] != held]
            cost, ways = best_of_all(kept, contrasts, psms, 2)
            assert tuple(got[held, r[0]] for r in kept) in ways
            head = bands.where(F.col("fold").eqNullSafe(F.lit(held))).first()
            assert (head["violations"], head["regret"]) == (cost[0], pytest.approx(cost[1]))
        out = bandfit.leave_one_out(cells, features, 2, 2).toPandas()
        regret = {r[0]: r[3][got[r[0], r[0]]][1] for r in rows}
        assert dict(zip(out["fixture"], out["regret"])) == pytest.approx(regret)
        inside = sum(r[3][got[None, r[0]]][1] for r in rows) / len(rows)
        assert out["gap"].tolist() == pytest.approx([sum(regret.values()) / len(rows) - inside] * len(rows))


def test_fit_refuses_gaps_and_takes_no_fixtures(spark):
    cells, features = fit_problem(spark, [("a", 1.0, 1.0, {(1.0, 3): (0, 0.5), (2.0, 3): (1, 0.25)}), ("b", 1.0, 2.0, {(1.0, 3): (0, 0.5), (2.0, 3): (0, 0.25)})])
    assert bandfit.fitted(cells, features).where("setting = 'contrast'").select("upper", "value").collect() == [(math.inf, 1.0)]
    assert bandfit.fitted(cells.limit(0), features.limit(0)).count() == 0
    with pytest.raises(ValueError):
        bandfit.fitted(cells.where("fixture = 'a' or contrast = 1"), features)


def test_bands_and_leave_one_out():
    fixtures = [{"fixture": str(i), "feature": float(i), "cost": {1: (0, abs(i - 1)), 2: (0, abs(i - 5))}} for i in range(6)]
    _, bands = calibrate.fitted_bands(fixtures, [1, 2], 2)
    assert bands[0][1] == 1 and bands[-1] == (float("inf"), 2) and 2 < bands[0][0] <= 4
    assert dict(calibrate.leave_one_out(fixtures, [1, 2], 2))["5"] == 2
    assert all(len(set(f)) for f in itertools.islice(step_functions(3, [1, 2], 2), 5))


def candidates(spark, rows):
    return spark.createDataFrame(rows, "file string, engine_ord int, engine string, text string, words long, score double")


def test_router_weight_flips_and_ties_go_to_the_first(spark):
    rows = [("a", 0, "long", "x", 80, 0.11), ("a", 1, "short", "x", 10, 0.15), ("b", 0, "p", "x", 5, 0.2), ("b", 1, "q", "x", 5, 0.2)]
    got = {r["file"]: r["engine"] for r in route.routed(candidates(spark, rows)).collect()}
    assert got == {"a": "short", "b": "p"}
    half = route.effective(candidates(spark, rows), 0.5).where("file = 'a'").orderBy("effective").collect()
    assert half[-1]["engine"] == "long"


def test_gate_uses_the_winners_raw_score_and_triage_the_raw_best(spark):
    df = candidates(spark, [("a", 0, "long", "text", 100, 0.09), ("a", 1, "short", "text", 1, 0.095)])
    row = route.routed(df).first()
    assert (row["engine"], row["quality_gate"], row["status"]) == ("long", "failed", "triage")
    assert triage.records(df).first()["best"]["engine"] == "short"


def test_short_engines_are_dropped_but_common_failures_cost_nobody(spark):
    rows = [(r, e, p, 0.5, 0.5) for r in ("x", "y") for e in ("a", "b") for p in (1, 2, 3) if (r, e, p) != ("y", "b", 3)]
    rows += [("x", "a", 4, None, None), ("x", "b", 4, None, None)]
    df = spark.createDataFrame(rows, "register string, engine string, page int, chr double, wrd double")
    assert [r["engine"] for r in registers.complete_engines(df).collect()] == ["a"]


def test_guards(spark):
    long = spark.createDataFrame([("f", "a", 0.5, 0.5, 1.0)], "fixture string, backend string, chr double, wrd double, sec double")
    with pytest.raises(ValueError):
        evaluate.merged(long, long.replace("f", "g"))
    old, new = (spark.createDataFrame([(x,) for x in names], "register string") for names in (["alpha", "beta"], ["alpha"]))
    assert evaluate.shrunk(old, new).count() == 1
    with pytest.raises(ValueError):
        tables.manifest_rows(long)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "b.csv").write_text("fixture,a_chr,a_wrd,a_sec\nf,0.5,N/A,1\nAverage,0.5,,1\n")
    rows = tables.wide_benchmark(spark, str(tmp_path / "b.csv")).collect()
    assert [(r["fixture"], r["backend"], r["chr"], r["wrd"]) for r in rows] == [("f", "a", 0.5, None)]
    (tmp_path / "c.json").write_text('{"pages": {"1": [{"text": "x", "bbox": [1, 2, 3, 4], "confidence": 0.5}, {"text": "y"}]}}')
    spans = tables.span_cache(spark, str(tmp_path / "c.json")).orderBy("ord").collect()
    assert [(s["text"], s["l"], s["confidence"]) for s in spans] == [("x", 1.0, 50.0), ("y", None, None)]
    split = tables.split_manifest(spark, 'excluded = ["z"]\n[one]\nfit = ["a", "b"]\nheld_out = ["c"]\n')
    assert split.count() == 4
    rows = spark.createDataFrame([("f", "processed", 0.5)], "file string, status string, quality double")
    for _ in range(2):
        tables.append_manifest(rows, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_live_log(spark, tmp_path):
    from leafloom.streaming import log

    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.json").write_text('{"ts":"2026-01-01T00:00:00.000Z","event":"backend_finish","backend":"a","seconds":2.5}\n' * 2)
    live = log.live_backend_seconds(log.stream(spark, str(folder)))
    query = live.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT * FROM live").collect()] == [("a", 2, 5.0)]


def test_page_shapes():
    from leafloom.plans.table_queries import _shapes

    for name, boxes, want in _shapes():
        assert ordered(boxes) == want, name


def test_evaluated_table_skips_failed_pages(spark):
    rows = [("f", "a", "alpha beta", 1.0), ("f", "b", "alpha", 2.0), ("g", "a", "x", 1.0), ("g", "b", None, 2.0), ("z", "a", "not expected", 9.0)]
    texts = spark.createDataFrame(rows, "fixture string, backend string, text string, sec double")
    expected = spark.createDataFrame([("f", "alpha beta"), ("g", "x")], "fixture string, expected string")
    table = {r["fixture"]: r.asDict() for r in study.evaluated(texts, expected, ["a", "b"]).collect()}
    assert set(table) == {"f", "g", "Average"} and table["g"]["b_chr"] is None and table["Average"]["b_wrd"] == 0.5
    assert table["Average"]["a_chr"] == 1.0 and table["Average"]["a_sec"] == 2.0 and table["f"]["b_chr"] == pytest.approx(2 / 3, abs=1e-3)


def test_serialisations_keep_recall(spark):
    spans = spark.createDataFrame([("p", i, *s) for i, s in enumerate(columns())], "page string, ord long, text string, l double, t double, r double, b double")
    expected = spark.createDataFrame([("p", " ".join(f"{c}{i}" for c in "LR" for i in range(6)))], "page string, expected string")
    scores = study.serialisation_scores(spans, expected)
    by = {r["strategy"]: (r["chr"], r["wrd"]) for r in scores.collect()}
    assert by["column"] == (1.0, 1.0) and by["linesort"][0] < 1 and study.uneven(scores).count() == 0


def test_refusals(spark):
    a = spark.createDataFrame([("d", 1), ("d", 2)], "doc string, page int")
    with pytest.raises(ValueError):
        study.zipped(a.withColumn("x", a["page"]), a.where("page = 1").withColumn("y", a["page"]), "doc", "page")
    means = spark.createDataFrame([(0.1, 0.2, 0.3, 0, 1, 4)], "plain double, fitted double, oracle double, regressions long, unmet long, fixtures long")
    with pytest.raises(ValueError):
        study.writable(means)


def test_batch_states(spark):
    files = spark.createDataFrame([("a", "x/a.pdf", 10, 10, 1), ("b", "x/b.png", 40_000, 1, 1), ("c", "x/c.png", 1, 1, 1)], "file string, path string, width int, height int, pages int")
    scored = candidates(spark, [("a", 0, "e", "text", 9, 0.5), ("b", 0, "e", "text", 9, 0.5)])
    rows = {r["file"]: r for r in batch.processed(files, scored, "pdf,md").collect()}
    assert rows["a"]["outputs"] == ["a.searchable.pdf", "a.md"] and rows["a"]["location"] == "processed"
    assert (rows["b"]["status"], rows["b"]["note"], rows["c"]["status"], rows["c"]["location"]) == ("refused", "side too long", "error", "scans")
    assert {r["status"]: r["outputs"] for r in batch.summary(batch.processed(files, scored, None)).collect()} == {"processed": 1, "refused": 0, "error": 0}


def test_large_lexicon_is_joined_in_two(spark):
    df = spark.createDataFrame([("f", 0, "e", "the cat the dog unknown word here"), ("g", 0, "e", ""), ("g", 1, "e2", "cat cat")], "file string, engine_ord int, engine string, text string")
    lexicon = spark.createDataFrame([("the", 50), ("cat", 3), ("dog", 2), ("here", 1)], "word string, n long")
    words = spark.createDataFrame([(w,) for w in ("the", "cat", "dog", "here", "unknown", "the")], "word string")
    by = lambda most: sorted(map(tuple, route.with_counts(words, lexicon, 56, 4, most).select("word", "n").collect()), key=str)
    assert by(10) == by(2) == by(1)
    assert [tuple(r) for r in route.quality_scores(df, lexicon).orderBy("file", "engine_ord").select("words", "coverage", "score").collect()][1] == (0, 0.0, 0.0)


def test_reading_files_back(spark, tmp_path):
    from leafloom.sources import engines

    (tmp_path / "s.csv").write_text("fixture,contrast,psm,char_sim,word_recall,seconds\nf,2.0,3,0.5,0.4,1.5\n")
    assert tables.typed_csv(spark, str(tmp_path / "s.csv"), tables.SWEEP).first()["psm"] == 3
    (tmp_path / "b.csv").write_text("backend,page,char_sim,word_recall\na,1,0.5,0.5\na,2,,\n")
    assert tables.baselines(spark, str(tmp_path / "b.csv")).count() == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "A.PDF").write_bytes(b"%PDF")
    (tmp_path / "in" / "n.txt").write_text("x")
    assert [r["stem"] for r in tables.scan(spark, str(tmp_path / "in"), [".pdf"]).select("stem").collect()] == ["A"]
    files = spark.createDataFrame([("a", ".png", 1, "words"), ("b", ".pdf", 3, "more")], "file string, suffix string, pages int, content string")
    own = [engines.existing("one", "content", (".png", ".pdf")), engines.Engine("two", lambda c, s: c, (".pdf",), True)]
    assert {(r["file"], r["engine"]) for r in engines.transcribed(files, own).collect()} == {("a", "one"), ("b", "one")}
    cache = spark.createDataFrame([("a", "one")], "file string, engine string")
    assert {tuple(r) for r in engines.missing(files, own, cache).collect()} == {("b", "one"), ("b", "two")}


def test_evaluation_over_documents(spark, sf_dir):
    """The wide table of q3: failed pages are left out of averages, and scores are those of the functions."""
    from leafloom import plans

    table = {r["fixture"]: r.asDict() for r in plans.QUERIES["q3_wide_table"](spark, sf_dir).collect()}
    pages = [r for f, r in table.items() if f != "Average"]
    assert len(pages) == 200 and all((r["reversed_chr"] is None) == (int(r["fixture"]) % 7 == 0) for r in pages)
    for c, fold in (("half_chr", lambda x: sum(x) / len(x)), ("reversed_wrd", lambda x: sum(x) / len(x)), ("garbled_sec", sum)):
        assert table["Average"][c] == pytest.approx(fold([r[c] for r in pages if r[c] is not None]))
    assert all(r["lower_chr"] == 1.0 and 0 < r["half_chr"] < 0.7 for r in pages)


def test_reading_order_study_over_documents(spark, sf_dir):
    from leafloom import plans

    rows = plans.QUERIES["q8_reading_order"](spark, sf_dir).toPandas()
    one = rows[(rows["layout"] == "single-column") & (rows["fixture"] == "mean")]
    assert set(one["chr"]) == {1.0}
    several = rows[(rows["layout"] == "multi-column") & (rows["fixture"] == "mean")].set_index("backend")["chr"]
    assert several["column"] == 1.0 and several["engine"] < 0.9 and several["linesort"] < 0.9
    detail = rows[rows["fixture"] != "mean"]
    assert set(detail["wrd"]) == {1.0}
    mean = detail[(detail["backend"] == "engine") & (detail["layout"] == "multi-column")]["chr"].mean()
    assert several["engine"] == pytest.approx(mean, abs=1e-5)


def test_blocks_without_variance_have_no_direction(spark):
    from leafloom.operators import imagestat

    rows = [("blank", 0.0, 0.0, 0.1, 0.2)] * 9 + [("mixed", 0.0, 0.0, 0.1, 0.2), ("mixed", 4.0, 1.0, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "image string, var_row double, var_col double, mean double, peak double")
    got = {r["image"]: (r["vote"], r["blocks"]) for r in imagestat.block_vote(df).collect()}
    assert got["blank"] == (0.0, 0) and got["mixed"] == (pytest.approx(math.log(4.0)), 1)


def test_bigram_chances_sum_to_one(spark):
    """After any word, over all words and one never seen; by a plain count of the same rule."""
    texts = ["the cat sat on the mat", "the cat ran", "a dog sat on the cat", "", "12 x"]
    model = scorer.Bigrams().fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    gain = {(r["u"], r["w"]): r["gain"] for r in model.bigrams.collect()}
    back = {r["u"]: r["back"] for r in model.contexts.collect()}
    own = {r["w"]: r["own"] for r in model.words.collect()}
    assert sum(own.values()) + model.unseen == pytest.approx(1.0)
    for u in ["", "the", "cat", "sat", "on"]:
        assert sum(gain.get((u, w), 0.0) + back[u] * p for w, p in own.items()) + back[u] * model.unseen == pytest.approx(1.0)
    # "the" comes after the start twice and after "on" twice: two different words before it, of all kinds of pairs.
    kinds = {p for t in texts for w in [[x for x in t.split() if len(x) > 1 and x.isalpha()]] for p in zip(["", *w], w)}
    assert own["the"] == pytest.approx((2 - 0.75 + 0.75 * len(own) / (len(own) + 1)) / len(kinds))


def test_scorers_are_slots(spark):
    """Below five tokens 1000; 1,024 tokens count; all ways of looking up agree; a scorer's perplexity enters the score."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(30)) for _ in range(10)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    long = " ".join(["aa bb"] * 700)
    rows = [("f", 0, "e", texts[0]), ("f", 1, "g", "zz yy xx ww vv"), ("g", 0, "e", "aa bb cc dd"), ("h", 0, "e", long), ("i", 0, "e", long + " zz" * 500), ("j", 0, "e", "")]
    df = spark.createDataFrame(rows, "file string, engine_ord int, engine string, text string")
    by = [{(r["file"], r["engine_ord"]): r["perplexity"] for r in scorer.Bigrams(most=most).fit(docs).perplexity(df).collect()} for most in (1000, 4, 1)]
    assert by[0] == pytest.approx(by[1]) and by[0] == pytest.approx(by[2])
    assert by[0]["g", 0] == by[0]["j", 0] == 1000.0 and by[0]["f", 1] > by[0]["f", 0]
    assert by[0]["h", 0] == pytest.approx(by[0]["i", 0]) and len(by[0]) == 6
    lexicon = spark.createDataFrame([("aa", 5), ("bb", 5), ("cc", 2)], "word string, n long")
    scored = route.quality_scores(df, lexicon, perplexities=scorer.Bigrams().fit(docs).perplexity(df)).where("file = 'f' and engine_ord = 0").first()
    assert scored["score"] == pytest.approx(scored["coverage"] / math.log1p(by[0]["f", 0]))


def lines_by_hand(rows):
    """The rules for lines of a profile, in loops: smoothed values, candidates, lines (a, p, b)."""
    n = len(rows)
    at = lambda y: rows[y] if 0 <= y < n else 0.0
    sm = [(at(y - 1) + at(y) + at(y + 1)) / len(rows[max(0, y - 1) : y + 2]) for y in range(n)]  # not sum(), which rounds otherwise
    tops = [y for y in range(2, n - 2) if sm[y - 1] < sm[y] >= sm[y + 1] and sm[y] > 0.01]
    thin = []
    for y in tops:
        if not thin or y - thin[-1] >= 6:
            thin.append(y)
        elif sm[y] > sm[thin[-1]]:
            thin[-1] = y
    merged = []
    for y in thin:
        if not merged or min(sm[merged[-1] : y + 1]) <= 0.5 * min(sm[merged[-1]], sm[y]):
            merged.append(y)
        elif sm[y] > sm[merged[-1]]:
            merged[-1] = y

    def middle_of_lowest(low, high):
        places = [y for y in range(low, high + 1) if sm[y] <= min(sm[low : high + 1]) + 1e-9]
        return places[len(places) // 2]

    bounds = [max(0, merged[0] - 80), *merged, min(n - 1, merged[-1] + 80)] if merged else []
    every = [(middle_of_lowest(bounds[k], p), p, middle_of_lowest(p, bounds[k + 2])) for k, p in enumerate(merged)]
    wide = [x for x in every if 3 <= x[1] - x[0] <= 80 and 3 <= x[2] - x[1] <= 80]
    return sm, len(wide), [x for x in wide if max(sm[x[0]], sm[x[2]]) <= 0.5 * sm[x[1]]]


def shares_by_hand(sm, lines):
    for a, p, b in lines:
        half = 0.5 * sm[p]
        top = max([y for y in range(a, p + 1) if sm[y] < half], default=a)
        bottom = min([y for y in range(p, b + 1) if sm[y] < half], default=b)
        above, below = sum(sm[a:top]), sum(sm[bottom + 1 : b + 1])
        if above + below > 0:
            yield above / (above + below)


def test_lines_of_profiles(spark):
    """Plateaus, twin maxima, crowded and bare profiles of many lengths: the same lines and shares as the loops find."""
    rng = random.Random(8)
    profiles = [[], [0.5], [0.2, 0.9, 0.2, 0.1], [0.0] * 40]
    for _ in range(60):
        period, noise = rng.choice([5, 8, 13, 30, 120]), rng.choice([0.0, 0.02, 0.2])
        bell = [math.exp(-(((k - period / 2) / (period / 5)) ** 2)) for k in range(period)]
        plateau = [min(0.6, v) for v in bell] if rng.random() < 0.5 else bell
        profiles.append([round(min(1.0, max(0.0, plateau[(y * (1 + y // 200)) % period] + rng.uniform(-noise, noise))) * 255) / 255 for y in range(rng.randint(5, 400))])
    df = spark.createDataFrame(list(enumerate(profiles)), "image long, rows array<double>")
    found = df.select("image", orientation.text_lines(F.col("rows")).alias("f")).select("image", "f", orientation.shares_above(F.col("f")).alias("s")).collect()
    total = 0
    for r in found:
        sm, candidates, lines = lines_by_hand(profiles[r["image"]])
        assert r["f"]["sm"] == pytest.approx(sm) and r["f"]["candidates"] == candidates
        assert [tuple(x) for x in r["f"]["lines"]] == lines
        assert r["s"] == pytest.approx(list(shares_by_hand(sm, lines)))
        total += len(lines)
    assert total > 200


def test_up_share_needs_lines_and_trust(spark):
    bell = [0.0, 0.0, 0.15, 0.3, 0.9, 1.0, 0.9, 0.1, 0.0, 0.0]
    rows = [("page", 0, bell * 4), ("page", 1, bell * 4), ("turned", 0, bell[::-1] * 8), ("few", 0, bell * 3), ("bare", 0, [0.0] * 90)]
    got = {r["image"]: r for r in orientation.up_shares(spark.createDataFrame(rows, "image string, strip int, rows array<double>")).collect()}
    assert got["page"]["share"] > 0.55 and got["turned"]["share"] == pytest.approx(1 - got["page"]["share"], abs=0.05)
    assert got["few"]["share"] is None and got["few"]["found"] == 3 and got["bare"]["share"] is None and got["bare"]["seen"] == 0


def test_line_direction_of_pixels(spark):
    """Stripes across vote above 0, the same page on its side below 0; a page of one tone and a blank one have no vote."""
    pixels = lambda name, f, w=36, h=36: [(name, x, y, float(f(x, y))) for x in range(w) for y in range(h)]
    rows = pixels("across", lambda x, y: 120 * (y % 3 == 0) + x % 2) + pixels("down", lambda x, y: 120 * (x % 3 == 0) + y % 2)
    rows += pixels("tone", lambda x, y: 60) + pixels("blank", lambda x, y: 0)
    got = {r["image"]: (r["vote"], r["blocks"]) for r in orientation.line_direction(spark.createDataFrame(rows, "image string, x long, y long, v double")).collect()}
    assert got["across"][0] > 1 and got["across"][1] == 144 and got["down"] == (pytest.approx(-got["across"][0]), 144)
    assert got["tone"] == got["blank"] == (0.0, 0)
    block = [r for r in rows if r[0] == "across" and r[1] < 3 and r[2] < 3]
    level = lambda key, k: math.floor(sum(r[3] for r in block if r[key] == k) / 3 + 0.5) / 255
    one = orientation.blocks(spark.createDataFrame(rows, "image string, x long, y long, v double")).where("image = 'across' and block = 0").first()
    assert one["var_row"] == pytest.approx(np.var([level(2, k) for k in range(3)])) and one["var_col"] == pytest.approx(np.var([level(1, k) for k in range(3)]))


def test_layout_comparison_counts_a_register_once(spark):
    """Two registers of one and three pages; the way that reads both columns in turn is best, and means are of registers."""
    one = columns(4)
    rows = [(f"{r}:{k}", i, *s) for r, k in (("a", 0), ("b", 0), ("b", 1), ("b", 2)) for i, s in enumerate(one if r == "b" else [span("alone", 10, 40), span("below", 10, 60)])]
    spans = spark.createDataFrame(rows, "page string, ord long, text string, l double, t double, r double, b double")
    words = " ".join(f"{c}{i}" for c in "LR" for i in range(4))
    expected = spark.createDataFrame([("a:0", "alone below"), *[(f"b:{k}", words) for k in range(3)]], "page string, expected string")
    registers_ = spark.createDataFrame([("a:0", "a"), *[(f"b:{k}", "b") for k in range(3)]], "page string, register string")
    got = {(r["register"], r["strategy"]): r for r in study.layout_comparison(spans, expected, registers_).collect()}
    assert len(got) == 15 and all(r["wrd"] == 1.0 for r in got.values())
    assert got["b", "gutter"]["chr"] == got["b", "xy-cut"]["chr"] == got["b", "shipped"]["chr"] == 1.0 > got["b", "detector"]["chr"]
    assert {got["a", s]["chr"] for s in study.STRATEGIES} == {1.0}
    mean = got["MEAN OVER REGISTERS", "lines"]
    assert mean["chr"] == pytest.approx((got["a", "lines"]["chr"] + got["b", "lines"]["chr"]) / 2) and mean["pages"] == 4


def test_shipped_text_rejoins_words(spark):
    order = spark.createDataFrame([("p", 0, 0, 0, "exam-"), ("p", 0, 1, 1, "ple"), ("p", 0, 1, 2, "text")], "page string, region int, line int, pos int, text string")
    assert layout.page_transcripts(order).first()["text"] == "example text"


def test_merged_table_keeps_what_was_not_measured(spark):
    table = spark.createDataFrame([("f", "0.5000", "N/A", "1.00", "0.1000", "0.2000", "3.00"), ("Average", "0.4999", "N/A", "9.00", "0.7777", "0.2000", "3.00")], "fixture string, a_chr string, a_wrd string, a_sec string, z_chr string, z_wrd string, z_sec string")
    fresh = spark.createDataFrame([("f", 0.25, None, 2.0)], "fixture string, chr double, wrd double, sec double")
    out = {r["fixture"]: r.asDict() for r in evaluate.merged_wide(table, fresh, "a", ["z", "a"]).collect()}
    assert list(out["f"])[1:4] == ["z_chr", "z_wrd", "z_sec"] and out["f"]["a_chr"] == "0.2500" and out["f"]["a_wrd"] == "N/A"
    assert out["Average"]["z_chr"] == "0.7777" and out["Average"]["a_chr"] == "0.2500" and out["Average"]["a_sec"] == "2.00"
    with pytest.raises(ValueError):
        evaluate.merged_wide(table, fresh.replace("f", "g"), "a", [])


def test_turned_four_times_is_as_before(spark):
    pixels = spark.createDataFrame([("p", x, y, float(10 * x + y)) for x in range(3) for y in range(2)], "image string, x long, y long, v double")
    quarter = spark.createDataFrame([("p", 90)], "image string, turn int")
    once = orientation.turned(pixels, quarter)
    # The left edge of a picture is its upper edge after a quarter turn clockwise.
    assert {(r["x"], r["y"]): r["v"] for r in once.collect()} == {(1, 0): 0.0, (0, 0): 1.0, (1, 1): 10.0, (0, 1): 11.0, (1, 2): 20.0, (0, 2): 21.0}
    back = orientation.turned(orientation.turned(once, spark.createDataFrame([("p", 180)], quarter.schema)), spark.createDataFrame([("p", -270)], quarter.schema))
    assert sorted(back.select("image", "x", "y", "v").collect()) == sorted(pixels.collect())


def test_empty_queue_and_order_of_ties(spark):
    none = spark.createDataFrame([], "stem string, file string, best_engine string, best_score double, reason string")
    assert [r["line"] for r in triage.described(none, "t").collect()] == ["The triage queue is empty (t)."]
    scores = spark.createDataFrame([("r", e, 0.5) for e in "abc"], "register string, engine string, chr double")
    by = lambda *order: registers.leaders(scores, "chr", list(order) or None).first()["leader"]
    assert (by(), by("c", "b"), by("x")) == ("a", "c", "a")


def test_views_show_and_mark(spark):
    from leafloom.operators import views

    rows = [("x", "a", 0.5, 0.25), ("x", "b", 0.5, 0.75), ("mean", "a", 0.5, 0.25), ("mean", "b", 0.25, 0.75)]
    scores = spark.createDataFrame(rows, "register string, engine string, chr double, wrd double")
    assert [tuple(r) for r in views.register_summary(scores).collect()] == [("b", "0.250", "0.750", False, True, 1), ("a", "0.500", "0.250", True, False, 1)]
    assert {tuple(r) for r in views.register_cells(scores, "chr").collect()} == {("x", "a", "0.500", True), ("x", "b", "0.500", True), ("mean", "a", "0.500", True), ("mean", "b", "0.250", False)}
    with pytest.raises(ValueError):
        views.register_summary(scores.where("register = 'x'"))
    with pytest.raises(ValueError):
        views.register_cells(scores, "sec")
    rows = [("f", "far", 0.9, 0.9, 1.0), ("f", "near", 0.5, 0.5, 2.0), ("f", "blind", None, None, None), ("Average", "near", 0.5, 0.5, 2.0)]
    bench = spark.createDataFrame(rows, "fixture string, backend string, chr double, wrd double, sec double")
    assert {tuple(r) for r in views.benchmark_cells(bench, ["far"]).collect()} == {("f", "far", "0.90/0.90", False), ("f", "near", "0.50/0.50", True), ("f", "blind", "N/A", False), ("Average", "near", "0.50/0.50", False)}
    assert {tuple(r)[:3] for r in views.benchmark_cells(bench, [], "sec").collect()} == {("f", "far", "1.0"), ("f", "near", "2.0"), ("f", "blind", "—"), ("Total seconds", "near", "2.0")}
    rows = [("p", "e", "multi-column", "engine", 0.5, 1.0), ("p", "e", "multi-column", "column", 1.0, 1.0), ("mean", "e", "multi-column", "engine", 0.5, 1.0), ("mean", "e", "single-column", "engine", 0.7, 1.0), ("mean", "e", "multi-column", "column", 1.0, 1.0)]
    study_rows = spark.createDataFrame(rows, "fixture string, backend string, layout string, strategy string, chr double, wrd double")
    assert {tuple(r) for r in views.reading_order_cells(study_rows).collect()} == {("e", "engine", "0.500", False), ("e", "column", "1.000", True)}
    assert {r["row"] for r in views.reading_order_cells(study_rows, "chr", "e").collect()} == {"p", "mean, multi-column", "mean, single-column"}
    with pytest.raises(ValueError):
        views.reading_order_cells(study_rows, "chr", "none")


def test_scores_do_not_depend_on_how_words_are_looked_up(spark):
    """A lexicon that is too large to be broadcast is asked by blocks, with the same scores to the last bit; no tokens are
    sorted, neither for the scores nor for the perplexity."""
    rows = [(f, e, "x", " ".join(f"w{chr(97 + (f * e + i) % 26)}{chr(97 + i % 7)}" for i in range(40))) for f in range(6) for e in range(3)]
    df = spark.createDataFrame([*rows, (9, 0, "x", "")], "file long, engine_ord int, engine string, text string")
    lexicon = df.where("file < 4").selectExpr("explode(split(text, ' ')) AS word").groupBy("word").agg(F.count("*").alias("n"))
    few, many = (route.quality_scores(df, lexicon, most=most) for most in (10_000, 3))
    assert sorted(few.collect()) == sorted(many.collect())
    own, blocks = route.in_blocks(df, "file")
    assert sorted(route.quality_scores(own, lexicon, blocks=blocks, most=3).collect()) == sorted(few.collect())
    plans_ = [p._jdf.queryExecution().executedPlan().toString() for p in (few, many, scorer.Bigrams(most=3).fit(df).perplexity(df))]
    assert not any("SortAggregate" in p or "SortMergeJoin [block" in p for p in plans_)


def test_sweeps_of_parts_are_never_broadcast(spark, sf_dir):
    """Cells are dealt with their part and joined by hash: neither they nor the parts pass through the driver."""
    from leafloom import plans
    from leafloom.plans import study_queries

    frames = {name: plans.QUERIES[name](spark, sf_dir) for name in ("p12_cell_costs", "m2_missing_cells")}
    cells, features = study_queries._brands(spark, sf_dir)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in text(frames["p12_cell_costs"]) + text(frames["m2_missing_cells"]) + text(features)
    assert text(cells).count("p_brand") > 0 and "BroadcastHashJoin" not in text(cells)
    assert text(frames["p12_cell_costs"]).count("Exchange hashpartitioning") <= 2
    assert calibrate.best_cells(views_sweep(spark, sf_dir)).count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def views_sweep(spark, sf_dir):
    from leafloom.plans import views

    cells = views.sweep(views.read(spark, sf_dir, "part"))
    assert cells.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    return cells


def test_pages_in_rows_are_not_shuffled(spark, sf_dir):
    """Pages made in the document's row are ordered and scored there, and are those of the spans, a row each."""
    from leafloom.plans import table_queries

    rows = table_queries.page_rows(spark, sf_dir)
    scores = study.serialisation_scores(rows.where("size(spans) < 20").withColumn("expected", F.lit("a")))
    assert "hashpartitioning(page" not in scores._jdf.queryExecution().executedPlan().toString()
    spans = table_queries.page_spans(spark, sf_dir)
    assert layout.paged(spans).exceptAll(rows).isEmpty() and rows.exceptAll(layout.paged(spans)).isEmpty()
    some = layout.unpaged(rows.where("page like '1%'"))
    assert study.shipped_text(some).exceptAll(layout.page_transcripts(layout.reading_order(some))).isEmpty()


def test_zip_is_dealt_by_document_in_parts_of_bounded_size(spark, sf_dir):
    from leafloom import plans

    plan = plans.QUERIES["j9_positional_zip"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2


def test_line_items_stay_in_parts_of_a_bounded_size(spark, sf_dir, monkeypatch):
    """More rows make more parts, not larger ones, and what follows needs no second shuffle."""
    from leafloom.plans import QUERIES, table_queries

    monkeypatch.setattr(table_queries, "LINES", 500)
    for name, shuffles in (("s9_wide_to_long", 1), ("w7_interior_gutters", 1), ("w8_moving_average", 1), ("a17_grey_statistics", 1)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == shuffles, name
    parts = evaluate.wide(table_queries._long(spark, sf_dir), ["A"]).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 500


def test_merge_refuses_fixtures_of_one_side(spark):
    rows = lambda *names: spark.createDataFrame([(n, "A", 0.5, 0.5, 1.0) for n in names], "fixture string, backend string, chr double, wrd double, sec double")
    assert evaluate.merged(rows("a", "a", None), rows(None, "a")).count() == 2
    for odd in (rows("a", "b"), rows("a", None)):
        with pytest.raises(ValueError, match="the fixtures differ"):
            evaluate.merged(odd, rows("a"))
        with pytest.raises(ValueError, match="the fixtures differ"):
            evaluate.merged(rows("a"), odd)


def test_pixels_are_not_moved_once_their_document_is_dealt(spark, sf_dir, monkeypatch):
    """One shuffle, that of the documents' texts; no pixel is sorted or joined by sorting."""
    from leafloom.plans import QUERIES, table_queries

    monkeypatch.setattr(table_queries, "PAGES", 20)
    for name, shuffles in (("g14_line_direction", 2), ("g16_up_share", 2), ("g19_turned", 3)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and plan.count("REPARTITION_BY_NUM") == 2, name
        assert "SortMergeJoin" not in plan and "Expand" not in plan


def test_gutters_come_from_one_grouping(spark, sf_dir):
    from leafloom.plans import QUERIES

    plan = QUERIES["g1_gutters"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    boxes = [(p, float(x), x + 40.0) for p, n in (("a", 4), ("b", 3), ("c", 40)) for i in range(n) for x in (10 + 100 * (i % 2),)] + [("d", None, None), ("a", None, None)]
    found = {r["page"]: r["gutter"] for r in layout.gutters(spark.createDataFrame(boxes, "page string, l double, r double")).collect()}
    assert found == {"a": 52.0, "b": None, "c": 52.0, "d": None}


def test_strip_profiles_fill_rows_without_pixels(spark):
    pixels = spark.createDataFrame([(1, x, y, 255.0) for y in (1, 4) for x in range(16)] + [(1, 0, 6, 255.0)], "image long, x long, y long, v double")
    rows = {r["strip"]: r["rows"] for r in orientation.strip_profiles(pixels, 2).collect()}
    assert rows == {0: [0, 1, 0, 0, 1, 0, 1], 1: [0, 1, 0, 0, 1, 0, 0]}


def test_recalls_count_by_hash_in_the_documents_part(spark, sf_dir, monkeypatch):
    from leafloom.functions import text as T
    from leafloom.plans import QUERIES, text_queries

    rows = [(1, "a b a c", "A b"), (2, "", "x"), (3, "a b", ""), (4, "x y x", None), (5, "é é B", "É  b b")]
    df = spark.createDataFrame(rows, "k long, expected string, text string").withColumn("wanted", T.wanted_words(F.col("expected")))
    found = {r["k"]: r["recall"] for r in evaluate.recalls(df.where("text is not null"), ["k"]).collect()}
    assert found == {1: 0.75, 2: 1.0, 3: 0.0, 5: 1.0}
    monkeypatch.setattr(text_queries, "PAGES", 20)
    for name, shuffles in (("t4_word_recall", 1), ("q3_evaluate", 2)):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and "array_sort" not in plan and "sort_array" not in plan, name
    assert text_queries.recalls(spark, sf_dir).rdd.getNumPartitions() >= 10


@pytest.fixture
def spilled(spark):
    """40 texts, a lexicon of their words, and three transcripts of the same words each, while sums are spilled every 137 rows."""
    pick = random.Random(14)
    words = ["".join(pick.choices("abcdefgh", k=5)) for _ in range(400)]
    texts = [" ".join(pick.choices(words, weights=range(1, 401), k=200)) for _ in range(40)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    lexicon = docs.select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rows = [(str(i), o, e, x) for i, t in enumerate(texts) for o, e, x in ((0, "full", t), (1, "lower", t), (2, "turned", " ".join(t.split(" ")[::-1])))]
    df = spark.createDataFrame(rows, "file string, engine_ord int, engine string, text string").coalesce(1)
    spark.conf.set("spark.sql.TungstenAggregate.testFallbackStartsAt", "0,137")
    yield docs, lexicon, df
    spark.conf.unset("spark.sql.TungstenAggregate.testFallbackStartsAt")


def test_equal_texts_tie_when_they_are_summed_in_parts(spilled):
    """a task that runs short of memory spills its sums, so that a text is added in two or more parts."""
    docs, lexicon, df = spilled
    scored = route.quality_scores(df, lexicon)
    by_model = scorer.Bigrams().fit(docs).perplexity(df.where("engine <> 'turned'"))
    assert [f.groupBy("file").agg(F.count_distinct("perplexity").alias("n")).where("n > 1").count() for f in (scored, by_model)] == [0, 0]
    assert [r["engine"] for r in route.routed(scored).collect()] == ["full"] * 40


def test_batch_takes_the_first_of_equal_texts_when_sums_are_spilled(spilled):
    """F15."""
    _, lexicon, df = spilled
    files = df.select("file", F.concat(F.lit("p/"), "file", F.lit(".png")).alias("path"), *[F.lit(n).alias(c) for c, n in (("width", 9), ("height", 9), ("pages", 1))]).distinct()
    rows = batch.processed(files, route.quality_scores(df.where("engine <> 'turned'"), lexicon)).collect()
    assert [(r["engine"], r["status"] in ("processed", "triage")) for r in rows] == [("full", True)] * 40


def test_exact_mean_does_not_depend_on_the_order(spark):
    values = [math.log(i / 7919) for i in random.Random(3).choices(range(1, 7919), k=1024)] + [-745.0, 0.0, 1e-17]
    by = [spark.createDataFrame([(v,) for v in vs] + [(None,)], "v double").coalesce(1).agg(rules.exact_mean(F.col("v"), 2048)).first()[0] for vs in (values, values[::-1], sorted(values))]
    assert len(set(by)) == 1 and math.isclose(by[0], math.fsum(values) / len(values), rel_tol=4e-16)
    assert spark.createDataFrame([(None,)], "v double").agg(rules.exact_mean(F.col("v"), 5)).first()[0] is None


def test_scores_take_no_row_a_token(spark):
    """F10 to F15: words, letters and tokens are told in numpy as the text functions tell them, and no token becomes a row."""
    from leafloom.functions import text as T
    from leafloom.operators import lookup

    pick = random.Random(5)
    letters = "aabbcXYZ  \t\n\x0b\x1c\x1f\x85\xa0  ​   　éßж漢\U0001f6001-'"
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 50))) for _ in range(300)] + ["", " ", "x" * 12 + " " + "x" * 13 + "Y" + "x" * 99, None]
    df = spark.createDataFrame([(i, 0, "e", t) for i, t in enumerate(texts)], "file long, engine_ord int, engine string, text string")
    text = F.col("text")
    told = df.select("file", T.word_count(text), T.scores_english_text(text), T.dictionary_tokens(text)).collect()
    words = lookup.lexicon(df.where("file % 3 > 0"))
    lexicon = df.where("file % 3 > 0").select(F.explode(T.dictionary_tokens(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, lookup.coded(lexicon).collect())) == sorted((r["code"], r["n"]) for r in words.collect())
    assert lookup.coded(spark.createDataFrame([("Ab", 1), ("a1", 2), ("a", 3), ("ab", 4)], "word string, n int")).where("code is not null").count() == 1
    known = {r["word"] for r in lexicon.collect()}
    scored = route.quality_scores(df, words)
    found = {r["file"]: tuple(r)[3:7] for r in scored.collect()}
    assert found == {f: (n, e, None if t is None else len(t), len(set(t or []) - known)) for f, n, e, t in told}
    assert "Generate" not in scored._jdf.queryExecution().executedPlan().toString()
    assert route.in_blocks(df, "file", 1000, "text")[1] == spark.sparkContext.defaultParallelism


def test_pages_are_told_in_their_row(spark):
    """F3, F4, F16: all ways of telling a page come from its row, as the expressions over spans make them; nothing is joined, and
    no page's words are held as objects with a whole batch of others."""
    pick = random.Random(4)
    rows = []
    for page in range(40):
        for i in range(pick.randint(1, 30)):
            l, t = pick.choice([None, 10.0, 120.0, 60.0]), pick.choice([10.0, 22.0, 23.0, 40.0, 60.0])  # noqa: E741
            box = (None, None, None, None) if l is None else (l, t, l + pick.choice([30.0, 90.0, 160.0]), t + pick.choice([8.0, 10.0, 0.0]))
            rows.append((str(page), i, pick.choice(["a-", "b", "\u00e9x", None, "c"]), *box))
    spans = spark.createDataFrame(rows, "page string, ord long, text string, l double, t double, r double, b double")
    found = {(r["page"], r["strategy"]): r["text"] for r in layout.told(spans, layout.WAYS).collect()}
    assert len(found) == 40 * len(layout.WAYS)
    by = layout.single_gutter_order(spans).groupBy("page", "region", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("w"))
    by = by.select("page", "region", "line", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text")).collect()
    order = layout.reading_order(spans).orderBy("page", "pos").collect()
    for page in map(str, range(40)):
        own = [r[2] for r in rows if r[0] == page]
        assert found[page, "engine"] == "\n".join(w for w in own if w is not None)
        assert found[page, "column"] == " ".join(r["text"] for r in order if r["page"] == page and r["text"] is not None)
        assert found[page, "gutter"] == "\n".join(r["text"] for r in sorted(by, key=lambda r: (r["region"], r["line"])) if r["page"] == page)
    shipped = {r["page"]: r["text"] for r in layout.page_transcripts(layout.reading_order(spans)).collect()}
    assert shipped == {p: t for (p, way), t in found.items() if way == "shipped"}
    pages = layout.paged(spans.na.fill("x")).withColumns({"expected": F.lit("a b"), "register": F.lit("r")})
    plan = study.layout_comparison(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == plan.count("ArrowEvalPython") > 0


def test_turned_pages_of_odd_documents_are_as_in_sql(spark, tmp_path):
    """a repeated id, an empty and a null text, no id."""
    from oracle import assert_same

    from leafloom import plans

    rows = [(1, "ab\nc" * 30), (1, "xyz"), (1, "xyz"), (2, ""), (3, None), (None, "ab"), (5, ""), (5, "e\u0301\u6f22\U0001f600 q"), (-3, "abc" * 40), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("g19_turned", "g14_line_direction"):
        assert_same(plans.QUERIES[name](spark, str(tmp_path)).toPandas(), plans.SQL[name], str(tmp_path))
