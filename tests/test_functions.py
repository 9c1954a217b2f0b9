import difflib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafloom.functions import blocks, headers, outputs, rules
from leafloom.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  Ab  C\x1d", "ab c"), ("Եւ։", "և:"), ("a․b", "a.b"), ("", ""), ("\t\n", "")],
)
def test_normalise(spark, raw, want):
    assert one(spark, T.normalise(F.col("t")), t=raw) == want


def test_word_recall(spark):
    recall = T.word_recall(F.col("a"), F.col("e"))
    assert one(spark, recall, a="alpha beta", e="alpha beta gamma delta") == 0.5
    assert one(spark, recall, a="", e=" … --- ") == 1.0
    assert one(spark, recall, a="x", e="x x y") == pytest.approx(2 / 3)


def test_character_similarity_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""), ("same", "same")], "a string, b string")
    got = [r[0] for r in df.select(T.character_similarity("a", "b")).collect()]
    assert got == [0.25, 0.5, 1.0, 0.0, 1.0]


def test_long_repetition_is_not_junk(spark):
    phrase = "the quick brown fox jumps " * 40
    df = spark.createDataFrame([(phrase, phrase.replace("quick", "quack", 1))], "a string, b string")
    assert df.select(T.character_similarity("a", "b")).first()[0] > 0.99


def test_effective_score(spark):
    for score, words, most, want in [(0.42, 100, 100, 0.42), (0.42, 0, 100, 0.336), (0.3, 0, 0, 0.3)]:
        got = one(spark, rules.effective_score(F.col("s"), F.col("w"), F.col("m")), s=score, w=words, m=most)
        assert got == pytest.approx(want)


def test_band_bounds_are_exclusive(spark):
    bands = [(10.0, 1), (20.0, 2), (math.inf, 3)]
    assert [one(spark, rules.band(F.col("v"), bands), v=v) for v in (9.9, 10.0, 20.0, 1e9)] == [1, 2, 3, 3]


def test_dehyphenate_chains_and_stops(spark):
    lines = F.array(*map(F.lit, ["foo-", "bar-", "baz", "x -", "y", "z-", "", "w", "9-", "a"]))
    assert one(spark, T.dehyphenated(lines)) == ["foobarbaz", "x -", "y", "z-", "", "w", "9-", "a"]


def test_gate(spark):
    gate = rules.gate(F.col("s"), F.col("e"))
    assert [one(spark, gate, s=s, e=e) for s, e in ((0.0999, True), (0.10, True), (0.0, False))] == ["failed", "passed", "skipped"]


def test_english_share_counts_ascii_only(spark):
    share = T.scores_english_text(F.col("t"))
    assert [one(spark, share, t=t) for t in ("ab éé", "a éé", "123", "")] == [True, False, True, True]


def python_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def noisy_pairs(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        letters = rng.choice(["ab", "abc", "abcdefgh ", "aé漢😀 "])
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        other = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        yield other if k % 2 else "".join(c if rng.random() > 0.15 else rng.choice(letters) for c in b), b


def test_ratio_equals_the_quadratic_one(monkeypatch):
    """Many ties, chains of short blocks, other scripts; all pairs in one call and in many."""
    pairs = list(noisy_pairs(600, 1))
    want = [python_ratio(a, b) for a, b in pairs]
    assert blocks.ratios([a for a, _ in pairs], [b for _, b in pairs]) == want
    monkeypatch.setattr(blocks, "SLICE", 1)
    assert blocks.ratios([a for a, _ in pairs[:60]], [b for _, b in pairs[:60]]) == want[:60]
    assert blocks.ratios([None, "a", None], ["a", None, None]) == [None] * 3


def test_ratio_of_windows_that_only_share_their_hash(monkeypatch):
    """With hashes that say nothing every block found is compared as text, and the pair is scored again."""
    monkeypatch.setattr(blocks._Hashes, "windows", lambda self, at, size: np.zeros(len(at), np.uint64))
    pairs = list(noisy_pairs(40, 2))
    assert blocks.ratios([a for a, _ in pairs], [b for _, b in pairs]) == [python_ratio(a, b) for a, b in pairs]


def test_ratio_of_a_long_text():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(20_000))
    start = time.time()
    assert 0.85 < blocks.ratios([text.translate(str.maketrans("eao", "c0q"))], [text])[0] < 0.95
    assert time.time() - start < 20  # about 1.5 s alone


def long_text(words=20_000, seed=3):
    rng = random.Random(seed)
    kinds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return " ".join(rng.choice(kinds) for _ in range(words))


@pytest.mark.parametrize("change", ["garbled", "reversed"])
def test_ratio_looks_at_few_windows(monkeypatch, change):
    """Work, not time: windows hashed for each character of both sides. Halving in every round took 101 and 62 of them."""
    text = long_text()
    actual = text[::-1] if change == "reversed" else text.translate(str.maketrans("eao", "c0q"))
    hashed, windows = [], blocks._Hashes.windows
    monkeypatch.setattr(blocks._Hashes, "windows", lambda self, at, size: hashed.append(len(at)) or windows(self, at, size))
    blocks.ratios([actual], [text])
    assert sum(hashed) < 45 * (len(actual) + len(text))


def test_ratio_of_long_and_short_blocks_in_turn():
    """Blocks around the length at which the search changes, repeated ones and one-sided rests, against `difflib`."""
    rng = random.Random(9)
    parts = ["".join(rng.choice("abc") for _ in range(n)) for n in (1, 3, 5, 30, 63, 64, 65, 66, 130)]
    pairs = []
    for _ in range(40):
        b = "".join(rng.choice([*parts, "x", "yy"]) for _ in range(rng.randint(1, 14)))
        a = "".join(rng.choice([*parts, "z", ""]) for _ in range(rng.randint(1, 14)))
        pairs.append((a, b))
    assert blocks.ratios([a for a, _ in pairs], [b for _, b in pairs]) == [python_ratio(a, b) for a, b in pairs]


def test_scores_in_one_pass(spark):
    """Similarity and recall of one pass are those of the two functions, with blanks, marks alone, repeats and nulls."""
    rows = [("Ab c ab", "ab  AB x ."), ("", "a"), ("a", ""), ("a b", "- ."), ("x", "X"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, e string")
    a, e = F.col("a"), F.col("e")
    one_pass = df.select(T.scores_of(T.normalise(a), T.normalise(e), T.wanted_text(e)).alias("s")).select("s.*")
    want = df.select(T.character_similarity(T.normalise(a), T.normalise(e)), F.when(a.isNotNull(), T.word_recall(a, e)))
    got = [tuple(r) for r in one_pass.collect()]
    assert got[:5] == [tuple(r) for r in want.collect()][:5] and [g[1] for g in got[:5]] == [2 / 3, 0.0, 1.0, 1.0, 1.0]
    assert got[5:] == [(None, None)] * 2


def test_t3_on_whole_documents(spark, sf_dir):
    from leafloom import plans

    got = plans.QUERIES["t3_character_similarity"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1200").toPandas()
    assert got["file"].nunique() == 200 and len(got) == 1000
    norm = lambda t: " ".join(t.lower().replace("։", ":").replace("․", ".").replace("եւ", "և").split())
    by = {(r.file, r.engine): r.char_sim for r in got.itertuples()}
    for r in docs.head(25).itertuples():
        texts = {"half": r.text[: len(r.text) // 2], "garbled": r.text.translate(str.maketrans("eao", "c0q")), "reversed": "" if r.doc_id % 7 == 0 else r.text[::-1]}
        for engine, t in texts.items():
            a, b = norm(t), norm(r.text)
            assert by[r.doc_id, engine] == pytest.approx(python_ratio(a, b) if a and b else float(a == b), abs=1e-6)


def made_headers():
    """(name, bytes, format, width, height): each format in each byte order, with parts before the size, and cut short."""
    import struct

    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480)
    frame = lambda marker, w, h: bytes([255, marker]) + struct.pack(">HBHH", 17, 8, h, w) + b"\3"
    segment = lambda marker, n: bytes([255, marker]) + struct.pack(">H", n) + b"\xff\xc0" * ((n - 2) // 2)
    entry = lambda order, tag, kind, value: struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    tiff = lambda order, gap, entries: (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + gap) + b"\7" * gap + struct.pack(order + "H", len(entries)) + b"".join(entry(order, *e) for e in entries)
    return [
        ("png", png, "png", 640, 480), ("png cut", png[:20], "png", 640, None),
        ("jpeg", b"\xff\xd8" + segment(0xE0, 16) + segment(0xE1, 300) + b"\xff\xff" + frame(0xC2, 3000, 2000), "jpeg", 3000, 2000),
        ("jpeg tables first", b"\xff\xd8" + segment(0xDB, 66) + segment(0xC4, 30) + frame(0xC0, 65535, 1), "jpeg", 65535, 1),
        ("jpeg without frame", b"\xff\xd8" + segment(0xE0, 16), "jpeg", None, None),
        ("tiff little", tiff("<", 0, [(254, 4, 0), (256, 3, 77), (257, 4, 70_000)]), "tiff", 77, 70_000),
        ("tiff big", tiff(">", 10, [(256, 4, 123_456), (257, 3, 99), (258, 3, 8)]), "tiff", 123_456, 99),
        ("tiff without size", tiff("<", 0, [(258, 3, 8)]), "tiff", None, None), ("tiff cut", b"MM\0*\0\0\0\x08", "tiff", None, None),
        ("pdf", b"%PDF-1.7\n", "pdf", None, None), ("gif", b"GIF89a\x01\0\x01\0", None, None, None), ("postscript", b"%!PS-Adobe", None, None, None), ("empty", b"", None, None, None),
    ]


def test_headers_tell_format_and_size(spark):
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, *_ in made_headers()], "name string, content binary")
    size = headers.real_size(F.col("content"))
    plan = df.select("name", headers.real_format(F.col("content")).alias("format"), size["width"].alias("w"), size["height"].alias("h"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    assert {r["name"]: (r["format"], r["w"], r["h"]) for r in plan.collect()} == {n: (f, w, h) for n, _, f, w, h in made_headers()}


def test_a_false_name_is_refused(spark):
    rows = [(n, bytearray(b), s) for n, b, s in [("a", made_headers()[0][1], ".PNG"), ("b", made_headers()[0][1], ".jpg"), ("c", b"%!PS", ".png"), ("d", b"%PDF-1", ".pdf"), ("e", made_headers()[3][1], ".jpg"), ("f", b"\xff\xd8\xff\xd9", ".jpeg"), ("g", b"%PDF-1", ".bmp")]]
    df = spark.createDataFrame(rows, "name string, content binary, suffix string")
    got = {r["name"]: r["why"] for r in df.select("name", headers.refused(F.col("content"), F.col("suffix"), F.lit(1)).alias("why")).collect()}
    assert got == {"a": None, "b": "named .jpg but is png", "c": "not a JPEG, PNG, TIFF or PDF file", "d": None, "e": "side too long", "f": "no size in its header", "g": "named .bmp but is pdf"}


def test_numbers_print_and_round_at_ties_as_in_c(spark):
    random.seed(5)
    values = [0.25, 0.75, 0.15, 0.35, -0.25, -0.01, 2.5, 12345678.25, 12345678.75, 0.0, 0.05375, 0.03125, 0.05625, -7e-9]
    values += [random.randrange(0, 100_000) / 8 / 10 ** random.randrange(5) for _ in range(500)] + [random.random() * 10 ** random.randrange(-6, 9) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, None, math.inf]], "v double")
    made = df.select("v", *[outputs.printed(F.col("v"), p).alias(f"p{p}") for p in (1, 2, 3, 4)], outputs.rounded(F.col("v"), 4).alias("r")).collect()
    for row in made[:-2]:
        assert [row[f"p{p}"] for p in (1, 2, 3, 4)] == [f"{row['v']:.{p}f}" for p in (1, 2, 3, 4)]
    assert made[-1]["r"] == math.inf and made[-2]["r"] is None
    mean = (0.04 + 0.01 + 0.07 + 0.09 + 0.02 + 0.1 + 0.04 + 0.06) / 8  # 0.05375, or the double beside it
    nearest = lambda v: math.floor(v * 1e4 + 0.5) / 1e4
    assert one(spark, outputs.rounded(F.col("v"), 4), v=mean) == nearest(mean)
    below = 0.056249999999999994  # scaled, exactly 562.5
    assert below * 1e4 == 562.5 and one(spark, outputs.rounded(F.col("v"), 4), v=below) == 0.0563


def test_headers_are_read_once(spark, sf_dir):
    """The walk through a file's segments stands once in the plan, for its size and for what is refused by it."""
    from leafloom import plans

    df = plans.QUERIES["s18_real_format"](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    alone = spark.range(1).select(headers.refused(F.lit(b"\xff\xd8\xff\xc0"), F.lit(".jpg"), F.lit(1)).alias("why"))
    assert alone._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert alone.first()["why"] == "no size in its header"
