"""Operators 11 to 13 against plain programs of the same rules, and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafloom.llm import common, fill_in_middle, queries, simhash_dedup, vector_codes

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, repeated rows, null ids, ties, a long text, sentinels, and extra columns with clashing names."""
    texts = [
        (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "One two  THREE four"), (5, "One two  THREE four"), (6, "one two three\nfour"), (7, "ñandú été ß 漢字😀 \x00 end"),
        (None, "one two three four"), (8, "lorem Ipsum, dolor sit " * 20_000), (9, "a" * 1000), (10, "has <M> in it"), (11, "<P"), (12, "S>"), (13, "<S>"), (14, "ab12 cd"), (5, "quite another text of the same id"),
    ]
    df = spark.createDataFrame(texts, DOCS)
    for c in ["output", "form", "n", "h1", "print", "key", "path", "large", "component", "salt", "least"]:
        df = df.withColumn(c, F.lit("x"))
    return df


# Operator 11


def print_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows, bits=3):
    """The smallest id reachable of each (id, print): over prints at most `bits` apart, and over equal ids."""
    kinds = sorted({p for _, p in rows})
    up = {p: p for p in kinds}

    def top(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, p in enumerate(kinds):
        for q in kinds[:i]:
            if bin(p ^ q).count("1") <= bits:
                up[top(p)] = top(q)
    first = {}
    for i, p in rows:
        if i is not None:
            up[top(p)] = top(first.setdefault(i, p))
    least = {}
    for i, p in rows:
        if i is not None:
            least[top(p)] = min(i, least.get(top(p), i))
    return [least.get(top(p)) for _, p in rows]


def test_op11_on_a_table(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").toPandas()
    got = queries.QUERIES["op11_simhash_near_dedup"](spark, sf_dir).toPandas().sort_values("doc_id")
    docs = docs.sort_values("doc_id")
    prints = [print_by_hand(t) for t in docs["text"]]
    assert got["fingerprint"].tolist() == [f"{p:016x}" for p in prints]
    assert got["component_id"].tolist() == components_by_hand(list(zip(docs["doc_id"].tolist(), prints)))


def test_op11_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    prints = [(i, print_by_hand(t)) for i, t in rows]
    want = sorted(map(str, zip([i for i, _ in prints], [p - (1 << 64) if p >> 63 else p for _, p in prints], components_by_hand(prints))))
    got = simhash_dedup.deduplicated(odd).collect()
    assert sorted(str((r["doc_id"], r["print"], r["component_id"])) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    # Wordless documents are linked; a row without id belongs to the documents it is like.
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[None]["component_id"] == 5 and by_id[6]["component_id"] == 5
    assert simhash_dedup.deduplicated(odd.limit(0)).count() == 0
    assert simhash_dedup.deduplicated(odd.where("doc_id is null")).first()["component_id"] is None


def linked(links, kinds):
    up = {k: k for k in kinds}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    return {k: top(k) for k in kinds}


@pytest.mark.parametrize("most", [16, 64])
def test_op11_refined_groups(spark, most):
    """A dense family (all fingerprints differ in the same 12 bits), chains and lone ones: the same components at every bound."""
    rng = random.Random(most)
    base = rng.getrandbits(64)
    places = rng.sample(range(64), 12)
    dense = {base ^ sum(1 << places[b] for b in range(12) if n >> b & 1) for n in rng.sample(range(1 << 12), 300)}
    chain, at = set(), rng.getrandbits(64)
    for _ in range(60):
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
        chain.add(at)
    kinds = sorted(p - (1 << 64) if p >> 63 else p for p in dense | chain | {rng.getrandbits(64) for _ in range(200)})
    pairs = [(a, b) for i, a in enumerate(kinds) for b in kinds[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    tables = simhash_dedup.print_links(spark.createDataFrame([(k,) for k in kinds], "print long"), 3, most, common.Scratch(spark))
    assert len(tables) > 2
    got = [(r["a"], r["b"]) for t in tables for r in t.collect()]
    assert linked(got, kinds) == linked(pairs, kinds)
    # A member has one link in each small group it lies in.
    assert len(got) <= sum(len(kinds) * 4 ** level for level in range(1, len(tables) + 1))


def test_op11_levels_end_in_small_groups():
    """Whatever path is taken, the bits that are not in common number log2(most) or fewer in the end."""
    masks = [0]
    for _ in range(6):
        own = simhash_dedup.refinements(masks[:1], 4)[0]
        assert all(m & masks[0] == masks[0] for m in own)
        full = masks[0]
        for m in own:
            full |= m
        assert full == (1 << 64) - 1
        masks = own
    assert 64 - bin(masks[0]).count("1") <= 12


# Operator 12


def cut_by_hand(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    parts = ["".join(u) for u in (units[:a], units[a:b], units[b:])]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return doc_id, len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def test_op12_odd_rows(spark, odd):
    got = fill_in_middle.transformed(odd)
    want = [cut_by_hand(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert got.where("doc_id in (10, 13)").select("form").distinct().first()[0] == "plain"
    assert fill_in_middle.transformed(odd.limit(0)).count() == 0


def test_op12_random_texts_and_round_trip(spark, monkeypatch):
    """Many texts in small kernel calls: marks and letters at the ends of neighbours do not run into each other."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "B", "z", " ", "é", "漢", "😀", "<", "P>", "S", ">", "\n", "<M", "0"]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t if i % 50 else None) for i, t in enumerate(texts)], DOCS)
    monkeypatch.setattr(fill_in_middle, "KERNEL_BYTES", 100)
    got = fill_in_middle.transformed(docs).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).toPandas().sort_values("doc_id")
    want = [cut_by_hand(i, t if i % 50 else None) for i, t in enumerate(texts)]
    assert got["output"].tolist() == [w[5] for w in want] and got["form"].tolist() == [w[2] for w in want]
    assert got["back"].tolist() == [t if i % 50 else "" for i, t in enumerate(texts)]
    assert {"plain", "psm", "spm"} == set(got["form"])


# Operator 13


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, list of Python integers, label). Codes, errors, label errors and codebooks in unbounded integers."""
    width = len(rows[0][1]) // parts
    starts = {}
    for i, v, _ in rows:
        if i is not None:
            starts[i] = min(v, starts.get(i, v))
    first = [starts[i] for i in sorted(starts)[:entries]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]

    def nearest(p, v):
        x = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(p, v)[1] for _, v, _ in rows]
            for e in range(len(books[p])):
                of = [v[p * width : (p + 1) * width] for (_, v, _), m in zip(rows, mine) if m == e]
                if of:
                    new = [sum(c) // len(of) for c in zip(*of)]
                    books[p] = [*books[p][:e], new, *books[p][e + 1 :]]
    coded = [[nearest(p, v) for p in range(parts)] for _, v, _ in rows]
    errors = [sum(d for d, _ in c) for c in coded]
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    top = (1 << 63) - 1
    return [(i, "".join(f"{e:02x}" for _, e in c), min(err, top), min(by_label[label], top), digest) for (i, _, label), c, err in zip(rows, coded, errors)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, key string").withColumn("vector", F.lit(1))


def got_codes(df, **args):
    cols = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(str, map(tuple, vector_codes.compressed(df, **args).select(*cols).collect())))


def test_op13_odd_rows(spark):
    """Broken and odd-length vectors go; repeated and null ids stay; ties go to the lower entry; floors go down."""
    rng = random.Random(3)
    good = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.001, 0.5, 2.25]) for _ in range(8)], rng.choice([0, 1, None])) for i in [7, 3, 3, None, 12, 5, 5, *range(20, 80)]]
    good.append((3, good[1][1], 0))
    broken = [(0, None, 1), (1, [float("nan")] * 8, 1), (2, [0.0] * 7 + [None], 1), (4, [float("inf")] + [0.0] * 7, 1), (6, [1.0] * 7, 1), (8, [], 1), (9, [1.0] * 12, 1)]
    df = vectors(spark, [(*r, "x", "y") for r in good + broken]).repartition(5)
    rows = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in good]
    assert got_codes(df, parts=4, entries=16) == sorted(map(str, codes_by_hand(rows, 4, 16)))
    assert got_codes(vectors(spark, []).repartition(2)) == []
    assert got_codes(vectors(spark, [(*r, "x", "y") for r in broken[:4]])) == []


def test_op13_large_components(spark):
    """Components whose squares pass 64 bits are done exactly; beyond 2 ** 54 they saturate, and so do errors."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e3, -2.5e6, 3e9, 1e12, 1e300, -1e300, 0.1]) for _ in range(8)], i % 2) for i in range(40)]
    whole = [(i, [max(min(int(np.floor(256 * x)) if abs(x) < 1e18 else (1 << 70) * (1 if x > 0 else -1), 1 << 62), -(1 << 62)) for x in v], label) for i, v, label in rows]
    assert got_codes(vectors(spark, [(*r, "x", "y") for r in rows]).repartition(3), parts=4, entries=8) == sorted(map(str, codes_by_hand(whole, 4, 8)))


def test_op13_partitions_do_not_matter(spark, sf_dir):
    df = common.table(spark, sf_dir, "embeddings")
    assert got_codes(df.repartition(7, "label")) == got_codes(df.coalesce(1)) != []
