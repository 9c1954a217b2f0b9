"""Operator 3, MinHash near-deduplication by a signature-coordinate inverted join.

Documents with the same shingle set form a class; one of each stands for it. A representative is
posted under its (coordinate, value) pairs. Two sets that agree in at least `matches` of the
`coordinates` must share one of the first coordinates - matches + 1, the prefix: only those lists
are joined, shortest first, and the collisions in the others are counted from the two signatures
(skip merging).
Pairs with enough collisions are confirmed on the full shingle sets of their texts.

Inside a list, pairs are not all made. Members are first compared with one hub; linked members
become one component, and only members of different components need to be compared further, with
new hubs while that saves work, and then with each other, block by block. So no link between components is
missed that the signatures show, whatever the size of a list. The rows of a long list are dealt over
several tasks wherever lists are joined.

Cases. Null, empty or wordless texts: empty set, linked with nothing, own component. Repeated rows
of a doc_id share its component; each row is returned, and each of their texts can link. Null doc_id:
own component, null. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm.common import Scratch, batches_of, salted_join, small_batches, table, text_slices, unbroadcast
from leafloom.llm.components import components

#: Coordinates that are posted, and all that a signature has.
COORDINATES, LENGTH = 32, 96
#: Signatures of a list are compared in blocks of so many; pairs are confirmed on the texts of twice TILE documents at most.
BLOCK, TILE = 2048, 512
#: Documents that share a smallest partner are sent on in groups of so many.
GROUP = 32

MULTIPLIERS = (np.random.default_rng(3).integers(1, 1 << 63, LENGTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def least_matches(coordinates: int, percent: int) -> int:
    """So few collisions that a pair of that similarity has fewer with probability about 1e-8 (6 deviations)."""
    p = percent / 100
    return max(1, int(coordinates * p - 6.1 * (coordinates * p * (1 - p)) ** 0.5 + 1))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of all words of the texts, one text after the other, and the number of words of each."""
    found = [(t or "").encode() for t in texts]
    found = [(b.lower() if lower else b).split() for b in found]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    codes, words = pd.factorize(np.array([w for f in found for w in f], dtype=object))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=np.uint64).reshape(-1, 2)
    return hashes[codes, 0], hashes[codes, 1], sizes


def shingle_sets(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts, one text after the other, and how many each has."""
    hashes, _, sizes = word_hashes(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(hashes)
    runs = np.zeros(max(0, n - length + 1), dtype=np.uint64)
    for k in range(length):
        runs += hashes[k : k + len(runs)] * FACTORS[k]
    whole = doc[: len(runs)] == doc[length - 1 :] if len(runs) else np.zeros(0, bool)
    runs, owner = mixed(runs[whole]), doc[: len(runs)][whole]
    for i in np.flatnonzero((sizes > 0) & (sizes < length)):
        start = int(sizes[:i].sum())
        value = np.array([(hashes[start : start + sizes[i]] * FACTORS[: sizes[i]]).sum(dtype=np.uint64) + np.uint64(sizes[i])])
        runs, owner = np.append(runs, mixed(value)), np.append(owner, i)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[fresh], np.bincount(owner[fresh], minlength=len(sizes))


def packed(sig: np.ndarray) -> list[bytes]:
    """Posted coordinates whole, as they also tell which list two documents share first; 16 bits of the others."""
    return [a.tobytes() + b.tobytes() for a, b in zip(sig[:, :COORDINATES], sig[:, COORDINATES:].astype(np.uint16), strict=True)]


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1)
    cut = 4 * COORDINATES
    return np.ascontiguousarray(data[:, :cut]).view(np.int32), np.ascontiguousarray(data[:, cut:]).view(np.uint16)


def signature_rows(length: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in text_slices(pdf):
                sets, counts = shingle_sets(part["text"].tolist(), length)
                starts = np.cumsum(counts) - counts
                some = counts > 0
                sig = np.zeros((len(counts), LENGTH), dtype=np.int32)
                for j, m in enumerate(MULTIPLIERS):
                    if some.any():
                        values = mixed(sets * m) >> np.uint64(32)
                        sig[some, j] = np.minimum.reduceat(values, starts[some]).astype(np.uint32).view(np.int32)
                keys = [hashlib.sha256(sets[a : a + n].tobytes()).digest()[:16] for a, n in zip(starts, counts, strict=True)]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_shingles": counts, "set_key": keys, "sig": list(sig[:, :COORDINATES]), "all_sig": packed(sig)})

    return rows


def shared_counts(texts: list[str], length: int, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all intersections of the texts' shingle sets, as a matrix, and the sizes of the sets. A shingle of one
    text only is left out; the others are counted by a product of 0-1 matrices, some columns at a time."""
    sets, sizes = shingle_sets(texts, length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, column, times = np.unique(sets, return_inverse=True, return_counts=True)
    several = times > 1
    place = np.cumsum(several) - 1
    kept = several[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sizes), len(sizes)))
    for start in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sizes), columns), dtype=np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        shared += part @ part.T
    return shared, sizes


def confirmed(length: int, percent: int):
    """Rows of bounded lists of ids, texts and pairs of ids: the pairs of which two texts are similar enough on full sets."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for ids, texts, left, right in zip(pdf["ids"], pdf["texts"], pdf["a"], pdf["b"], strict=True):
                shared, n = shared_counts(list(texts), length)
                order = np.argsort(ids)
                begin, end = ([np.searchsorted(ids, v, side=side, sorter=order) for v in (left, right)] for side in ("left", "right"))
                linked = np.zeros(len(left), dtype=bool)
                # An id has as many places as texts, nearly always one.
                for i in range(int((end[0] - begin[0]).max())):
                    for j in range(int((end[1] - begin[1]).max())):
                        a, b = order[np.minimum(begin[0] + i, end[0] - 1)], order[np.minimum(begin[1] + j, end[1] - 1)]
                        linked |= 100 * shared[a, b] >= percent * (n[a] + n[b] - shared[a, b])
                found.append(pd.DataFrame({"a": left[linked], "b": right[linked]}))
            yield pd.concat(found) if found else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return rows


def collisions(least: int, percent: int):
    """Rows of two blocks of a list: as lists, the pairs of different components with enough collisions in all
    coordinates, each pair in the first list that both are posted under; a row for each pair of tiles of the blocks."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                posted, more = unpacked(row.sig)
                side, first = np.asarray(row.block) == row.y, np.asarray(row.block) == row.x
                ids, part, n, mask = (np.asarray(v) for v in (row.rep, row.c, row.n, row.mask))
                right = np.flatnonzero(side)
                left_at, right_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.flatnonzero(first).tolist():
                    other = right[(ids[right] > ids[i]) if row.x == row.y else slice(None)]
                    other = other[(part[other] != part[i]) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
                    equal = posted[other] == posted[i]
                    enough = equal.sum(axis=1) + (more[other] == more[i]).sum(axis=1) >= least
                    other, equal = other[enough], equal[enough]
                    both = equal & ((mask[other, None] & mask[i]) >> np.arange(COORDINATES) & 1).astype(bool)
                    other = other[both.argmax(axis=1) == row.j]
                    left_at.append(np.full(len(other), i))
                    right_at.append(other)
                at, to = np.concatenate(left_at), np.concatenate(right_at)
                tile = (at // TILE) * len(ids) + to // TILE
                order = np.argsort(tile, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
                    if len(own):
                        a, b = ids[at[own]].tolist(), ids[to[own]].tolist()
                        found.append((row.list, row.x, row.y, int(tile[own[0]]), sorted({*a, *b}), a, b))
            yield pd.DataFrame(found, columns=["list", "x", "y", "tile", "ids", "a", "b"])

    return rows


class Links:
    """The representatives and the links found so far."""

    def __init__(self, docs: DataFrame, reps: DataFrame, links: DataFrame, length: int, percent: int, scratch: Scratch):
        self.docs, self.reps, self.length, self.percent, self.scratch = docs, reps, length, percent, scratch
        self.found = scratch.written(links, "same-id")

    def compare(self, pairs: DataFrame, name: str) -> int:
        """Count collisions of pairs (a, b) in the posted coordinates and confirm those with enough."""
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one = lambda side: self.reps.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        both = pairs.join(one("a"), "a").join(one("b"), "b")
        low, high = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        near = both.where((100 * low >= self.percent * high) & (agree >= least_matches(COORDINATES, self.percent)))
        return self.confirm(self.scratch.written(near.select("a", "b").distinct(), f"{name}-near"), name)

    def compare_all(self, marked: DataFrame, masks: DataFrame) -> int:
        """Compare the members of different components of each list, block by block."""
        members = marked.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
        members = members.join(self.reps.select("rep", "n", "all_sig"), "rep").join(masks, "rep")
        members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = F.struct("rep", "c", "n", "mask", "block", F.col("all_sig").alias("sig"))
        keys = ["list", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")]
        blocks = dealt.groupBy(*keys).agg(F.collect_list(own).alias("own"))
        fields = [F.col(f"own.{f}").alias(f) for f in ("rep", "c", "n", "mask", "block", "sig")]
        blocks = blocks.select("list", F.shiftright("list", 32).cast("int").alias("j"), "x", "y", *fields)
        schema = "list long, x int, y int, tile long, ids array<long>, a array<long>, b array<long>"
        with batches_of(self.docs.sparkSession, 4):
            near = self.scratch.written(blocks.mapInPandas(collisions(least_matches(LENGTH, self.percent), self.percent), schema), "rest-near")
        if near.isEmpty():
            return 0
        held = near.select("list", "x", "y", "tile", F.explode("ids").alias("id"))
        texts = self.scratch.written(self.texts(held.select("id").distinct()), "rest-texts")
        sets = held.join(texts, "id").groupBy("list", "x", "y", "tile").agg(F.collect_list(F.struct("id", "text")).alias("t"))
        groups = near.drop("ids").join(sets, ["list", "x", "y", "tile"])
        return self.linked(groups.select(F.col("t.id").alias("ids"), F.col("t.text").alias("texts"), "a", "b"), "rest")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of every text of the ids. The ids grow with the documents, so they are never broadcast, at any size."""
        own = self.docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").join(ids.hint("merge"), "id")
        return own.groupBy("id").agg(F.collect_set("text").alias("t")).select("id", F.explode("t").alias("text"))

    def linked(self, groups: DataFrame, name: str) -> int:
        with batches_of(self.docs.sparkSession, 1):
            links = self.scratch.written(groups.mapInPandas(confirmed(self.length, self.percent), "a long, b long"), f"{name}-links")
        self.found = self.found.union(links)
        return links.count()

    def confirm(self, near: DataFrame, name: str) -> int:
        """Confirm pairs on full sets. Documents with the same smallest partner stand in blocks, so that a text is sent
        once for many pairs."""
        if near.isEmpty():
            return 0
        written = self.scratch.written
        ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("f")), F.struct(F.col("b").alias("id"), F.col("a").alias("f")))).alias("e"))
        ends = written(ends.groupBy("e.id").agg(F.min("e.f").alias("f")), f"{name}-ends")
        sizes = ends.groupBy("f").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
        blocks = salted_join(ends, sizes, "f", "id").select("id", F.xxhash64("f", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))
        blocks = written(blocks, f"{name}-blocks")
        pairs = near.join(blocks.select(F.col("id").alias("a"), F.col("block").alias("x")), "a").join(blocks.select(F.col("id").alias("b"), F.col("block").alias("y")), "b")
        pairs = written(pairs.select(F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("g"), "a", "b"), f"{name}-pairs")
        by_group = pairs.groupBy("g").agg(F.collect_list(F.struct("a", "b")).alias("p"))
        held = pairs.select("g", F.explode(F.array("a", "b")).alias("id")).distinct()
        groups = held.join(self.texts(ends.select("id")), "id").groupBy("g").agg(F.collect_list(F.struct("id", "text")).alias("t")).join(by_group, "g")
        split = [F.col("t.id").alias("ids"), F.col("t.text").alias("texts"), F.col("p.a").alias("a"), F.col("p.b").alias("b")]
        return self.linked(groups.select(*split), name)

    def labels(self) -> DataFrame:
        return self.scratch.written(components(self.found, self.scratch), "labels")


def prefix_posts(reps: DataFrame, matches: int, scratch: Scratch) -> DataFrame:
    """(list, rep, hub): each representative under the shortest of its lists that any partner must share.

    Lists are ordered by length for all documents alike, so that two signatures with enough collisions share one of
    the first coordinates - matches + 1 of each. The long lists of passages that many documents hold come last, and
    are only counted. Lists of one member are left out after that.
    """
    posts = reps.select("rep", F.posexplode("sig").alias("j", "value")).select(
        (F.col("j").cast("long") * F.lit(1 << 32) + F.col("value").cast("long").bitwiseAND(F.lit((1 << 32) - 1))).alias("list"), "rep"
    )
    lengths = posts.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
    common = salted_join(posts, lengths, "list", "rep", salts=4)
    own = common.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "list"))).alias("lists"))
    # The lists of one member, which are not here, come first and use up places of the prefix.
    places = F.lit(COORDINATES - matches + 1) - (F.lit(COORDINATES) - F.size("lists"))
    posted = own.where(places > 0).select("rep", F.explode(F.slice("lists", F.lit(1), places)).alias("l")).select("l.list", "rep")
    posted = scratch.written(posted, "posts")
    shared = posted.groupBy("list").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return scratch.written(salted_join(posted, shared.select("list", "hub"), "list", "rep"), "posts")


def near_components(docs: DataFrame, length: int = 3, percent: int = 85, most_hubs: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of `docs`. No side of a join is broadcast, as all grow with them."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    with unbroadcast(docs.sparkSession):
        signed, reps, labels = signed_and_labelled(docs, length, percent, most_hubs, scratch)
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = reps.select("set_key", "rep").join(labels.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    classes = classes.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    known = filled.select("doc_id", "n_shingles", "set_key").join(classes.hint("merge"), "set_key").select("doc_id", "n_shingles", "component_id")
    rest = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    scratch.drop(signed, reps, labels)
    return known.unionByName(rest)


def signed_and_labelled(docs: DataFrame, length: int, percent: int, most_hubs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures of the documents, their representatives, and the component of each representative that is linked."""
    written = scratch.written
    signed = docs.select("doc_id", "text").mapInPandas(
        signature_rows(length), "doc_id long, n_shingles long, set_key binary, sig array<int>, all_sig binary"
    )
    signed = written(signed, "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    reps = filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("all_sig").alias("all_sig"))
    reps = written(reps, "representatives")
    posts = prefix_posts(reps, least_matches(COORDINATES, percent), scratch)
    state = Links(docs, reps, same_id_links(filled, reps), length, percent, scratch)
    state.compare(posts.select(F.col("hub").alias("a"), F.col("rep").alias("b")), "hub")
    labels = state.labels()
    for k in range(most_hubs + 1):
        marked = posts.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("list", "rep", F.coalesce("component", "rep").alias("c"))
        sizes = marked.groupBy("list", "c").agg(F.count("*").alias("n")).groupBy("list")
        sizes = sizes.agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s"), F.count("*").alias("parts"))
        open_lists = written(sizes.where("parts > 1"), "open")
        left, members = open_lists.agg(F.sum((F.col("m") * F.col("m") - F.col("s")) / 2), F.sum("m")).first()
        if not left:
            break
        marked = written(salted_join(marked, open_lists.select("list", "m"), "list", "rep"), "marked")
        if k == most_hubs or left <= 50 * members:
            masks = posts.groupBy("rep").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(list, 32) as int))")).alias("mask"))
            if state.compare_all(marked, masks):
                labels = state.labels()
            break
        hubs = marked.groupBy("list").agg(F.max(F.struct("c", "rep")).alias("h")).select("list", F.col("h.c").alias("hc"), F.col("h.rep").alias("a"))
        if state.compare(salted_join(marked, hubs, "list", "rep").where("c <> hc").select("a", F.col("rep").alias("b")), f"hub{k}"):
            labels = state.labels()
    return signed, reps, labels


def same_id_links(filled: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b): representatives of the different sets of one doc_id."""
    sets = filled.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low < high")
    own = filled.select("doc_id", "set_key").join(sets.select("doc_id"), "doc_id").join(reps.select("set_key", "rep"), "set_key")
    first = own.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return own.join(first, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct()


def one_of_each(docs: DataFrame, length: int = 3, percent: int = 85) -> DataFrame:
    """The documents that are the smallest of their component; columns stay. Rows of null doc_id stay."""
    gone = near_components(docs, length, percent).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
"""
