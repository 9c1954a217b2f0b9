"""Queries of the text, scoring and rule functions, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions import rules
from leafloom.functions import text as T
from leafloom.operators import evaluate, lookup, route, scorer
from leafloom.plans.views import LEXICON_SQL, candidates, candidates_sql, normalise_sql, read, spread, strip_sql, tokens_sql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, md5({normalise_sql('text')}) AS digest FROM documents")
def t1_normalise(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.normalise(F.col("text")).cast("binary")).alias("digest"))


@query(rf"SELECT doc_id, len(list_filter({tokens_sql('text')}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))) AS n_words FROM documents")
def t2_word_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(F.filter(T.tokens(F.col("text")), T.is_word)).cast("long").alias("n_words"))


@query()
def t3_character_similarity(spark, d):
    """Whole transcripts against whole documents; the document's text stands in the row of its transcripts."""
    docs = read(spark, d, "documents").withColumn("expected", T.normalise(F.col("text")))
    pairs = candidates(docs, also=["expected"])
    return pairs.select("file", "engine", F.round(T.character_similarity(T.normalise(F.col("text")), F.col("expected")), 6).alias("char_sim"))


#: Documents of one part, which become some 5,000 words each with their five transcripts.
PAGES = 500


def recalls(spark, d):
    """Recall of all transcripts. They come from the document's own row, so its words are prepared once; documents are dealt
    first, and the words of a transcript are counted where its document is."""
    docs = route.dealt(read(spark, d, "documents").select("doc_id", "text"), "doc_id", PAGES).withColumn("wanted", T.wanted_words(F.col("text")))
    return evaluate.recalls(candidates(docs, also=["wanted"], spread_out=False), ["file", "engine"])


_WANTED = rf"list_filter({tokens_sql(normalise_sql('e.text'))}, lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]'))"
_ACTUAL = f"list_distinct({tokens_sql(normalise_sql('c.text'))})"
_RECALL = (
    f"p AS (SELECT c.file, c.engine, {_WANTED} AS w, {_ACTUAL} AS h FROM c JOIN documents e ON e.doc_id = c.file), "
    "r AS (SELECT file, engine, CASE WHEN len(w) = 0 THEN 1.0 ELSE len(list_filter(w, lambda x: list_contains(h, x))) / len(w) END AS recall FROM p)"
)


@query(f"WITH c AS ({candidates_sql()}), {_RECALL} SELECT file, engine, round(recall, 6) AS recall FROM r")
def t4_word_recall(spark, d):
    return recalls(spark, d).select("file", "engine", F.round("recall", 6).alias("recall"))


@query(r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) = 0 THEN true ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 0.5 END AS english FROM documents")
def t5_english_share(spark, d):
    return read(spark, d, "documents").select("doc_id", T.scores_english_text(F.col("text")).alias("english"))


_TOKENS = "list_transform(list_filter(regexp_extract_all(text, '[a-zA-Z]+'), lambda w: length(w) >= 2), lambda w: lower(w))"
_SCORES = f"""
c AS ({candidates_sql()}), lex AS ({LEXICON_SQL}), tot AS (SELECT sum(n) AS total, count(*) AS size FROM lex),
tok AS (SELECT file, engine_ord, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT file, engine_ord, {_TOKENS} AS w FROM c)),
agg AS (SELECT file, engine_ord, count(*) AS n_tokens, count(DISTINCT CASE WHEN n IS NULL THEN word END) AS n_unknown,
  avg(CASE WHEN pos < 1024 THEN ln((coalesce(n, 0) + 1) / (total + size + 1)) END) AS mean_log FROM tok LEFT JOIN lex USING (word), tot GROUP BY 1, 2),
m AS (SELECT c.*, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_unknown, 0) AS n_unknown, len({tokens_sql('text')}) AS words, CASE WHEN coalesce(n_tokens, 0) = 0 THEN 0.0 ELSE (n_tokens - n_unknown) / n_tokens END AS coverage,
  CASE WHEN coalesce(n_tokens, 0) < 5 THEN 1000.0 ELSE exp(-mean_log) END AS perplexity FROM c LEFT JOIN agg USING (file, engine_ord)),
s AS (SELECT *, CASE WHEN {strip_sql('text')} = '' THEN 0.0 ELSE coverage / ln(1 + perplexity) END AS score FROM m)
"""


#: Documents of one block, if they are short: the fewer blocks, the fewer words are asked for twice.
BLOCK = 2500


def _scored(spark, d):
    docs = read(spark, d, "documents")
    own, blocks = route.in_blocks(docs.select("doc_id", "text"), "doc_id", BLOCK, "text")
    return route.quality_scores(candidates(own, also=["block"], spread_out=False), lookup.lexicon(spread(docs, "doc_id")), blocks=blocks)


@query(f"WITH {_SCORES} SELECT file, engine, words, n_tokens, n_unknown, round(perplexity, 3) AS perplexity, round(score, 6) AS score FROM s")
def t8_quality_scores(spark, d):
    return _scored(spark, d).select("file", "engine", F.col("words").cast("long"), F.col("n_tokens").cast("long"), "n_unknown", F.round("perplexity", 3).alias("perplexity"), F.round("score", 6).alias("score"))


_BIGRAM = f"""
c AS ({candidates_sql()}),
dt AS (SELECT {_TOKENS} AS t FROM documents), ct AS (SELECT file, engine_ord, engine, ({_TOKENS})[1:1024] AS t FROM c),
big AS (SELECT u, w, count(*) AS n FROM (SELECT unnest(list_concat([''], t[1:len(t) - 1])) AS u, unnest(t) AS w FROM dt WHERE len(t) > 0) GROUP BY ALL),
ctx AS (SELECT u, sum(n) AS total, count(*) AS followers FROM big GROUP BY u), aft AS (SELECT w, count(*) AS follows FROM big GROUP BY w),
z AS (SELECT count(*) AS kinds, (SELECT count(*) FROM aft) AS words FROM big),
q AS (SELECT file, engine_ord, unnest(list_concat([''], t[1:len(t) - 1])) AS u, unnest(t) AS w FROM ct WHERE len(t) > 0),
e AS (SELECT file, engine_ord, (coalesce(follows - 0.75::DOUBLE, 0) + 0.75::DOUBLE * words / (words + 1)) / kinds AS own, coalesce((n - 0.75::DOUBLE) / total, 0) AS gain, coalesce(0.75::DOUBLE * followers / total, 1) AS back
  FROM q LEFT JOIN big USING (u, w) LEFT JOIN ctx USING (u) LEFT JOIN aft USING (w), z),
s AS (SELECT file, engine_ord, avg(ln(gain + back * own)) AS mean_log, count(*) AS n FROM e GROUP BY 1, 2)
SELECT file, engine, CASE WHEN coalesce(n, 0) < 5 THEN 1000.0::DOUBLE ELSE round(exp(-mean_log), 3) END AS perplexity FROM c LEFT JOIN s USING (file, engine_ord)
"""


@query(f"WITH {_BIGRAM}")
def t7_bigram_perplexity(spark, d):
    """Perplexity of all candidates by a bigram model of all documents: 1,024 tokens of a text, 1000 below five."""
    docs = read(spark, d, "documents")
    own, blocks = route.in_blocks(docs.select("doc_id", "text"), "doc_id")
    scores = scorer.Bigrams().fit(docs).perplexity(candidates(own, also=["block"], spread_out=False), blocks)
    return scores.select("file", "engine", F.round("perplexity", 3).alias("perplexity"))


_ROUTE = rf"""
WITH {_SCORES},
g AS (SELECT *, greatest(max(words) OVER (PARTITION BY file), 1) AS most FROM s),
e AS (SELECT *, score * (0.8 + 0.2 * least(greatest(words / most, 0), 1)) AS effective,
  CASE WHEN length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) = 0 THEN true ELSE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) >= 0.5 END AS english FROM g),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY file ORDER BY effective DESC, engine_ord) = 1),
v AS (SELECT *, CASE WHEN NOT english THEN 'skipped' WHEN score < 0.10 THEN 'failed' ELSE 'passed' END AS quality_gate FROM b)
SELECT file, engine, words, round(effective, 6) AS effective, CASE WHEN quality_gate = 'skipped' THEN NULL ELSE round(score, 6) END AS quality, quality_gate,
  CASE WHEN quality_gate = 'failed' THEN 'triage' ELSE 'processed' END AS status FROM v
"""


@query(_ROUTE)
def q1_route(spark, d):
    return route.routed(_scored(spark, d))


@query("SELECT doc_id, length(text) AS n_code_points, strlen(text) AS n_bytes FROM documents")
def t10_char_count(spark, d):
    return read(spark, d, "documents").select("doc_id", T.char_count(F.col("text")).cast("long").alias("n_code_points"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"SELECT conv_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> '')) AS digest, count(*) AS n_pages FROM (SELECT conv_id, turn, {strip_sql('text')} AS t FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)) GROUP BY conv_id")
def t11_page_join(spark, d):
    pages = read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    each = pages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    joined = T.joined_pages(F.transform("p", lambda p: p["text"]))
    return each.select("conv_id", F.md5(joined.cast("binary")).alias("digest"), F.size("p").cast("long").alias("n_pages"))


@query(f"SELECT doc_id, md5(replace(left({strip_sql('text')}, 500), chr(10), ' ')) AS digest FROM documents")
def t12_excerpt(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.excerpt(F.col("text")).cast("binary")).alias("digest"))


@query(r"""WITH l AS (SELECT doc_id, string_split(replace(replace(text, 'on', '-' || chr(10) || 'on'), 'é', '֊' || chr(10) || 'é'), chr(10)) AS x FROM documents),
s AS (SELECT doc_id, list_transform(x, lambda t: regexp_replace(t, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '')) AS x FROM l),
j AS (SELECT doc_id, list_reduce(x, lambda a, b: CASE WHEN regexp_matches(a, '\p{L}[-–—֊]$') AND regexp_matches(b, '^\p{L}') THEN left(a, length(a) - 1) || b ELSE a || chr(10) || b END) AS t FROM s)
SELECT doc_id, md5(t) AS digest FROM j""")
def t13_dehyphenate(spark, d):
    broken = F.replace(F.replace(F.col("text"), F.lit("on"), F.lit("-\non")), F.lit("é"), F.lit("֊\né"))
    lines = T.dehyphenated(F.split(broken, "\n"))
    return read(spark, d, "documents").select("doc_id", F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def t14_html_escape(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.html_escaped(F.col("html")).cast("binary")).alias("digest"))


@query(r"SELECT page_id, lower(regexp_extract(f, '^.+(\.[^.]+)$', 1)) AS suffix, CASE WHEN regexp_matches(f, '^.+\.[^.]+$') THEN regexp_extract(f, '^(.+)\.[^.]+$', 1) ELSE f END AS stem, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS relative FROM (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS f FROM pages)")
def t15_path_pieces(spark, d):
    url = F.col("url")
    return read(spark, d, "pages").select("page_id", T.suffix(url).alias("suffix"), T.stem(url).alias("stem"), T.relative(url, "https://").alias("relative"))


@query(f"WITH c AS (SELECT conv_id, turn, role, text FROM conversations GROUP BY ALL) SELECT conv_id, coalesce(array_to_string(list_transform(list_sort(list(x) FILTER (turn % 5 <> 3)), lambda v: v.t), chr(10)), '') AS block FROM (SELECT conv_id, turn, {{'i': turn, 'l': role, 't': {strip_sql('text')}}} AS x FROM c) GROUP BY conv_id")
def t17_block_text(spark, d):
    """Turns as blocks: every fifth is a figure, which is skipped."""
    label = F.when(F.col("turn") % 5 == 3, "figure").otherwise(F.col("role")).alias("label")
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct().groupBy("conv_id")
    own = turns.agg(F.sort_array(F.collect_list(F.struct("turn", "role", T.strip(F.col("text")).alias("text"), label))).alias("b"))
    return own.select("conv_id", T.block_text(F.col("b")).alias("block"))


@query(f"SELECT item_id, array_to_string({tokens_sql('lower(text)')}, '|') AS terms FROM benchmark")
def t19_search_tokens(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.search_tokens(F.col("text")), "|").alias("terms"))


@query("SELECT l_returnflag, round(sum((l_quantity * 1000 / 1e6 * 3.0 + l_extendedprice / 1e6 * 15.0) * 0.5), 4) AS cost FROM lineitem GROUP BY 1")
def t20_pricing(spark, d):
    cost = T.price(F.col("l_quantity") * 1000, F.col("l_extendedprice"), 3.0, 15.0, 0.5)
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(cost), 4).alias("cost"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(s * CASE WHEN m <= 0 THEN 1 ELSE 0.8 + 0.2 * least(greatest(w / m, 0), 1) END, 9) AS effective FROM (SELECT *, l_discount AS s, l_quantity AS w, CAST(l_suppkey % 40 AS DOUBLE) AS m FROM lineitem)")
def p1_effective_score(spark, d):
    value = rules.effective_score(F.col("l_discount"), F.col("l_quantity"), (F.col("l_suppkey") % 40).cast("double"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 9).alias("effective"))


BANDS = [(10.0, 1.5), (25.0, 2.0), (40.0, 2.5), (float("inf"), 3.0)]


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 1.5 WHEN p_size < 25 THEN 2.0 WHEN p_size < 40 THEN 2.5 ELSE 3.0 END AS contrast, CAST(CASE WHEN p_retailprice < 1000 THEN 3 WHEN p_retailprice < 1500 THEN 6 ELSE 11 END AS INTEGER) AS psm FROM part")
def p4_suggest(spark, d):
    psm = rules.band(F.col("p_retailprice"), [(1000.0, 3), (1500.0, 6), (float("inf"), 11)])
    return read(spark, d, "part").select("p_partkey", rules.band(F.col("p_size").cast("double"), BANDS).cast("double").alias("contrast"), psm.cast("int").alias("psm"))


@query("SELECT p_partkey, value FROM part JOIN (VALUES (-1e9, 10.0, 1), (10.0, 25.0, 2), (25.0, 1e9, 3)) b(low, high, value) ON p_size >= low AND p_size < high")
def j3_band_join(spark, d):
    bands = spark.createDataFrame([(-1e9, 10.0, 1), (10.0, 25.0, 2), (25.0, 1e9, 3)], "low double, high double, value int")
    part = read(spark, d, "part")
    return part.join(F.broadcast(bands), (F.col("p_size") >= F.col("low")) & (F.col("p_size") < F.col("high"))).select("p_partkey", "value")


@query("SELECT l_orderkey, min(l_linenumber) AS l, min(l_quantity) AS t, max(l_linenumber) AS r, max(l_quantity) AS b FROM lineitem GROUP BY 1")
def p7_extent(spark, d):
    points = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.array(F.col("l_linenumber").cast("double"), "l_quantity")).alias("p"))
    return points.select("l_orderkey", rules.extent(F.col("p")).alias("x")).select("l_orderkey", F.col("x.l").cast("int").alias("l"), "x.t", F.col("x.r").cast("int").alias("r"), "x.b")


@query("SELECT p_partkey, round(x * 1400, 6) AS l, round((1 - y - h) * 2000, 6) AS t, round((x + w) * 1400, 6) AS r, round((1 - y) * 2000, 6) AS b FROM (SELECT p_partkey, p_size / 100 AS x, (p_partkey % 50) / 100 AS y, 0.25 AS w, (p_partkey % 7) / 100 AS h FROM part)")
def p8_flipped_box(spark, d):
    x, y, h = F.col("p_size") / 100, (F.col("p_partkey") % 50) / 100, (F.col("p_partkey") % 7) / 100
    box = rules.flipped_box(x, y, F.lit(0.25), h, F.lit(1400), F.lit(2000))
    return read(spark, d, "part").select("p_partkey", *[F.round(box[c], 6).alias(c) for c in "ltrb"])


@query("SELECT p_partkey, round(CASE WHEN low + 8 > high - 8 THEN (low + high) / 2 ELSE low + 8 END, 6) AS low, round(CASE WHEN low + 8 > high - 8 THEN (low + high) / 2 ELSE high - 8 END, 6) AS high FROM (SELECT p_partkey, CAST(p_partkey % 40 AS DOUBLE) AS low, CAST(p_partkey % 40 + p_size AS DOUBLE) AS high FROM part)")
def p10_trimmed(spark, d):
    low = (F.col("p_partkey") % 40).cast("double")
    out = rules.trimmed(low, low + F.col("p_size"), F.lit(8.0))
    return read(spark, d, "part").select("p_partkey", F.round(out["low"], 6).alias("low"), F.round(out["high"], 6).alias("high"))


@query("SELECT p_partkey, low, high, c AS edge FROM (SELECT *, CASE WHEN low < r0 AND r0 <= high THEN r0 WHEN low < r1 AND r1 <= high THEN r1 WHEN low < r2 AND r2 <= high THEN r2 ELSE m END AS c FROM (SELECT *, round_even(m, 0) AS r0, round_even(m, 1) AS r1, round_even(m, 2) AS r2 FROM (SELECT p_partkey, p_size / 4 AS low, p_size / 4 + 0.25 AS high, (p_size / 4 + p_size / 4 + 0.25) / 2 AS m FROM part)))")
def p13_edges(spark, d):
    low, high = F.col("p_size") / 4, F.col("p_size") / 4 + 0.25
    return read(spark, d, "part").select("p_partkey", low.alias("low"), high.alias("high"), rules.edge_between(low, high).alias("edge"))


_TURNED = """WITH m AS (SELECT event_id, value * 30 AS med, (event_id % 9 - 4) / 2 AS votes, event_id % 20 AS blocks, CASE WHEN event_id % 17 > 0 THEN (event_id % 13) / 12 END AS up FROM events),
s AS (SELECT *, votes < 0 AS down, CASE WHEN med < 96 THEN 'too dark to be a page of text' WHEN blocks < 8 THEN 'no text to read'
  WHEN votes > -1 AND votes < 1 THEN 'the lines run neither clearly across nor clearly down' WHEN up IS NULL THEN '{few}'
  WHEN up > {low} AND up < {high} THEN printf('cannot tell which way is up: %.2f is too near a half', up) END AS unsure FROM m),
t AS (SELECT *, CASE WHEN unsure IS NOT NULL THEN 0 WHEN up > 0.5 THEN CASE WHEN down THEN 90 ELSE 0 END ELSE CASE WHEN down THEN 270 ELSE 180 END END AS turn FROM s)
SELECT event_id, turn, CASE WHEN unsure IS NOT NULL THEN 'orientation unsure (' || unsure || '); read as it is' WHEN turn > 0 THEN 'turned ' || turn || '° clockwise to read' ELSE 'upright' END AS told, blocks >= 8 AND votes <= -1 AS sideways FROM t"""


def _turned(spark, d, script):
    e = F.col("event_id")
    votes, blocks, up = (e % 9 - 4) / 2, e % 20, F.when(e % 17 > 0, (e % 13) / 12)
    read_as = read(spark, d, "events").select("event_id", rules.orientation(F.col("value") * 30, votes, blocks, up, script).alias("o"), rules.sideways(votes, blocks).alias("sideways"))
    return read_as.select("event_id", "o.turn", rules.orientation_text(F.col("o.turn"), F.col("o.unsure")).alias("told"), "sideways")


@query(_TURNED.format(few="too few clear lines of writing to tell which way is up", low=0.45, high=0.55))
def p14_orientation(spark, d):
    return _turned(spark, d, "latin")


@query(_TURNED.format(few="too few letters to tell which way is up", low=0.48, high=0.52))
def p15_orientation_armenian(spark, d):
    return _turned(spark, d, "armenian")


@query("SELECT event_id, round(value * 100 / CASE WHEN coalesce(dpi, 300) < 50 THEN 300 ELSE coalesce(dpi, 300) END * 72, 6) AS points FROM (SELECT event_id, value, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 400 AS DOUBLE) END AS dpi FROM events)")
def s19_plausible_points(spark, d):
    dpi = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 400).cast("double"))
    return read(spark, d, "events").select("event_id", F.round(rules.plausible_points(F.col("value") * 100, dpi), 6).alias("points"))


@query("SELECT p_partkey, CASE WHEN w * h > 89478485 THEN 'too many pixels' WHEN greatest(w, h) > 30000 THEN 'side too long' WHEN pages > 500 THEN 'too many pages' END AS refused FROM (SELECT p_partkey, p_size * 700 AS w, p_partkey % 100 * 40 AS h, p_partkey % 600 AS pages FROM part)")
def s18_admission(spark, d):
    key = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", rules.refused_reason((F.col("p_size") * 700).cast("long"), key % 100 * 40, key % 600).alias("refused"))


@query("SELECT doc_id, '# ' || doc_id || chr(10) || chr(10) AS head, md5('# ' || doc_id || chr(10) || chr(10) || " + strip_sql("text") + " || chr(10)) AS digest FROM documents")
def k1_markdown(spark, d):
    name = F.col("doc_id").cast("string")
    return read(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), name, F.lit("\n\n")).alias("head"), F.md5(T.markdown_page(name, F.col("text")).cast("binary")).alias("digest"))


@query(r"SELECT doc_id, NOT regexp_matches(text, '[^\x00-\x7f\x{a0}-\x{ff}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]') AS encodable FROM documents")
def k4_font_encodable(spark, d):
    return read(spark, d, "documents").select("doc_id", T.cp1252_encodable(F.col("text")).alias("encodable"))
