"""Operator 5, URL filters.

Two lists decide. Rules are (host, path) pairs: a url is expanded to its entries, every suffix of its
host by labels with every prefix of its path that has a listed length, and the longest fitting rule
decides. Urls that no rule fits are looked up in a list of canonical urls. In both, a blocked Bloom
filter of the listed entries, of bounded size, passes the possible hits, and an exact hash join with
the list removes false positives.

Canonical: the scheme and the fragment go, the host is in lower case without a default port or final
dot, percent-encoded unreserved characters are decoded, dot segments are resolved, no path is `/`.

Cases. Null urls or urls without `://`: empty host and path, which no entry fits, and no canonical
form. Repeated rows: each is judged. Ties of length: longer host, then the entry's text. Repeated
entries of the url list: block wins. Empty lists: all are allowed. The columns of `pages` stay; host,
path, rule and verdict replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import bloom
from leafloom.llm.common import salted_join, table, unused

# The rules of the query (verdict, host and path as one text).
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: The query's list of blocked urls: every third page's, written in another way, beside urls of no page.
LISTED_EVERY = 3

#: Blocks of the filter of rules, which stands in the plan; most distinct lengths of listed paths.
RULE_BLOCKS, PATH_LENGTHS = 1 << 13, 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null or without `://`."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, rule_verdict, rule_host, rule_path) of texts such as `example.net/en/`."""
    rows = [(text, verdict) for verdict, text in rules]
    listed = spark.createDataFrame(rows, "rule string, rule_verdict string")
    return listed.withColumn("rule_host", F.lower(F.substring_index("rule", "/", 1))).withColumn(
        "rule_path", F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    )


def key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, path)


def rule_filter(rules: DataFrame) -> tuple[Column, int]:
    """The filter of a rule table as one array literal, RULE_BLOCKS blocks of 64 bits at most."""
    blocks = bloom.blocks_for(rules.count(), RULE_BLOCKS)
    words = [0] * blocks
    for block, bits in bloom.table_of(rules, key(F.col("rule_host"), F.col("rule_path")), blocks).collect():
        words[block] = bits
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"), blocks


def path_lengths(rules: DataFrame) -> list[int] | None:
    """The distinct lengths of listed paths; None, if there are so many that all prefixes up to the longest are tried."""
    found = [r[0] for r in rules.select(F.length("rule_path")).distinct().limit(PATH_LENGTHS + 1).collect()]
    return sorted(found) if len(found) <= PATH_LENGTHS else None


def entries(host: Column, path: Column, lengths: list[int] | None, longest: int) -> Column:
    """All (host suffix, path prefix) of a url, as an array of structs."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = F.sequence(F.lit(0), F.least(F.length(path), F.lit(longest))) if lengths is None else F.array(*map(F.lit, lengths)).cast("array<int>")
    prefixes = F.transform(F.filter(tried, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("host"), p.alias("path")))))
    return F.when(host != "", pairs).otherwise(F.expr("cast(array() as array<struct<host:string,path:string>>)"))


def decoded_path(path: Column) -> Column:
    """Percent-encoded unreserved characters as themselves, other encodings in upper case."""
    parts = F.split(path, "%")

    def piece(p: Column) -> Column:
        char = F.char(F.conv(F.left(p, F.lit(2)), 16, 10).cast("long"))
        rest = F.substr(p, F.lit(3))
        known = F.when(char.rlike("^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.left(p, F.lit(2))), rest))
        return F.when(p.rlike("^[0-9A-Fa-f]{2}"), known).otherwise(F.concat(F.lit("%"), p))

    rest = F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece)
    return F.when(path.contains("%"), F.concat(parts[0], F.array_join(rest, ""))).otherwise(path)


def resolved_path(path: Column) -> Column:
    """Without `.` and `..` segments."""
    start = F.expr("cast(array() as array<string>)")

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    joined = F.array_join(F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), start, step), "/")
    closed = F.when(path.rlike(r"/\.{1,2}$") & (joined != ""), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), closed)).otherwise(path)


def canonical(url: Column) -> Column:
    """Host, path and query in canonical form; null for null or without `://`."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    port = F.when(scheme == "https", r":443$").otherwise(r":80$")
    host = F.regexp_replace(F.regexp_replace(host_of(url), port, ""), r"\.$", "")
    path = resolved_path(decoded_path(path_of(url)))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host, F.when(path == "", "/").otherwise(path), query))


def listed_verdicts(pages: DataFrame, listed: DataFrame, otherwise: str, most_blocks: int = bloom.MOST_BLOCKS) -> DataFrame:
    """Add `verdict` by a list (url, verdict) of urls; both sides meet in canonical form. Columns stay."""
    own, h, said = unused(pages, "canonical"), unused(pages, "url_hash"), "verdict"
    entries = listed.select(canonical(F.col("url")).alias(own), F.col("verdict").alias(said)).where(F.col(own).isNotNull())
    entries = entries.groupBy(own).agg(F.max(said).alias(said))  # `block` comes after `allow`
    hashes = entries.select(F.xxhash64(own).alias(h))
    tested = pages.withColumn(own, canonical(F.col("url"))).withColumn(h, F.xxhash64(own))
    blocks = bloom.blocks_for(hashes.count(), most_blocks)
    block, bits = unused(pages, "block"), unused(pages, "bits")
    filled = bloom.table_of(hashes, F.col(h), blocks).select(F.col("block").alias(block), F.col("bits").alias(bits))
    tested = tested.withColumn(block, bloom.block_of(F.col(h), blocks)).join(F.broadcast(filled), block, "left")
    # Equal urls meet one entry. A url on very many pages is a hot key: its rows are dealt by the page.
    possible = F.col(own).isNotNull() & F.coalesce(F.col(bits).bitwiseAND(bloom.mask_of(F.col(h))) == bloom.mask_of(F.col(h)), F.lit(False))
    tested = tested.withColumn(bits, possible).drop(block, h)
    salt = unused(tested, "salt")
    hits = tested.where(F.col(bits)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    spread = entries.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    found = hits.join(spread, [own, salt], "left").withColumn(said, F.coalesce(said, F.lit(otherwise)))
    rest = tested.where(~F.col(bits)).withColumn(said, F.lit(otherwise))
    return found.select(*pages.columns, said).unionByName(rest.select(*pages.columns, said))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", listed: DataFrame | None = None) -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict: the rule's, else that of `listed` (url, verdict), else
    `otherwise`."""
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    n, longest = rules.agg(F.count("*"), F.coalesce(F.max(F.length("rule_path")), F.lit(0))).first()
    by_list = lambda df: listed_verdicts(df, listed, otherwise) if listed is not None else df.withColumn("verdict", F.lit(otherwise))
    if not n:
        return by_list(parsed.withColumn("rule", F.lit(None).cast("string")))
    bits, blocks = rule_filter(rules)

    def possible(e: Column) -> Column:
        h = key(e["host"], e["path"])
        m = bloom.mask_of(h)
        return F.element_at(bits, bloom.block_of(h, blocks) + 1).bitwiseAND(m) == m

    hit, row = unused(parsed, "hits"), unused(parsed, "row")
    tested = parsed.withColumn(hit, F.filter(entries(F.col("host"), F.col("path"), path_lengths(rules), longest), possible))
    own = F.struct(*[F.col(c) for c in [*kept, "host", "path"]])
    hits = tested.where(F.size(hit) > 0).withColumn(row, F.monotonically_increasing_id()).select(row, own.alias("own"), F.explode(hit).alias("e"))
    best = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "rule_verdict").alias("best")
    fitting = rules.select(best, F.struct(F.col("rule_host").alias("host"), F.col("rule_path").alias("path")).alias("e"))
    fitting = fitting.groupBy("e").agg(F.max("best").alias("best"))
    joined = salted_join(hits, fitting, "e", row, "left")
    judged = joined.groupBy(row).agg(F.any_value("own").alias("own"), F.max("best").alias("best"))
    judged = judged.select("own.*", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
    rest = tested.where(F.size(hit) == 0).select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"))
    rest = by_list(rest.unionByName(judged.where("rule is null").drop("verdict")))
    return judged.where("rule is not null").unionByName(rest)


def written_otherwise(pages: DataFrame) -> DataFrame:
    """(url): the urls of pages with another scheme, host in upper case, default port, dot segment, percent-encoded letters
    and fragment; all have the canonical form of the page's url."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    query = F.regexp_extract("url", r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    encoded = F.replace(F.replace(F.substr(path, F.lit(2)), F.lit("a"), F.lit("%61")), F.lit("e"), F.lit("%65"))
    return pages.where(host != "").select(F.concat(F.lit("HTTPS://"), F.upper(host), F.lit(":443/./"), encoded, query, F.lit("#top")).alias("url"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = written_otherwise(pages.where(F.col("page_id") % LISTED_EVERY == 0))
    other = pages.select(F.concat(F.lit("http://"), host_of(F.col("url")), F.lit("/never/"), F.col("page_id").cast("string")).alias("url"))
    listed = own.unionByName(other).withColumn("verdict", F.lit("block"))
    return judge(pages, rule_table(spark, RULES), listed=listed).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query FROM pages),
c AS (SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END || query AS form FROM p WHERE host <> ''),
r(rule, rule_verdict, h, q) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
  ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
m AS (SELECT p.*, (SELECT rule FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q) ORDER BY length(rule) DESC LIMIT 1) AS rule FROM p)
SELECT page_id, host, path, m.rule, coalesce(rule_verdict, CASE WHEN page_id IN (SELECT page_id FROM c WHERE form IN (SELECT form FROM c WHERE page_id % 3 = 0)) THEN 'block' ELSE 'allow' END) AS verdict FROM m LEFT JOIN r ON m.rule = r.rule
"""
