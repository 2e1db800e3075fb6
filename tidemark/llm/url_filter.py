"""URL filters: a Bloom filter cascade beside longest-prefix rules, in built-in functions only.

The cascade answers "is this host (or a parent domain of it) on the block list?" exactly for
every key of the corpus, without a join. Level 0 is a Bloom filter of the listed keys; level 1
holds the keys of the corpus's complete universe that level 0 accepts wrongly; level 2 the
listed keys that level 1 accepts, and so on until a level accepts nothing wrongly. A key that
stops at an even level (first level it misses is odd, or it passes all of an odd number of
levels) is listed.

What is broadcast is the levels' bitmaps, as binary literals of the plan. Level 0 has
``BITS_PER_KEY`` bits for each listed key that occurs in the corpus; each further level holds a
small share of its predecessor's domain. Keys are cut by hash into as many segments as keep each
level within ``MAX_LEVEL_BYTES``; every segment has a cascade of its own, and segments are asked
one after the other, in a pass over the rows each.

Null urls and urls without ``://`` have an empty host and path, match no rule and are allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: Rules of the contract: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Words that mark a domain's first label as spam; every known top level is listed for each.
SPAM_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKLIST = tuple(f"{name}.example.{top}" for name in SPAM_NAMES for top in ("com", "net", "org"))

BITS_PER_KEY = 12
PROBES = 6
MAX_LEVEL_BYTES = 4 << 20


def host_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)"))
    return ascii_lower(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(_url, locate('://', _url) + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def suffixes(host: Column, labels: int) -> Column:
    """The host and its parent domains of at most so many labels, most specific first.

    labels is that of the longest key on the list: a longer domain can't be on it.
    """
    n = F.least(F.size(F.split(host, r"\.")), F.lit(max(1, labels)))
    return F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.call_function("substring_index", host, F.lit("."), -i))


def _segment(key: Column, of: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(of))


def _bit(key: Column, level: int, probe: int, n_bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level * 64 + probe), key), F.lit(n_bits))


def _passes(key: Column, level: int, bitmap: bytes) -> Column:
    """Whether a level accepts key."""
    n_bits, bits = len(bitmap) * 8, F.lit(bytearray(bitmap))

    def is_set(probe: int) -> Column:
        at = _bit(key, level, probe, n_bits)
        byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0

    return reduce(lambda a, b: a & b, (is_set(p) for p in range(PROBES)))


def _bitmap(keys: DataFrame, level: int, n_keys: int) -> bytes:
    """Bloom filter of keys(key), gathered as 64-bit words: some MAX_LEVEL_BYTES to the driver."""
    n_words = max(1, -(-n_keys * BITS_PER_KEY // 64))
    at = F.explode(F.array(*(_bit(F.col("key"), level, p, n_words * 64) for p in range(PROBES))))
    one = F.expr("shiftleft(1L, CAST(pmod(at, 64) AS INT))")
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(one).alias("bits"))
    out = bytearray(8 * n_words)
    for r in rows.collect():
        out[8 * r["word"] : 8 * r["word"] + 8] = r["bits"].to_bytes(8, "little", signed=True)
    return bytes(out)


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[bytes]:
    """Levels for keys(key) of the universe against listed(key); both distinct, universe complete."""
    inside = materialise(universe.join(listed, "key", "left_semi"), "cascade-in")
    outside = universe.join(listed, "key", "left_anti")
    levels: list[bytes] = []
    wanted, others = inside, outside
    while n := wanted.count():
        k = len(levels)
        levels.append(_bitmap(wanted, k, n))
        wrong = materialise(others.filter(_passes(F.col("key"), k, levels[k])), f"cascade-{k}")
        wanted, others = wrong, wanted
    return levels


def is_listed(key: Column, levels: list[bytes]) -> Column:
    """Exact membership for any key of the universe that the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(_passes(key, k, levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def judge(pages: DataFrame, rules=RULES, blocklist: DataFrame | tuple[str, ...] = BLOCKLIST, key: str = "page_id", max_level_bytes: int = MAX_LEVEL_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed_key (the listed domain, else null) of every row.

    The longest fitting rule decides (ties, of which equal rules alone have any: the earlier);
    where none fits, a url is blocked if its host or a parent domain is on the block list, of which
    listed_key is the longest. The list is a DataFrame whose first column holds the domains, of any
    number and in any letters' case, nulls and empty ones aside, or a few names; it stays a table.
    Repeated rows are judged each for itself; a null key stays null.
    """
    spark = pages.sparkSession
    split = pages.select(F.col(f"`{key}`").alias("page_id"), F.col("`url`").cast("string").alias("_url")).select(
        "page_id", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")
    )
    given = blocklist if isinstance(blocklist, DataFrame) else spark.createDataFrame([(k,) for k in blocklist], "key string")
    names = given.select(ascii_lower(F.col(f"`{given.columns[0]}`").cast("string")).alias("key")).filter("key <> ''").distinct()
    listed = materialise(names, "listed")
    size = listed.agg(F.count("*").alias("n"), F.max(F.size(F.split("key", r"\."))).alias("labels")).first()
    depth = size["labels"] or 1
    universe = split.select("host").distinct().select(F.explode(suffixes(F.col("host"), depth)).alias("key")).distinct()
    of = -(-size["n"] * BITS_PER_KEY // (8 * max_level_bytes)) or 1
    if of > 1:
        universe = materialise(universe, "cascade-keys")
    for s in range(of):
        own = (lambda k: F.lit(True)) if of == 1 else (lambda k, s=s: _segment(k, of) == s)
        levels = build_cascade(universe.filter(own(F.col("key"))), listed.filter(own(F.col("key"))))
        hit = F.get(F.filter(suffixes(F.col("host"), depth), lambda k: own(k) & is_listed(k, levels)), F.lit(0))  # noqa: B023
        if s:
            longer = F.length("found") > F.coalesce(F.length("listed_key"), F.lit(-1))
            split = split.withColumn("found", hit).withColumn("listed_key", F.when(longer, F.col("found")).otherwise(F.col("listed_key"))).drop("found")
        else:
            split = split.withColumn("listed_key", hit)
        if s % 16 == 15:  # passes pile up in one plan
            split = materialise(split, "judged")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed_key").isNotNull(), "block").otherwise("allow")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = rule_fits(F.col("host"), F.col("path"), host, path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return split.select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed_key"
    )


def oracle(rules=RULES, blocklist=BLOCKLIST) -> str:
    """DuckDB SQL of the same result, the list as a plain IN."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda pick, other: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(v, h, p)}'" for v, h, p in ordered) + f" ELSE {other} END"
    names = ", ".join(f"'{k}'" for k in sorted(set(blocklist)))
    return f"""
    WITH cut AS (
      SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), split AS (
      SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), keys AS (
      SELECT *, list_filter(list_transform(range(1, len(string_split(host, '.')) + 1),
                lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                lambda k: k IN ({names}))[1] AS listed_key FROM split
    )
    SELECT page_id, host, path, {case(lambda v, h, p: h + p, "NULL")} AS rule,
           {case(lambda v, h, p: v, "CASE WHEN listed_key IS NOT NULL THEN 'block' ELSE 'allow' END")} AS verdict, listed_key
    FROM keys
    """
