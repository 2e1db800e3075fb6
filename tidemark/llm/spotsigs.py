"""Document fingerprints by SpotSigs, in built-in functions only.

A signature is an anchor (a common word) with the chain of content words (words that are no
anchors) that follow it. A fingerprint is the set of a text's signatures. Anchors are the common
words of four languages; where a text has none that is followed by a whole chain, every word
is taken for an anchor of the words after it; a text of too few words for a chain is a signature
as a whole. Words are runs of letters and digits in lower case.

With a the (0-based) place of the j-th anchor in the list of words, a - j content words stand
before it, so its chain starts at content word a - j: each signature takes constant time.

Sets that reach a Jaccard likeness t have sizes within t of each other. :func:`near_pairs` cuts
sizes into ranges of that ratio, compares sets of one and the next range that share one of the
signatures that a likeness of t can't do without, and discards pairs by size first.

Defined results: null text is empty; an empty text's fingerprint is the hash of nothing, so empty
texts are alike; rows without doc_id have a fingerprint, but no edited text and no next document
(these are null), and rows of one doc_id follow one another by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    """
    a an and are as at be by for from in is it of on or that the this to was with
    als auf das dem den der des die ein eine für im ist mit nicht sich und von zu
    au aux avec ce dans de des du elle est et la le les ne par pas pour que qui sur un une
    al con del el en es las lo los no para por se su una y
    """.split()
)
CHAIN = 2
SPLIT = r"[^\p{L}\p{N}]+"
HASH = 12
BUCKET = 64
#: A bucket of more rows holds repeated doc_ids; its rows are dealt by ranges instead.
FULL = 4096
THRESHOLD = 0.8
#: Sets that meet at one signature and size range in one part of the join's one side.
PART = 1024
#: Bounds that a product of doubles misses by its rounding are still met.
SLACK = 1e-9


def signatures(text: Column, chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> Column:
    """Sorted distinct signature hashes of a text, never empty."""
    words = F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")
    is_anchor = lambda w: w.isin(*anchors)

    def of(w: Column) -> Column:
        content = F.filter(w, lambda x: ~is_anchor(x))
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: is_anchor(F.get(w, i)))
        return _let(content, lambda c: F.transform(places, lambda a, j: F.when(a - j + chain <= F.size(c), F.concat_ws(" ", F.get(w, a), F.slice(c, a - j + 1, F.lit(chain))))))

    def every(w: Column) -> Column:
        return F.when(F.size(w) > chain, F.transform(F.sequence(F.lit(1), F.size(w) - chain), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(chain + 1))))).otherwise(F.array(F.concat_ws(" ", w)))

    def either(w: Column) -> Column:
        return _let(
            F.when(F.size(w) > 0, F.filter(of(w), lambda s: s.isNotNull())).otherwise(F.array().cast("array<string>")),
            lambda s: F.when(F.size(s) > 0, s).otherwise(every(w)),
        )

    return F.array_sort(F.array_distinct(F.transform(_let(words, either), lambda s: F.substring(F.md5(s.cast("binary")), 1, HASH))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fingerprint(signature_set: Column) -> Column:
    return F.array_join(signature_set, "")


def jaccard(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Likeness of two sets; 0 by their sizes alone where it can't reach floor."""
    shared = F.size(F.array_intersect(a, b))
    whole = shared / (F.size(a) + F.size(b) - shared)
    return whole if not floor else F.when(F.least(F.size(a), F.size(b)) < floor * F.greatest(F.size(a), F.size(b)) - SLACK, 0.0).otherwise(whole)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, n_chars, fingerprint and signatures of every row."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    out = docs.select(F.col("`doc_id`").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), signatures(text, chain).alias("signatures"))
    return out.withColumn("fingerprint", fingerprint(F.col("signatures")))


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD, chain: int = CHAIN) -> DataFrame:
    """Representatives a <= b of different fingerprints with likeness >= threshold, and likeness.

    A fingerprint's representative is the smallest doc_id that has it (a = b where that is one doc_id
    with several texts); rows without doc_id take no part, repeated rows count once. Sets meet at their rarest signatures, by the number of sets that
    have them, so one that many share is seldom among these; a meeting of many sets is dealt over
    parts of about ``PART`` of one side each. Only ids and sizes are dealt; the sets are fetched for
    pairs that pass by size.
    """
    sets = fingerprints(docs, chain).filter("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.first("signatures").alias("s"))
    # two sets of one doc_id are told apart by their fingerprint's hash
    sets = materialise(sets.select("id", F.xxhash64("fingerprint").alias("h"), "s"), "signature-sets")
    every = sets.select("id", "h", F.size("s").alias("n"), F.explode("s").alias("sig"))
    counts = materialise(every.groupBy("sig").agg(F.count("*").alias("df")), "signature-counts")
    needed = F.col("n") - F.ceil(F.col("n") * threshold - SLACK).cast("int") + 1
    rarest = every.join(counts, "sig").groupBy("id", "h", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("x"))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + SLACK).cast("int")
    entries = rarest.select("id", "h", "n", level.alias("level"), F.explode(F.slice("x", F.lit(1), needed)).alias("x"))
    entries = materialise(entries.filter("x.df > 1").select("id", "h", "n", "level", F.col("x.sig").alias("sig")), "signature-index")
    parts = materialise(entries.groupBy("sig", "level").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "signature-parts")

    right = entries.join(parts, ["sig", "level"]).select("sig", "level", F.pmod(F.col("h"), F.col("parts")).cast("int").alias("part"), F.col("id").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    left = entries.withColumn("level", F.explode(F.array("level", F.col("level") - 1, F.col("level") + 1))).join(parts, ["sig", "level"])
    left = left.select("sig", "level", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    close = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - SLACK
    pairs = left.join(right, ["sig", "level", "part"]).filter((F.struct("a", "ha") < F.struct(F.col("b").alias("a"), F.col("hb").alias("ha"))) & close)
    pairs = pairs.select("a", "ha", "b", "hb").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("h").alias(f"h{x}"), F.col("s").alias(f"s{x}"))
    pairs = pairs.join(side("a"), ["a", "ha"]).join(side("b"), ["b", "hb"])
    return pairs.select("a", "b", jaccard(F.col("sa"), F.col("sb"), threshold).alias("likeness")).filter(F.col("likeness") >= threshold)


def _following(numbers: DataFrame, at: str) -> DataFrame:
    """Distinct numbers(at) with ``following``, the next number that there is (null after the last).

    Numbers are dealt by ranges; only the ranges' first numbers, one a partition, meet in one task.
    """
    ranged = materialise(numbers.select(at).repartitionByRange(at).withColumn("range", F.spark_partition_id()), "ranged")
    ahead = ranged.groupBy("range").agg(F.min(at).alias("head")).select("range", F.lead("head").over(Window.orderBy("range")).alias("ahead"))
    within = F.lead(at).over(Window.partitionBy("range").orderBy(at))
    return ranged.withColumn("following", within).join(F.broadcast(ahead), "range").select(at, F.coalesce("following", "ahead").alias("following"))


def _led(rows: DataFrame, chain: int) -> DataFrame:
    """rows(bucket, doc_id, text) with their and the next row's text and signatures, where a bucket has a next one."""
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    led = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("s", signatures(F.col("text"), chain))
    return led.select("bucket", "doc_id", "text", "s", "next_text", F.lead("s").over(order).alias("next_s"), F.lit(1).cast("long").alias("times"))


def _led_by_range(rows: DataFrame, chain: int) -> DataFrame:
    """The same for buckets of very many rows, that is of repeated doc_ids: each distinct row once, as often as it's there.

    Rows are dealt by ranges of doc_id and text, whatever the buckets.
    """
    once = rows.groupBy("bucket", "doc_id", "text").agg(F.count("*").alias("n"))
    once = materialise(once.repartitionByRange("doc_id", "text").withColumn("range", F.spark_partition_id()), "repeated")
    item = F.struct("bucket", "text")
    order = Window.partitionBy("range").orderBy("doc_id", "text")
    ahead = once.groupBy("range").agg(F.min_by(item, F.struct("doc_id", "text")).alias("head")).select("range", F.lead("head").over(Window.orderBy("range")).alias("ahead"))
    led = once.withColumn("next", F.lead(item).over(order)).join(F.broadcast(ahead), "range").withColumn("next", F.coalesce("next", "ahead"))
    last = F.struct(F.when(F.col("next.bucket") == F.col("bucket"), F.col("next.text")).alias("next_text"), F.lit(1).cast("long").alias("times"))
    copies = F.struct(F.col("text").alias("next_text"), (F.col("n") - 1).alias("times"))
    led = led.select("bucket", "doc_id", "text", F.explode(F.when(F.col("n") > 1, F.array(last, copies)).otherwise(F.array(last))).alias("then")).select("bucket", "doc_id", "text", "then.*")
    return led.select("bucket", "doc_id", "text", signatures(F.col("text"), chain).alias("s"), "next_text", F.when(F.col("next_text").isNotNull(), signatures(F.col("next_text"), chain)).alias("next_s"), "times")


def edited(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Every row with its own, the edited text's and the next document's likeness."""
    text = F.coalesce(F.col("`text`").cast("string"), F.lit(""))
    base = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), text.alias("text")).withColumn("bucket", F.floor(F.col("doc_id") / BUCKET))
    known = base.filter("doc_id IS NOT NULL")
    numbers = docs.select(F.floor(F.col("`doc_id`").cast("long") / BUCKET).alias("bucket")).filter("bucket IS NOT NULL")
    numbers = materialise(numbers.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    full = numbers.filter(F.col("n") > FULL).select("bucket")
    repeated = not full.isEmpty()
    led = _led(known.join(full, "bucket", "left_anti") if repeated else known, chain)
    if repeated:
        led = led.unionByName(_led_by_range(known.join(full, "bucket", "left_semi"), chain))

    # the last of each bucket is followed by the first of the next bucket, or of all
    heads = known.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head")).select(F.col("bucket").alias("following"), F.col("head.text").alias("head"), signatures(F.col("head.text"), chain).alias("head_s"))
    least = numbers.agg(F.min("bucket").alias("least"))
    follows = _following(numbers, "bucket").crossJoin(F.broadcast(least)).select("bucket", F.coalesce("following", "least").alias("following"))
    ahead = follows.join(heads, "following").select("bucket", "head", "head_s")
    led = led.join(ahead, "bucket").withColumns({"next_text": F.coalesce("next_text", "head"), "next_s": F.coalesce("next_s", "head_s"), "n_chars": F.char_length("text").cast("long")})

    cut = F.floor(F.col("n_chars") / 4).cast("int")
    new = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next_text", F.lit(1), cut))
    led = led.select("doc_id", "n_chars", "s", "next_s", new.alias("edited"), "times").withColumn("edited_s", signatures(F.col("edited"), chain))
    result = led.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("edited_s")).alias("edited_fingerprint"),
        jaccard(F.col("s"), F.col("edited_s")).alias("near_edited"), jaccard(F.col("s"), F.col("next_s")).alias("near_next"), "times",
    )
    result = result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times") if repeated else result.drop("times")
    none = base.filter("doc_id IS NULL").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), signatures(F.col("text"), chain).alias("s"))
    none = none.select("doc_id", "n_chars", F.lit(None).cast("string").alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"), F.lit(None).cast("string").alias("edited_fingerprint"), F.lit(None).cast("double").alias("near_edited"), F.lit(None).cast("double").alias("near_next"))
    return result.unionByName(none)


digest = edited


def oracle(chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> str:
    names = ", ".join(f"'{a}'" for a in anchors)
    chained = " || ".join(f"' ' || c[a - j + {i + 2}]" for i in range(chain))

    def sets(source: str, text: str, out: str) -> str:
        return f"""
    {out}_w AS (SELECT doc_id, {text} AS txt, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM {source}),
    {out}_c AS (SELECT *, list_filter(w, lambda x: x NOT IN ({names})) AS c, list_filter(range(len(w)), lambda i: w[i + 1] IN ({names})) AS places FROM {out}_w),
    {out}_s AS (SELECT *, list_filter(list_transform(range(len(places)), lambda j: CASE WHEN places[j + 1] - j + {chain} <= len(c) THEN
        w[places[j + 1] + 1] || {chained.replace("a - j", "places[j + 1] - j").replace("+ 2]", "+ 1]").replace("+ 3]", "+ 2]")} END), lambda s: s IS NOT NULL) AS found FROM {out}_c),
    {out} AS (SELECT doc_id, txt, list_sort(list_distinct(list_transform(CASE WHEN len(found) > 0 THEN found
        WHEN len(w) > {chain} THEN list_transform(range(1, len(w) - {chain} + 1), lambda i: array_to_string(w[i:i + {chain}], ' '))
        ELSE [array_to_string(w, ' ')] END, lambda s: substr(md5(s), 1, {HASH})))) AS s FROM {out}_s)"""

    like = lambda a, b: f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE"
    return f"""
    WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    {sets("base", "text", "own")},
    led AS (SELECT doc_id, txt, s, coalesce(lead(txt) OVER o, first_value(txt) OVER o) AS ntxt, coalesce(lead(s) OVER o, first_value(s) OVER o) AS ns
            FROM own WINDOW o AS (ORDER BY doc_id, txt)),
    cut AS (SELECT doc_id, substr(txt, 1, length(txt) - length(txt) // 4) || substr(ntxt, 1, length(txt) // 4) AS edited FROM led),
    {sets("cut", "edited", "ed")}
    SELECT led.doc_id, length(led.txt) AS n_chars, sha256(ed.txt) AS edited_sha256, array_to_string(led.s, '') AS fingerprint,
           array_to_string(ed.s, '') AS edited_fingerprint, {like("led.s", "ed.s")} AS near_edited, {like("led.s", "led.ns")} AS near_next
    FROM led JOIN ed USING (doc_id)
    """
