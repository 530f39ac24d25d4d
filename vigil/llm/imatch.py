"""I-Match document fingerprints, in DataFrame operations only.

A lexicon holds the words whose document frequency lies in a band: at least
``LOW`` and at most ``HIGH`` of the documents, where a large group of copies or
near copies counts as one document.  ``SUBSETS`` randomised sub-lexica each
keep a share of it, three for every rate from a quarter down to 1/512.  A
document's signature under a sub-lexicon is a hash of its sorted distinct terms
in it; its fingerprint is the list of the signatures.  The likeness of two
fingerprints is the share of equal signatures among those that are not empty
in both.  With wide and narrow sub-lexica there are some that a small edit
leaves alone, for long and short documents.  A document of whose distinct words
fewer than one in ``SCARCE`` are in the band (a hot group's words are all too
frequent, invented words all too rare) has the same sub-lexica applied to all
its words.

A word is a 60-bit code of its hash from then on, and a sub-lexicon keeps the
codes in which its own few bits are 0.  Codes depend on the word alone, so
fingerprints of different tables can be compared.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import settled, shuffle_width, whole

LOW, HIGH = 0.0005, 0.1
SCARCE = 8
SUBSETS = 24
DIGITS = 8  # of a signature
#: A lexicon of up to so many rows (8 bytes each) is broadcast; a larger one is
#: joined by shuffle.
BROADCAST_ROWS = 500_000
#: Groups from one in so many documents on are weighted; there are at most as many.
HOT = 1000
#: A document's weight, as an integer so that sums do not depend on their order.
UNIT = 1 << 30
#: Bits of a code (15 hexadecimal digits).
BITS = 60


def rate(j: int) -> int:
    """Sub-lexicon j keeps one in so many terms."""
    return 4 << (j // 3)


def mask(j: int) -> int:
    """The bits that are 0 in the codes that sub-lexicon j keeps, drawn by a
    multiplicative generator."""
    bits, x = 0, pow(48271, 97 * (j + 1), (1 << 31) - 1)
    while bits.bit_count() < rate(j).bit_length() - 1:
        bits |= 1 << x % BITS
        x = x * 48271 % ((1 << 31) - 1)
    return bits


def code(word: Column) -> Column:
    return F.conv(F.substring(F.md5(word), 1, BITS // 4), 16, 10).cast("long")


def terms(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))


def codes(text: Column) -> Column:
    """Codes of a text's distinct words."""
    return F.transform(terms(text), code)


def once(x: Column) -> Column:
    """The value as a column of its own: an expression over it would otherwise
    take its definition in, and compute it at each of its uses."""
    return F.explode(F.array(x))


def band(n: int, low: float = LOW, high: float = HIGH) -> tuple[int, int]:
    """Least and greatest document frequency of a term among n documents."""
    return max(2, math.ceil(low * n)), max(2, math.floor(high * n))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(code): the terms of the band.

    A document's group is the least of its codes, which copies share and near
    copies mostly do.  A group of at least one in ``HOT`` documents (so at most
    ``HOT`` groups, which are broadcast) weighs as one document together.
    Frequencies are counted over all documents, as partial sums before the shuffle.
    A document has so many distinct words, on average W, so the band holds at
    most W / low terms, however large the corpus."""
    each = docs.select(once(codes(whole(text))).alias("codes")).withColumn("group", F.array_min("codes"))
    sizes = settled(each.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * HOT >= docs.count()))
    share = F.floor(F.lit(UNIT) / F.col("n")).cast("long")
    hot = F.broadcast(sizes.filter("group is not null").select("group", share.alias("share")))
    weighed = each.join(hot, "group", "left").select("codes", F.coalesce("share", F.lit(UNIT)).alias("weight"))
    total = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
    lo, hi = band(total // UNIT, low, high)
    df = weighed.select("weight", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("weight").alias("df"))
    return df.filter(F.col("df").between(lo * UNIT, hi * UNIT)).select("code")


def _edges(docs: DataFrame, id_col: str, parts: int) -> list:
    """Greatest ids of about ``parts`` equal id ranges, ascending (only the id column is read)."""
    spread = docs.select(F.col(id_col).alias("id")).filter("id is not null").repartitionByRange(parts, "id")
    return sorted(r["top"] for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.max("id").alias("top")).collect())


def _range_of(x: Column, edges: list) -> Column:
    """How many of the sorted edges are below x, by one step over every
    sqrt-th edge and one over those between."""
    if not edges:
        return F.lit(0)
    step = max(1, math.isqrt(len(edges)))
    below = lambda es: F.size(F.filter(es, lambda e: e < x))
    groups = [edges[i:i + step] for i in range(0, len(edges), step)]
    full = below(F.array(*[F.lit(g[-1]) for g in groups]))
    inside = F.get(F.array(*[F.array(*[F.lit(e) for e in g]) for g in groups] + [F.array(F.lit(edges[-1]))]), full)
    return F.when(full == len(groups), F.lit(len(edges))).otherwise(full * step + below(inside))


def with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, next, range, at, next_range, next_at): every row with the
    text of the next document in descending id order (after the last: the
    first), hash-partitioned by ``range``; (range, at) numbers the rows and
    (next_range, next_at) names the next one.

    Rows are dealt to id ranges; a range also gets a copy of the greatest
    row of the range below it, which is what its last row needs.  Null ids
    come last; rows of equal id are ordered by a hash of their text."""
    edges = _edges(docs, id_col, shuffle_width(docs.sparkSession))
    x = docs.select(F.col(id_col).alias("id"), whole(text).alias("text"), F.lit(False).alias("ghost"))
    x = x.withColumn("tie", F.xxhash64("text"))
    last = max(0, len(edges) - 1)
    x = x.withColumn("range", F.when(F.col("id").isNull(), 0).otherwise(F.least(_range_of(F.col("id"), edges[:-1]), F.lit(last))))
    if last:
        top = F.col("id").isin(*edges) if len(edges) <= 64 else F.array_contains(F.array(*[F.lit(e) for e in edges]), F.col("id"))
        up = F.when(F.col("range") == last, 0).otherwise(F.col("range") + 1)
        copies = F.when(top, F.array(F.struct("range", F.lit(False).alias("ghost")),
                                     F.struct(up.alias("range"), F.lit(True).alias("ghost")))) \
            .otherwise(F.array(F.struct("range", F.lit(False).alias("ghost"))))
        x = x.select("id", "text", "tie", F.explode(copies).alias("c")).select("id", "text", "tie", "c.range", "c.ghost")
    order = Window.partitionBy("range").orderBy("ghost", F.col("id").desc_nulls_last(), "tie")
    whole_range = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("at", F.row_number().over(order)).withColumn("next", F.lead("text").over(order)) \
        .withColumn("next_ghost", F.lead("ghost").over(order))
    if not last:  # the only range: the last row is followed by its first
        x = x.withColumn("next", F.coalesce("next", F.first("text").over(whole_range)))
    x = x.filter(~F.col("ghost"))
    step_up = F.coalesce(F.col("next_ghost"), F.lit(True))
    below = F.when(F.col("range") == 0, last).otherwise(F.col("range") - 1)
    return x.select("id", "text", "next", "range", "at",
                    F.when(step_up, below).otherwise(F.col("range")).alias("next_range"),
                    F.when(step_up, 1).otherwise(F.col("at") + 1).alias("next_at"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last third (rounded down, code points) replaced by
    the first as many of the other."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(other, F.lit(1), k))


def signatures(kept: Column) -> Column:
    """A signature of the sorted codes for each sub-lexicon; without terms in
    it, the signature of nothing."""
    def one(bits: Column) -> Column:
        own = F.filter(kept, lambda p: p.bitwiseAND(bits) == 0)
        return F.substring(F.md5(F.array_join(own.cast("array<string>"), " ")), 1, DIGITS)

    return F.transform(F.array(*[F.lit(mask(j)).cast("long") for j in range(SUBSETS)]), one)


#: The signature of nothing.
EMPTY = hashlib.md5(b"").hexdigest()[:DIGITS]


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those not empty in both (1 for two of
    which nothing is filled)."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    filled = F.filter(both, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    same = F.filter(filled, lambda p: p["a"] == p["b"])
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(F.size(same) / F.size(filled))


#: Stands for the text itself among its codes (which are not negative).
OWN = -1


def fingerprints(rows: DataFrame, lex: DataFrame, keys: list[str], text: Column, carried: Column, lex_rows: int) -> DataFrame:
    """(keys, sig, carried): the signature array of each row's text, and a
    column that goes along.

    Rows hash-partitioned by one of ``keys`` stay where they are: the lexicon
    is broadcast and a text's codes meet in the task that cut them.  Besides
    its codes a text gives one row (:data:`OWN`), which holds all codes and the
    carried column, so that only lexicon terms and that row are grouped."""
    words = rows.select(*keys, carried.alias("carried"), once(F.sort_array(codes(text))).alias("all"))
    each = words.select(*keys, F.explode(F.concat(F.array(F.struct(F.lit(OWN).cast("long").alias("code"), F.struct("all", "carried").alias("held"))),
                                                  F.transform("all", lambda c: F.struct(c.alias("code"), F.lit(None).cast(_held_type(words)).alias("held"))))).alias("x")) \
        .select(*keys, "x.code", "x.held")
    if lex_rows <= BROADCAST_ROWS:
        mark = lex.sparkSession.range(1).select(F.lit(OWN).cast("long").alias("code"))
        found = each.join(F.broadcast(lex.unionByName(mark)), "code", "left_semi")
    else:
        found = each.filter(F.col("code") != OWN).join(lex, "code", "left_semi").unionByName(each.filter(F.col("code") == OWN))
    grouped = found.groupBy(*keys).agg(F.collect_list(F.when(F.col("code") != OWN, F.col("code"))).alias("band"),
                                       F.first("held", ignorenulls=True).alias("held"))
    enough = (F.size("band") > 0) & (F.size("band") * SCARCE >= F.size("held.all"))
    kept = grouped.select(*keys, "held.carried", once(F.when(enough, F.sort_array("band")).otherwise(F.col("held.all"))).alias("kept"))
    return kept.select(*keys, signatures(F.col("kept")).alias("sig"), "carried")


def _held_type(words: DataFrame) -> str:
    return words.select(F.struct("all", "carried").alias("h")).schema["h"].dataType.simpleString()


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) per row: the fingerprints of the text and of its
    edited text (see :func:`edited`, with the next document in descending id
    order), and the likeness of the first to the second and to the next
    document's.

    Null texts count as empty; an only row is its own next document; repeated
    rows come as often as they are; an empty table gives no rows.  Texts cross
    the network once."""
    lex = settled(lexicon(docs, text, low, high))
    n_lex = lex.count()
    rows = with_next(docs, id_col, text).withColumn("changed", edited(F.col("text"), F.col("next")))
    info = F.struct("id", "next_range", "next_at", F.char_length("text").cast("long").alias("n_chars"),
                    F.sha2("changed", 256).alias("edited_sha256"))
    both = rows.withColumn("info", info).select("range", "at", "info", F.explode(F.array(
        F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("changed").alias("t")))).alias("x")) \
        .select("range", "at", "info", "x.v", "x.t")
    sig = fingerprints(both, lex, ["range", "at", "v"], F.col("t"), F.when(F.col("v") == 0, F.col("info")), n_lex)
    pair = settled(sig.groupBy("range", "at").agg(F.max(F.when(F.col("v") == 0, F.col("sig"))).alias("own"),
                                                  F.max(F.when(F.col("v") == 1, F.col("sig"))).alias("changed"),
                                                  F.first("carried", ignorenulls=True).alias("info")))
    nxt = pair.select(F.col("range").alias("next_range"), F.col("at").alias("next_at"), F.col("own").alias("next_own"))
    joined = pair.select("info.*", "own", "changed").join(nxt, ["next_range", "next_at"])
    return joined.select(F.col("id").alias(id_col), "n_chars", "edited_sha256",
                         F.array_join("own", ".").alias("fingerprint"), F.array_join("changed", ".").alias("edited_fingerprint"),
                         likeness(F.col("own"), F.col("changed")).alias("near_edited"),
                         likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def oracle_sql(low: float = LOW, high: float = HIGH) -> str:
    """DuckDB SQL for :func:`report` on ``documents``, from the definitions."""
    sigs = ", ".join(f"""substr(md5(coalesce(array_to_string(list_filter(ps, lambda p: (p & {mask(j)}) = 0), ' '), '')), 1, {DIGITS})""" for j in range(SUBSETS))
    empty = f"substr(md5(''), 1, {DIGITS})"
    same = " + ".join(f"(a[{j}] <> {empty} AND a[{j}] = b[{j}])::INT" for j in range(1, SUBSETS + 1))
    filled = " + ".join(f"(a[{j}] <> {empty} OR b[{j}] <> {empty})::INT" for j in range(1, SUBSETS + 1))
    like = lambda a, b: f"CASE WHEN ({filled}) = 0 THEN 1.0 ELSE ({same})::DOUBLE / ({filled}) END".replace("a[", f"{a}[").replace("b[", f"{b}[")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt,
              coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
       FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, next_id, n, text, substr(text, 1, n - n // 3) || substr(nxt, 1, n // 3) AS changed FROM nx),
v AS (SELECT doc_id, 0 AS v, text AS t FROM e UNION ALL SELECT doc_id, 1, changed FROM e),
t AS (SELECT DISTINCT doc_id, v, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS term FROM v),
hs AS (SELECT DISTINCT term, ('0x' || substr(md5(term), 1, {BITS // 4}))::BIGINT AS code FROM t),
w AS (SELECT doc_id, v, code FROM t JOIN hs USING (term)),
g AS (SELECT d.doc_id, min(code) AS grp FROM d LEFT JOIN w ON w.doc_id = d.doc_id AND v = 0 GROUP BY d.doc_id),
wt AS (SELECT doc_id, CASE WHEN grp IS NOT NULL AND count(*) OVER (PARTITION BY grp) * {HOT} >= (SELECT count(*) FROM d)
              THEN floor({UNIT} / count(*) OVER (PARTITION BY grp))::BIGINT ELSE {UNIT} END AS weight FROM g),
nn AS (SELECT sum(weight) // {UNIT} AS n FROM wt),
lex AS (SELECT code FROM w JOIN wt USING (doc_id) WHERE v = 0 GROUP BY code
        HAVING sum(weight) BETWEEN greatest(2, ceil({low} * (SELECT n FROM nn))) * {UNIT} AND greatest(2, floor({high} * (SELECT n FROM nn))) * {UNIT}),
c AS (SELECT doc_id, v, list(w.code ORDER BY w.code) AS everything, list(lex.code ORDER BY lex.code) FILTER (lex.code IS NOT NULL) AS inside
      FROM w LEFT JOIN lex USING (code) GROUP BY ALL),
k AS (SELECT doc_id, v, CASE WHEN len(inside) > 0 AND len(inside) * {SCARCE} >= len(everything) THEN inside ELSE everything END AS ps
      FROM v LEFT JOIN c USING (doc_id, v)),
s AS (SELECT doc_id, v, [{sigs}] AS sig FROM k)
SELECT e.doc_id, n AS n_chars, sha256(changed) AS edited_sha256, array_to_string(o.sig, '.') AS fingerprint,
       array_to_string(h.sig, '.') AS edited_fingerprint, {like('o.sig', 'h.sig')} AS near_edited, {like('o.sig', 'x.sig')} AS near_next
FROM e JOIN s o ON o.doc_id = e.doc_id AND o.v = 0 JOIN s h ON h.doc_id = e.doc_id AND h.v = 1
JOIN s x ON x.doc_id = e.next_id AND x.v = 0"""
