"""Document fingerprints by SpotSigs, in DataFrame operations only.

A spot signature is a common word (the anchor) with the chain of the next CHAIN content words after it,
content words being all that are not common; of several common words in a row each is an anchor. A
document's fingerprint is the set of its signatures' hashes.

Sets are compared by a pruned Jaccard similarity: partitioned by set length, as sets of lengths m <= n
reach a similarity t only if m >= t n, so that a set is held only against its own partition and its
neighbours, and there only if the lengths allow it; a similarity below t counts as none. The self-join
of near_duplicates takes t = 0.8 and meets only sets that share one of their rarest signatures; the
likeness of stated pairs takes t = LEAST_LIKENESS.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let, positional
from .components import connected_components

#: Common words of English, German, French and Spanish that may be anchors.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were which with "
    "auch auf das dem den der des die ein eine für im ist mit nicht sich sie und von zu "
    "au avec ce dans de des du en est et il la le les ne pas pour que qui sur un une "
    "al como con del el es la las lo los más no para por que se su una y"
).split()
ANCHORS = tuple(sorted(set(ANCHORS)))
CHAIN = 3
#: Fixed value: what parts words.
APART = r"[\x09-\x0D\x20!-/:-@\[-`{-~]+"
SIMILARITY = 0.8
#: Least likeness of a stated pair that counts.
LEAST_LIKENESS = 0.1
#: Rows of an ordered window's bucket, about, and the most buckets (whose table goes to every task, some 64
#: bytes each); beyond, buckets hold more rows.
BUCKET_ROWS, MOST_BUCKETS = 4096, 200_000
#: How often a bucket that holds over CROWDED times its rows is cut again.
CUTS, CROWDED = 6, 4


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The sorted distinct signature hashes (array of long) of a text; of a text without signatures,
    one hash of all its words, so that only equal sequences of words look alike. Letters are lower-cased."""

    def marked(w):  # an anchor ends with a space, a content word with a line feed; words have neither
        return F.when(w == "", w).when(w.isin(*ANCHORS), F.concat(w, F.lit(" "))).otherwise(F.concat(w, F.lit("\n")))

    def of(parts):
        groups = F.split(F.array_join(F.transform(parts, marked), ""), "\n", -1)  # a content word each, its anchors before it
        whole = F.array(F.xxhash64(F.trim(F.array_join(parts, " "))))
        return let(let(groups, spots), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

    def spots(groups):
        n = F.size(groups) - 1  # the last has no content word
        words = F.transform(groups, lambda g: F.xxhash64(F.substring_index(g, " ", -1)))

        def at(h):
            def one(g, j):
                follow = F.xxhash64(*[F.get(h, j + i) for i in range(chain)])
                here = lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), lambda a: F.xxhash64(a, follow))
                return F.when((j + chain <= n) & g.contains(" "), let(F.split(g, " ", -1), here))

            found = F.filter(F.transform(groups, one), lambda x: x.isNotNull())
            return F.sort_array(F.array_distinct(F.flatten(found)))

        return let(words, at)

    return let(F.split(F.lower(text), APART, -1), of)


def partition(n: Column, least: float) -> Column:
    """The length partition of sets of n elements: bounds grow by 1 / least, so that sets which can reach the
    similarity `least` lie in one partition or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / least)) + F.lit(1e-9)).cast("int")


def jaccard(a: Column, b: Column, least: float) -> Column:
    """Pruned Jaccard similarity of two sorted arrays of distinct elements, neither of them empty: 0 if their
    partitions or their lengths rule out `least`, or if it is not reached; equal sets are not compared."""
    m, n = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    value = both / (m + n - both)
    near = F.abs(partition(m, least) - partition(n, least)) <= 1
    near = near & (F.least(m, n) >= F.greatest(m, n) * least - 1e-9)
    return F.when(a == b, F.lit(1.0)).when(near, let(value, lambda v: F.when(v >= least - 1e-12, v).otherwise(F.lit(0.0)))).otherwise(F.lit(0.0))


def printed(sigs: Column) -> Column:
    """A fingerprint as text: its signatures in ascending order, 16 hex digits each."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """doc_id, n_signatures, signatures (array of long) for every row. Null and empty texts share one
    fingerprint. Repeated rows and ids stay; other columns are ignored."""
    plain, i, t = positional(docs, id_col, text_col)
    sigs = signatures(F.coalesce(plain[t].cast("string"), F.lit("")), chain)
    return plain.select(plain[i].alias("doc_id"), sigs.alias("signatures")).select("doc_id", F.size("signatures").alias("n_signatures"), "signatures")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, chain: int = CHAIN
) -> DataFrame:
    """Classes of documents whose signature sets reach a Jaccard similarity of at least `least`: one
    row for each row of docs, doc_id and component_id (least doc_id of the class).

    Equal sets are one node. Sets are dealt out by length partition (bounds grow by 1 / least) and
    each of their rarest len - ceil(least len) + 1 signatures: two sets that reach the similarity share one
    of those, in the same partition or in neighbouring ones. Null ids stay null and name a class only
    without others. An empty table gives an empty result.
    """
    marked = fingerprints(docs, id_col, text_col, chain).withColumn("set", F.xxhash64("signatures"))
    sets = marked.groupBy("set").agg(F.min("doc_id").alias("least_id"), F.first("signatures").alias("signatures"))
    rare = sets.select(F.explode("signatures").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = (
        sets.select("set", F.size("signatures").alias("n"), F.explode("signatures").alias("sig"))
        .join(rare, "sig", "left")
        .groupBy("set", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "sig"))).alias("order"))
    )
    band = partition(F.col("n"), least)
    prefix = F.slice("order", 1, F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    keyed = ranked.select("set", "n", band.alias("band"), F.explode(prefix).alias("x")).where("x.df > 1").select("set", "n", "band", "x.sig")
    left = keyed.select(F.col("set").alias("u"), F.col("n").alias("nu"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = keyed.select(F.col("set").alias("v"), F.col("n").alias("nv"), "sig", "band")
    pairs = left.join(right, ["sig", "band"]).where(
        ((F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))) & (F.col("nu") >= F.col("nv") * least - 1e-9)
    ).select("u", "v").distinct()
    a = sets.select(F.col("set").alias("u"), F.col("signatures").alias("su"))
    b = sets.select(F.col("set").alias("v"), F.col("signatures").alias("sv"))
    links = pairs.join(a, "u").join(b, "v").where(jaccard(F.col("su"), F.col("sv"), least) > 0).select("u", "v")
    roots = connected_components(links).withColumnRenamed("node", "set")
    named = sets.select("set", "least_id").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
    least_of = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return marked.select("doc_id", "set").join(named.join(least_of, "root").select("set", "component_id"), "set").select("doc_id", "component_id")


def _cuts(ids: DataFrame, bucket_rows: int):
    """How rows with the columns o (long) and h (long) are dealt to ordered buckets of about bucket_rows rows:
    a function that adds the column b, an array that orders as (o, nulls last, h) does.

    The range of o is cut evenly; a bucket that holds too many rows is cut again, by its own range, or by
    h if it has one value of o only. Places are worked out in floating point, which keeps the order
    whatever the values. Rows equal in both stay together.
    """
    whole = ids.agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi")).first()
    rows_of = max(bucket_rows, -(-whole["n"] // MOST_BUCKETS))
    pieces = max(1, -(-whole["n"] // rows_of))
    lo, hi = (float(whole[k]) if whole[k] is not None else 0.0 for k in ("lo", "hi"))

    def place(share: Column, pieces: Column) -> Column:
        return F.least(F.floor(F.greatest(share, F.lit(0.0)) * pieces), pieces - 1).cast("int")

    first = place((F.col("o").cast("double") - lo) / max(hi - lo, 1.0), F.lit(pieces))
    first = F.array(F.coalesce(first, F.lit(pieces)))
    levels = []

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("b", first)
        for crowded in levels:
            met = rows.join(F.broadcast(crowded), rows["b"] == crowded["of"], "left")
            o, h = F.col("o").cast("double"), (F.col("h").cast("double") + 2.0**63) / 2.0**64
            spread = F.col("hi") > F.col("lo")
            share = F.when(spread, (o - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(h)
            further = F.when(F.col("of").isNotNull(), F.array(place(share, F.col("pieces")))).otherwise(F.array().cast("array<int>"))
            rows = met.withColumn("b", F.concat("b", further)).drop(*crowded.columns)
        return rows

    for _ in range(CUTS):
        sizes = dealt(ids).groupBy("b").agg(
            F.count(F.lit(1)).alias("n"), F.min("o").cast("double").alias("lo"), F.max("o").cast("double").alias("hi")
        )
        crowded = sizes.where(F.col("n") > CROWDED * rows_of)
        crowded = durable(crowded.select(F.col("b").alias("of"), "lo", "hi", F.ceil(F.col("n") / rows_of).cast("int").alias("pieces")))
        if crowded.isEmpty():
            break
        levels.append(crowded)
    return dealt


def with_next(rows: DataFrame, order: str, text: str, take, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The columns order and text of rows, the named columns that `take` makes of the text, and text and these
    of the row that follows, as next_<name>: by `order`, a long (nulls last), ties by the text's hash and
    the text; after the last row the first.

    Rows are dealt to ordered buckets and sorted there, in one shuffle; the first row of each bucket also
    goes to the bucket before. Where buckets begin comes from a scan of the order and of the hashes.
    """
    rows = rows.select(F.col(order).alias("o"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    dealt = _cuts(rows.select("o", "h"), bucket_rows)
    here = F.struct(F.col("o").isNull().alias("nameless"), "o", "h")
    firsts = dealt(rows.select("o", "h")).groupBy("b").agg(F.min(here).alias("first"))
    one = Window.partitionBy(F.lit(1))  # one row for each bucket
    before = F.coalesce(F.lag("b").over(one.orderBy("b")), F.max("b").over(one))
    firsts = durable(firsts.select(F.col("b").alias("of"), "first", before.alias("before")))
    own = dealt(rows)
    own = own.join(F.broadcast(firsts), own["b"] == F.col("of"))
    home = F.struct("b", F.lit(False).alias("lent"))
    away = F.struct(F.col("before").alias("b"), F.lit(True).alias("lent"))
    both = F.when(here.eqNullSafe(F.col("first")), F.array(home, away)).otherwise(F.array(home))
    every = own.select("o", "t", "h", F.explode(both).alias("x")).select("o", "t", "h", "x.b", "x.lent").repartition("b")
    made = every.select("*", *[c.alias(n) for n, c in take(F.col("t")).items()])
    names = list(take(F.col("t")))
    follow = Window.partitionBy("b").orderBy("lent", F.col("o").asc_nulls_last(), "h", "t")
    out = made.select("*", *[F.lead(c).over(follow).alias(f"next_{n}") for n, c in ((text, "t"), *zip(names, names))])
    out = out.where(~F.col("lent"))
    return out.select(F.col("o").alias(order), F.col("t").alias(text), *names, *[f"next_{n}" for n in (text, *names)])


def edited_likeness(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, least: float = LEAST_LIKENESS
) -> DataFrame:
    """Every document's fingerprint against that of its edited text and of the next document.

    The edited text's last floor(n_chars / 4) code points are the first as many (or all) of the next
    document's, by ascending id; the first follows the last. A likeness of less than `least` is 0. Null texts
    are empty; texts without signatures are like equal ones only. Rows without an id come after all others;
    rows with equal ids are ordered by the hash of their text, rows equal in both are interchangeable. One
    row has itself as its next. Empty tables give empty results; other columns are ignored.
    """
    plain, i, t = positional(docs, id_col, text_col)
    rows = plain.select(plain[i].cast("long").alias("doc_id"), F.coalesce(plain[t].cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text", lambda x: {"sigs": signatures(x, chain)}, BUCKET_ROWS)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs")
    rows = rows.withColumn("edited_sigs", signatures(F.col("edited"), chain))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("sigs")).alias("fingerprint"),
        printed(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs"), least).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs"), least).alias("near_next"),
        partition(F.size("sigs"), least).alias("length_partition"),
    )
