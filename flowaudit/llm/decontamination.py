"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, functions as F


#: Items up to which the sketches are sent to all executors (each is at most a few KB); beyond it all joins shuffle.
BROADCAST_ITEMS = 20_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Distinct hashes of the ``width``-word shingles; fewer words are one shingle; no words, none.

    ``words`` is bound to a lambda variable, so that it is computed once per text and not once per shingle.
    """

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return (F.when(F.size(w) >= width, F.array_distinct(many))
                .when(F.size(w) > 0, F.array(F.xxhash64(w)))
                .otherwise(F.array().cast("array<bigint>")))

    return F.get(F.transform(F.array(words), of), F.lit(0))


def item_sketches(items: DataFrame, width: int, percent: int) -> DataFrame:
    """(item_id, shingles, n_item, need, sketch): items by size class, each with the smallest of its hashes.

    In a class of sizes [2^k, 2^(k+1)) every item keeps as many minima as its class needs: of n shingles a containing
    document holds ``need`` at least, so it holds one of any n - need + 1 of them. The sketch of the
    short side alone decides: sizes of documents don't dilute it, and no containment is missed.
    """
    made = items.select("item_id", shingles_of(words_of(F.col("text")), width).alias("shingles"))
    made = made.withColumn("n_item", F.size("shingles").cast("long")).where("item_id is not null and n_item > 0")
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1) - 1
    made = made.withColumn("need", F.ceil(F.col("n_item") * percent / F.lit(100)).cast("long"))
    minima = F.least(F.col("n_item"), F.floor(largest * (100 - percent) / F.lit(100)) + 1).cast("int")
    # ordered by a second hash, so that the order is independent of the hash that names a shingle
    mixed = F.array_sort(F.transform("shingles", lambda x: F.struct(F.xxhash64(x).alias("rank"), x.alias("shingle"))))
    return made.withColumn("sketch", F.slice(F.transform(mixed, lambda x: x["shingle"]), F.lit(1), minima))


def contained_items(documents: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds ``percent`` of the word shingles or more.

    Documents are cut into words and shingles once; a shingle meets only the sketches of items. A document
    that holds a sketch value is a candidate for that item, and its whole shingle set is then intersected with the
    item's. Documents aren't shuffled: only the verified pairs are grouped.

    Defined results: null or empty texts hold nothing and are held by nothing; items below ``width`` words are one shingle,
    held by documents with exactly these words; null ids are left out; repeated rows give one pair; other columns are ignored.
    """
    sketches = item_sketches(items, width, percent)
    docs = documents.where("doc_id is not null").select("doc_id", shingles_of(words_of(F.col("text")), width).alias("own"))
    hits = sketches.select("item_id", F.explode("sketch").alias("shingle"))
    whole = sketches.select("item_id", "shingles", "n_item", "need")
    small = items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    if small:
        found = docs.select("doc_id", "own", F.explode_outer("own").alias("shingle")).join(F.broadcast(hits), "shingle").join(F.broadcast(whole), "item_id")
    else:
        candidates = docs.select("doc_id", F.explode("own").alias("shingle")).join(hits, "shingle").select("doc_id", "item_id").distinct()
        found = candidates.join(whole, "item_id").join(docs, "doc_id")
    shared = F.size(F.array_intersect("shingles", "own")).cast("long")
    verified = found.where(F.size("own") >= F.col("need")).select("doc_id", "item_id", shared.alias("n_shared"), "n_item", "need").where("n_shared >= need")
    return verified.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def remove_contaminated(documents: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without those that hold an item; rows with a null doc_id stay."""
    held = contained_items(documents, items, width, percent).select("doc_id").distinct()
    return documents.join(held, "doc_id", "left_anti").select(documents.columns)
