"""Benchmark decontamination by a prefix-filtered set join, built from DataFrame operations only.

An item window is ``window`` consecutive words of an item (an item of fewer words, but not none, is one window). A window
is a set of shingles with fixed places. Since all of them have to be there, one shingle is a necessary prefix: the rarest
by its count in all documents. Only that one generates candidates; length and position bound where the window can lie;
each candidate is then verified by finding every other shingle at its place. Shingles are compared as strings, so a match
is exact.

The one pass over the texts keeps only places whose shingle occurs in some item. The items' shingles are broadcast when
they are counted to be few (``broadcast_rows``); otherwise the same join shuffles both sides.

Defined results: a null text has no words; repeated rows of the same id and text are searched once and returned each; null ids group as one
more id value; an empty item matches nothing; without items every document is clean; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import materialise

#: Words as they are before lower-casing A-Z, which changes no boundary.
WORD = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: At most so many item shingles are broadcast (under 100 bytes each).
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, SMALL))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(WORD), F.lit(1))


def shingles(word_list: str, width: int) -> Column:
    """Every ``width`` consecutive words, joined by a blank (which no word holds)."""
    last = F.size(word_list) - width
    each = [f"element_at({word_list}, i + {k + 1})" for k in range(width)]
    joined = F.expr(f"transform(sequence(0, greatest(size({word_list}) - {width}, 0)), i -> concat_ws(' ', {', '.join(each)}))")
    return F.when(last >= 0, joined).otherwise(F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows: their words as one string, length and shingle width, and one row per item that has it."""
    listed = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - size + 1))
    return listed.select("item_id", "w", size.alias("len"), starts.alias("s")).select(
        "item_id", F.concat_ws(" ", F.slice("w", F.col("s"), F.col("len"))).alias("win"), "len"
    ).distinct()


def find(documents: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sizes, matches, windows)``: words per document and how many rows it has; verified (doc_id, rid, start, win, len); windows by item."""
    windows = materialise(item_windows(items, window), "windows")
    each = materialise(
        windows.select("win", "len").distinct().select("win", "len", F.split("win", " ").alias("w"), F.least("len", F.lit(shingle)).alias("width")), "patterns"
    )
    widths = sorted(r["width"] for r in each.select("width").distinct().collect())  # at most ``shingle`` rows

    parts = [each.where(F.col("width") == n).select("win", "len", "width", F.posexplode(shingles("w", n)).alias("offset", "sh")) for n in widths]
    needles = materialise(reduce(DataFrame.unionByName, parts), "needles") if parts else None
    source = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), words(F.col("text")).alias("w"))
    found = []
    for n in widths or [shingle]:
        marker = n == (widths or [shingle])[0]  # the first pass also leaves a row with each document's length
        own = F.array(F.lit(None).cast("string")) if marker else F.array().cast("array<string>")
        places = source.select("doc_id", "rid", F.size("w").alias("n_words"), F.posexplode(F.concat(own, shingles("w", n))).alias("p", "sh"))
        places = places.withColumn("p", F.col("p") - int(marker))
        if needles is None:
            found.append(places.where("p < 0"))
            continue
        wanted = needles.where(F.col("width") == n).select(F.col("sh").alias("wanted")).distinct()
        if needles.count() <= broadcast_rows:
            wanted = F.broadcast(wanted)
        joined = places.join(wanted, F.col("sh") == F.col("wanted"), "left" if marker else "inner")
        found.append(joined.where("p < 0 or wanted is not null").select("doc_id", "rid", "n_words", "p", "sh"))
    places = materialise(reduce(DataFrame.unionByName, found), "places")
    sizes = places.where("p < 0").groupBy("doc_id", "rid", "n_words").agg(F.count("*").cast("int").alias("rows"))
    if needles is None:
        empty = places.where("1 = 0").select("doc_id", "rid", F.col("p").alias("start"), F.col("sh").alias("win"), F.col("p").alias("len"))
        return sizes, empty, windows
    # a repeated row gives its places twice; a place is one fact
    places = places.where("p >= 0").select("doc_id", "rid", "n_words", "p", "sh")

    counts = places.groupBy("sh").count()
    rank = Window.partitionBy("win").orderBy("count", "sh", "offset")
    prefix = materialise(
        needles.join(counts, "sh").withColumn("r", F.row_number().over(rank)).where("r = 1").select("win", "len", "width", "offset", "sh"), "prefix"
    )
    start = F.col("p") - F.col("offset")
    candidates = places.join(prefix, "sh").where((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("doc_id", "rid", start.alias("start"), "win", "len", "width").distinct()
    w = F.split("win", " ")
    expected = [
        candidates.where(F.col("width") == n).withColumn("w", w).select("doc_id", "rid", "start", "win", "len", F.posexplode(shingles("w", n)).alias("offset", "sh"))
        for n in widths
    ]
    expected = reduce(DataFrame.unionByName, expected).withColumn("p", F.col("start") + F.col("offset"))
    there = places.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), F.col("p").alias("q"), F.col("sh").alias("s")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")) & (F.col("p") == F.col("q")) & (F.col("sh") == F.col("s"))
    needed = F.col("len") - F.least("len", F.lit(shingle)) + 1
    matches = expected.join(there, same).groupBy("doc_id", "rid", "start", "win", "len").agg(F.count("*").alias("n")).where(F.col("n") == needed)
    return sizes, matches.select("doc_id", "rid", "start", "win", "len"), windows


def contamination(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence), item_ids (sorted strings), contaminated, and the hash of id and text."""
    sizes, matches, windows = find(documents, items, **options)
    matches = materialise(matches, "matches")
    # covered words: spans sorted by start, each adds what lies beyond the furthest end so far
    spans = matches.select("doc_id", "rid", "start", "len").distinct().groupBy("doc_id", "rid").agg(
        F.expr("aggregate(array_sort(collect_list(struct(start, start + len as stop))), struct(0L as hit, 0 as upto), (a, x) -> struct(a.hit + greatest(x.stop - greatest(x.start, a.upto), 0) as hit, greatest(a.upto, x.stop) as upto)).hit").alias("n_hit")
    )
    items_of = matches.select("doc_id", "rid", "win").distinct().join(windows.select("win", F.col("item_id").cast("string").alias("item")), "win")
    listed = items_of.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    both = spans.join(listed.withColumnsRenamed({"doc_id": "d", "rid": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left").drop("d", "r")
    both = both.withColumnsRenamed({"doc_id": "d", "rid": "r"})
    return sizes.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left").select(
        "*", F.explode(F.array_repeat(F.lit(0), F.col("rows")))  # a row for each repeated one
    ).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "rid",
    )
