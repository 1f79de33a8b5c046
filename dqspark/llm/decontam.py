"""Benchmark decontamination by a prefix-filtered set join, in built-in expressions alone.

An item's windows are its runs of consecutive words. A document can only hold a window
if it holds each of the window's shingles, so one shingle is a sufficient prefix: of each
window the rarest, by occurrences in all documents. Documents send on just the places
where such a shingle stands, each with the few words around it; these meet the items by
the shingle. Around a meeting the equal words are counted to both sides (within the item,
the document and the window's length: the positional and length bounds), and a run as
long as a window proves it word by word.

Nulls and empty texts have no words; they hold nothing, and such an item has no window.
Repeated documents are judged alike, repeated items each count. A null doc_id keeps its
row. An empty table of either kind gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dqspark.llm import bloom
from dqspark.llm.common import ascii_lower, cut, stored

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 2
#: Shingles that may stand as a set inside an expression, and item words that may be broadcast;
#: larger benchmarks are a Bloom filter, of so many bits at most, and joined by a shuffle.
MAX_INLINE = 50_000
MAX_BROADCAST_WORDS = 2_000_000
MAX_BITS, RATE = 1 << 26, 0.001

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Maximal runs of 0-9, a-z and characters outside ASCII, after A-Z became a-z."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BREAK), lambda w: w != "")


def _shingles(w: Column, at: Column, size: int) -> Column:
    parts = [F.get(w, at)]
    for k in range(1, size):
        parts += [F.lit(" "), F.get(w, at + k)]
    return F.concat(*parts)


def _run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal, one by one."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    broken = F.array_position(same, F.lit(False))
    return F.when(broken > 0, broken.cast("int") - 1).otherwise(F.size(same))


def _prefixes(documents: DataFrame, items: DataFrame, window: int, size: int) -> DataFrame:
    """(shingle, item_key, at, need, item_words, m) for each window's rarest shingle, size words long."""
    last = F.greatest(F.col("m") - F.col("need"), F.lit(0))
    spread = items.where((F.col("m") >= size) if size > 1 else F.lit(True)).select(
        "item_key", "item_words", "m", "need",
        F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - size), lambda k: _shingles(F.col("item_words"), k, size))).alias("at", "shingle"),
    )
    known = cut(spread.select("shingle").distinct())
    put, doubtful = _places(known, known.count(), size, context=0)
    places = documents.select(F.inline(put)).select("shingle")
    places = places.join(known, "shingle", "left_semi") if doubtful else places
    occurring = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(occurring, "shingle", "left").select("item_key", "at", "shingle", F.coalesce("df", F.lit(0)).alias("df"))
    # a window's shingles are few: each shingle goes to the windows that contain it
    offers = ranked.join(items.select("item_key", "m", "need"), "item_key").select(
        "item_key", "at", "shingle", "df",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") + size - F.col("need")), F.least(F.col("at"), last))).alias("start"),
    )
    chosen = offers.groupBy("item_key", "start").agg(F.min(F.struct("df", "shingle", "at")).alias("best"))
    chosen = chosen.select("item_key", F.col("best.shingle").alias("shingle"), F.col("best.at").alias("at"))
    return chosen.distinct().join(items, "item_key")


def _places(shingles: DataFrame, n: int, size: int, context: int) -> tuple[Column, bool]:
    """An array of the places in _words where one of the n shingles stands: (at, shingle, left, right); and whether others may be among them.

    left: up to context words before it, nearest first; right: as many from its end on. Few
    shingles are a set inside the expression, many a Bloom filter, whose few errors a join must take out.
    """
    w = F.col("_words")
    if n <= MAX_INLINE:
        inline = [r["shingle"] for r in shingles.collect()]
        known = lambda s: s.isin(*inline)
    else:
        known = bloom.build(shingles.select(F.col("shingle").alias("key")), n, RATE, most=MAX_BITS).contains
    places = F.filter(F.sequence(F.lit(0), F.size(w) - size), lambda k: known(_shingles(w, k, size))) if n else F.array().cast("array<int>")
    around = lambda k: [
        F.reverse(F.slice(w, F.greatest(k - context, F.lit(0)) + 1, F.least(k, F.lit(context)))).alias("left"),
        F.slice(w, k + size + 1, F.lit(context)).alias("right"),
    ]
    put = F.transform(places, lambda k: F.struct(k.alias("at"), _shingles(w, k, size).alias("shingle"), *(around(k) if context else [])))
    return F.when(F.size(w) >= size, put), n > MAX_INLINE


def hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents with n_words instead of their text, and (_doc, item_id, start, end): runs of document words equal to windows of an item.

    documents: with _doc, any value that names a row; benchmark: item_id and text. After the
    shingles are counted, one more pass over the texts gives both.
    """
    items = benchmark.select("item_id", F.monotonically_increasing_id().alias("item_key"), words(F.col("text")).alias("item_words"))
    items = items.withColumn("m", F.size("item_words")).where("m > 0").withColumn("need", F.least("m", F.lit(window)))
    items = cut(items)
    kept = [c for c in documents.columns if c != text]
    docs = documents.select(*kept, words(F.col(text)).alias("_words"))
    total = items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    passes = []
    for size in (SHINGLE, 1):
        own = items.where(F.col("need") >= SHINGLE) if size == SHINGLE else items.where(F.col("need") < SHINGLE)
        if own.head(1):
            prefixes = cut(_prefixes(docs.select("_words"), own, window, size))
            shingles = cut(prefixes.select("shingle").distinct())
            passes.append((size, prefixes, shingles, *_places(shingles, shingles.count(), size, window - size)))
    read = stored(docs.select(*kept, F.size("_words").cast("long").alias("n_words"), *[put.alias(f"_places{size}") for size, *_, put, _ in passes]))
    out = None
    for size, prefixes, shingles, _, doubtful in passes:
        places = read.select("_doc", F.inline(f"_places{size}"))
        places = places.join(shingles, "shingle", "left_semi") if doubtful else places
        sides = prefixes.select(
            F.col("shingle"), "item_id", "need",
            F.reverse(F.slice("item_words", F.greatest(F.col("at") - (window - size), F.lit(0)) + 1, F.least(F.col("at"), F.lit(window - size)))).alias("item_left"),
            F.slice("item_words", F.col("at") + size + 1, F.lit(window - size)).alias("item_right"),
        )
        sides = F.broadcast(sides) if total <= MAX_BROADCAST_WORDS else sides
        met = places.join(sides, "shingle").withColumn("l", _run(F.col("left"), F.col("item_left"))).withColumn("r", _run(F.col("right"), F.col("item_right")))
        found = met.where(F.col("l") + F.col("r") + size >= F.col("need")).select(
            "_doc", "item_id", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + size + F.col("r")).alias("end")
        )
        out = found if out is None else out.unionAll(found)
    if out is None:
        nothing = [F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0).alias("end")]
        out = read.where(F.lit(False)).select("_doc", *nothing)
    return read.select(*kept, "n_words"), out


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit: words inside any occurrence of a window; items_sha256: of the ids of the items
    with an occurring window, sorted as strings and joined by commas. Items of one id count
    once, those without an id not.
    """
    # rows of one id and one text share their hits, whatever order they are read in
    marked = documents.select("doc_id", "text", F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("_doc"))
    base, found = hits(marked, benchmark, window)
    runs = found.groupBy("_doc", "start").agg(F.max("end").alias("end"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    spans = runs.groupBy("_doc").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    per_doc = spans.select("_doc", covered.alias("n_hit"), "items")
    none = F.array().cast("array<string>")
    return base.join(per_doc, "_doc", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
