"""Vector, keyword and hybrid retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import similarity as S
from verdigris.operators import nearest as N
from verdigris.sources.shared import written

#: A search of a stored index of texts: (queries, limit or none, items) -> (qid, id, score).
Search = Callable[[DataFrame, int | None, DataFrame | None], DataFrame]


def top_k(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each query. Rows beyond k in an input partition are dropped before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def vector_scores(queries: DataFrame, items: DataFrame, least: float | None = None) -> DataFrame:
    """(qid, id, score): cosine of every query with every item, or those of ``least`` or more. queries: (qid, vector); items:
    (id, vector). Null vectors and vectors of another length than the query's are left out; one without length scores 0."""
    return N.scored(queries, items, least=least)


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k items with the best of these scores of each query, ties by id: (qid, id, score, rank)."""
    return top_k(N.scored(queries, items, k), "qid", "score", "id", k)


def shared_runs(docs: DataFrame, items: DataFrame, key: str, item_key: str, n: int, small: int = 1_000_000) -> DataFrame:
    """(key, item_key, shared): how many distinct runs of n words each document shares with each item; pairs without any are
    left out. Both have a column ``text``. Up to ``small`` runs of items are sent to all executors, so that the documents'
    runs meet them where they are; with more, documents' runs that no item has are dropped by their 64-bit hash before the
    join on the runs themselves."""
    runs = lambda df, k: df.select(F.col(k), F.explode(S.word_ngrams(S.tokens(F.col("text")), n)).alias("run"))
    theirs, mine = runs(items, item_key), runs(docs, key)
    if theirs.limit(small + 1).count() <= small:
        theirs = F.broadcast(theirs)
    else:
        hashes = theirs.select(F.xxhash64("run").alias("hash")).distinct()
        mine = mine.withColumn("hash", F.xxhash64("run")).join(hashes, "hash", "left_semi").drop("hash")
    return mine.join(theirs, "run").groupBy(key, item_key).agg(F.count("*").alias("shared"))


def fuse(vectors: DataFrame, keywords: DataFrame, weight: float = 0.7, least: float = 0.0) -> DataFrame:
    """Full outer join of two scored lists; a missing score is 0. Returns qid, id, score of ``least`` or more."""
    v = vectors.select("qid", "id", F.col("score").alias("v"))
    k = keywords.select("qid", "id", F.col("score").alias("k"))
    both = v.join(k, ["qid", "id"], "full_outer")
    score = weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("k", F.lit(0.0))
    return both.select("qid", "id", score.alias("score")).where(F.col("score") >= least)


def hybrid(queries: DataFrame, items: DataFrame, words: Search, limit: int = 10, weight: float = 0.7, least: float = 0.5) -> DataFrame:
    """The ``limit`` best items of each query by vectors and words together: (qid, id, score, rank). queries: (qid, vector,
    text); items: (id, vector), those that the filters on type, domain or ticker leave; an item whose vector is null is
    found by its words alone. words: the search of the stored index of all texts. Each list goes in with twice the limit; a
    missing score is 0, and a sum below ``least`` isn't shown."""
    near = nearest(queries.select("qid", "vector"), items.select("id", "vector"), 2 * limit)
    found = keyword(queries.select("qid", "text"), items.select("id"), words, 2 * limit)
    return _ranked(fuse(near, found, weight, least), limit)


def keyword(queries: DataFrame, items: DataFrame, words: Search, limit: int) -> DataFrame:
    """The ``limit`` best items that hold all words of a query: (qid, id, score, rank), the score from 0 to 1."""
    found = words(queries, limit, items)
    return _ranked(found.select("qid", "id", (F.col("score") / (1 + F.col("score"))).alias("score")), limit)


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    """Scores that differ only beyond nine digits are ties, which the smaller id wins."""
    return top_k(scored.withColumn("__near", F.round("score", 9)), "qid", "__near", "id", limit).drop("__near")


#: Which type a preset searches, how many it shows, and from which score.
PRESETS = {"field_codes": ("field_code", 5, 0.3), "examples": ("query_example", 3, 0.4)}


def preset(name: str, queries: DataFrame, items: DataFrame, words: Search) -> DataFrame:
    """Hybrid search for one type of items; queries without a vector take the keyword half alone."""
    kind, limit, least = PRESETS[name]
    mine = items.where(F.col("type") == kind)
    by_both = hybrid(queries.where("vector IS NOT NULL"), mine, words, limit, least=least)
    return by_both.unionByName(keyword(queries.where("vector IS NULL").select("qid", "text"), mine.select("id"), words, limit))


def small_to_big(queries: DataFrame, children: DataFrame, words: Search, limit: int = 10, child_limit: int = 30, least: float = 0.0, weight: float = 0.7) -> DataFrame:
    """(qid, id, is_parent, score, matched, rank): the best parents of the ``child_limit`` best children of ``least`` or more,
    scored by vectors and words; for queries without such a parent, the children. children: (id, parent, vector); those
    without a parent are left out. words: an index of all texts, or another search, which is asked for all matches."""
    kids = children.where("parent IS NOT NULL").select("id", "parent", "vector")
    both = _by_both(queries, kids.select("id", "vector"), words, child_limit, weight)
    top = written(_ranked(both, child_limit).drop("rank"), "children")
    big = top.where(F.col("score") >= least).join(kids.select("id", "parent"), "id").groupBy("qid", F.col("parent").alias("id")).agg(F.avg("score").alias("score"), F.count("*").alias("matched"))
    small = top.join(big.select("qid").distinct(), "qid", "left_anti").select("qid", "id", "score", F.lit(1).cast("long").alias("matched"), F.lit(False).alias("is_parent"))
    return _ranked(big.withColumn("is_parent", F.lit(True)).unionByName(small), limit)


def _by_both(queries: DataFrame, items: DataFrame, words: Search, limit: int, weight: float) -> DataFrame:
    """(qid, id, score), among them each query's ``limit`` best by vectors and words together, of items with a vector. With an
    index this is done by blocks of queries and items, and no more than the best leave a block: neither all matches of words nor
    their vectors are made into rows."""
    if hasattr(words, "asked"):
        facts = words.facts()
        halves = lambda theirs, mine: ((at, score / (1 + score)) for at, score in facts.matches(theirs, mine))
        return N.scored(queries.select("qid", "vector"), items, limit, weight=weight, also=(*words.asked(queries.select("qid", "text")), halves))
    asked = queries.select("qid", "vector")
    near = N.scored(asked, items, limit, weight=weight)
    said = words(queries.select("qid", "text"), None, items.select("id")).select("qid", "id", (F.col("score") / (1 + F.col("score"))).alias("k"))
    # The best are among those best by vectors alone and those that hold all words, whose vectors are compared here.
    met = said.join(asked.where("vector IS NOT NULL").withColumnRenamed("vector", "query"), "qid").join(items.where("vector IS NOT NULL"), "id").where("size(vector) = size(query)")
    size = S.norm(F.col("vector")) * S.norm(F.col("query"))
    met = met.select("qid", "id", F.when(size == 0, 0.0).otherwise(S.dot(F.col("vector"), F.col("query")) / size).alias("score"), "k")
    either = near.withColumn("k", F.lit(0.0)).unionByName(met).groupBy("qid", "id").agg(F.max("score").alias("score"), F.max("k").alias("k"))
    return either.select("qid", "id", (weight * F.col("score") + (1 - weight) * F.col("k")).alias("score"))


def containing(docs: DataFrame, needles: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(qid, id): documents that hold a whole needle, without regard to case. docs: (id, text); needles: (qid, needle).

    A text that holds a needle has the needle's inner words, those between two blanks, as words of its own. So a needle's
    longest inner word selects its candidates, in a join on words, and the whole needle is checked afterwards. Needles
    without an inner word are a stated set of queries against all texts. Null and empty needles find nothing."""
    n = needles.where("needle <> ''").select("qid", F.lower("needle").alias("needle"))
    inner = F.filter(F.split("needle", r"\s+"), lambda w, i: (i > 0) & (w != ""))
    inner = F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0)))
    n = n.withColumn("word", F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"])
    keyed, bare = n.where("word IS NOT NULL"), n.where("word IS NULL").drop("word")
    low = docs.select("id", F.lower("text").alias("low")).where("low IS NOT NULL")
    sent = F.broadcast(keyed) if keyed.limit(small + 1).count() <= small else keyed
    by_word = low.select("id", "low", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("word")).join(sent, "word").where(F.contains("low", F.col("needle")))
    by_text = low.join(F.broadcast(bare), F.contains("low", F.col("needle")))  # a stated set of queries
    return by_word.select("qid", "id").union(by_text.select("qid", "id"))


def parents(scored: DataFrame, children: DataFrame, least: float, limit: int) -> DataFrame:
    """Small to big: a parent's score is the mean of its matched children of ``least`` or more. children: (id, parent).
    Returns qid, parent, score, matched, rank; queries without any are left to the caller's fallback."""
    matched = scored.where(F.col("score") >= least).join(children, "id").groupBy("qid", "parent").agg(F.avg("score").alias("score"), F.count("*").alias("matched"))
    return top_k(matched, "qid", "score", "parent", limit)


def recency(score: Column, year: Column, newest: Column) -> Column:
    """5 per cent less for each year behind the newest, at least half; unchanged without a year. Decimal scores stay decimal."""
    return F.when(year.isNull() | newest.isNull(), score).otherwise(score * F.greatest(F.lit(Decimal("0.50")), 1 - F.lit(Decimal("0.05")) * (newest - year)))
