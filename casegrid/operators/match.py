"""Greedy one-to-one matching of extracted to true cases by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casegrid.functions.text import name_tokens
from casegrid.operators.ranks import earlier_max, earlier_sum, ranked
from casegrid.operators.similar import similar_sets
from casegrid.plans.tables import written

THRESHOLD = 0.5
#: Places of a list with several names that a refused row looks ahead in one round.
AHEAD = 64
#: Rows of one name that a single task may sort; longer lists are ranked in chunks.
ONE_TASK = 1_000_000


def _sides(llm: DataFrame, gt: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(by, idx, key, run, words) of the rows that have words: a key is a set of words in one run of ``by``."""
    run = F.concat_ws("\x01", *(F.col(k).cast("string") for k in by)) if by else F.lit("")

    def of(df: DataFrame, name: str) -> DataFrame:
        rows = df.dropna(subset=list(by)) if by else df
        rows = rows.select(*by, F.col("row_idx").cast("bigint").alias(name), run.alias("_run"), F.array_distinct(name_tokens("name")).alias("words"))
        return rows.filter(F.size("words") > 0).withColumn("key", F.concat_ws("\x02", "_run", F.array_join("words", " ")))

    return of(llm, "llm_idx"), of(gt, "gt_idx")


def _alike(a: DataFrame, b: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the keys of either side."""
    keys = lambda df: df.select("key", "_run", "words").dropDuplicates(["key"])
    return similar_sets(keys(a), keys(b), threshold, "_run")


def name_candidates(llm: DataFrame, gt: DataFrame, by: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (by, llm_idx, gt_idx, similarity) at or above the threshold.  Names are compared once per distinct word set, then led
    back to their rows."""
    a, b = _sides(llm, gt, by)
    return (
        _alike(a, b, threshold)
        .join(a.select(F.col("key").alias("a"), *by, "llm_idx"), "a").join(b.select(F.col("key").alias("b"), "gt_idx"), "b")
        .select(*by, "llm_idx", "gt_idx", "similarity")
    )


def greedy_match(llm: DataFrame, gt: DataFrame, by: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """(by, llm_idx, gt_idx, case_name, similarity): extracted rows in order each take the most similar true row not yet
    taken, the first of equal ones.

    That is the one stable matching in which every true row prefers extracted rows by their order, so it is found by
    proposals in rounds.  The true rows of one word set are its seats, by number; whoever takes one takes the first that is
    free, so the seats of a set are taken in the order of the extracted rows.  Extracted rows with one word set share a list: for each
    similarity, from above, the seats of one set, or of several sets by number.  Each row points to the place in its list before
    which nothing is free for it.  In a round each row learns how many seats of the set it points into are gone: the rows before
    it that point there take one each, if they can go to no other set of that similarity, and a seat that one of them points to is
    gone with all before it.  It moves on past those, and past a set's last seat goes on in its list.  When nothing moves, the
    places are the matching.  All steps are joins, counts and windows over chunks; pairs of rows are listed for sets of equal
    similarity only."""
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    if list(by) != list(names.values()):  # so that no name of a column clashes with one of those below
        out = greedy_match(llm.withColumnsRenamed(names), gt.withColumnsRenamed(names), tuple(names.values()), threshold)
        return out.withColumnsRenamed({v: k for k, v in names.items()})
    a, b = (written(x) for x in _sides(llm, gt, by))
    alike = written(_alike(a, b, threshold))
    chunked = max(a.count(), b.count()) > ONE_TASK
    seats = ranked(b.select("key", "gt_idx"), ["key"], "gt_idx", "seat", chunked)
    sizes = b.groupBy(F.col("key").alias("b")).agg(F.count("*").alias("size"))
    levels = alike.join(sizes, "b").groupBy("a", "similarity").agg(F.sum("size").alias("size"), F.count("*").alias("sets"), F.min("b").alias("t"))
    levels = written(levels.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity")))))
    mixed_lists = not levels.filter("sets > 1").isEmpty()
    if mixed_lists:
        several = levels.filter("sets > 1").select("a", "k", "similarity").join(alike, ["a", "similarity"]).join(seats.withColumnRenamed("key", "b"), "b")
        several = written(ranked(several.select("a", "k", F.col("b").alias("t"), "seat", "gt_idx"), ["a", "k"], "gt_idx", "o", chunked).drop("gt_idx"))

    def pointed(state: DataFrame) -> DataFrame:
        """``state`` (by, llm_idx, a, k, o) with the set and seat that each row points to; those at the end of their list go."""
        columns = (*by, "llm_idx", "a", "k", "o", "similarity", "size", "sets", "t", "seat")
        at = state.join(levels, ["a", "k"])
        one = at.filter("sets = 1").withColumn("seat", F.col("o"))
        if not mixed_lists:
            return one.select(*columns)
        more = at.filter("sets > 1").drop("t").join(several, ["a", "k", "o"])
        return one.select(*columns).unionByName(more.select(*columns))

    def onward(rows: DataFrame) -> DataFrame:
        """Places past the end of a level are the first of the next one."""
        end = F.col("o") >= F.col("size")
        return rows.select(*by, "llm_idx", "a", (F.col("k") + end.cast("int")).alias("k"), F.when(end, F.lit(0)).otherwise(F.col("o")).cast("bigint").alias("o"))

    places = (*by, "llm_idx", "a", "k", "o")
    # rows with one list are at rising places of it
    state = ranked(a.select(*by, "llm_idx", F.col("key").alias("a"), F.lit(1).alias("k")), ["a"], "llm_idx", "o", chunked)
    state, first = onward(state.join(levels.select("a", "k", "size"), ["a", "k"])), True
    while True:
        if mixed_lists and not first:
            at = state.join(levels.select("a", "k", "size", "sets"), ["a", "k"])
            shared = earlier_sum(at.filter("sets > 1"), ["a", "k"], "llm_idx", F.lit(1), "n", chunked)
            shared = earlier_max(shared, ["a", "k"], "llm_idx", F.col("o") - F.col("n"), "most", chunked).withColumn("o", F.greatest("o", F.col("most") + F.col("n")))
            state = at.filter("sets = 1").select(*places).unionByName(onward(shared))
        first = False
        alone = F.col("sets") == 1
        rows = earlier_sum(pointed(state), ["t"], "llm_idx", alone.cast("bigint"), "n", chunked)
        rows = earlier_max(rows, ["t"], "llm_idx", F.col("seat") - F.col("n") + (~alone).cast("bigint"), "most", chunked)
        rows = written(rows.withColumn("free", F.greatest(F.col("seat"), "n", F.col("n") + F.col("most"))))
        late = rows.filter("free > seat")
        if late.isEmpty():
            break
        moved = late.filter(alone).withColumn("o", F.col("o") + F.col("free") - F.col("seat")).select(*by, "llm_idx", "a", "k", "o", "size")
        if mixed_lists:
            ahead = late.filter(~alone).select(*by, "llm_idx", "a", "k", F.col("t").alias("own"), "free", "size", F.explode(F.sequence(F.col("o") + 1, F.least(F.col("o") + AHEAD, F.col("size")))).alias("o"))
            other = F.col("t").isNull() | (F.col("t") != F.col("own")) | (F.col("seat") >= F.col("free"))
            tried = ahead.join(several, ["a", "k", "o"], "left").groupBy(*by, "llm_idx", "a", "k", "size").agg(F.coalesce(F.min(F.when(other, F.col("o"))), F.max("o")).alias("o"))
            moved = moved.unionByName(tried)
        state = rows.filter("free = seat").select(*places).unionByName(onward(moved))
    names = llm.select(*by, F.col("row_idx").alias("llm_idx"), F.col("name").alias("case_name"))
    own = seats.select(F.col("key").alias("t"), "seat", "gt_idx")
    return rows.join(own, ["t", "seat"]).join(names, [*by, "llm_idx"]).select(*by, "llm_idx", "gt_idx", "case_name", "similarity")
