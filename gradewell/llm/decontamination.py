"""Benchmark passages in training text, found with a positional inverted index; DataFrame functions only.

Every window of benchmark words (13 words, or a shorter item as a whole) is looked up by its rarest words in the corpus.
The index holds the places of just these words in the documents, with the words around each place. Places are adjusted
by the word's offset in the item and intersected: only where the rarest and the next rarest word of a window stand at
the same shift can the window occur. There the words around decide: a run of equal words at least as long as a window
is an exact match.

A proximity match is a window of which at least ``NEAR_WORDS`` words in ``WINDOW_WORDS`` stand in the document with shifts
(place less offset) that differ by ``SLOP`` at most: the window with words inserted, left out, replaced or moved. Every word of
the window is evidence. If at most m of its words may be missing, one of its m + 1 rarest is there, so these are the lists that
are looked up, and none is lost whatever is edited. The words around each place are then counted against the whole window.
An item counts as near in a document where none of its windows occurs exactly.

Null texts have no words. A null item id counts as the empty id. Rows that repeat id and text get equal results. Very long
texts are indexed whole. Among equally rare words the one that sorts first, then the earlier place, is the anchor; which of
them it is changes no result. An empty table of documents gives none, and without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewell.llm.common import hand_over
from gradewell.llm.postings import agreement, postings, postings_in_context, raw_words, sides, small, spaced_words, term_counts, words

WINDOW_WORDS, SLOP = 13, 5
# Words of a full window that a proximity match needs; shorter windows need the same share, rounded up.
NEAR_WORDS = 10
# A document is contaminated if at least one word in so many is hit.
HIT_SHARE = 20


def _windows(
    items: DataFrame, docs: DataFrame, item_col: str, text_col: str, doc_text: str, window: int, listed: Callable[[Column], Column] = raw_words,
) -> DataFrame:
    """(item, words, window_length, start, rank): every window with (n, term, pos) of its words, null for one no document has."""
    spelled = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")
    ).where(F.size("words") > 0).distinct()
    spelled = spelled.select("item", F.xxhash64("words").alias("spelling"), "words")
    placed = spelled.select("item", "spelling", F.posexplode("words").alias("pos", "w")).select(
        "item", "spelling", "pos", F.lower("w").alias("term")
    )
    counts = term_counts(docs, F.col(doc_text), placed.select("term"), listed)
    counted = placed.join(counts, "term")  # a window with a word that no document has cannot occur as a whole
    ranked = counted.groupBy("item", "spelling").agg(
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct("n", "term", "pos")))).alias("rank")
    )
    size = F.size("words")
    last = F.greatest(size - window, F.lit(0))
    lists = spelled.join(ranked, ["item", "spelling"]).select(
        "item", "words", F.least(size, F.lit(window)).cast("long").alias("window_length"),
        F.explode(F.sequence(F.lit(0), last)).alias("start"),
        F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.col("rank")[i]).alias("rank"),
    )
    return lists.withColumn("rank", F.slice("rank", F.col("start") + 1, F.col("window_length").cast("int")))


def _anchors(windows: DataFrame, window: int) -> DataFrame:
    """(item, window_length, term, item_pos, item_before, item_after): the two rarest words of every window."""
    whole_windows = ~F.exists("rank", lambda x: x.isNull())
    lists = windows.where(whole_windows).withColumn("a", F.slice(F.array_sort("rank"), 1, 2))
    chosen = lists.select("item", "words", "window_length", F.explode("a").alias("a")).distinct()
    return chosen.select("item", "window_length", *_around(window))


def _around(window: int) -> list[Column]:
    at = F.col("a.pos")
    begin = F.greatest(at - window + 1, F.lit(0))
    return [
        F.col("a.term").alias("term"), at.cast("long").alias("item_pos"),
        F.reverse(F.slice("words", begin + 1, at - begin)).alias("item_before"),
        F.slice("words", at + 1, F.lit(window)).alias("item_after"),
    ]


def _near_anchors(windows: DataFrame, window: int) -> DataFrame:
    """(item, window_length, need, term, spots): the places of each anchor word in an item, with the words around.

    Anchors of a window are as many of its rarest words as may be missing and one more. Words that no document has are among
    the rarest and need no lookup. Where all words are known, the two rarest are anchors, as for an exact match. ``need`` counts
    words of a window; ``least`` of a spot the different ones around it.
    """
    size = F.col("window_length").cast("int")
    need = F.ceil(F.col("window_length") * NEAR_WORDS / WINDOW_WORDS).cast("int")
    known = F.array_sort(F.filter("rank", lambda x: x.isNotNull()))
    take = F.greatest(size - need + 1 - (size - F.size(known)), F.when(F.size(known) == size, 2).otherwise(0))
    different = F.size(F.array_distinct(F.slice("words", F.col("start") + 1, size)))
    chosen = windows.select(
        "item", "words", "window_length", need.alias("need"), F.greatest(different - size + need, F.lit(1)).alias("least"),
        F.explode(F.slice(known, F.lit(1), take)).alias("a"),
    ).groupBy("item", "words", "window_length", "need", "a").agg(F.min("least").alias("least"))
    placed = chosen.select("item", "words", "window_length", "need", "least", *_around(window))
    spot = F.struct("least", F.concat(F.reverse("item_before"), "item_after").alias("around"), F.size("item_before").alias("at"))
    return placed.groupBy("item", F.xxhash64("words").alias("spelling"), "window_length", "need", "term").agg(F.collect_list(spot).alias("spots"))


def _near(slop: int = SLOP) -> Column:
    """Whether at some spot a window around the anchor has ``need`` words within the slop; spots are tried until one has."""
    doc, at, size = F.col("context"), F.col("at"), F.col("window_length").cast("int")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def at_spot(spot: Column) -> Column:
        item, item_at = spot["around"], spot["at"]
        within = F.call_function("shiftleft", one, size) - 1

        def window_has(bits: Column) -> Column:
            return F.exists(F.sequence(F.lit(0), F.size(item) - size), lambda s: F.bit_count(
                F.call_function("shiftright", bits, s).bitwiseAND(within)) >= F.col("need"))

        # Item words that stand anywhere around; where no window has enough of them, none has within the slop.
        anywhere = F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), zero, lambda bits, j: bits.bitwiseOR(
            F.when(F.array_contains(doc, F.get(item, j)), F.call_function("shiftleft", one, j)).otherwise(zero)))
        # Item words are bits. For each offset against the anchor's shift: the words that the document has there.
        equal = F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.aggregate(
            F.sequence(F.lit(0), F.size(item) - 1), zero, lambda bits, j: bits.bitwiseOR(F.when(
                (at + j - item_at + d >= 0) & (F.get(doc, at + j - item_at + d) == F.get(item, j)), F.call_function("shiftleft", one, j)).otherwise(zero))))
        bands = F.transform(F.sequence(F.lit(1), F.lit(slop + 1)), lambda low: F.aggregate(
            F.slice(equal, low, F.lit(slop + 1)), zero, lambda bits, x: bits.bitwiseOR(x)))
        some = F.exists(bands, window_has)
        return F.when(_likely(spot), F.when(window_has(anywhere), some).otherwise(False)).otherwise(False)

    return F.exists("spots", at_spot)


def _likely(spot: Column) -> Column:
    """Whether enough different words of the item stand around the place; every near window has them."""
    return (F.size(spot["around"]) >= F.col("window_length")) & (F.size(F.array_intersect(F.col("context"), spot["around"])) >= spot["least"])


# One in so many likely places is tried first; the others only for documents and items that these leave open.
_PROBE = 16
# What tells the spots of an anchor word in one spelling of an item from others.
_SPOTS_OF = ["item", "spelling", "term"]


def spaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k0, k1, n_words, words): document id, hash of its text, and the text's words, lower-cased and joined by spaces.

    Written once, because splitting at spaces takes a fraction of the time of finding words, and is done by several passes.
    """
    found = words(F.col(text_col))
    return hand_over(docs.select(
        F.col(id_col).cast("long").alias("k0"), F.xxhash64(F.col(text_col)).alias("k1"), F.size(found).cast("long").alias("n_words"),
        F.concat_ws(" ", found).alias("words"),
    ), "words")


def _likely_places(spelled: DataFrame, near: DataFrame, around: int) -> tuple[DataFrame, DataFrame]:
    """The places of the index at which a window can stand, exactly or near, with item and context; and the lookup by item and term.

    The words around a place are judged where they are found. Only the few likely places are written, not the whole index.
    """
    lookup, _ = small(near, "near-lookup")
    index = postings_in_context(spelled, [F.col("k0"), F.col("k1")], F.col("words"), near.select("term"), around, spaced_words)
    likely = index.join(lookup, "term").where(F.exists("spots", _likely))
    return hand_over(likely.select("k0", "k1", "n_words", *_SPOTS_OF, "pos", "context", "at"), "likely"), lookup


def _near_pairs(likely: DataFrame, lookup: DataFrame) -> DataFrame:
    """(k0, k1, item) of documents with a near window of an item. A document full of them is settled by a few of its places."""
    probe = F.pmod(F.xxhash64("pos"), F.lit(_PROBE)) == 0
    first = hand_over(likely.where(probe).join(lookup, _SPOTS_OF).where(_near()).select("k0", "k1", "item").distinct(), "near-first")
    settled, _ = small(first.toDF("s0", "s1", "s2"), "near-settled")
    same = F.col("k0").eqNullSafe(F.col("s0")) & (F.col("k1") == F.col("s1")) & (F.col("item") == F.col("s2"))
    rest = likely.where(~probe).join(settled, same, "left_anti").join(lookup, _SPOTS_OF).where(_near()).select("k0", "k1", "item")
    return first.unionByName(rest).distinct()


def _exact_places(index: DataFrame, anchors: DataFrame, window: int, on: tuple[str, ...] = ("term",)) -> DataFrame:
    """Places of the index joined with the benchmark places of ``anchors`` they could belong to.

    Columns: k0 (document id), k1 (hash of its text), n_words, item, shift, pos, item_pos, window_length, and begin and
    end of the run of equal words around the place.
    """
    lookup, _ = small(anchors, "anchor-lookup")
    back = agreement(F.slice("before", 1, window - 1), F.col("item_before"))
    ahead = agreement(F.slice("after", 1, window), F.col("item_after"))
    return index.join(lookup, list(on)).select(
        "k0", "k1", "n_words", "item", (F.col("pos") - F.col("item_pos")).alias("shift"), "pos", "item_pos",
        "window_length", (F.col("pos") - back).alias("begin"), (F.col("pos") + ahead).alias("end"),
    )


def phrase_places(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW_WORDS,
) -> DataFrame:
    """The places at which windows can occur exactly: see :func:`_exact_places`."""
    anchors = hand_over(_anchors(_windows(items, docs, item_col, item_text, text_col, window), window), "anchors")
    keys = [F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))]
    index = hand_over(postings(docs, keys, F.col(text_col), anchors.select("term"), window - 1), "postings")
    return _exact_places(index, anchors, window)


def exact_matches(places: DataFrame) -> DataFrame:
    """(k0, k1, n_words, item, begin, end): word ranges of documents in which every word is in an occurring window.

    The lists of places are intersected by (document, item, shift) first; a window of one word needs no second list.
    """
    run = F.struct("begin", "end")
    meeting = places.groupBy("k0", "k1", "n_words", "item", "shift").agg(
        F.size(F.collect_set("item_pos")).alias("lists"), F.min("window_length").alias("least"),
        F.collect_set(F.when(F.col("end") - F.col("begin") >= F.col("window_length"), run)).alias("runs"),
    )
    return meeting.where((F.col("lists") >= 2) | (F.col("least") == 1)).select(
        "k0", "k1", "n_words", "item", F.inline("runs")
    )


def exact_and_near(
    spelled: DataFrame, items: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Of :func:`spaced` documents: the places of :func:`phrase_places`, and (k0, k1, item) with a proximity match of an item.

    Both come from one index. Where a window occurs exactly, all its words stand around its anchors, so these are likely places.
    """
    windows = hand_over(_windows(items, spelled, item_col, item_text, "words", window, spaced_words), "windows")
    anchors, near = hand_over(_anchors(windows, window), "anchors"), hand_over(_near_anchors(windows, window), "near-anchors")
    likely, lookup = _likely_places(spelled, near, window - 1 + SLOP)
    return _exact_places(sides(likely), anchors, window, ("item", "term")), _near_pairs(likely, lookup)


def _hits(matches: DataFrame) -> DataFrame:
    """Per document with matches: n_hit (words in the union of its ranges), n_items, items_sha256, contaminated."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.array_sort("ranges"), zero,
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["end"]).alias("end"),
            (acc["n"] + F.greatest(x["end"] - F.greatest(acc["end"], x["begin"]), F.lit(0))).alias("n"),
        ),
    )["n"]
    grouped = matches.groupBy("k0", "k1", F.col("n_words").alias("words_of_hit")).agg(
        F.collect_set(F.struct("begin", "end")).alias("ranges"), F.array_sort(F.collect_set("item")).alias("items")
    )
    return grouped.select(
        "k0", "k1", "words_of_hit", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (HIT_SHARE * F.col("n_hit") >= F.col("words_of_hit")))


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", proximity: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    With ``proximity`` also n_near_items, the number of items with a proximity match.
    """
    spelled = spaced(docs, id_col, text_col)
    if proximity:
        places, near = exact_and_near(spelled, items, item_col, item_text)
    else:
        places, near = phrase_places(docs, items, id_col, text_col, item_col, item_text), None
    matches = hand_over(exact_matches(hand_over(places.where("end - begin >= window_length"), "places")), "matches")
    hits = _hits(matches)
    if near is not None:
        met = matches.select("k0", "k1", "item", F.lit(True).alias("exact")).unionByName(hand_over(near, "near").withColumn("exact", F.lit(False)))
        met = met.groupBy("k0", "k1", "item").agg(F.max("exact").alias("exact")).where("NOT exact")
        near = met.groupBy("k0", "k1").agg(F.count("*").alias("n_near_items"))
        same = F.col("k0").eqNullSafe(F.col("n0")) & (F.col("k1") == F.col("n1"))
        hits = hits.join(near.withColumnsRenamed({"k0": "n0", "k1": "n1"}), same, "full").select(
            F.coalesce("k0", "n0").alias("k0"), F.coalesce("k1", "n1").alias("k1"), "n_hit", "n_items", "items_sha256",
            "contaminated", "n_near_items",
        )
    every = spelled.select(F.col("k0").alias("doc_id"), F.col("k1").alias("h"), "n_words")
    none, zero = F.sha2(F.lit(""), 256), F.lit(0).cast("long")
    return every.join(hits, every["doc_id"].eqNullSafe(F.col("k0")) & (every["h"] == F.col("k1")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
        *([F.coalesce("n_near_items", zero).alias("n_near_items")] if proximity else []),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    places = hand_over(phrase_places(docs, items, id_col, text_col), "places")
    bad = hand_over(_hits(exact_matches(places)).where("contaminated").select("k0", "k1"), "contaminated")
    bad, _ = small(bad, "contaminated")
    same = F.col(id_col).cast("long").eqNullSafe(bad["k0"]) & (F.xxhash64(F.col(text_col)) == bad["k1"])
    return docs.join(bad, same, "left_anti")
