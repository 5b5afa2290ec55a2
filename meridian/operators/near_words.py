"""Words within an edit distance of others: slices of a sorted vocabulary, each walked as a trie by all queries' automata.

The state of an automaton after some letters is its query's band of the distance table, 2k + 1 numbers for k edits, so a
letter moves all queries that are still alive in a few array operations, and words that begin alike share the work on
their beginning. A beginning that no query can follow is left at once, with all words behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage, unstage
from .order import numbered

#: Words of a slice at most, and queries of a block, by a hash about so many; a slice and a block meet in one task.
SLICE, BLOCK = 1 << 16, 1 << 13
#: Letters that the table of a task's queries holds at once, padding included.
CELLS = 1 << 22
FAR = 99


def near_words(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, word, edits): the words of vocabulary (word) at most that many edits from each of queries (query, most).

    Edits are optimal string alignments: letters put in, left out or replaced, or two neighbours swapped, in code points.
    Repeats count once, for the largest most of a query; null words, queries and limits match nothing, the empty word is a
    word. Words are dealt by their order and queries by a hash: every block of queries walks every slice of words.
    """
    spark = vocabulary.sparkSession
    words = numbered(vocabulary.select("word").filter("word IS NOT NULL").distinct(), "word")
    wanted = queries.filter("query IS NOT NULL AND most >= 0").groupBy("query").agg(F.max("most").cast("int").alias("most"))
    asked = stage(wanted, "asked")
    rows, blocks = max(1, words.count()), max(1, -(-asked.count() // BLOCK))
    per_slice = min(SLICE, max(1024, -(-rows // spark.sparkContext.defaultParallelism)))
    slices = -(-rows // per_slice)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = words.select(F.floor(F.col("number") / per_slice).cast("int").alias("slice"), every(blocks).alias("block"), "word")
    right = asked.select(every(slices).alias("slice"), F.pmod(F.hash("query"), F.lit(blocks)).alias("block"), "query", "most")
    found = left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInPandas(_meet, "query string, word string, edits int")
    out = stage(found, "near")
    unstage(words, asked)
    return out


def _meet(words: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    names, asked = sorted(words["word"]), asked.sort_values("query", key=lambda q: q.str.len())
    queries, most, found, at = list(asked["query"]), list(asked["most"]), [], 0
    while at < len(queries):
        end = at + 1
        while end < len(queries) and (end + 1 - at) * len(queries[end]) <= CELLS:
            end += 1
        found += [(queries[at + q], names[w], d) for w, q, d in walk(names, queries[at:end], most[at:end])]
        at = end
    return pd.DataFrame(found, columns=["query", "word", "edits"])


def walk(words: list[str], queries: list[str], most: list[int], steps: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
    """(word, query, edits) by position, for words in any order, though only sorted ones share all they can. steps, if
    given, takes the number of queries that each letter moved."""
    k, size, limit = max(most, default=0), np.array([len(q) for q in queries], np.int64), np.array(most, np.int64)
    letters = np.full((len(queries), size.max(initial=0) + 3 * k + 2), -1, np.int32)
    for row, q in zip(letters, queries):
        row[k : k + len(q)] = [ord(c) for c in q]
    offsets = np.arange(2 * k + 1) - k  # of a band's places from the depth
    start = np.where((offsets >= 0) & (offsets <= size[:, None]), offsets, FAR).astype(np.int16)
    # by depth: the queries alive, their bands, and their bands one letter before
    stack, text = [(np.arange(len(queries)), start, start)], ""
    for w, word in enumerate(words):
        same, most_same = 0, min(len(stack) - 1, len(word))
        while same < most_same and text[same] == word[same]:
            same += 1
        del stack[same + 1 :]
        text = word
        for depth in range(same + 1, len(word) + 1):
            alive, band, before = stack[-1]
            if not len(alive):
                break
            if steps is not None:
                steps.append(len(alive))
            c = ord(word[depth - 1])
            here = letters[alive, depth - 1 : depth + 2 * k]
            moved = band + (here != c)
            moved[:, :-1] = np.minimum(moved[:, :-1], band[:, 1:] + 1)
            if depth > 1:
                swap = (here == ord(word[depth - 2])) & (letters[alive, depth - 2 : depth + 2 * k - 1] == c)
                moved = np.where(swap, np.minimum(moved, before + 1), moved)
            for t in range(1, 2 * k + 1):
                moved[:, t] = np.minimum(moved[:, t], moved[:, t - 1] + 1)
            places = depth + offsets
            moved = np.where((places >= 0) & (places <= size[alive][:, None]), np.minimum(moved, FAR), FAR).astype(np.int16)
            stay = moved.min(axis=1) <= limit[alive]
            stack.append((alive[stay], moved[stay], band[stay]))
        alive, band, _ = stack[-1]
        if len(stack) == len(word) + 1 and len(alive):
            place = size[alive] - len(word) + k
            inside = (place >= 0) & (place <= 2 * k)
            edits = np.where(inside, band[np.arange(len(alive)), np.where(inside, place, 0)], FAR)
            for q in np.flatnonzero(edits <= limit[alive]):
                yield w, int(alive[q]), int(edits[q])
