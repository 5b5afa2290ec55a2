"""Ranked, typo-tolerant search over a gazetteer (id, name, rank, lon, lat)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geo import distance_bias, haversine
from ..functions.text import EXPANSIONS, fold, forms, label_key, match, score_names, tokens
from ..storage import stage, unstage
from .areas import in_boxes
from .near_words import near_words


def postings(names: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    return names.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(fold(F.col(name_col))))).alias("token"))


def token_and(posting: DataFrame, wanted: list[str]) -> DataFrame:
    """Ids that have every wanted token."""
    return posting.filter(F.col("token").isin(wanted)).groupBy("id").agg(F.countDistinct("token").alias("hits")).filter(F.col("hits") == len(set(wanted))).select("id")


def _keys(form: Column, asked: bool) -> Column:
    """Keys of a form of a query's token or of a name's, such that forms of which one begins with or holds the other have
    one in common: a first letter, the first three letters anywhere, a whole form that the other starts with."""
    n = F.length(form)
    mark = lambda kind, words: F.transform(words, lambda w: F.concat(F.lit(kind), w))
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring(form, i, F.lit(k)))
    none = F.array().cast("array<string>")
    if asked:
        head = F.when(n == 1, mark("p", F.array(form))).otherwise(mark("s", F.array(F.substring(form, 1, 3))))
        whole = F.when(n > 1, mark("r", F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n)), lambda i: F.substring(form, F.lit(1), i)))).otherwise(none)
    else:
        head = F.concat(mark("p", F.array(F.substring(form, 1, 1))), mark("s", pieces(3)), F.when(n > 1, mark("s", pieces(2))).otherwise(none))
        whole = F.when(n > 1, mark("r", F.array(form))).otherwise(none)
    return F.array_distinct(F.concat(head, whole))


def allowed(n: Column) -> Column:
    """Edits that a word of n letters may be off."""
    return F.when(n <= 3, 0).when(n <= 5, 1).otherwise(2)


def vocabulary_matches(vocabulary: DataFrame, queries: DataFrame) -> DataFrame:
    """(qtok, token) of the distinct query tokens and the vocabulary tokens they match. Forms that begin with or hold one
    another meet by keys and are told in the JVM; forms a few edits apart come from walks over the sorted vocabulary."""
    full = F.create_map(*(x for k, v in EXPANSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    forms = lambda c: F.concat(F.array(c), F.coalesce(F.element_at(full, F.col(c)), F.array().cast("array<string>")))
    asked = queries.select("qtok").distinct().withColumn("query", F.explode(forms("qtok")))
    held = vocabulary.select("token").distinct().withColumn("word", F.explode(forms("token")))
    keyed = lambda df, c, asks: df.withColumn("key", F.explode(_keys(F.col(c), asks)))
    q, w = F.col("query"), F.col("word")
    fits = F.startswith(w, q) | ((F.length(w) >= 2) & F.startswith(q, w)) | ((F.length(q) >= 2) & F.contains(w, q))
    alike = keyed(asked, "query", True).join(keyed(held, "word", False), "key").filter(fits).select("qtok", "token")
    typos = near_words(held, asked.select("query", allowed(F.length("query")).alias("most")).filter("most > 0"))
    return alike.union(typos.join(asked, "query").join(held, "word").select("qtok", "token")).distinct()


def house_boost(query: str, house: str | None, street: str | None, name: str) -> float | None:
    """The score of a folded query that has a folded house number; its other words must fit the street (the name if there
    is none). None without the number, or for the right number of another street."""
    words = query.split()
    if house is None or house not in words:
        return None
    at = words.index(house)
    rest, target = words[:at] + words[at + 1 :], (street or name).split()
    if not rest:
        return 900.0
    best = [min((m for n in target if (m := match(q, n))), default=None) for q in rest]
    return None if any(m is None or m[1] > 1 for m in best) else 930.0 - 2 * sum(m[0] for m in best)


@F.pandas_udf(T.DoubleType())
def house_boosts(query: pd.Series, house: pd.Series, street: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([house_boost(*row) for row in zip(query, house, street, name)], dtype="float64")


def name_forms(gazetteer: DataFrame, by: list[str]) -> DataFrame:
    """(id, ..., name, folded, own): a row for each name of an entry; own marks the first name, the others are alternates."""
    every = F.array(F.struct(F.col("name").alias("text"), F.lit(True).alias("own")))
    if "alt" in gazetteer.columns:
        every = F.concat(every, F.transform(F.coalesce("alt", F.array().cast("array<string>")), lambda t: F.struct(t.alias("text"), F.lit(False).alias("own"))))
    return gazetteer.withColumn("form", F.explode(every)).select("id", *by, "name", fold(F.col("form.text")).alias("folded"), F.col("form.own").alias("own")).filter("folded IS NOT NULL")


def search(gazetteer: DataFrame, queries: DataFrame, limit: int = 12, by: list[str] | None = None, near: tuple[float, float] | None = None) -> DataFrame:
    """queries (q) over gazetteer: (q, id, name, score, place), the best limit of each q (and of each value of by).

    gazetteer has id, name, rank, lon and lat, and may have alt (alternate names), importance (which then counts as 100
    times it instead of the rank), house and street. The best of an entry's names counts, or the boost of its house number
    if that is more. Tokens without digits must all match; if a query has only numbers, any may. Scores add the rank and
    subtract the distance bias, which a null place does not have; ties go by name, then id.
    """
    by = by or []
    asked = queries.select("q", fold(F.col("q")).alias("norm")).filter("norm <> ''").distinct()
    parts = asked.select("q", F.explode(F.array_distinct(tokens(F.col("norm")))).alias("qtok")).withColumn("number", F.col("qtok").rlike("^[0-9]+$"))
    forms = name_forms(gazetteer, by)
    posting = forms.select("id", *by, F.explode(tokens(F.col("folded"))).alias("token")).distinct()
    sizes = stage(posting.groupBy("token").agg(F.count("*").alias("rows")), "vocabulary")
    found = stage(vocabulary_matches(sizes, parts).join(sizes, "token"), "matches")
    unstage(sizes)
    # a query's rarest word without digits brings its candidates, as all must match; a query of numbers takes them all
    weights = parts.join(found.groupBy("qtok").agg(F.sum("rows").alias("weight")), "qtok", "left")
    of = Window.partitionBy("q")
    weights = weights.withColumns({"words": F.count_if(~F.col("number")).over(of), "lost": F.count_if(~F.col("number") & F.col("weight").isNull()).over(of)})
    rank = F.row_number().over(of.orderBy("number", "weight", "qtok"))
    wanted = weights.withColumn("at", rank).filter((F.col("lost") == 0) & ((F.col("words") == 0) | (F.col("at") == 1))).select("q", "qtok")
    total = found.select("token", "rows").distinct().agg(F.sum("rows")).first()[0] or 0
    candidates = _dealt(wanted.join(found, "qtok"), posting, max(1000, total // 1000)).select("q", "id", *by).distinct()
    pairs = candidates.join(asked, "q").join(forms, ["id", *by])
    raw = pairs.withColumn("raw", score_names("norm", "folded")).filter("raw IS NOT NULL AND NOT isnan(raw)").groupBy("q", "norm", "id", *by).agg(F.max("raw").alias("raw"))
    if "house" in gazetteer.columns:
        street = fold(F.col("street")) if "street" in gazetteer.columns else F.lit(None).cast("string")
        houses = gazetteer.filter("house IS NOT NULL").select("id", *by, fold(F.col("house").cast("string")).alias("house"), street.alias("street"), fold(F.col("name")).alias("folded"))
        boosted = candidates.join(asked, "q").join(houses, ["id", *by]).withColumn("raw", house_boosts("norm", "house", "street", "folded")).filter("raw IS NOT NULL AND NOT isnan(raw)")
        # what the boost lets in must still have every word without digits among its names
        words = parts.filter("NOT number").join(found, "qtok").join(posting.join(boosted.select("id", *by).distinct(), ["id", *by]), "token").groupBy("q", "id", *by).agg(F.countDistinct("qtok").alias("hit"))
        needed = parts.groupBy("q").agg(F.count_if(~F.col("number")).alias("need"))
        boosted = boosted.join(needed, "q").join(words, ["q", "id", *by], "left").filter(F.coalesce("hit", F.lit(0)) == F.col("need"))
        raw = raw.unionByName(boosted.select("q", "norm", "id", *by, "raw")).groupBy("q", "norm", "id", *by).agg(F.max("raw").alias("raw"))
    weight = F.col("rank")
    if "importance" in gazetteer.columns:
        weight = F.when(F.col("importance").isNull(), F.col("rank")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "importance")) * 100)
    places = gazetteer.select("id", *by, "name", weight.alias("weight"), "lon", "lat")
    bias = F.coalesce(distance_bias(haversine(F.lit(near[0]), F.lit(near[1]), F.col("lon"), F.col("lat"))), F.lit(0.0)) if near else F.lit(0.0)
    scored = raw.join(places, ["id", *by]).withColumn("score", F.round(F.col("raw") + F.col("weight") - bias, 4))
    order = Window.partitionBy("q", *by).orderBy(F.desc("score"), "name", "id")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("q", *by, "id", "name", "score", "place")


def _dealt(wanted: DataFrame, posting: DataFrame, most: int) -> DataFrame:
    """wanted (token, rows, ...) joined with posting on token; a token of more than most rows is dealt by id into parts."""
    parts = F.ceil(F.col("rows") / most).cast("int")
    hot = F.broadcast(wanted.filter(F.col("rows") > most).select("token", parts.alias("parts")).distinct())  # few: each holds a share of all rows
    dealt = posting.join(hot, "token", "left").withColumn("part", F.pmod(F.hash("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    return wanted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("rows").join(dealt, ["token", "part"])


def merge_hits(hits: DataFrame, metres: float = 120.0) -> DataFrame:
    """hits (q, source, identity, label, score, lon, lat) in score order, without repeats and shadows.

    A hit goes when a kept one of another source lies within metres and one label is the other or a word-prefix of it,
    or when its label and identity were kept before. What is kept depends on earlier choices, so a query's hits (a few
    tens, as top-k gives them) are walked in order in one group.
    """
    from math import asin, cos, radians, sin, sqrt

    def gap(a, b):
        p, q = radians(a.lat), radians(b.lat)
        h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b.lon - a.lon) / 2) ** 2
        return 2 * 6371008.8 * asin(min(1.0, sqrt(h)))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        kept, seen = [], set()
        for hit in group.sort_values(["score", "source", "identity"], ascending=[False, True, True], kind="stable").itertuples():
            same = lambda o: o.key == hit.key or o.key.startswith(hit.key + " ") or hit.key.startswith(o.key + " ")  # noqa: B023, E731
            if any(o.source != hit.source and same(o) and gap(o, hit) <= metres for o in kept) or (hit.key, hit.identity) in seen:
                continue
            seen.add((hit.key, hit.identity))
            kept.append(hit)
        return group.loc[[k.Index for k in kept]]

    keyed = hits.withColumn("key", label_key(fold(F.col("label"))))
    return keyed.groupBy("q").applyInPandas(walk, keyed.schema).drop("key")


def suggest(names: DataFrame, queries: DataFrame, near: tuple[float, float] | None = None) -> DataFrame:
    """(q, name, edits) for each q: the nearest name by edit distance, then by rank, by distance from near, and by name;
    null without one near enough, or if q has fewer than three letters. names has name and rank, and lon and lat for near.

    Equal folded names count by their best row. Those near a query come from walks over the sorted names (near_words).
    """
    asked = queries.select("q", fold(F.col("q")).alias("query")).distinct()
    metres = haversine(F.lit(near[0]), F.lit(near[1]), F.col("lon"), F.col("lat")) if near else F.lit(0.0)
    best = F.min(F.struct((-F.col("rank")).alias("r"), metres.alias("metres"), "name")).alias("best")
    held = names.select("*", fold(F.col("name")).alias("word")).filter("word IS NOT NULL").groupBy("word").agg(best)
    n = F.length("query")
    found = near_words(held, asked.filter(n >= 3).select("query", (allowed(n) + (n >= 8).cast("int")).alias("most")))
    pairs = found.join(held, "word").groupBy("query").agg(F.min(F.struct("edits", "best")).alias("m"))
    return asked.join(pairs, "query", "left").select("q", F.col("m.best.name").alias("name"), F.col("m.edits").alias("edits"))


def highlights(rows: DataFrame, label: str = "label", query: str = "q") -> DataFrame:
    """rows with ranges, array<struct<start, end>>: where a label shows what a query asks for, in code points.

    For each token of two letters or more the longest form that starts a word of the label: its expansions, then the token,
    then ever shorter beginnings of it; overlapping and touching ranges are one.
    """
    return rows.withColumn("_folded", fold(F.col(query))).withColumn("ranges", _ranges(F.col(label), F.col("_folded"))).drop("_folded")


def highlight_ranges(label: str, folded: str) -> list[tuple[int, int]]:
    low, found = label.lower(), []
    for t in (t for t in folded.split() if len(t) >= 2):
        for needle in (*forms(t)[1:], *(t[:n] for n in range(len(t), 1, -1))):
            at = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", low) if m.start() == 0 or not low[m.start() - 1].isalnum()]
            if at:
                found += [(a, a + len(needle)) for a in at]
                break
    merged = []
    for a, b in sorted(found, key=lambda r: r[0]):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], b)
        else:
            merged.append((a, b))
    return merged


@F.pandas_udf(T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())))
def _ranges(label: pd.Series, folded: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or q is None else [{"start": a, "end": b} for a, b in highlight_ranges(x, q)] for x, q in zip(label, folded)])


def category_nearest(places: DataFrame, category: str, lon: float, lat: float, limit: int = 20) -> DataFrame:
    metres = haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))
    return places.filter(F.col("cat") == category).withColumn("metres", F.round(metres, 3)).orderBy("metres", "id").limit(limit)


def covering(points: DataFrame, boxes: DataFrame, cell: float = 0.5, by: Column | None = None) -> DataFrame:
    """(point, box): the smallest box around each point, or that with the least by, ties to the smaller box id."""
    least = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south")) if by is None else by
    hits = in_boxes(points.select("point", "lon", "lat"), boxes, cell)
    return hits.groupBy("point").agg(F.min(F.struct(least.alias("least"), "box")).alias("m")).select("point", "m.box")


def online_score(text_score: Column, importance: Column, metres: Column) -> Column:
    """Score of a hit from elsewhere; a name that does not match still counts."""
    return F.coalesce(text_score, F.lit(480.0)) + F.least(F.lit(120.0), F.coalesce(importance, F.lit(0.25)) * 120) - distance_bias(metres)


def saved_score(text_score: Column, metres: Column) -> Column:
    """Score of a saved place, null where its label does not match."""
    return text_score + 250 - distance_bias(metres)


def capped(gazetteer: DataFrame, most: int, seq: str = "id") -> DataFrame:
    """The most entries of the highest rank; entries of one rank by seq. A top-k: each task keeps its own first."""
    return gazetteer.orderBy(F.desc("rank"), F.asc(seq)).limit(most)
