"""Search text: folding, tokens, abbreviations, edit distance and the score of a name."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Results must equal published ones.
EXPANSIONS = {
    "st": ("street", "saint"), "str": ("street",), "strt": ("street",), "ave": ("avenue",), "av": ("avenue",),
    "rd": ("road",), "dr": ("drive",), "blvd": ("boulevard",), "boul": ("boulevard",), "hwy": ("highway",),
    "expy": ("expressway",), "pkwy": ("parkway",), "pky": ("parkway",), "ln": ("lane",), "ct": ("court",),
    "pl": ("place",), "sq": ("square",), "ter": ("terrace",), "terr": ("terrace",), "trl": ("trail",),
    "cir": ("circle",), "ctr": ("center",), "plz": ("plaza",), "hbr": ("harbor",), "mt": ("mount",), "ft": ("fort",),
    "n": ("north",), "s": ("south",), "e": ("east",), "w": ("west",), "ne": ("northeast",), "nw": ("northwest",),
    "se": ("southeast",), "sw": ("southwest",), "intl": ("international",),
}


@F.pandas_udf(T.StringType())
def _decompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", x)))


def fold(text: Column) -> Column:
    """Without accents and case, & as and, other signs as single spaces. Only texts beyond ASCII leave the JVM, which is
    faster than to translate their letters there (measured on long texts)."""
    plain = F.when(F.length(text) == F.octet_length(text), text).otherwise(_decompose(F.when(F.length(text) < F.octet_length(text), text)))
    low = F.regexp_replace(F.lower(plain), "['’ʼ]", "")
    return F.trim(F.regexp_replace(F.replace(low, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def label_key(folded: Column) -> Column:
    """Each token by its first expansion."""
    full = F.create_map(*(F.lit(x) for k, v in EXPANSIONS.items() for x in (k, v[0])))
    return F.array_join(F.transform(tokens(folded), lambda t: F.coalesce(F.element_at(full, t), t)), " ")


def tolerance(n: int) -> int:
    return 0 if n <= 3 else 1 if n <= 5 else 2


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment: an adjacent swap costs one; most + 1 stands for anything beyond most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cell = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cell = min(cell, two[j - 2] + 1)
            row.append(cell)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return min(one[-1], most + 1)


def forms(token: str) -> tuple[str, ...]:
    return (token, *EXPANSIONS.get(token, ()))


@lru_cache(1 << 18)
def match(query: str, name: str) -> tuple[int, int, int] | None:
    """(cost, kind, edits) of the best pair of forms: prefix 0, substring 1, fuzzy 2; None without one."""
    found = []
    for q in forms(query):
        for n in forms(name):
            if n.startswith(q) or len(n) >= 2 and q.startswith(n):
                found.append((abs(len(n) - len(q)), 0, 0))
            elif len(q) >= 2 and q in n:
                found.append((len(n) - len(q), 1, 0))
            elif (most := tolerance(len(q))) and abs(len(n) - len(q)) <= most and (d := edit_distance(q, n, most)) <= most:
                found.append((10 + d, 2, d))
    return min(found, default=None)


def score_name(query: str, name: str) -> float | None:
    """The tiered score of a folded name for a folded query; None if a token that must match does not."""
    if name == query:
        return 1000.0
    if name.startswith(query):
        return 800.0 - (len(name) - len(query))
    wanted, have = query.split(), name.split()
    dropped, hits = 0, []
    for q in wanted:
        best = min(((*m, k) for k, n in enumerate(have) if (m := match(q, n))), key=lambda m: (m[0], m[3]), default=None)
        if best:
            hits.append(best)
        elif q.isdigit() and len(wanted) >= 2:
            dropped += 60
        else:
            return None
    if not hits:
        return None
    at, cost, edits, n = [h[3] for h in hits], sum(h[0] for h in hits), sum(h[2] for h in hits), len(hits)
    span = max(at) - min(at) - (n - 1)
    gaps = 15 * min(at) + 15 * span
    prefix, fuzzy = all(h[1] == 0 for h in hits), any(h[1] == 2 for h in hits)
    if prefix and span == 0 and all(a < b for a, b in zip(at, at[1:])) and (n >= 2 or at[0] == 0):
        base = 700 - 3 * cost - 10 * min(at)
    elif prefix:
        base = 620 - 4 * cost - gaps
    elif not fuzzy:
        base = 500 - 3 * cost - gaps
    else:
        base = 440 - 25 * edits - 3 * cost - gaps
    return float(base - dropped)


@F.pandas_udf(T.DoubleType())
def score_names(query: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([score_name(q, n) for q, n in zip(query, name)], dtype="float64")
